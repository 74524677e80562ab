"""Masks from annotations: polygons in files, their spans, and tiles under them."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasspane.operators import grid, polygons
from glasspane.plans.frames import table
from glasspane.plans.registry import query
from glasspane.sources import tables
from glasspane.sources.scratch import shared_dir

#: Slides that the polygons of parts lie on, and the size of their masks.
SLIDES, WIDTH, HEIGHT = 97, 28, 20
_GROUP = "CASE p_partkey % 3 WHEN 0 THEN 'Carcinoma' WHEN 1 THEN 'Exclude' ELSE 'Another pathology' END"


def _polygons(spark, sf_dir):
    """Annotation files, one a slide, with a polygon of 3 to 7 points for each part; most are concave or
    cross themselves, and some reach beyond the mask. Read back as polygons."""
    part, where = table(spark, sf_dir, "part"), shared_dir(spark)
    key = F.col("p_partkey")

    def point(i):
        x = (i * 7 * (1 + key % 3) + key) % 29 + (key % 4) * 0.25
        y = (i * i * 5 + key * 3) % 23 + (key % 2) * 0.5
        return F.format_string('<Coordinate Order="%d" X="%s" Y="%s"/>', i, x.cast("string"), y.cast("string"))

    points = F.concat_ws("", F.transform(F.sequence(F.lit(0).cast("long"), (2 + key % 5).cast("long")), point))
    line = F.format_string('<Annotation Name="%d" PartOfGroup="%s"><Coordinates>%s</Coordinates></Annotation>', key, F.expr(_GROUP), points)
    whole = F.concat(F.lit("<Annotations>\n"), F.concat_ws("\n", F.collect_list("line")), F.lit("\n</Annotations>"))
    part.select((key % SLIDES).alias("slide"), line.alias("line")).groupBy("slide").agg(whole.alias("value")).write.partitionBy("slide").text(where)
    slide = F.regexp_extract("path", r"slide=(\d+)/", 1).cast("long")
    return polygons.as_polygons(tables.read_annotations(spark, where), slide)


_PIXELS_SQL = f"""v AS (SELECT p_partkey AS p, p_partkey % {SLIDES} AS slide_id, {_GROUP} AS part_of_group, i, 3 + p_partkey % 5 AS n,
 CAST((i * 7 * (1 + p_partkey % 3) + p_partkey) % 29 + (p_partkey % 4) * 0.25 AS DOUBLE) AS x, CAST((i * i * 5 + p_partkey * 3) % 23 + (p_partkey % 2) * 0.5 AS DOUBLE) AS y
 FROM part, range(0, 7) r(i) WHERE i < 3 + p_partkey % 5),
e AS (SELECT a.p, a.slide_id, a.part_of_group, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v a JOIN v b ON a.p = b.p AND b.i = (a.i + 1) % a.n WHERE a.y <> b.y),
c AS (SELECT p, slide_id, part_of_group, my, x0 + (my + CAST(0.5 AS DOUBLE) - y0) * ((x1 - x0) / (y1 - y0)) AS cut FROM e, range(0, {HEIGHT}) r(my) WHERE my + 0.5 >= least(y0, y1) AND my + 0.5 < greatest(y0, y1)),
px AS (SELECT DISTINCT slide_id, part_of_group, mx, my FROM (SELECT p, slide_id, part_of_group, mx, my FROM c, range(0, {WIDTH}) r(mx) WHERE cut <= mx + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1))"""


@query(f"WITH {_PIXELS_SQL} SELECT slide_id, part_of_group, CAST(count(*) AS BIGINT) AS area, CAST(sum(my * {WIDTH} + mx) AS BIGINT) AS places FROM px GROUP BY 1, 2")
def annotation_masks(spark, sf_dir):
    """Pixels of each mask, and the sum of their places, which tells masks of one size apart."""
    spans = polygons.polygon_masks(_polygons(spark, sf_dir), WIDTH, HEIGHT)
    length = F.col("stop") - F.col("start")
    places = F.col("my") * WIDTH * length + (F.col("start") + F.col("stop") - 1) * length / 2
    return spans.groupBy("slide_id", "part_of_group").agg(F.sum(length).alias("area"), F.sum(places.cast("long")).alias("places"))


@query(f"""WITH {_PIXELS_SQL}, t AS (SELECT DISTINCT p_partkey % {SLIDES} AS slide_id, x, y FROM part, range(0, {WIDTH - 7}, 4) a(x), range(0, {HEIGHT - 7}, 4) b(y))
SELECT t.slide_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, part_of_group, round(count(*) / CAST(64 AS DOUBLE), 9) AS fraction
FROM t JOIN px ON t.slide_id = px.slide_id AND mx >= x AND mx < x + 8 AND my >= y AND my < y + 8 GROUP BY ALL""")
def annotated_tiles(spark, sf_dir):
    """Overlapping tiles of every slide and the share of each under each group's mask."""
    slides = table(spark, sf_dir, "part").select((F.col("p_partkey") % SLIDES).alias("id")).distinct()
    sizes = {"extent_x": WIDTH, "extent_y": HEIGHT, "tile_extent_x": 8, "tile_extent_y": 8, "stride_x": 4, "stride_y": 4}
    tiles = grid.grid_tiles(slides.select("id", *(F.lit(v).alias(c) for c, v in sizes.items())))
    found = polygons.span_overlap(tiles, polygons.polygon_masks(_polygons(spark, sf_dir), WIDTH, HEIGHT), 8)
    return found.select("slide_id", "x", "y", "part_of_group", F.round("fraction", 9).alias("fraction"))
