"""Tiles: filters, labels, joins with slides and embeddings, masks and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasspane.functions import overlap, vectors
from glasspane.operators import curves, filters, grid, joins, labels, tiling
from glasspane.plans.frames import FILTER_SQL, SCORED_SQL, THRESHOLDS, TILES_SQL, digits, scored_tiles, table, tiles
from glasspane.plans.registry import query
from glasspane.sources.scratch import shared_dir

ORDERS_LABEL = "o_orderstatus = 'F'"


def _slides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("carcinoma"), "o_orderpriority")


@query(f"""
WITH t AS (SELECT * FROM ({TILES_SQL}) WHERE {FILTER_SQL}),
m AS (SELECT slide_id, max(carcinoma_roi_percentage) AS prediction FROM t GROUP BY 1),
j AS (SELECT prediction >= CAST(0.5 AS DOUBLE) AS p, o_orderstatus = 'F' AS t FROM m JOIN orders ON slide_id = o_orderkey),
c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM j)
SELECT tp, fp, fn, tn, round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0.0), 6) AS accuracy, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6) AS "precision",
 round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0), 6) AS specificity, round(coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0.0), 6) AS npv FROM c
""")
def tiles_to_confusion_metrics(spark, sf_dir):
    kept = filters.filter_tiles(tiles(spark, sf_dir), THRESHOLDS)
    scores = grid.slide_max(kept.withColumnRenamed("carcinoma_roi_percentage", "score"))
    slides = joins.with_slide_columns(scores, _slides(spark, sf_dir), ["carcinoma"]).where("carcinoma is not null")
    found = slides.withColumn("p", labels.binary_prediction("prediction", 0.5))
    return digits(curves.confusion_metrics(found, "p", "carcinoma"), "accuracy", "precision", "recall", "specificity", "npv")


@query(f"SELECT * FROM ({TILES_SQL}) WHERE {FILTER_SQL}")
def tile_threshold_filter(spark, sf_dir):
    return filters.filter_tiles(tiles(spark, sf_dir), THRESHOLDS)


@query(f"SELECT count(*) AS n, count(*) FILTER (tissue_roi_percentage > 0) AS with_tissue FROM ({TILES_SQL})")
def empty_tissue(spark, sf_dir):
    all_tiles = tiles(spark, sf_dir)
    kept = filters.drop_empty_tissue(all_tiles).agg(F.count("*").alias("with_tissue"))
    return all_tiles.agg(F.count("*").alias("n")).crossJoin(kept)


@query(f"SELECT slide_id, x, y, carcinoma_roi_percentage > CAST(0.5 AS DOUBLE) AS carcinoma FROM ({TILES_SQL})")
def tile_labels(spark, sf_dir):
    return tiles(spark, sf_dir).select("slide_id", "x", "y", labels.tile_label("carcinoma_roi_percentage", 0.5).alias("carcinoma"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'R' AS tile_label, o_orderstatus = 'F' AS slide_label
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_orderstatus = 'F' AND l_returnflag <> 'R')""")
def stratified_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide_id"), "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("tile_label"))
    marked = joins.with_slide_label(lines, _slides(spark, sf_dir))
    return filters.stratified_filter(marked, "slide_label", "tile_label").withColumnRenamed("slide_id", "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def slide_attr_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.with_slide_columns(lines, _slides(spark, sf_dir), ["o_orderpriority"], "l_orderkey")


@query("SELECT doc_id, source, CAST(quality AS DOUBLE) AS carcinoma FROM documents LEFT JOIN labels USING (doc_id)")
def relabel_left(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0.0).alias("carcinoma"))
    return joins.relabel(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("carcinoma")), "doc_id")


@query("SELECT 'a/' || doc_id || '.tiff' AS path, CAST(quality AS INT) AS carcinoma FROM documents JOIN labels USING (doc_id)")
def relabel_inner(spark, sf_dir):
    name = lambda top, end: F.concat(F.lit(top), F.col("doc_id").cast("string"), F.lit(end))
    docs = table(spark, sf_dir, "documents").select(name("a/", ".tiff").alias("path"), F.lit(0).alias("carcinoma"))
    source = table(spark, sf_dir, "labels").select(name("b/c/", ".mrxs").alias("slide_path"), F.col("quality").alias("carcinoma"))
    return joins.relabel_by_stem(docs, source)


@query("""SELECT 'm/' || doc_id || '.tiff' AS path, CASE WHEN toxic = 1 THEN 'masks/' || doc_id || '.tiff' ELSE 'dummy.tiff' END AS mask_path
FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) USING (doc_id)""")
def mask_path_resolution(spark, sf_dir):
    name = lambda top: F.concat(F.lit(top), F.col("doc_id").cast("string"), F.lit(".tiff")).alias("path")
    listing = table(spark, sf_dir, "labels").where("toxic = 1").select(name("masks/"))
    return joins.mask_paths(table(spark, sf_dir, "documents").select(name("m/")), listing, "dummy.tiff")


@query("""SELECT p_partkey AS slide_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y
FROM part, range(0, 50, 5) a(x), range(0, 50, 5) b(y) WHERE x <= p_size - 10 AND y <= p_size - 10""")
def grid_tiles(spark, sf_dir):
    size, tile, stride = F.col("p_size"), F.lit(10), F.lit(5)
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), size.alias("extent_x"), size.alias("extent_y"), tile.alias("tile_extent_x"), tile.alias("tile_extent_y"), stride.alias("stride_x"), stride.alias("stride_y")
    )
    return grid.grid_tiles(parts)


@query(f"SELECT slide_id, gx, gy, round(avg(score), 9) AS score FROM (SELECT slide_id, x + dx AS gx, y + dy AS gy, score FROM ({SCORED_SQL}), (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)) GROUP BY 1, 2, 3")
def heatmap_mean(spark, sf_dir):
    return digits(grid.heatmap(scored_tiles(spark, sf_dir), extent=2, stride=1), "score", n=9)


@query(f"SELECT DISTINCT slide_id, x AS gx, y AS gy, 255 AS value FROM ({SCORED_SQL})")
def filled_mask(spark, sf_dir):
    return grid.filled_mask(scored_tiles(spark, sf_dir), extent=1, stride=1)


@query(f"""
WITH m AS (SELECT user_id AS slide_id, CAST(day(ts) AS INT) AS mx, CAST(hour(ts) AS INT) AS my, event_type AS cls FROM events),
t AS (SELECT DISTINCT slide_id, CAST(x - x % 3 AS INT) AS x, CAST(y - y % 3 AS INT) AS y FROM ({SCORED_SQL})),
n AS (SELECT t.slide_id, x, y, cls, count(*) AS n FROM t JOIN m ON t.slide_id = m.slide_id AND mx >= x AND mx < x + 4 AND my >= y AND my < y + 4 GROUP BY 1, 2, 3, 4)
SELECT slide_id, x, y, round(1 - coalesce(sum(n) FILTER (cls = 'click'), 0) / sum(n), 9) AS foreground FROM n GROUP BY 1, 2, 3
""")
def mask_foreground(spark, sf_dir):
    mask = table(spark, sf_dir, "events").select(F.col("user_id").alias("slide_id"), F.dayofmonth("ts").alias("mx"), F.hour("ts").alias("my"), F.when(F.col("event_type") == "click", "0").otherwise(F.col("event_type")).alias("cls"))
    found = grid.overlap_fractions(scored_tiles(spark, sf_dir).select("slide_id", (F.col("x") - F.col("x") % 3).alias("x"), (F.col("y") - F.col("y") % 3).alias("y")), mask, 4)
    return found.select("slide_id", "x", "y", F.round(overlap.foreground(F.col("overlap")), 9).alias("foreground"))


_PIXELS_SQL = "SELECT user_id AS slide_id, CAST(day(ts) AS INT) AS mx, CAST(hour(ts) AS INT) AS my, event_type = 'click' AS a0, value < 250 AS b0 FROM events"


@query(f"""
WITH t AS (SELECT p_partkey AS slide_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM part, range(0, 50, 5) a(x), range(0, 50, 5) b(y) WHERE x <= p_size - 10 AND y <= p_size - 10),
m AS ({_PIXELS_SQL}),
a AS (SELECT t.slide_id, x, y, count(*) FILTER (a0) / CAST(count(*) AS DOUBLE) AS z FROM t JOIN m ON t.slide_id = m.slide_id AND mx >= x AND mx < x + 10 AND my >= y AND my < y + 10 GROUP BY 1, 2, 3),
b AS (SELECT t.slide_id, x, y, count(*) FILTER (b0) / CAST(count(*) AS DOUBLE) AS z FROM t JOIN m ON t.slide_id = m.slide_id AND mx >= x + 2 AND mx < x + 7 AND my >= y + 2 AND my < y + 7 GROUP BY 1, 2, 3)
SELECT slide_id, x, y, round(1 - coalesce(b.z, 0), 9) AS blur_percentage, round(1 - coalesce(a.z, 0), 9) AS tissue_roi_percentage
FROM t LEFT JOIN a USING (slide_id, x, y) LEFT JOIN b USING (slide_id, x, y) WHERE 1 - coalesce(a.z, 0) > 0
""")
def tiling_pipeline(spark, sf_dir):
    size, tile, stride = F.col("p_size"), F.lit(10), F.lit(5)
    slides = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), size.alias("extent_x"), size.alias("extent_y"), tile.alias("tile_extent_x"), tile.alias("tile_extent_y"), stride.alias("stride_x"), stride.alias("stride_y")
    )
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("slide_id"), F.dayofmonth("ts").alias("mx"), F.hour("ts").alias("my"), "event_type", "value")
    pixels = lambda zero: events.select("slide_id", "mx", "my", F.when(zero, "0").otherwise("255").alias("cls"))
    masks = [tiling.Mask("blur", pixels(F.col("value") < 250), centre=True), tiling.Mask("tissue_roi", pixels(F.col("event_type") == "click"))]
    return digits(tiling.tile_table(slides, masks, 10), "blur_percentage", "tissue_roi_percentage", n=9)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(1 - l_tax, 9) AS tissue_roi_percentage, round(l_discount + CASE WHEN l_quantity > 25 THEN l_tax ELSE 0 END, 9) AS carcinoma_roi_percentage FROM lineitem""")
def hybrid_mask(spark, sf_dir):
    m = F.map_filter(F.create_map(F.lit(0), F.col("l_tax"), F.lit(3), F.col("l_discount"), F.lit(4), F.when(F.col("l_quantity") > 25, F.col("l_tax"))), lambda k, v: v.isNotNull())
    found = overlap.hybrid_percentages(m)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(c, 9).alias(n) for n, c in found.items()))


@query("""SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 255 ELSE 0 END AS benign, CASE WHEN p_size IN (4, 5) THEN 255 ELSE 0 END AS carcinoma FROM part""")
def class_remap(spark, sf_dir):
    groups = overlap.remapped(F.col("p_size"), {"benign": [1, 2, 3], "carcinoma": [4, 5]})
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in groups.items()))


@query("SELECT p_partkey, round(p_retailprice / CAST(0.5 AS DOUBLE), 6) AS scale FROM part")
def resolution_scale(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(overlap.resolution_scale(price, price * 1.05, 0.5), 6).alias("scale"))


@query("""WITH p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, embedding FROM embeddings)
SELECT label AS slide_id, pos, vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM p""")
def embedding_attach(spark, sf_dir):
    vec = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "slide_id")
    numbered = joins.positions(vec, "slide_id", ["vec_id"])
    found = joins.attach_embeddings(numbered.select("slide_id", "pos", "vec_id"), numbered.select("slide_id", "pos", "embedding"))
    return found.select("slide_id", "pos", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query("""WITH p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, embedding[1] AS first_value FROM embeddings)
SELECT label AS slide_id, pos, vec_id FROM p WHERE first_value > 0""")
def embedding_filter(spark, sf_dir):
    numbered = joins.positions(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "slide_id"), "slide_id", ["vec_id"])
    return joins.surviving_embeddings(numbered.select("slide_id", "pos", "vec_id"), numbered.where("embedding[0] > 0"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 64, 6) AS mean_value, round(CAST(list_max(embedding) AS DOUBLE), 6) AS largest, 66 AS padded_size FROM embeddings")
def token_pooling(spark, sf_dir):
    vec = table(spark, sf_dir, "embeddings")
    tokens = F.transform("embedding", lambda x: F.array(x.cast("double")))
    return vec.select("vec_id", F.round(vectors.mean_vector(tokens)[0], 6).alias("mean_value"), F.round(vectors.max_pooled(F.array("embedding"))[0].cast("double"), 6).alias("largest"), F.size(vectors.padded(tokens, 66, 1)).alias("padded_size"))


@query(f"""WITH m AS ({_PIXELS_SQL}), t AS (SELECT DISTINCT slide_id, CAST(mx - mx % 4 AS INT) AS x, CAST(my - my % 4 AS INT) AS y FROM m)
SELECT t.slide_id, x, y, round(count(*) FILTER (a0) / CAST(count(*) AS DOUBLE), 9) AS fold_percentage FROM t JOIN m ON t.slide_id = m.slide_id AND mx >= x AND mx < x + 4 AND my >= y AND my < y + 4 GROUP BY 1, 2, 3""")
def marked_foreground(spark, sf_dir):
    """The first form of a foreground: the share of class 255, from a configured mask."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("slide_id"), F.dayofmonth("ts").alias("mx"), F.hour("ts").alias("my"), "event_type")
    pixels = events.select("slide_id", "mx", "my", F.when(F.col("event_type") == "click", "255").otherwise("0").alias("cls"))
    (mask,) = tiling.configured([{"name": "fold", "kind": "marked"}], {"fold": pixels})
    cells = events.select("slide_id", (F.col("mx") - F.col("mx") % 4).alias("x"), (F.col("my") - F.col("my") % 4).alias("y")).distinct()
    return digits(tiling.with_mask(cells, mask, 4), "fold_percentage", n=9)


@query(f"""WITH t AS (SELECT DISTINCT slide_id, x, y FROM ({SCORED_SQL})) SELECT slide_id, x + a AS x0, y + b AS y0, x + c AS x1, y + d AS y1
FROM t, (VALUES (0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)) e(a, b, c, d)""")
def tile_outlines(spark, sf_dir):
    return grid.outlines(scored_tiles(spark, sf_dir).select("slide_id", "x", "y").distinct(), 4)


@query("SELECT vec_id, label AS slide_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings")
def input_order(spark, sf_dir):
    """Places in stored order over several files, by slide and over all, joined by slide, and the input's
    order (by vec_id) restored."""
    where = shared_dir(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("slide_id"))
    rows.repartitionByRange(5, "vec_id").sortWithinPartitions("vec_id").write.parquet(where)
    stored = spark.read.parquet(where)
    numbered = joins.stored_positions(joins.with_input_order(stored), "slide_id").join(joins.stored_positions(stored, None, "place").select("vec_id", "place"), "vec_id")
    joined = numbered.join(numbered.groupBy("slide_id").agg(F.count("*").alias("n")), "slide_id")
    return joins.in_input_order(joined).select("vec_id", "slide_id", "pos", "place")


@query(f"SELECT slide_id, x, y, tissue_roi_percentage FROM ({TILES_SQL}) WHERE slide_id = 7")
def tiles_of_slide(spark, sf_dir):
    return filters.of_slide(tiles(spark, sf_dir), 7).select("slide_id", "x", "y", "tissue_roi_percentage")
