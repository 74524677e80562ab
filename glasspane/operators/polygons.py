"""Polygons to masks: scanline fill into spans of pixels, and the share of tiles under them.

A pixel belongs to a polygon if its centre does, by the even-odd rule, so polygons that touch
share no pixel and leave none out. Each edge is exploded to the pixel rows whose centre line it crosses
(the lower end counts, the upper doesn't); the crossings of a row, in order, open and close its spans.
The rows of a mask stay spans, (slide_id, part_of_group, my, start, stop) with stop exclusive: as many as
its outline is long, not as its area is large. Every step goes by slide, polygon and row, so one large
polygon is spread over all tasks.

Polygons of fewer than three points, or without area, have no spans. A missing or NaN coordinate raises
when the row is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHAPE = ["slide_id", "part_of_group", "shape"]
LINE = ["slide_id", "part_of_group", "my"]


def as_polygons(annotations: DataFrame, slide: Column) -> DataFrame:
    """Annotations (part_of_group, vertices), as read, with their slide and a shape of their own each."""
    return annotations.select(slide.alias("slide_id"), "part_of_group", F.monotonically_increasing_id().alias("shape"), "vertices")


def edges(polygons: DataFrame, scale_x: Column | float = 1.0, scale_y: Column | float = 1.0) -> DataFrame:
    """slide_id, part_of_group, shape and x0, y0, x1, y1 of each edge in pixels of the mask, the last one
    back to the first point. polygons: slide_id, part_of_group, shape (told apart by it) and vertices
    (array of x, y), which the scales turn into mask pixels."""

    def pixel(value: Column, scale: Column | float) -> Column:
        known = value.isNotNull() & ~F.isnan(value)
        return F.when(known, value * scale).otherwise(F.raise_error(F.lit("a vertex without a coordinate")).cast("double"))

    points = F.transform("vertices", lambda v: F.struct(pixel(v["x"], scale_x).alias("x"), pixel(v["y"], scale_y).alias("y")))
    closed = polygons.where(F.size("vertices") >= 3).select(*SHAPE, points.alias("a")).select(*SHAPE, "a", F.concat(F.slice("a", 2, F.size("a") - 1), F.slice("a", 1, 1)).alias("b"))
    rows = closed.select(*SHAPE, F.explode(F.arrays_zip("a", "b")).alias("e"))
    return rows.select(*SHAPE, *(F.col(f"e.{p}.{c}").alias(f"{c}{i}") for i, p in enumerate("ab") for c in "xy"))


def _first_centre(at: Column) -> Column:
    """The first pixel whose centre is not before at."""
    return F.ceil(at - 0.5).cast("long")


def crossings(edges: DataFrame, height: Column | int) -> DataFrame:
    """SHAPE, my, at: where each edge crosses the centre line of each pixel row of the mask."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.greatest(_first_centre(low), F.lit(0)), F.least(_first_centre(high), _long(height)) - 1
    slope = (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    lines = F.when((F.col("y0") != F.col("y1")) & (first <= last), F.sequence(first, last))
    rows = edges.select(*SHAPE, "x0", "y0", F.when(F.col("y0") != F.col("y1"), slope).alias("slope"), F.explode(lines).alias("my"))
    return rows.select(*SHAPE, "my", (F.col("x0") + (F.col("my") + 0.5 - F.col("y0")) * F.col("slope")).alias("at"))


def _long(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("long")


def spans(polygons: DataFrame, width: int, height: int, scale_x: Column | float = 1.0, scale_y: Column | float = 1.0) -> DataFrame:
    """slide_id, part_of_group, shape, my, start, stop of every polygon by itself, cut to the mask's size."""
    order = W.partitionBy(*SHAPE, "my").orderBy("at")
    paired = crossings(edges(polygons, scale_x, scale_y), height).withColumns({"n": F.row_number().over(order), "end": F.lead("at").over(order)}).where("n % 2 = 1")
    start, stop = F.greatest(_first_centre(F.col("at")), F.lit(0)), F.least(_first_centre(F.col("end")), F.lit(width).cast("long"))
    return paired.select(*SHAPE, "my", start.alias("start"), stop.alias("stop")).where("start < stop")


def united(spans: DataFrame) -> DataFrame:
    """slide_id, part_of_group, my, start, stop: the pixels under any polygon of a group, in spans that
    neither overlap nor touch."""
    order = W.partitionBy(*LINE).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    begun = spans.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    numbered = begun.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*LINE, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def polygon_masks(polygons: DataFrame, width: int, height: int, scale_x: Column | float = 1.0, scale_y: Column | float = 1.0) -> DataFrame:
    """The masks of all slides and groups as united spans; a mask without a pixel has no rows."""
    return united(spans(polygons, width, height, scale_x, scale_y))


def span_areas(spans: DataFrame) -> DataFrame:
    """slide_id, part_of_group and the pixels under the spans."""
    return spans.groupBy("slide_id", "part_of_group").agg(F.sum(F.col("stop") - F.col("start")).alias("area"))


def span_pixels(spans: DataFrame, cls: str = "255") -> DataFrame:
    """slide_id, part_of_group, mx, my, cls of every pixel, in the form that masks of pixels have."""
    pixels = F.explode(F.sequence(F.col("start").cast("int"), F.col("stop").cast("int") - 1))
    return spans.select("slide_id", "part_of_group", pixels.alias("mx"), F.col("my").cast("int").alias("my"), F.lit(cls).alias("cls"))


def span_overlap(tiles: DataFrame, spans: DataFrame, extent: int) -> DataFrame:
    """slide_id, x, y, part_of_group, fraction of each tile that lies under united spans; tiles under
    none are left out.

    Spans are cut at the borders of cells of the tile's size, and a tile joins the cells that it touches,
    four at most: a row of a cell is one row of the join, however wide it is.
    """
    cell = lambda at: F.floor(at / extent).cast("long")
    pieces = spans.select(*LINE, "start", "stop", cell(F.col("my")).alias("cy"), F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop") - 1))).alias("cx"))
    pieces = pieces.withColumns({"start": F.greatest("start", F.col("cx") * extent), "stop": F.least("stop", (F.col("cx") + 1) * extent)})
    # the spans of one row of a cell, few as they are apart, travel together
    held = pieces.groupBy("slide_id", "part_of_group", "cx", "cy", "my").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))
    touched = lambda at: F.array_distinct(F.array(*(cell(F.col(at) + d) for d in (0, extent - 1))))
    keyed = tiles.select("slide_id", "x", "y").distinct().select("slide_id", "x", "y", F.explode(touched("x")).alias("cx"), touched("y").alias("cys")).select("slide_id", "x", "y", "cx", F.explode("cys").alias("cy"))
    met = keyed.join(held, ["slide_id", "cx", "cy"]).where((F.col("my") >= F.col("y")) & (F.col("my") < F.col("y") + extent))
    inside = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.greatest(F.lit(0), F.least(p["stop"], F.col("x") + extent) - F.greatest(p["start"], F.col("x"))))
    shares = met.withColumn("n", inside).groupBy("slide_id", "x", "y", "part_of_group").agg((F.sum("n") / float(extent * extent)).alias("fraction"))
    return shares.where("fraction > 0")
