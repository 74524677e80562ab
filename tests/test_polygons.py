"""Polygons as spans against brute force by pixel, and tiles under them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glasspane.operators import grid, polygons

SCHEMA = "slide_id long, part_of_group string, shape long, vertices array<struct<x: double, y: double>>"


def inside(points, x, y):
    odd = False
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        if min(y0, y1) <= y < max(y0, y1) and x0 + (y - y0) * ((x1 - x0) / (y1 - y0)) <= x:
            odd = not odd
    return odd


def pixels(points, width, height):
    return {(mx, my) for mx in range(width) for my in range(height) if len(points) > 2 and inside(points, mx + 0.5, my + 0.5)}


def spread(rows):
    found = [(r["slide_id"], r["part_of_group"], mx, r["my"]) for r in rows for mx in range(r["start"], r["stop"])]
    assert len(found) == len(set(found))
    return set(found)


def shapes(seed):
    g = random.Random(seed)
    out = []
    for n in range(25):
        count = g.randint(0, 9)
        points = [(g.choice([g.uniform(-6, 40), float(g.randint(-3, 35)), g.randint(0, 60) / 2]), g.choice([g.uniform(-6, 30), g.randint(-8, 60) / 2])) for _ in range(count)]
        out.append((n % 3, "ab"[n % 2], n, points))
    return out


SQUARE, BOW = [(2.0, 2.0), (10.0, 2.0), (10.0, 9.0), (2.0, 9.0)], [(0.0, 0.0), (12.0, 12.0), (12.0, 0.0), (0.0, 12.0)]
CONCAVE = [(0.0, 0.0), (20.0, 0.0), (20.0, 15.0), (10.0, 3.0), (0.0, 15.0)]


@pytest.mark.parametrize("rows", [shapes(1), shapes(2), [(1, "a", 0, SQUARE), (1, "a", 1, BOW), (1, "b", 2, CONCAVE), (2, "a", 3, SQUARE), (2, "a", 4, SQUARE)]])
def test_masks_equal_brute_force(spark, rows):
    got = polygons.polygon_masks(spark.createDataFrame(rows, SCHEMA), 30, 22).collect()
    want = {(s, g, mx, my) for s, g, _, points in rows for mx, my in pixels(points, 30, 22)}
    assert spread(got) == want
    lines = {}
    for r in got:
        lines.setdefault((r["slide_id"], r["part_of_group"], r["my"]), []).append((r["start"], r["stop"]))
    for parts in lines.values():  # as few spans as can be
        parts.sort()
        assert all(a[1] < b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_polygons_that_touch_share_no_pixel_and_miss_none(spark):
    corners = [(0.0, 0.0), (17.3, 0.0), (17.3, 13.7), (0.0, 13.7)]
    fan = [(0, "a", i, [(7.1, 4.4), corners[i], corners[(i + 1) % 4]]) for i in range(4)]
    alone = polygons.spans(spark.createDataFrame(fan, SCHEMA), 30, 22)
    assert alone.groupBy("my").agg(F.sum(F.col("stop") - F.col("start")).alias("n")).where("n != 17").count() == 0
    assert polygons.span_areas(polygons.united(alone)).first()["area"] == 17 * 14


def test_the_scale_turns_slide_pixels_into_mask_pixels(spark):
    rows = [(0, "a", 0, [(x * 32, y * 16) for x, y in CONCAVE])]
    scaled = polygons.polygon_masks(spark.createDataFrame(rows, SCHEMA), 30, 22, 1 / 32, F.lit(1 / 16)).collect()
    assert spread(scaled) == {(0, "a", *p) for p in pixels(CONCAVE, 30, 22)}


def test_a_large_outline_stays_spans(spark):
    side = 5000.0
    rows = [(0, "a", 0, [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)])]
    found = polygons.polygon_masks(spark.createDataFrame(rows, SCHEMA), 10_000, 10_000)
    assert found.count() == 5000 and polygons.span_areas(found).first()["area"] == 25_000_000


def test_no_rows_and_bad_vertices(spark):
    assert polygons.polygon_masks(spark.createDataFrame([], SCHEMA), 9, 9).collect() == []
    few = [(0, "a", 0, []), (0, "a", 1, [(1.0, 1.0)] * 2), (0, "a", 2, [(1.0, 1.0)] * 9), (0, "a", 3, None), (0, "a", 4, [(0.0, 4.0), (9.0, 4.0), (3.0, 4.0)])]
    assert polygons.polygon_masks(spark.createDataFrame(few, SCHEMA), 9, 9).collect() == []
    for bad in (None, math.nan):
        rows = spark.createDataFrame([(0, "a", 0, [(0.0, 0.0), (1.0, bad), (1.0, 1.0)])], SCHEMA)
        with pytest.raises(Exception, match="a vertex without a coordinate"):
            polygons.polygon_masks(rows, 9, 9).collect()


def test_shares_of_tiles_equal_those_of_pixel_masks(spark):
    rows = [r for r in shapes(3) if r[1] == "a"]
    spans = polygons.polygon_masks(spark.createDataFrame(rows, SCHEMA), 30, 22).cache()
    tiles = spark.createDataFrame([(s, x, y) for s in range(3) for x in range(-3, 28, 3) for y in range(0, 20, 5)] * 2, "slide_id long, x int, y int")
    got = {(r["slide_id"], r["x"], r["y"]): r["fraction"] for r in polygons.span_overlap(tiles, spans, 6).collect()}
    under = {(r["slide_id"], r["mx"], r["my"]) for r in polygons.span_pixels(spans).collect()}
    want = {(s, x, y): sum((s, x + i, y + j) in under for i in range(6) for j in range(6)) / 36 for s, x, y in {tuple(t) for t in tiles.collect()}}
    assert got == {k: v for k, v in want.items() if v}
    whole = spark.range(30).crossJoin(spark.range(22).toDF("my")).crossJoin(spark.range(3).toDF("slide_id")).select("slide_id", F.col("id").alias("mx"), "my")
    mask = whole.join(polygons.span_pixels(spans), ["slide_id", "mx", "my"], "left").select("slide_id", "mx", "my", F.coalesce("cls", F.lit("0")).alias("cls"))
    inner = tiles.where("x >= 0 and x <= 24 and y <= 16")
    maps = {(r["slide_id"], r["x"], r["y"]): r["overlap"].get("255", 0.0) for r in grid.overlap_fractions(inner, mask, 6).collect()}
    assert maps == {k: want[k] for k in maps} and len(maps) == inner.distinct().count()
