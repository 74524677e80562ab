"""Rasters of overlapping tiles against brute force by pixel."""

import math

import numpy as np
import pytest

from glasspane.operators import rasters

SCHEMA = "slide_id string, x int, y int, values array<double>, n int"


def brute(rows, height, width):
    sums, counts = {}, {}
    for s, x, y, values, _ in rows:
        for i, v in enumerate(values or []):
            if not math.isnan(v):
                at = s, x + i % width, y + i // width
                sums[at], counts[at] = sums.get(at, 0) + v, counts.get(at, 0) + 1
    return {k: (sums[k] / counts[k], counts[k]) for k in sums}


def made(n, height, width, seed=1):
    g = np.random.default_rng(seed)
    rows = [(f"s{i % 3}", int(g.integers(-20, 60)), int(g.integers(-9, 40)), g.normal(size=height * width).tolist(), 1) for i in range(n)]
    return rows + [("s0", 0, 0, None, 1), ("s9", 5, 5, [float("nan")] * (height * width), 1)]


@pytest.mark.parametrize(("height", "width", "block"), [(8, 8, 16), (5, 7, 4), (20, 3, 16), (1, 1, 8)])
def test_blocks_equal_brute_force(spark, height, width, block):
    rows = made(70, height, width)
    blocks = rasters.raster_blocks(spark.createDataFrame(rows, SCHEMA), height, width, block)
    got = {(r.slide_id, r.px, r.py): (r["mean"], r.n, r.pixels) for r in rasters.block_pixels(rasters.grey(blocks), block).collect()}
    want = brute(rows, height, width)
    assert got.keys() == want.keys()
    for k, (mean, n) in want.items():
        assert math.isclose(got[k][0], mean, abs_tol=1e-12) and got[k][1] == n
        assert got[k][2] == math.floor(255 / (1 + math.exp(-got[k][0])))
    assert blocks.groupBy("slide_id", "bx", "by").count().where("count > 1").count() == 0


def test_few_held_blocks_give_the_same():
    rows = made(40, 6, 6, 3)
    import pyarrow as pa

    schema = pa.schema([("slide_id", pa.string()), ("bx", pa.int32()), ("by", pa.int32()), ("sums", pa.binary()), ("counts", pa.binary())])
    batch = pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(("slide_id", "x", "y", "values"))})
    found, held = [], rasters.HELD_BLOCKS
    for rasters.HELD_BLOCKS in (2, held):
        parts = [r for b in rasters._partial(schema, 6, 6, 8)([batch]) for r in b.to_pylist()]
        parts.sort(key=lambda r: (r["slide_id"], r["bx"], r["by"]))
        found.append([r for b in rasters._added([pa.RecordBatch.from_pylist(parts, schema)]) for r in b.to_pylist()])
    few, many = found
    assert [{k: r[k] for k in ("slide_id", "bx", "by", "counts")} for r in few] == [{k: r[k] for k in ("slide_id", "bx", "by", "counts")} for r in many]
    assert all(np.allclose(np.frombuffer(a["sums"]), np.frombuffer(b["sums"])) for a, b in zip(few, many, strict=True))


def test_wrong_sizes_and_no_rows(spark):
    with pytest.raises(Exception, match="a tile of 3 values, not 2 x 2"):
        rasters.raster_blocks(spark.createDataFrame([("s", 0, 0, [1.0] * 3, 1)], SCHEMA), 2, 2).collect()
    assert rasters.raster_blocks(spark.createDataFrame([], SCHEMA), 2, 2).collect() == []
