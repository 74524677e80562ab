"""Rasters of whole slides from the arrays of their tiles: activation maps added where tiles overlap.

A slide's raster is cut into square blocks. A task adds the arrays of the tiles it reads into dense
blocks of sums and counts, each tile cut at the blocks' borders; what several tasks have of a block is sorted
together and added up in a stream, two arrays at a time. So rows are blocks, not pixels, and no task
holds more than HELD_BLOCKS of them, however many tiles lie over one place.

Pixels that are NaN and tiles without an array count for nothing; a pixel that nothing covers is null
in the mean. An array of another size than height x width is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from glasspane.functions.vectors import sigmoid
from glasspane.sources.workers import ship

#: Side of a block, and blocks that a task holds.
BLOCK, HELD_BLOCKS = 256, 64

Dense = tuple[np.ndarray, np.ndarray]


def pieces(x: int, y: int, height: int, width: int, block: int) -> Iterator[tuple[int, int, slice, slice, slice, slice]]:
    """The blocks under a tile at x, y: their place, the rows and columns in the block, and those in the tile."""
    for by in range(y // block, (y + height - 1) // block + 1):
        top, bottom = max(y, by * block), min(y + height, (by + 1) * block)
        for bx in range(x // block, (x + width - 1) // block + 1):
            left, right = max(x, bx * block), min(x + width, (bx + 1) * block)
            inner = slice(top - by * block, bottom - by * block), slice(left - bx * block, right - bx * block)
            yield bx, by, *inner, slice(top - y, bottom - y), slice(left - x, right - x)


def _partial(schema: pa.Schema, height: int, width: int, block: int) -> Callable:
    def passed_on(held: dict[tuple, Dense]) -> pa.RecordBatch:
        keys = list(held)
        columns = [*zip(*keys, strict=True), *([held[k][i].tobytes() for k in keys] for i in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Dense] = {}
        for batch in batches:
            for slide, x, y, values in zip(*(batch.column(c) for c in ("slide_id", "x", "y", "values")), strict=True):
                if not values.is_valid:
                    continue
                tile = values.values.to_numpy(zero_copy_only=False).astype(float)
                if len(tile) != height * width:
                    raise ValueError(f"a tile of {len(tile)} values, not {height} x {width}")
                tile = tile.reshape(height, width)
                known = ~np.isnan(tile)
                tile = np.where(known, tile, 0.0)
                for bx, by, rows, columns, own_rows, own_columns in pieces(x.as_py(), y.as_py(), height, width, block):
                    key = slide.as_py(), bx, by
                    if key not in held:
                        if len(held) >= HELD_BLOCKS:
                            yield passed_on(held)
                            held = {}
                        held[key] = np.zeros((block, block)), np.zeros((block, block), np.int32)
                    sums, counts = held[key]
                    sums[rows, columns] += tile[own_rows, own_columns]
                    counts[rows, columns] += known[own_rows, own_columns]
        if held:
            yield passed_on(held)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their block; those of one block become one."""
    now, sums, counts, schema = None, None, None, None

    def done():
        columns = [*([v] for v in now), [sums.tobytes()], [counts.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for *key, s, n in zip(*(batch.column(c) for c in ("slide_id", "bx", "by", "sums", "counts")), strict=True):
            key = tuple(k.as_py() for k in key)
            s, n = np.frombuffer(s.as_buffer(), float), np.frombuffer(n.as_buffer(), np.int32)
            if key == now:
                sums += s
                counts += n
                continue
            if now is not None:
                yield done()
            now, sums, counts = key, s.copy(), n.copy()
    if now is not None:
        yield done()


def _means(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                sums, counts = np.frombuffer(row.column("sums")[0].as_buffer(), float), np.frombuffer(row.column("counts")[0].as_buffer(), np.int32)
                mean = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), v) for v in (mean, pa.array(counts))]
                yield pa.RecordBatch.from_arrays([row.column("slide_id"), row.column("bx"), row.column("by"), *(a.cast(f.type) for a, f in zip(arrays, list(schema)[3:], strict=True))], schema=schema)

    return run


def raster_blocks(tiles: DataFrame, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """slide_id, bx, by, mean (array of double) and n (array of int): the blocks of every slide's raster, row by
    row of pixels. tiles: slide_id, x, y and values, an array of height x width numbers, row by row."""
    spark = tiles.sparkSession
    ship(spark)
    slide = dict(tiles.dtypes)["slide_id"]
    key = f"slide_id {slide}, bx int, by int"
    arrow = lambda ddl: to_arrow_schema(spark.createDataFrame([], ddl).schema)
    sums, means = f"{key}, sums binary, counts binary", f"{key}, mean array<double>, n array<int>"
    rows = tiles.select("slide_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("values").cast("array<double>").alias("values"))
    partial = rows.mapInArrow(_partial(arrow(sums), height, width, block), sums)
    order = ["slide_id", "bx", "by"]
    added = partial.repartition(*order).sortWithinPartitions(*order).mapInArrow(_added, sums)
    return added.mapInArrow(_means(arrow(means)), means)


def grey(blocks: DataFrame) -> DataFrame:
    """blocks with pixels, the grey values of the means (sigmoid, times 255, cut), 0 where nothing is."""
    value = F.transform("mean", lambda m: F.coalesce(F.floor(255 * sigmoid(m)), F.lit(0)).cast("int"))
    return blocks.withColumn("pixels", value)


def block_pixels(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """slide_id, px, py and the columns mean, n (and pixels, if it is there) of each covered pixel."""
    columns = [c for c in ("mean", "n", "pixels") if c in blocks.columns]
    rows = blocks.select("slide_id", "bx", "by", F.posexplode(F.arrays_zip(*columns)).alias("at", "v")).where("v.n > 0")
    place = [(F.col("bx") * block + F.col("at") % block).alias("px"), (F.col("by") * block + F.floor(F.col("at") / block)).cast("int").alias("py")]
    return rows.select("slide_id", *place, *(F.col(f"v.{c}").alias(c) for c in columns))
