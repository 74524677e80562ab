"""Headers of slides in TIFF files: sizes and resolution of every level, by ranges of bytes, no pixels.

Classic and big TIFF in either byte order. Levels are the directories of tiled or striped images in the order of
the file; those of another shape than the first (labels, thumbnails of the glass) are left out. A file
that isn't TIFF, or whose directories run in a circle or beyond its end, is an error that names it.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from glasspane.functions.text import stem
from glasspane.sources.files import FileReader, InBatches, load, store_of
from glasspane.sources.workers import ship

#: Fixed values of the format: tags, and the size and form of field types.
WIDTH, HEIGHT, X_RESOLUTION, Y_RESOLUTION, UNIT, TILE_WIDTH, TILE_HEIGHT = 256, 257, 282, 283, 296, 322, 323
FORMS = {1: "B", 3: "H", 4: "I", 5: "II", 13: "I", 16: "Q", 18: "Q"}
#: Micrometres in a unit of resolution: inch, centimetre.
UNITS = {2: 25_400.0, 3: 10_000.0}
#: Directories of a file, and share by which a level's shape may differ from the first's, at most.
MOST_DIRECTORIES, SHAPE = 64, 0.02
#: Files of a folder that write_pyramids makes, about, and least tasks among which more folders than these are dealt.
FOLDER_FILES, WRITERS = 1000, 128
#: Bytes that are read at once: as a rule all of a file's headers, which lie together.
READ_BYTES = 2048

HEADER = "path string, level int, width long, height long, tile_width int, tile_height int, mpp_x double, mpp_y double, downsample double"
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _numbers(source: BinaryIO, order: str, form: str, at: int | None = None) -> tuple[int, ...]:
    if at is not None:
        source.seek(at)
    size = struct.calcsize(order + form)
    data = source.read(size)
    if len(data) < size:
        raise ValueError("a directory reaches beyond the end")
    return struct.unpack(order + form, data)


def directories(source: BinaryIO) -> Iterator[dict[int, float]]:
    """The tags above of each directory: numbers, ratios for resolutions."""
    mark = source.read(4)
    order = {b"II": "<", b"MM": ">"}.get(mark[:2])
    version = struct.unpack(order + "H", mark[2:])[0] if order and len(mark) == 4 else None
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    if big:
        source.read(4)
    (at,) = _numbers(source, order, "Q" if big else "I")
    seen: set[int] = set()
    while at:
        if at in seen or len(seen) >= MOST_DIRECTORIES:
            raise ValueError("directories run in a circle")
        seen.add(at)
        (count,) = _numbers(source, order, "Q" if big else "H", at)
        size = 20 if big else 12
        tags: dict[int, float] = {}
        if count > 4096:
            raise ValueError("a directory of too many tags")
        # a directory is one read, with the place of the next one at its end
        table = source.read(count * size + (8 if big else 4))
        if len(table) < count * size + (8 if big else 4):
            raise ValueError("a directory reaches beyond the end")
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), table, i * size)
            form = FORMS.get(kind)
            if tag not in (WIDTH, HEIGHT, X_RESOLUTION, Y_RESOLUTION, UNIT, TILE_WIDTH, TILE_HEIGHT) or not form or n != 1:
                continue
            value = i * size + (12 if big else 8)
            if struct.calcsize("<" + form) > (8 if big else 4):
                parts = _numbers(source, order, form, struct.unpack_from(order + "I", table, value)[0])
            else:
                parts = struct.unpack_from(order + form, table, value)
            tags[tag] = parts[0] if len(parts) == 1 else parts[0] / parts[1] if parts[1] else 0.0
        yield tags
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), table, count * size)


def levels(path: str, source: BinaryIO) -> Iterator[tuple]:
    first = None
    level = 0
    try:
        for tags in directories(source):
            if WIDTH not in tags or HEIGHT not in tags:
                continue
            width, height = int(tags[WIDTH]), int(tags[HEIGHT])
            first = first or (width, height, tags)
            if not width or not height or abs(width / height / (first[0] / first[1]) - 1) > max(SHAPE, 2 / width, 2 / height):
                continue
            down = first[0] / width
            # levels but the first often lack a resolution: it follows from their size
            unit = UNITS.get(int(first[2].get(UNIT, 2)))
            x, y = (unit / first[2][t] if unit and first[2].get(t) else None for t in (X_RESOLUTION, Y_RESOLUTION))
            yield path, level, width, height, int(tags.get(TILE_WIDTH, width)), int(tags.get(TILE_HEIGHT, height)), x and x * down, y and y * first[1] / height, down
            level += 1
    except (ValueError, struct.error) as error:
        raise ValueError(f"{path}: {error}") from error
    if not level:
        raise ValueError(f"{path}: no image")


class SlideHeaders(DataSource):
    """format("slide_headers"): option path, and pattern of names."""

    @classmethod
    def name(cls) -> str:
        return "slide_headers"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema) -> InBatches:
        return InBatches(HeaderReader(self.options), pa.schema([(name, ARROW[kind]) for name, kind in (f.split() for f in HEADER.split(", "))]))


class HeaderReader(FileReader):
    PATTERN = "*.tif*"

    def rows_of(self, path: str, source: BinaryIO) -> Iterator[tuple]:
        return levels(path, io.BufferedReader(source, READ_BYTES))


def read_headers(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """HEADER of every level of the slides at or below a place."""
    return load(spark, SlideHeaders, path, pattern=pattern)


def slides_at(headers: DataFrame, mpp: float, tile_extent: int, stride: int) -> DataFrame:
    """One row a slide, as grid_tiles takes it: the level whose resolution is nearest to mpp (of two, the
    finer one). Without a resolution the first level."""
    away = F.coalesce(F.abs(F.log(F.col("mpp_x") / mpp)), F.lit(0.0))
    nearest = headers.groupBy("path").agg(F.min_by(F.struct("level", "width", "height", "mpp_x", "mpp_y", "downsample"), F.struct(away, "level")).alias("l"))
    sizes = {"tile_extent_x": tile_extent, "tile_extent_y": tile_extent, "stride_x": stride, "stride_y": stride}
    return nearest.select(
        stem(F.col("path")).alias("id"), "path", F.col("l.width").cast("int").alias("extent_x"), F.col("l.height").cast("int").alias("extent_y"),
        *(F.lit(v).alias(c) for c, v in sizes.items()), "l.mpp_x", "l.mpp_y", "l.level", "l.downsample",
    )


def pyramid(width: int, height: int, mpp: float, count: int, big: bool = False, order: str = "<") -> bytes:
    """A file of count levels, each half as wide and high as the one before, with headers alone: sizes,
    tiles of 256 and, in the first, the resolution in pixels a centimetre. For tests and examples."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + ("HHH" if big else "H"), *((43, 8, 0) if big else (42,))))
    place = len(out)
    out += bytes(8 if big else 4)
    for level in range(count):
        w, h = max(1, width >> level), max(1, height >> level)
        ratio = (round(UNITS[3] / mpp * 1000), 1000)
        tags = [(WIDTH, 4, w), (HEIGHT, 4, h), *([(X_RESOLUTION, 5, ratio), (Y_RESOLUTION, 5, ratio), (UNIT, 3, 3)] if not level else []), (TILE_WIDTH, 3, 256), (TILE_HEIGHT, 3, 256)]
        at = len(out)
        struct.pack_into(order + ("Q" if big else "I"), out, place, at)
        size = 20 if big else 12
        tail = at + (8 if big else 2) + size * len(tags) + (8 if big else 4)
        body, extra = bytearray(struct.pack(order + ("Q" if big else "H"), len(tags))), bytearray()
        for tag, kind, value in tags:
            data = struct.pack(order + FORMS[kind], *(value if isinstance(value, tuple) else (value,)))
            room = 8 if big else 4
            if len(data) > room:
                data, extra = struct.pack(order + ("Q" if big else "I"), tail + len(extra)), extra + data
            body += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, 1) + data.ljust(room, b"\0")
        place = at + len(body)
        out += body + bytes(8 if big else 4) + extra
    return bytes(out)


def write_pyramids(slides: DataFrame, path: str) -> None:
    """A file <id>.tiff of headers for each row (id, width, height, mpp, levels), in folders of about
    FOLDER_FILES by hashes of the id. A task writes one folder, or several where there are many, as to start a
    task of Python takes as long as to write a folder; a task that is repeated writes the same files."""
    ship(slides.sparkSession)
    folders = max(1, -(-slides.count() // FOLDER_FILES))
    each = max(1, folders // WRITERS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        first = TaskContext.get().partitionId() * each
        places = [f"{root}/{first + i:05d}" for i in range(each)]
        for place in places:
            store.create_dir(place, recursive=True)
        for batch in batches:
            for name, width, height, mpp, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_output_stream(f"{places[zlib.crc32(name.encode()) % each]}/{name}.tiff") as out:
                    out.write(pyramid(width, height, mpp, count, big=width % 2 == 1))
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    rows = slides.select("id", "width", "height", "mpp", "levels").repartition(-(-folders // each), "id")
    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
