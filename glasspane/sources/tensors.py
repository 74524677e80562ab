"""Tensor files: the zipped form of a 2-D tensor of numbers, read and written without its library.

A file holds the pickled shape and the raw numbers. Reading takes the shape through an unpickler
that knows the calls a plain tensor needs and no other, so a hostile file is an error and nothing in
it runs; numbers are read in ranges of rows, so that a large file is several tasks' work and none
holds it whole. Writing streams the rows of a key, in order, into one file.
"""

from __future__ import annotations

import io
import pickle
import struct
import uuid
import zipfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, InputPartition

from glasspane.sources.files import FileReader, FileWriter, Written, listed, load, opened, registered

#: Fixed values of the format: the storage of each kind of number.
STORAGES = {"FloatStorage": np.dtype("<f4"), "DoubleStorage": np.dtype("<f8"), "HalfStorage": np.dtype("<f2")}
#: Rows that are read at a time, and bytes of numbers of one task.
BLOCK_ROWS, TASK_BYTES = 1024, 1 << 26

TENSOR = "slide_id string, pos long, embedding array<float>"


@dataclass
class Storage:
    key: str
    kind: np.dtype
    size: int


@dataclass
class Tensor:
    storage: Storage
    offset: int
    rows: int
    columns: int


def _rebuilt(storage: Storage, offset: int, size: tuple, stride: tuple, *rest: Any) -> Tensor:
    if len(size) != 2 or tuple(stride) != (size[1], 1) or offset < 0 or min(size) < 0 or offset + size[0] * size[1] > storage.size:
        raise pickle.UnpicklingError(f"not a whole tensor of rows: {size}, {stride}")
    return Tensor(storage, offset, *size)


class _Plain(pickle.Unpickler):
    """Allows a tensor's own calls only."""

    def find_class(self, module: str, name: str) -> Any:
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _rebuilt
        if module == "torch" and name in STORAGES:
            return STORAGES[name]
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        raise pickle.UnpicklingError(f"{module}.{name} isn't part of a plain tensor")

    def persistent_load(self, found: Any) -> Storage:
        kind, dtype, key, _, size = found
        if kind != "storage" or not isinstance(dtype, np.dtype):
            raise pickle.UnpicklingError("not a storage")
        return Storage(str(key), dtype, int(size))


def described(path: str, archive: zipfile.ZipFile) -> tuple[Tensor, str]:
    """The tensor of an archive and the member that holds its numbers."""
    names = [n for n in archive.namelist() if n.endswith("/data.pkl")]
    if len(names) != 1:
        raise ValueError(f"{path}: not a tensor file")
    try:
        tensor = _Plain(io.BytesIO(archive.read(names[0]))).load()
    except pickle.UnpicklingError as error:
        raise ValueError(f"{path}: {error}") from error
    except Exception as error:
        raise ValueError(f"{path}: a damaged description ({type(error).__name__})") from error
    if not isinstance(tensor, Tensor):
        raise ValueError(f"{path}: holds no tensor")
    return tensor, f"{names[0].removesuffix('data.pkl')}data/{tensor.storage.key}"


def _number(n: int) -> bytes:
    data = n.to_bytes((n.bit_length() + 8) // 8, "little", signed=True)
    return b"\x8a" + bytes([len(data)]) + data


def _text(value: str) -> bytes:
    data = value.encode()
    return b"X" + struct.pack("<I", len(data)) + data


def description(rows: int, columns: int, storage: str = "FloatStorage") -> bytes:
    """The pickled form of a tensor of that shape whose numbers are in member 0."""
    where = b"(" + _text("storage") + b"ctorch\n" + storage.encode() + b"\n" + _text("0") + _text("cpu") + _number(rows * columns) + b"tQ"
    shape, stride = (_number(a) + _number(b) + b"\x86" for a, b in ((rows, columns), (columns, 1)))
    return b"\x80\x02ctorch._utils\n_rebuild_tensor_v2\n(" + where + _number(0) + shape + stride + b"\x89ccollections\nOrderedDict\n)RtR."


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class TensorReader(FileReader):
    PATTERN = "*.pt"

    def partitions(self) -> list[InputPartition]:
        """Small files as one part each, and equal ranges of bytes of larger ones (as shares of their rows)."""
        found: list[InputPartition] = []
        for path, size in listed(self.where, self.pattern):
            parts = max(1, -(-size // TASK_BYTES))
            found += [Rows(path, i, parts) for i in range(parts)]
        return found

    def read(self, partition: Rows) -> Iterator[tuple]:
        with opened(self.where, partition.path) as source, zipfile.ZipFile(source) as archive:
            tensor, member = described(partition.path, archive)
            slide = partition.path.rsplit("/", 1)[-1].removesuffix(".pt")
            first, last = (tensor.rows * i // partition.last for i in (partition.first, partition.first + 1))
            width = tensor.columns * tensor.storage.kind.itemsize
            with archive.open(member) as numbers:
                numbers.seek(tensor.offset * tensor.storage.kind.itemsize + first * width)
                for row in range(first, last, BLOCK_ROWS):
                    n = min(BLOCK_ROWS, last - row)
                    data = numbers.read(n * width)
                    if len(data) < n * width:
                        raise ValueError(f"{partition.path}: numbers end early")
                    values = np.frombuffer(data, tensor.storage.kind).reshape(n, tensor.columns).astype(np.float32)
                    for i, v in enumerate(values):
                        yield slide, row + i + 1, v.tolist()


class TensorWriter(FileWriter):
    """One file for each run of a slide_id in a task's rows."""

    def write(self, iterator) -> Written:
        store, root = self.begun()
        done: list[tuple[str, str]] = []
        now, archive, out, numbers, rows, columns = None, None, None, None, 0, 0

        def close() -> None:
            numbers.close()
            archive.writestr("archive/data.pkl", description(rows, columns))
            archive.writestr("archive/version", "3\n")
            archive.close()
            out.close()

        for row in iterator:
            if row["slide_id"] != now or archive is None:
                if archive is not None:
                    close()
                now, rows, columns = row["slide_id"], 0, len(row["embedding"])
                temporary = f"{root}/.{uuid.uuid4().hex}"
                if now is None or "/" in now or f"{root}/{now}.pt" in {n for _, n in done}:
                    raise ValueError(f"rows of slide {now!r} aren't together, or it names no file")
                done.append((temporary, f"{root}/{now}.pt"))
                out = store.open_output_stream(temporary)
                archive = zipfile.ZipFile(out, "w")
                numbers = archive.open("archive/data/0", "w", force_zip64=True)
            if len(row["embedding"]) != columns:
                raise ValueError(f"rows of slide {now!r} differ in length")
            numbers.write(np.asarray(row["embedding"], "<f4").tobytes())
            rows += 1
        if archive is not None:
            close()
        return Written(done)


class Tensors(DataSource):
    """format("tensors"): option path, and pattern of names."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return TENSOR

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options)

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options)


def read_tensors(spark: SparkSession, path: str, pattern: str = "*.pt") -> DataFrame:
    """slide_id (the file's stem), pos (from 1) and embedding of each row of each tensor."""
    return load(spark, Tensors, path, pattern=pattern)


def write_tensors(embeddings: DataFrame, path: str) -> None:
    """A file <slide_id>.pt for each slide, its rows in order of pos."""
    spark = embeddings.sparkSession
    rows = embeddings.selectExpr("cast(slide_id as string) as slide_id", "cast(pos as bigint) as pos", "cast(embedding as array<float>) as embedding")
    ordered = rows.repartition("slide_id").sortWithinPartitions("slide_id", "pos")
    ordered.write.format(registered(spark, Tensors)).mode("append").save(path)


def tensor_bytes(values: np.ndarray, storage: str = "FloatStorage") -> bytes:
    """A file of that tensor, for tests."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("x/data.pkl", description(*values.shape, storage))
        archive.writestr("x/data/0", values.astype(STORAGES[storage]).tobytes())
    return out.getvalue()

