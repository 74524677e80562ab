"""What the file sources share: listing, opening at any store, and one partition for a few files."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from glasspane.sources.workers import ship


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a URI or a local path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def listed(uri: str, pattern: str) -> list[tuple[str, int]]:
    """Path in its store and size of the files at or below a place whose name fits, sorted."""
    store, path = store_of(uri)
    own = store.get_file_info(path)
    found = [own] if own.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and fits(f.base_name, pattern))


def fits(name: str, pattern: str) -> bool:
    return fnmatch.fnmatch(name, pattern) and not name.startswith((".", "_"))


def opened(uri: str, path: str) -> BinaryIO:
    """A file at the store of a URI, for reading at any place."""
    return store_of(uri)[0].open_input_file(path)


@dataclass
class Files(InputPartition):
    """Paths of one task, and folders that it lists itself."""

    paths: list[str]
    folders: list[str] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote under a temporary name, and their names."""

    renames: list[tuple[str, str]]


class FileReader(DataSourceReader):
    """Reads each file by itself; a subclass has rows_of.

    The driver lists folders level by level only until there are WIDE of them at a level: those are listed by
    the tasks, so that it never holds the names of a large tree. A task has BATCH files, or more where
    there would be over MOST tasks.
    """

    PATTERN, BATCH, WIDE, MOST = "*", 16, 64, 512

    def __init__(self, options: dict[str, str]) -> None:
        self.where, self.pattern = options["path"], options.get("pattern", self.PATTERN)

    def partitions(self) -> list[InputPartition]:
        store, path = store_of(self.where)
        own = store.get_file_info(path)
        paths, folders = ([path], []) if own.is_file and fits(own.base_name, self.pattern) else ([], [] if own.is_file else [path])
        while folders and len(folders) < self.WIDE:
            below = [f for folder in folders for f in store.get_file_info(fs.FileSelector(folder))]
            paths += [f.path for f in below if f.is_file and fits(f.base_name, self.pattern)]
            folders = [f.path for f in below if not f.is_file]
        some = lambda names, least: [names[i : i + n] for n in [max(least, -(-len(names) // self.MOST))] for i in range(0, len(names), n)]
        return [Files(p) for p in some(sorted(paths), self.BATCH)] + [Files([], f) for f in some(sorted(folders), 1)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = store_of(self.where)
        for folder in partition.folders:
            below = (f for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and fits(f.base_name, self.pattern))
            yield from self.read(Files(sorted(f.path for f in below)))
        for path in partition.paths:
            with store.open_input_file(path) as source:
                yield from self.rows_of(path, source)

    def rows_of(self, path: str, source: BinaryIO) -> Iterator[tuple]:
        raise NotImplementedError


class InBatches(DataSourceReader):
    """The rows of a reader as record batches. Spark checks and converts tuples value by value, which takes
    longer than to read a small file."""

    ROWS = 4096

    def __init__(self, reader: DataSourceReader, schema: pa.Schema) -> None:
        self.reader, self.schema = reader, schema

    def partitions(self) -> list[InputPartition]:
        return list(self.reader.partitions())

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows = iter(self.reader.read(partition))
        while some := list(islice(rows, self.ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*some, strict=True), self.schema, strict=True)], schema=self.schema)


class FileWriter(DataSourceWriter):
    """Files under temporary names, renamed when all tasks are done and deleted when one fails."""

    def __init__(self, options: dict[str, str]) -> None:
        self.where = options["path"].rstrip("/")

    def begun(self) -> tuple[fs.FileSystem, str]:
        store, path = store_of(self.where)
        store.create_dir(path, recursive=True)
        return store, path

    def commit(self, messages: list[Any]) -> None:
        store, _ = store_of(self.where)
        for message in messages:
            for temporary, name in message.renames if message else []:
                store.move(temporary, name)

    def abort(self, messages: list[Any]) -> None:
        store, _ = store_of(self.where)
        for message in messages:
            for temporary, _ in message.renames if message else []:
                store.delete_file(temporary)


def registered(spark: SparkSession, source: type[DataSource]) -> str:
    """The name by which a session knows a source."""
    ship(spark)
    spark.dataSource.register(source)
    return source.name()


def load(spark: SparkSession, source: type[DataSource], path: str, schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(registered(spark, source)).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
