"""Sharded storage with size-tiered compaction and versioned manifests.

A store is a folder: data/ holds immutable Parquet shards, manifest/ lists of shards and a folder
for each version, which counts once it is there. Appending writes an arrival as small shards and
commits a version that adds one list to those before. Compaction puts the shards that are smaller
than half the target into tiers by size, each FANOUT times the one below; a tier with at least
FANOUT shards is merged into files of about the target, read and written without a shuffle: Spark
packs whole files into tasks of the target's size, the like-sized together. It commits a version
with one new list.

A commit is the rename of a folder that only this writer has to the version's name, which fails if
another writer's is there. Who loses commits again after that version: nobody's rows are lost. The
file system must rename folders atomically (local, HDFS and the like). Readers see one version,
whole. expire() deletes versions, their lists and the shards that they listed and no kept version
does; what a writer is about to commit is in no version, so it is safe.

An append of no rows commits a version without new shards. Columns are kept as they are, repeated
rows and nulls too.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

TARGET_BYTES, FANOUT, SMALLEST = 128 << 20, 4, 1 << 20
#: Small shards that one round of compaction merges, at most; rounds go on until none is left.
ROUND = 10_000
ENTRY = "path string, bytes bigint, rows bigint"
#: Arrivals of the query: one more than FANOUT, so that tiers fill at any size.
ARRIVALS = FANOUT + 1


@contextmanager
def _settings(spark: SparkSession, **values: str):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tier(size: Column | str = "bytes", fanout: int = FANOUT) -> Column:
    """0 for shards of less than FANOUT x SMALLEST bytes, 1 for less than FANOUT times that, ..."""
    return F.greatest(F.lit(0), F.floor(F.log(F.col(size) / SMALLEST) / math.log(fanout) + 1e-9)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        self.files, self.root = fs.FileSystem.from_uri(self.where)
        self.files.create_dir(f"{self.root}/manifest", recursive=True)

    def versions(self) -> list[int]:
        """The committed versions that are kept, in order."""
        listed = self.files.get_file_info(fs.FileSelector(f"{self.root}/manifest"))
        return sorted(int(x.base_name[1:]) for x in listed if x.type == fs.FileType.Directory and re.fullmatch(r"v\d{8}", x.base_name))

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, bytes and rows of each shard."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*(f"{self.where}/manifest/{x}" for x in self._marker(version)["lists"]))

    def _marker(self, version: int) -> dict:
        with self.files.open_input_stream(f"{self.root}/manifest/v{version:08d}/marker.json") as marker:
            return json.loads(marker.read())

    def _folder(self, name: str) -> str:
        """A data folder that no other writer, dead or alive, writes to."""
        return f"{self.where}/data/{name}-{uuid.uuid4().hex[:12]}"

    def _entries(self, folder: str, schema) -> DataFrame:
        shards = self.spark.read.schema(schema).parquet(folder)
        m = shards.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return m.groupBy("path", "bytes").agg(F.count("*").alias("rows"))

    def _list(self, entries: DataFrame) -> str:
        """Write a list of shards; its name."""
        name = f"list-{uuid.uuid4().hex[:12]}"
        entries.write.parquet(f"{self.where}/manifest/{name}")
        return name

    def _commit(self, lists: list[str], schema, version: int) -> None:
        """Make these lists the version; FileExistsError if another writer has it."""
        writer = uuid.uuid4().hex
        temp, final = (f"{self.root}/manifest/{x}" for x in (f".new-{writer}", f"v{version:08d}"))
        self.files.create_dir(temp)
        with self.files.open_output_stream(f"{temp}/marker.json") as out:
            out.write(json.dumps({"version": version, "writer": writer, "lists": lists, "schema": schema.jsonValue()}).encode())
        try:
            self.files.move(temp, final)
        except OSError as error:
            if self.files.get_file_info(final).type == fs.FileType.NotFound:
                raise
            self.files.delete_dir(temp)
            raise FileExistsError(f"version {version} was committed by another writer") from error
        if self._marker(version)["writer"] != writer:  # a file system that moved it into the other's
            raise FileExistsError(f"version {version} was committed by another writer")

    def append(self, rows: DataFrame, max_rows: int = 20_000) -> int:
        """Commit an arrival as small shards (one or more a task); the new version."""
        folder = self._folder(f"a{self.version() + 1:08d}")
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", max_rows).parquet(folder)
        added = self._list(self._entries(folder, rows.schema))
        while True:
            version = self.version()
            try:
                self._commit([*(self._marker(version)["lists"] if version else []), added], rows.schema, version + 1)
                return version + 1
            except FileExistsError:
                continue

    def due(self, manifest: DataFrame, target: int = TARGET_BYTES, fanout: int = FANOUT) -> dict[int, list[str]]:
        """The shards of each tier that is to be merged."""
        small = manifest.where(F.col("bytes") < target // 2).select("path", tier("bytes", fanout).alias("tier")).orderBy("tier", "path").limit(ROUND).collect()
        tiers: dict[int, list[str]] = {}
        for r in small:
            tiers.setdefault(r.tier, []).append(r.path)
        return {t: paths for t, paths in tiers.items() if len(paths) >= fanout}

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge tiers until none has `fanout` shards; the version then. What another writer
        commits meanwhile is taken up anew."""
        while True:
            version, now = self.version(), self.manifest()
            merges = self.due(now, target, fanout)
            if not merges:
                return version
            schema = self.schema(version)
            added, folders = None, []
            for t, paths in sorted(merges.items()):
                folders.append(self._folder(f"c{version + 1:08d}-t{t}"))
                with _settings(self.spark, **{"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}):
                    self.spark.read.schema(schema).parquet(*paths).write.option("compression", "zstd").parquet(folders[-1])
                entries = self._entries(folders[-1], schema)
                added = entries if added is None else added.union(entries)
            merged = self.spark.createDataFrame([(p,) for paths in merges.values() for p in paths], "path string")
            after = self._list(now.join(F.broadcast(merged), "path", "left_anti").select(now.columns).union(added))
            try:
                self._commit([after], schema, version + 1)
            except FileExistsError:
                for name in (f"manifest/{after}", *(folder.removeprefix(f"{self.where}/") for folder in folders)):
                    self.files.delete_dir(f"{self.root}/{name}")
                continue
            if self.manifest(version + 1).count() >= now.count():  # nothing left to gain
                return version + 1

    def schema(self, version: int):
        from pyspark.sql.types import StructType

        return StructType.fromJson(self._marker(version)["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; _metadata tells their shards. The driver has their paths."""
        version = version or self.version()
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], self.schema(version)) if version else self.spark.createDataFrame([], "empty int")
        return self.spark.read.schema(self.schema(version)).parquet(*paths)

    def expire(self, keep: int = 1) -> None:
        """Delete all but the newest versions, and the lists and shards that only those have."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return
        live = {x for v in kept for x in self._marker(v)["lists"]}
        gone = {x for v in old for x in self._marker(v)["lists"]} - live
        if gone:
            listed = lambda names: self.spark.read.schema(ENTRY).parquet(*(f"{self.where}/manifest/{x}" for x in sorted(names))).select("path")
            for r in listed(gone).distinct().join(listed(live), "path", "left_anti").toLocalIterator():
                self.files.delete_file(f"{self.root}/data/{'/'.join(r.path.rsplit('/', 2)[1:])}")
        for name in gone:
            self.files.delete_dir(f"{self.root}/manifest/{name}")
        for v in old:
            self.files.delete_dir(f"{self.root}/manifest/v{v:08d}")


def op6_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS parts, by hash of doc_id, and tiers are merged after each; read
    back, each with its length (null text: 0) and the digest of its text and the shard that holds it."""
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, shared_dir(spark))
    for part in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == part))
        store.compact()
    store.expire()
    rows = store.read()
    name = r"/data/([ac]\d+(?:-t\d+)?)-[0-9a-f]+/part-(\d+)"
    shard = F.concat_ws("/", *(F.regexp_extract("_metadata.file_path", name, i) for i in (1, 2)))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.char_length(text).cast("bigint").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), shard.alias("shard"))
