"""What the operators share: tables, shared storage, and bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.sources.scratch import shared_dir
from glasspane.sources.workers import ship

#: Rows and characters that one task holds in Python at a time.
BLOCK_ROWS, BLOCK_CHARS = 2_000, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, where: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here and
    a lost executor loses nothing."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    df.write.mode("overwrite").parquet(where)
    found = spark.read.schema(df.schema).parquet(where)
    found._glasspane_folder = where
    return found


def release(*frames: DataFrame) -> None:
    """Delete what stored() wrote for frames that nothing reads any more."""
    for df in frames:
        if where := getattr(df, "_glasspane_folder", None):
            store, path = fs.FileSystem.from_uri(where)
            store.delete_dir(path)


def placed(docs: DataFrame) -> DataFrame:
    """docs with __file and __row: a hash of the path of the file that a row is read from, and its
    place there. What isn't just a table of files is stored first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = stored(docs)
    return docs.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """placed() rows but those that gone (file, row) lists, in a narrow pass: the list is stored in
    order of files, some in a folder, and a task looks up that of the file it reads. So texts are never
    shuffled, however long the list is, and there are as many folders however many files."""
    spark = rows.sparkSession
    ship(spark)
    where, folders = shared_dir(spark), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = gone.select("file", "row", F.expr(f"pmod(file, {folders})").cast("int").alias("folder"))
    kept.repartition(folders, "folder").sortWithinPartitions("folder", "file", "row").write.partitionBy("folder").parquet(where)

    def listed(file: int) -> np.ndarray:
        store, root = fs.FileSystem.from_uri(where)
        found = store.get_file_info(fs.FileSelector(f"{root}/folder={file % folders}", allow_not_found=True))
        parts = [pq.read_table(x.path, filesystem=store, columns=["row"], filters=[("file", "==", file)], partitioning=None)["row"].to_numpy() for x in found if x.base_name.endswith(".parquet")]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    @F.pandas_udf("boolean")
    def stays(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        now, gone = None, None
        for file, row in batches:
            keep = np.ones(len(file), bool)
            for f in file.unique():
                if f != now:
                    now, gone = f, listed(int(f))
                keep &= ~((file == f).to_numpy() & np.isin(row.to_numpy(), gone))
            yield pd.Series(keep)

    return rows.where(stays("__file", "__row")).drop("__file", "__row")


def utf8(column: str = "text"):
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def blocks(batches: Iterable[pa.RecordBatch], column: str, max_rows: int = BLOCK_ROWS, max_bytes: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with a bounded number of rows and bytes of a binary column; a
    single row may exceed the bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        yield batch.slice(start)


def per_block(df: DataFrame, column: str, make: Callable[[], Callable[[dict], dict]], schema: str, max_rows: int = BLOCK_ROWS, max_bytes: int = BLOCK_CHARS) -> DataFrame:
    """Apply make()'s function to blocks of df, as dicts of column lists in and out.

    make runs once a task, so that tables it builds are built there.
    """
    spark = df.sparkSession
    ship(spark)
    target = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches):
        work = make()
        for block in blocks(batches, column, max_rows, max_bytes):
            out = work(block.to_pydict())
            arrays = [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type, from_pandas=True) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)
