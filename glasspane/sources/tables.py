"""Readers and writers: CSV, Parquet pairs, JSON split tables, XML annotations, listings."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glasspane.functions.text import last_token
from glasspane.operators.statistics import union_by_name

#: Schemas of the core tables.
SLIDES = "id string, path string, extent_x int, extent_y int, tile_extent_x int, tile_extent_y int, stride_x int, stride_y int, mpp_x double, mpp_y double, level int, downsample double, carcinoma boolean"
TILES = "slide_id string, x int, y int"
METADATA = "slide_path string, carcinoma boolean, case_id string, patient_id string, isup_grade double, gleason_score string, case_carcinoma boolean, perineural_invasions boolean"
#: Rows that write_json_split takes to the driver, at most: such files hold small result tables.
MAX_JSON_ROWS = 1_000_000
#: Files that a task of write_sharded writes, about, where rows a file are bounded.
TASK_FILES = 100


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """With a header; without a schema types are inferred, which reads the file twice."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder with a file a task, or with one (small tables)."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def read_dataset(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """The slides and tiles of a dataset folder; no path gives no frames."""
    if not path:
        return None, None
    return spark.read.parquet(f"{path}/slides.parquet"), spark.read.parquet(f"{path}/tiles.parquet")


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows of several Parquet tables of one schema."""
    return spark.read.parquet(*paths)


def write_dataset(slides: DataFrame, tiles: DataFrame, path: str) -> None:
    slides.write.mode("overwrite").parquet(f"{path}/slides.parquet")
    tiles.write.mode("overwrite").parquet(f"{path}/tiles.parquet")


def write_sharded(df: DataFrame, path: str, max_rows: int | None = None, min_rows: int | None = None) -> None:
    """Files of at most max_rows rows, or of about min_rows or more. Where max_rows makes many files, rows are
    spread so that a task writes about TASK_FILES, however few tasks the table is read by."""
    if min_rows:
        df = df.repartition(max(1, math.floor(df.count() / min_rows)))
    elif max_rows and (files := math.ceil(df.count() / max_rows)) > TASK_FILES:
        df = df.repartition(math.ceil(files / TASK_FILES))
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).parquet(path)


def read_json_split(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """A {"columns": [...], "data": [[...]]} file; columns without a type are strings. One file
    is one record: this form is for small result tables."""
    raw = spark.read.schema("columns array<string>, data array<array<string>>").json(path, multiLine=True)
    columns = raw.select("columns").first()["columns"]
    rows = raw.select(F.explode("data").alias("row"))
    return rows.select(*(F.col("row")[i].cast((types or {}).get(c, "string")).alias(c) for i, c in enumerate(columns)))


def write_json_split(df: DataFrame, path: str) -> None:
    """A folder with one such file, on any file system that Spark writes to."""
    rows = df.limit(MAX_JSON_ROWS + 1).collect()
    if len(rows) > MAX_JSON_ROWS:
        raise ValueError(f"more than {MAX_JSON_ROWS} rows: write Parquet")
    text = json.dumps({"columns": df.columns, "index": list(range(len(rows))), "data": [list(r) for r in rows]})
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def list_files(spark: SparkSession, folder: str, pattern: str, nested: bool = False) -> DataFrame:
    """path and length of the files that match, also of folders below if nested; their contents
    aren't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", nested)
    return reader.load(folder).select("path", "length")


def read_annotations(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """path, part_of_group and the vertices (array of x, y in order) of each annotation; all
    groups, or one. An annotation without the attribute raises when it is read."""
    schema = "Coordinates struct<Coordinate: array<struct<_Order: int, _X: double, _Y: double>>>, _PartOfGroup string"
    raw = spark.read.format("xml").option("rowTag", "Annotation").schema(schema).load(path).withColumn("path", F.col("_metadata.file_path"))
    part = F.when(F.col("_PartOfGroup").isNotNull(), F.col("_PartOfGroup")).otherwise(F.raise_error(F.lit("annotation without PartOfGroup")))
    ordered = F.array_sort("Coordinates.Coordinate")
    out = raw.select("path", part.alias("part_of_group"), F.transform(ordered, lambda c: F.struct(c["_X"].alias("x"), c["_Y"].alias("y"))).alias("vertices"))
    return out.where(F.col("part_of_group") == group) if group else out


def metrics_as_rows(df: DataFrame, metrics: str = "metrics", extra: dict[str, float] | None = None) -> DataFrame:
    """stem and value for each entry of a map column: the key's last "_" token without ".svs";
    extra entries are added."""
    rows = df.select(F.explode(metrics).alias("key", "value")).select(F.replace(last_token(F.col("key")), F.lit(".svs"), F.lit("")).alias("stem"), F.col("value").cast("double").alias("value"))
    if extra:
        rows = rows.unionByName(df.sparkSession.createDataFrame(list(extra.items()), "stem string, value double"))
    return rows


def read_quality_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV reports one after another; a column that one lacks is null there."""
    return union_by_name(*(read_csv(spark, p) for p in paths))


def enriched(df: DataFrame, key: str, call: Callable[[str], str], attempts: int = 4, wait: Callable[[float], None] | None = None, concurrency: int = 5) -> DataFrame:
    """key, result, error of a remote call for each row, several at a time in each task.

    A RuntimeError is tried again after 1, 2, 4, ... seconds; a TimeoutError ends the row's
    attempts at once; any other error is kept as text. One row never stops the others.
    """

    def one(value: str) -> tuple[str | None, str | None]:
        import time

        pause = wait or time.sleep
        for n in range(attempts):
            try:
                return call(value), None
            except TimeoutError as error:
                return None, f"timeout: {error}"
            except RuntimeError as error:
                if n + 1 == attempts:
                    return None, str(error)
                pause(2.0**n)
            except Exception as error:
                return None, f"{type(error).__name__}: {error}"
        return None, "no attempt"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                found = list(pool.map(one, frame[key]))
                yield pd.DataFrame({key: frame[key], "result": [r for r, _ in found], "error": [e for _, e in found]})

    return df.select(key).mapInPandas(run, f"{key} string, result string, error string")


def organised(listing: DataFrame, folders: dict[str, str]) -> DataFrame:
    """path and target of files whose name begins with one of the prefixes; others are left out.
    Of several prefixes that fit the longest counts."""
    name = F.element_at(F.split("path", "/"), -1)
    target = F.lit(None).cast("string")
    for prefix, folder in sorted(folders.items(), key=lambda x: len(x[0])):
        target = F.when(name.startswith(prefix), F.concat(F.lit(folder + "/"), name)).otherwise(target)
    return listing.select("path", target.alias("target")).where("target is not null")
