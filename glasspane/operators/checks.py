"""Integrity checks. Those named assert_* run an action and raise; the others stay lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if lost := [n for n in names if n not in df.columns]:
        raise KeyError(f"no such column: {', '.join(lost)}")
    return df


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Like DataFrame.drop, but a column that isn't there is an error."""
    return require_columns(df, *names).drop(*names)


def required(value: Column, message: str) -> Column:
    """The value; a null raises when the row is read."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    if rows := repeated_keys(df, *keys).limit(5).collect():
        raise ValueError(f"{keys} isn't unique, e.g. {[tuple(r[k] for k in keys) for r in rows]}")
    return df


def assert_no_nulls(df: DataFrame, column: str, message: str | None = None) -> DataFrame:
    if not df.where(F.col(column).isNull()).isEmpty():
        raise ValueError(message or f"missing {column}")
    return df


def leaking_groups(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups with rows in more than one fold."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def without_leak(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """df; a row whose group lies in several folds raises when it is read."""
    leaks = leaking_groups(df, group, fold).select(F.col(group).alias("__leak"))
    bad = F.raise_error(F.concat(F.lit(f"in more than one {fold}: {group} "), F.col(group).cast("string")))
    kind = df.schema[fold].dataType
    return df.join(leaks, F.col(group) == F.col("__leak"), "left").withColumn(fold, F.when(F.col("__leak").isNull(), F.col(fold)).otherwise(bad.cast(kind))).drop("__leak")


def assert_no_leak(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    if not leaking_groups(df, group, fold).isEmpty():
        raise ValueError(f"a {group} lies in more than one {fold}")
    return df


def partition_counts(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """One row: rows of the whole, rows of all parts, keys that several parts have, and whether the
    parts are a partition of the whole."""
    long = None
    for i, p in enumerate(parts):
        one = p.select(F.lit(i).alias("part"), F.col(key).alias("key"))
        long = one if long is None else long.union(one)
    keys = long.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"))
    sums = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_parts"), F.count_if(F.col("parts") > 1).alias("shared_keys"))
    found = whole.agg(F.count("*").alias("in_whole")).crossJoin(sums)
    return found.withColumn("complete", (F.col("in_whole") == F.col("in_parts")) & (F.col("shared_keys") == 0))


def assert_partition(whole: DataFrame, parts: list[DataFrame], key: str) -> None:
    """The parts are disjoint by key and together as many rows as the whole."""
    found = partition_counts(whole, parts, key).first()
    if found.shared_keys:
        raise ValueError(f"two parts share a {key}")
    if not found.complete:
        raise ValueError("the parts don't add up to the whole")
