"""Predicates over slides and tiles. Each becomes one Filter that Catalyst can push down.

A NaN fails every comparison here (Spark alone would rank it above all numbers), as does a null.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX, LABEL, TISSUE = "percentage", "carcinoma", "tissue"


def _ordered(value: Column) -> Column:
    return ~F.isnan(value) & value.isNotNull()


def above(value: Column, threshold: float) -> Column:
    return _ordered(value) & (value > F.lit(threshold))


def at_most(value: Column, threshold: float) -> Column:
    return _ordered(value) & (value <= F.lit(threshold))


def at_least(value: Column, threshold: float) -> Column:
    return _ordered(value) & (value >= F.lit(threshold))


def threshold_predicate(columns: Iterable[str], thresholds: Mapping[str, float]) -> Column:
    """Conjunction over all *percentage columns but the label's: tissue above its threshold,
    every other at most. The key of a column's threshold ends in t for percentage; a column
    without one is an error."""
    wanted = sorted(c for c in columns if c.endswith(SUFFIX) and LABEL not in c)
    keys = {c: c.removesuffix(SUFFIX) + "t" for c in wanted}
    if lost := [k for k in keys.values() if k not in thresholds]:
        raise KeyError(f"no threshold {', '.join(lost)}")
    tests = [(above if TISSUE in c else at_most)(F.col(c), thresholds[k]) for c, k in keys.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_tiles(tiles: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    return tiles.where(threshold_predicate(tiles.columns, thresholds))


def drop_empty_tissue(tiles: DataFrame, column: str = "tissue_roi_percentage") -> DataFrame:
    return tiles.where(above(F.col(column), 0.0))


def stratified_filter(tiles: DataFrame, slide_label: str, tile_label: str) -> DataFrame:
    """Negative tiles of positive slides go."""
    return tiles.where(~(F.col(slide_label) & ~F.col(tile_label)))


def complete_cases(metadata: DataFrame, *flags: str) -> DataFrame:
    """Rows where every flag holds."""
    return metadata.where(reduce(lambda a, b: a & b, map(F.col, flags)))


def split_by(df: DataFrame, column: str, values: Iterable[str]) -> dict[str, DataFrame]:
    return {v: df.where(F.col(column) == v) for v in values}


def excluding(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the other table; null keys stay."""
    return df.join(excluded.select(key), key, "left_anti").select(df.columns)


def keeping(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return df.join(wanted.select(key), key, "left_semi").select(df.columns)


def not_listed(df: DataFrame, column: str, blacklist: Iterable[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*blacklist))


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text matches; others are skipped without an error."""
    return df.where(F.col(column).rlike(pattern))


def mispredictions(df: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Rows where the two differ; a missing value differs from any other."""
    return df.where(~F.col(prediction).eqNullSafe(F.col(target)))


def of_slide(tiles: DataFrame, slide_id: str | int) -> DataFrame:
    return tiles.where(F.col("slide_id") == slide_id)


def last_digit_label(stem: Column) -> Column:
    """The 0 or 1 that ends a stem, as boolean; another ending raises."""
    last = F.substring(stem, -1, 1)
    return F.when(last.isin("0", "1"), last == "1").otherwise(F.raise_error(F.concat(F.lit("no label in "), stem)).cast("boolean"))
