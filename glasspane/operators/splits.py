"""Splits, folds and samples that depend on a seed and the rows' keys alone.

Ranks come from hash_rank, so a class or a kind of group may hold most of the rows.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glasspane.operators.ranks import draws, hash_rank

SEED = 42
#: Leading bits that a class count is told apart by: those below 16 are exact, larger ones within an eighth.
KIND_BITS = 4


def stratified_split(df: DataFrame, label: str, keys: list[str], test_size: float, names: tuple[str, str] = ("train", "test"), seed: int = SEED) -> DataFrame:
    """df with a column split. The test part has ceil(n * test_size) rows, shared among the
    classes in proportion (largest remainders first; ties by class). keys identify a row."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    all_rows = W.partitionBy(F.lit(0))  # one row for each class
    exact = F.ceil(F.sum("n").over(all_rows) * F.lit(test_size)) * F.col("n") / F.sum("n").over(all_rows)
    shares = counts.withColumn("__exact", exact).withColumn("__low", F.floor("__exact"))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(F.col("__exact") - F.col("__low")), label)
    spare = F.round(F.sum("__exact").over(all_rows)).cast("bigint") - F.sum("__low").over(all_rows)
    quota = shares.withColumn("__quota", F.col("__low") + F.when(F.row_number().over(order) <= spare, 1).otherwise(0)).select(label, "__quota")
    ranked = hash_rank(df, [label], keys, seed, "__rank").join(quota, label)
    split = F.when(F.col("__rank") <= F.col("__quota"), names[1]).otherwise(names[0])
    return ranked.withColumn("split", split).select(*df.columns, "split")


def _deal(kinds: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """How many groups of each kind go to each fold. kinds: class counts of a group of the
    kind (their mean); sizes: how many such groups. Whole rounds are dealt evenly; what is left goes, largest
    spread of counts first, to the fold that keeps class shares most even, then to the one with
    the fewest rows."""
    quota = np.repeat((sizes // k)[:, None], k, 1)
    total = np.maximum((kinds * sizes[:, None]).sum(0), 1)
    folds = (quota[:, :, None] * kinds[:, None, :]).sum(0).astype(float)
    for i in np.argsort(-kinds.std(1).round(9), kind="stable"):
        for _ in range(int(sizes[i] % k)):
            trial = np.repeat(folds[None], k, 0)
            trial[np.arange(k), np.arange(k)] += kinds[i]
            uneven = (trial / total).std(1).mean(1)
            best = min(range(k), key=lambda f: (round(uneven[f], 12), folds[f].sum(), f))
            quota[i, best] += 1
            folds[best] += kinds[i]
    return quota


def _kind(count: Column) -> Column:
    """A count with its leading bits alone."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(count)) - KIND_BITS, F.lit(0)))
    return (F.floor(count / step) * step).cast("bigint")


def group_folds(df: DataFrame, label: str, group: str, k: int, seed: int = SEED) -> DataFrame:
    """group and fold (0 to k-1): no group is in two folds, classes are spread evenly.

    Groups are dealt by kind: the class counts' leading bits. Of each kind only the mean counts and how many
    groups it has come to the driver, and there are as many kinds as octaves, not as groups: a few hundred
    for two classes. Which groups of a kind go where is a ranked hash. Null groups and labels are left out.
    """
    if k < 2:
        raise ValueError("there must be at least two folds")
    rows = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    counts = rows.groupBy(group).agg(F.array(*(F.count_if(F.col(label) == c) for c in classes)).alias("__counts")).withColumn("kind", F.transform("__counts", _kind))
    mean = F.array(*(F.avg(F.col("__counts")[i]) for i in range(len(classes))))
    kinds = counts.groupBy("kind").agg(F.count("*").alias("n"), mean.alias("mean")).orderBy("kind").collect()
    if not kinds:
        return counts.select(group, F.lit(0).alias("fold"))
    quota = _deal(np.array([r.mean for r in kinds], float), np.array([r.n for r in kinds]), k)
    ends = np.cumsum(quota, 1)
    bounds = [(r.kind, f, int(ends[i, f] - quota[i, f]), int(ends[i, f])) for i, r in enumerate(kinds) for f in range(k) if quota[i, f]]
    table = df.sparkSession.createDataFrame(bounds, "kind array<bigint>, fold int, after long, upto long")
    ranked = hash_rank(counts, ["kind"], [group], seed, "__rank")
    return ranked.join(table, "kind").where("__rank > after and __rank <= upto").select(group, "fold")


def with_folds(df: DataFrame, label: str, group: str, k: int, seed: int = SEED) -> DataFrame:
    return df.join(group_folds(df, label, group, k, seed), group, "left").select(*df.columns, "fold")


def group_split(df: DataFrame, label: str, group: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """df with a column split: of round(1 / test_size) folds the one whose class shares are the
    closest (sum of absolute differences) to the whole's is the test part. A fold that lacks a
    class is taken only if the first fold is no better."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    k = round(1 / test_size)
    if k < 2:
        raise ValueError(f"test_size {test_size} leaves a single fold")
    if abs(1 / k - test_size) > 0.05:
        warnings.warn(f"the test part is about {1 / k:.2f} of the groups, not {test_size:.2f}", stacklevel=2)
    folds = with_folds(df, label, group, k, seed)
    counts = folds.where(F.col("fold").isNotNull()).groupBy("fold", label).agg(F.count("*").alias("n")).collect()
    whole: dict = {}
    for r in counts:
        whole[r[label]] = whole.get(r[label], 0) + r.n
    best, least = 0, None
    for f in range(k):
        own = {r[label]: r.n for r in counts if r.fold == f}
        gap = math.inf if len(own) != len(whole) else sum(abs(own[c] / sum(own.values()) - n / sum(whole.values())) for c, n in whole.items())
        if least is None or gap < least:
            best, least = f, gap
    return folds.withColumn("split", F.when(F.col("fold") == best, "test").otherwise("train")).drop("fold")


def inverse_class_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight = 1 / rows of the same class; weights add up to the number of classes."""
    counts = df.groupBy(label).agg((1.0 / F.count("*")).alias("weight"))
    return df.join(counts, label).select(*df.columns, "weight")


def weighted_sample(df: DataFrame, label: str, keys: list[str], n: int | None = None, seed: int = SEED) -> DataFrame:
    """n rows (as many as df has, if none is said) drawn with replacement, each with the probability of its inverse class weight:
    a draw picks a class, all alike, and then a row of it by rank. Adds draw, 0 to n-1."""
    spark = df.sparkSession
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    order = W.partitionBy(F.lit(0)).orderBy(label)  # one row for each class
    classes = counts.withColumns({"__class": F.row_number().over(order) - 1, "__k": F.count("*").over(W.partitionBy(F.lit(0)))})
    k = classes.agg(F.max("__k").alias("k"))
    if n is None:  # each row gives the number of a draw
        numbers = hash_rank(df.select(*keys).withColumn("__all", F.lit(0)), ["__all"], keys, seed, "__draw").select((F.col("__draw") - 1).alias("draw"))
    else:
        numbers = spark.range(n).withColumnRenamed("id", "draw")
    drawn = draws(numbers.crossJoin(k), F.col("draw") * 2, F.col("k"), "__class", seed)
    drawn = drawn.join(classes.select(F.col(label).alias("__label"), "__class", "__n"), "__class")
    drawn = draws(drawn, F.col("draw") * 2 + 1, F.col("__n"), "__place", seed).select("draw", "__label", (F.col("__place") + 1).alias("__rank"))
    ranked = hash_rank(df, [label], keys, seed, "__rank")
    return drawn.join(ranked, (F.col("__label") == F.col(label)) & (drawn["__rank"] == ranked["__rank"])).select(*df.columns, "draw")
