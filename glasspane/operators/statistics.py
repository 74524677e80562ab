"""Distributions, moments, sets and resampled comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a task holds what it drew as an array; with more, draws are joined and summed as rows.
HELD_ROWS = 2_000_000
#: Draws that a task is dealt (one replicate at least), and that it lists at a time.
TASK_DRAWS, CHUNK = 4_000_000, 16_384


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """value, n and share of each value; nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows, positives and negatives."""
    t = F.col(label).cast("boolean")
    return df.agg(F.count("*").alias("n"), F.count_if(t).alias("positives"), F.count_if(~t).alias("negatives"))


def largest_group(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))


def aligned_shares(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """source, value, share: every value that any table has, 0 where a table lacks it."""
    long = None
    for name, df in tables.items():
        one = value_shares(df, column).select(F.lit(name).alias("source"), "value", "share")
        long = one if long is None else long.union(one)
    grid = long.select("value").distinct().crossJoin(df.sparkSession.createDataFrame([(n,) for n in tables], "source string"))
    return grid.join(long, ["source", "value"], "left").select("source", "value", F.coalesce("share", F.lit(0.0)).alias("share"))


def distribution_distance(one: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """distance: sum of absolute differences of shares; infinite if either lacks a value."""
    a, b = (value_shares(x, column).select("value", F.col("share").alias(n)) for x, n in ((one, "p"), (other, "q")))
    both = a.join(b, "value", "full")
    lost = F.count_if(F.col("p").isNull() | F.col("q").isNull()) > 0
    return both.agg(F.when(lost, F.lit(float("inf"))).otherwise(F.coalesce(F.sum(F.abs(F.col("p") - F.col("q"))), F.lit(0.0))).alias("distance"))


def channel_moments(df: DataFrame, channels: list[str], digits: int = 4) -> DataFrame:
    """channel, n, mean and population standard deviation, rounded half to even; one pass of
    partial sums over all channels, rows without a value or with NaN left out."""
    entries = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("x")) for c in channels)))
    long = df.select(entries.alias("e")).select("e.channel", "e.x").where("x is not null and not isnan(x)")
    return long.groupBy("channel").agg(F.count("*").alias("n"), F.bround(F.avg("x"), digits).alias("mean"), F.bround(F.stddev_pop("x"), digits).alias("std"))


def inverse_cdf(df: DataFrame, column: str, thresholds: int = 100, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """step, threshold and n, the rows strictly above it, for equally spaced thresholds. Each row
    adds to the last threshold below it; a running sum over the steps does the rest."""
    from pyspark.sql import Window as W

    spark = df.sparkSession
    width = (high - low) / (thresholds - 1)
    grid = spark.range(thresholds).select(F.col("id").cast("int").alias("step"), (F.lit(low) + F.col("id") * F.lit(width)).alias("threshold"))
    x = F.col(column)
    guess = F.floor((x - low) / width).cast("int")
    # the product above decides, so a guess that rounding put one off is set right
    at = lambda s: F.lit(low) + s * F.lit(width)
    step = F.when(x > at(guess + 1), guess + 1).when(x > at(guess), guess).otherwise(guess - 1)
    clipped = F.when(x > high, F.lit(thresholds - 1)).when(x <= low, F.lit(-1)).otherwise(F.least(step, F.lit(thresholds - 1)))
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(clipped.alias("step")).agg(F.count("*").alias("n"))
    filled = grid.join(counts, "step", "left")
    above = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0))
    return filled.select("step", "threshold", above.alias("n"))


def quality_sweep(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """measure and n, the rows at or above the measure's limit."""
    entries = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(f"`{c}`").cast("double").alias("x"), F.lit(float(t)).alias("limit")) for c, t in limits.items())))
    long = df.select(entries.alias("e")).select("e.measure", "e.x", "e.limit")
    return long.groupBy("measure").agg(F.count_if(~F.isnan("x") & (F.col("x") >= F.col("limit"))).alias("n"))


def resampled_aucs(df: DataFrame, key: str, target: str, scores: list[str], n_boot: int, seed: int = 42) -> DataFrame:
    """replicate and the auc of each score column (under its place in scores, "0", "1", ...) over
    resamples with replacement; null where a class is absent. df must be unique in key.

    Each of n_boot x n draws takes the row whose place (by hash) comes from the draw's number, so
    every run gives the same result, and all scores share the draws. Up to HELD_ROWS rows a replicate is
    drawn and folded in one task (resampling.folded_aucs); of more rows than a task can hold the same draws
    are counted and summed by joins.
    """
    from pyspark.sql import Window as W

    from glasspane.operators.ranks import draws, hash_rank
    from glasspane.operators.resampling import folded_aucs

    spark = df.sparkSession
    sides = [f"__s{i}" for i in range(len(scores))]
    plain = df.select(key, F.col(target).cast("int").alias("__t"), *(F.col(f"`{c}`").cast("double").alias(s) for s, c in zip(sides, scores, strict=True)))
    rows = hash_rank(plain.withColumn("__all", F.lit(0)), ["__all"], [key], seed, "place").select("place", "__t", *sides)
    n = max(df.count(), 1)
    kinds = rows.groupBy("__t", *sides).agg(F.min("place").alias("kind"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("__t", *sides)]
    places = rows.alias("r").join(kinds.alias("k"), same).select("place", "kind")
    entries = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(s).alias("score")) for i, s in enumerate(sides))))
    known = kinds.where("__t is not null").select("kind", "__t", entries.alias("e")).select("kind", "__t", "e.side", "e.score")
    known = known.where("not isnan(score) and abs(score) < double('infinity')")
    if n <= HELD_ROWS:
        return folded_aucs(places, known.withColumnRenamed("__t", "target"), len(sides), n, n_boot, seed)

    tasks = min(n_boot, max(4 * spark.sparkContext.defaultParallelism, n_boot * n // TASK_DRAWS))
    drawn = spark.range(n_boot).select(F.col("id").alias("replicate")).repartition(max(tasks, 1), "replicate")
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"), F.lit(CHUNK).cast("bigint")))
    drawn = drawn.select("replicate", first.alias("first"))
    drawn = drawn.select("replicate", F.explode(F.sequence("first", F.least(F.col("first") + (CHUNK - 1), F.lit(n - 1).cast("bigint")))).alias("draw"))
    drawn = draws(drawn, F.col("replicate") * n + F.col("draw"), F.lit(n), "place", seed).select("replicate", (F.col("place") + 1).alias("place"))
    counts = drawn.join(places, "place").groupBy("replicate", "kind").agg(F.count("*").alias("n"))
    points = counts.join(known, "kind").groupBy("replicate", "side", "score").agg(F.sum(F.col("n") * F.col("__t")).alias("tp"), F.sum(F.col("n") * (1 - F.col("__t"))).alias("fp"))
    below = F.sum("fp").over(W.partitionBy("replicate", "side").orderBy("score").rowsBetween(W.unboundedPreceding, 0))
    area = F.sum(F.col("tp") * (F.col("below") - F.col("fp") / 2.0))
    aucs = points.withColumn("below", below).groupBy("replicate", "side").agg(F.try_divide(area, F.sum("tp") * F.sum("fp").cast("double")).alias("auc"))
    return aucs.groupBy("replicate").agg(*(F.max(F.when(F.col("side") == i, F.col("auc"))).alias(str(i)) for i in range(len(scores))))


def bootstrap_auc_differences(df: DataFrame, key: str, target: str, base: str, other: str, n_boot: int, seed: int = 42) -> DataFrame:
    """replicate and delta = AUC(other) - AUC(base) over resamples with replacement (see
    resampled_aucs); resamples with a single class are left out."""
    return resampled_aucs(df, key, target, [base, other], n_boot, seed).select("replicate", (F.col("1") - F.col("0")).alias("delta")).where("delta is not null")


def non_inferiority(deltas: DataFrame, margin: float = 0.02, by: list[str] | None = None) -> DataFrame:
    """n, mean_delta, the 2.5, 97.5 and 95 percentiles (exact, linear between rows) of the deltas
    AUC(other) - AUC(base), and whether the last lies below the margin: then the base is not
    worse than the other by more than that."""
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975), F.lit(0.95)))
    out = deltas.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), q.alias("q"))
    names = ("ci_95_lower", "ci_95_upper", "upper_95")
    return out.select(*(by or []), "n", "mean_delta", *(F.col("q")[i].alias(c) for i, c in enumerate(names)), (F.col("q")[2] < margin).alias("non_inferior"))


def non_inferiority_table(master: DataFrame, models: list[str], methods: list[str], n_boot: int, margin: float = 0.02, base: str = "max", key: str = "slide_name", target: str = "target", seed: int = 42) -> DataFrame:
    """model, method and the columns of non_inferiority for every model (columns
    <model>__<method>), its base method against each other one; all share the draws."""
    columns = {f"{model}__{method}": None for model in models for method in (base, *methods)}
    at = {c: F.col(str(i)) for i, c in enumerate(columns)}
    pairs = [F.struct(F.lit(model).alias("model"), F.lit(method).alias("method"), (at[f"{model}__{method}"] - at[f"{model}__{base}"]).alias("delta")) for model in models for method in methods]
    deltas = resampled_aucs(master, key, target, list(columns), n_boot, seed).select(F.explode(F.array(*pairs)).alias("d")).select("d.*").where("delta is not null")
    return non_inferiority(deltas, margin, ["model", "method"])


def difference(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.subtract(other)


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
