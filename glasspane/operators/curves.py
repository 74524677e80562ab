"""ROC and precision-recall points, thresholds chosen on them, confusion metrics, histograms.

Scores are collapsed to their distinct values first; running counts over those are taken in two
levels (see ranks). Rows with a missing or non-finite score, or no target, take no part.
All functions take grouping columns `by`, so that many models or parameters are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glasspane.operators.ranks import running_sums

BINS = 20


def _zero_if_undefined(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def distinct_scores(df: DataFrame, score: str, target: str, by: list[str]) -> DataFrame:
    """threshold, tp and fp (rows of either kind with just that score), by group."""
    s, t = F.col(score).cast("double"), F.col(target).cast("int")
    rows = df.select(*by, s.alias("threshold"), t.alias("t")).where("t is not null and not isnan(threshold) and abs(threshold) < double('infinity')")
    return rows.groupBy(*by, "threshold").agg(F.sum("t").cast("bigint").alias("tp"), F.sum(1 - F.col("t")).cast("bigint").alias("fp"))


def counts_at(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """For each distinct score: tp and fp at it, next_tp and next_fp at the next lower one, cum_tp and
    cum_fp at or above it, whether it is the first, and the totals positives and negatives of the
    group. The scores are collapsed once; what is summed of them reads that again."""
    by = by or []
    at = running_sums(distinct_scores(df, score, target, by), by, "threshold", ["tp", "fp"])
    return at.withColumnsRenamed({"all_tp": "positives", "all_fp": "negatives"})


def roc_points(df: DataFrame, score: str, target: str, by: list[str] | None = None, drop_intermediate: bool = False) -> DataFrame:
    """threshold, fpr, tpr; the first point is (0, 0) at threshold infinity. Rates are null where
    a class is absent. drop_intermediate leaves out points on a straight line between others."""
    by = by or []
    at = counts_at(df, score, target, by)
    if drop_intermediate:
        at = at.where(F.col("first") | F.col("next_fp").isNull() | (F.col("next_fp") != F.col("fp")) | (F.col("next_tp") != F.col("tp")))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    found = at.select(*by, "threshold", rate("cum_fp", "negatives").alias("fpr"), rate("cum_tp", "positives").alias("tpr"))
    first = distinct_scores(df, score, target, by).select(*by).distinct() if by else df.sparkSession.range(1).select()
    return first.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).unionByName(found)


def roc_auc(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """auc: area by trapezoids, so ties count half; null where a class is absent."""
    by = by or []
    at = counts_at(df, score, target, by)
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2.0))
    return at.groupBy(*by).agg(F.try_divide(area, F.max("positives") * F.max("negatives").cast("double")).alias("auc"))


def _first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group; without groups a top-1, which needs no full sort."""
    if not by:
        return df.orderBy(*order).limit(1)
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def j_threshold(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Threshold of the largest tpr - fpr; of equals the highest, which is infinity where no
    threshold beats chance."""
    by = by or []
    points = roc_points(df, score, target, by).withColumn("j", F.col("tpr") - F.col("fpr")).where("j is not null")
    return _first(points, by, F.desc("j"), F.desc("threshold")).select(*by, "threshold", "fpr", "tpr", "j")


def full_sensitivity_threshold(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """The highest threshold at which every positive is found."""
    by = by or []
    at = counts_at(df, score, target, by).where("cum_tp = positives and positives > 0")
    return _first(at, by, F.desc("threshold")).select(*by, "threshold", F.try_divide(F.col("cum_fp").cast("double"), F.col("negatives").cast("double")).alias("fpr"))


def pr_points(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """threshold, precision, recall for each distinct score (without the closing point (1, 0),
    which has no threshold)."""
    by = by or []
    at = counts_at(df, score, target, by)
    return at.select(*by, "threshold", (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"), _zero_if_undefined(F.col("cum_tp"), F.col("positives")).alias("recall"))


def best_f1_threshold(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Threshold of the largest F1; of equals the lowest."""
    by = by or []
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)
    return _first(pr_points(df, score, target, by).withColumn("f1", f1), by, F.desc("f1"), F.asc("threshold")).select(*by, "threshold", "precision", "recall", "f1")


def nearest_threshold(points: DataFrame, preset: float, by: list[str] | None = None, descending: bool = True) -> DataFrame:
    """The point whose threshold is nearest to a preset; of equals the first in the curve's
    order (ROC curves run from high thresholds to low, precision-recall from low to high)."""
    order = F.desc("threshold") if descending else F.asc("threshold")
    return _first(points, by or [], F.abs(F.col("threshold") - F.lit(preset)), order)


def confusion_matrix(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """actual, predicted, n: always all four cells."""
    cells = df.sparkSession.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)], "actual int, predicted int")
    counts = df.groupBy(F.col(target).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_metrics(df: DataFrame, prediction: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Counts and accuracy, precision, recall, specificity, npv; 0 where undefined."""
    by = by or []
    p, t = F.col(prediction).cast("boolean"), F.col(target).cast("boolean")
    cells = {"tp": p & t, "fp": p & ~t, "fn": ~p & t, "tn": ~p & ~t}
    counts = df.groupBy(*by).agg(*(F.count_if(c).alias(k) for k, c in cells.items()))
    tp, fp, fn, tn = (F.col(k) for k in cells)
    rates = {"accuracy": (tp + tn, tp + fp + fn + tn), "precision": (tp, tp + fp), "recall": (tp, tp + fn), "specificity": (tn, tn + fp), "npv": (tn, tn + fn)}
    return counts.select(*by, *cells, *(_zero_if_undefined(a, b).alias(k) for k, (a, b) in rates.items()))


def nested_metrics(df: DataFrame, prediction: str, score: str, target: str, by: list[str]) -> DataFrame:
    """confusion_metrics and auc by group; auc is null where a class is absent."""
    return confusion_metrics(df, prediction, target, by).join(roc_auc(df, score, target, by), by, "left")


def score_histogram(df: DataFrame, score: str, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """Counts in equal bins of [0, 1], the last closed; scores outside are left out."""
    by = by or []
    s = F.col(score)
    inside = df.where(~F.isnan(s) & s.between(0.0, 1.0))
    return inside.groupBy(*by, F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def sweep_auc(df: DataFrame, target: str, columns: dict[str, str], fallback: dict[str, str] | None = None) -> DataFrame:
    """parameter and auc for score columns by parameter key (a=1_b=2); where a column is absent
    its fallback, and if that is absent too a KeyError. Names get "_" for "="."""
    found = {}
    for key, column in columns.items():
        name = column if column in df.columns else (fallback or {}).get(key, column)
        if name not in df.columns:
            raise KeyError(f"no column for {key}")
        found[key.replace("=", "_")] = name
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("parameter"), F.col(f"`{c}`").cast("double").alias("score")) for k, c in found.items())))
    long = df.select(F.col(target).alias("target"), entries.alias("e")).select("target", "e.parameter", "e.score")
    return roc_auc(long, "score", "target", ["parameter"])


def best_parameter(aucs: DataFrame) -> DataFrame:
    """The parameter of the largest auc; of equals the first by name."""
    return _first(aucs, [], F.desc_nulls_last("auc"), F.asc("parameter"))
