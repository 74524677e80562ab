"""Scores of tiles and bags from embeddings: linear heads and attention over a bag's tiles.

A bag is the rows of one key. Padding (all-zero embeddings) is left out before any softmax or
mean. Dropout has no part in scoring.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspane.functions.vectors import dot, present, sigmoid
from glasspane.operators.ranks import join_groups


def linear_scores(rows: DataFrame, weights: list[float], bias: float, embedding: str = "embedding", name: str = "prediction") -> DataFrame:
    """rows with the probability of a linear head."""
    return rows.withColumn(name, sigmoid(dot(F.col(embedding), weights, bias)))


def softmax(rows: DataFrame, value: str, by: list[str], name: str = "weight") -> DataFrame:
    """rows with the softmax of a value over their group, stable for large values. What a group
    needs is aggregated and joined back, so that a group may be split over tasks."""
    top = join_groups(rows, rows.groupBy(*by).agg(F.max(value).alias("__top")), by)
    raised = top.withColumn("__e", F.exp(F.col(value) - F.col("__top")))
    sums = raised.groupBy(*by).agg(F.sum("__e").alias("__sum"))
    return join_groups(raised, sums, by).withColumn(name, F.col("__e") / F.col("__sum")).drop("__top", "__e", "__sum")


def min_max(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """rows with (x - min) / (max - min) over their group; null where all are equal."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return join_groups(rows, ends, by).withColumn(name, F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def attended(rows: DataFrame, bag: str, attention: tuple[list[float], float], classifier: tuple[list[float], float], embedding: str = "embedding") -> DataFrame:
    """rows without padding, with logit (classifier) and weight (softmax of the attention over
    the bag)."""
    e = F.col(embedding)
    scored = rows.where(present(e)).withColumns({"__a": dot(e, *attention), "logit": dot(e, *classifier)})
    return softmax(scored, "__a", [bag]).drop("__a")


def bag_scores(rows: DataFrame, bag: str, attention: tuple[list[float], float], classifier: tuple[list[float], float], embedding: str = "embedding") -> DataFrame:
    """bag, n tiles, logit and prediction: sum of weight * logit, and its sigmoid. The softmax is
    folded into the sums: sum(exp(a - m) * logit) / sum(exp(a - m)) with m the bag's largest a,
    joined to the rows from a small table of bags, so that a bag may be split over tasks."""
    e = F.col(embedding)
    scored = rows.where(present(e)).select(bag, dot(e, *attention).alias("a"), dot(e, *classifier).alias("c"))
    top = scored.groupBy(bag).agg(F.max("a").alias("m"))
    x = F.exp(F.col("a") - F.col("m"))
    sums = scored.join(top, bag).groupBy(bag).agg(F.count("*").alias("n"), (F.sum(x * F.col("c")) / F.sum(x)).alias("logit"))
    return sums.withColumn("prediction", sigmoid(F.col("logit")))


def masked_bag_loss(rows: DataFrame, bag: str, loss: str, mask: str) -> DataFrame:
    """Mean over bags of the mean loss of their unmasked rows (a bag without any counts as 0)."""
    own = rows.groupBy(bag).agg((F.sum(F.when(F.col(mask), F.col(loss)).otherwise(0.0)) / F.greatest(F.count_if(F.col(mask)), F.lit(1))).alias("x"))
    return own.agg(F.avg("x").alias("loss"))


def bags(rows: DataFrame, bag: str, order: str, embedding: str = "embedding") -> DataFrame:
    """One array of embeddings for each bag, in the order of a column: for export of small bags."""
    item = F.struct(F.col(order).alias("o"), F.col(embedding).alias("e"))
    return rows.groupBy(bag).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("embeddings"))


def map_bags(rows: DataFrame, bag: str, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that a function gives for all rows of each bag at once, for what no aggregate
    expresses. A bag must fit in a task: it is one slide's tiles."""
    return rows.groupBy(bag).applyInPandas(call, schema)
