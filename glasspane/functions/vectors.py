"""Vector and score expressions over arrays, and a matrix form for wide layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT = 1e-6


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(vector: Column, weights: list[float], bias: float = 0.0) -> Column:
    """Linear layer with one output; null if the lengths differ."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    terms = F.zip_with(vector, w, lambda a, b: a.cast("double") * b)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) + F.lit(float(bias))


def mean_vector(vectors: Column) -> Column:
    """Element-wise mean of an array of equally long arrays; null if there is none."""
    width = F.size(vectors[0])
    return F.when(
        F.size(vectors) > 0,
        F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + v[i].cast("double")) / F.size(vectors)),
    )


def present(vector: Column, tolerance: float = ABSENT) -> Column:
    """False for padding: every element within the tolerance of zero."""
    return F.exists(vector, lambda x: F.abs(x) > tolerance)


def padded(vectors: Column, length: Column | int, width: int) -> Column:
    """An array of vectors filled up with zero vectors to a length; never cut."""
    zero = F.array_repeat(F.lit(0.0), width)
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(vectors, F.array_repeat(zero, F.greatest(n - F.size(vectors), F.lit(0)).cast("int")))


def cls_and_mean(tokens: Column, first: int = 6) -> Column:
    """First token followed by the mean of the tokens from place `first` (1-based) on."""
    rest = F.slice(tokens, first, F.greatest(F.size(tokens) - first + 1, F.lit(0)))
    return F.concat(F.transform(tokens[0], lambda x: x.cast("double")), mean_vector(rest))


def cls_token(tokens: Column) -> Column:
    return F.transform(tokens[0], lambda x: x.cast("double"))


def max_pooled(maps: Column) -> Column:
    """Largest value of each feature map."""
    return F.transform(maps, F.array_max)


def normalised(values: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std by channel."""
    m, s = (F.array(*(F.lit(float(x)) for x in v)) for v in (mean, std))
    return F.zip_with(F.zip_with(values, m, lambda a, b: a - b), s, lambda a, b: a / b)


def bce_with_logits(logit: Column, target: Column, positive_weight: float = 1.0) -> Column:
    """Binary cross-entropy of a logit, in the form that doesn't overflow."""
    t = target.cast("double")
    weight = 1 + (positive_weight - 1) * t
    return (1 - t) * logit + weight * (F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0)))


def cam_pixel(total: Column, n: Column) -> Column:
    """Mean activation as a grey value: sigmoid, times 255, cut to an integer."""
    return F.floor(255 * sigmoid(total / n)).cast("int")


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def close_to(a: Column, b: Column, relative: float) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def layer(weights: np.ndarray, bias: np.ndarray):
    """A layer with many outputs as a Pandas UDF of array to array: one matrix product a batch,
    which wide layers need (the array expressions above are interpreted for each element)."""

    @F.pandas_udf("array<double>")
    def apply(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(vectors.to_numpy()).astype(float) @ weights.T + bias))

    return apply
