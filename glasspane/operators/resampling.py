"""Areas under ROC curves over resamples, folded in the task that draws.

Rows alike in target and all scores are one kind. For each score the order of the kinds is fixed once:
its negative kinds ascending, and for each positive kind how many of them lie below it, and below or level
with it. A task draws a few replicates, counts each by kind (an array), and folds the counts along the
order of one score after the other: the negatives' counts are summed up, and every positive kind adds
its own count times what lies below it, half of what is level. What is drawn is never shuffled,
nor are replicates times scores; a task holds CELLS counts and the order of one score.

The draws are those of ranks.draws. Rows without a target, and scores that are missing or not
finite, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspane.operators.ranks import PRIMES
from glasspane.sources.scratch import shared_dir
from glasspane.sources.workers import ship

#: Counts that a task holds at a time, and numbers that it draws at a time.
CELLS, CHUNK = 4_000_000, 1 << 16

_U = np.uint64


def drawn(first: int, count: int, n: int, seed: int) -> np.ndarray:
    """The draws from 0 to n-1 of count numbers from first on, as ranks.draws gives them."""
    number = np.arange(first, first + count, dtype=_U)
    parts = []
    for p in map(_U, PRIMES):
        u = (number % p + _U(seed)) % p
        for last in (False, True):
            square = u * u % p
            u = square * square % p * u % p
            if not last:
                u = (u * _U(7919) + _U(104729)) % p
        parts.append(u)
    return (((parts[0] << _U(31)) + parts[1]) % _U(n)).astype(np.int64)


def order_of_score(rows: pd.DataFrame) -> pd.DataFrame:
    """rows (kind, target, score) of one side to its order: the positive kinds with the negative ones
    below them, and below or level, and the negative kinds ascending."""
    rows = rows.sort_values(["score", "kind"])
    target, score, kind = rows["target"].to_numpy(bool), rows["score"].to_numpy(float), rows["kind"].to_numpy(np.int64)
    negative = score[~target]
    below, upto = (np.searchsorted(negative, score[target], side) for side in ("left", "right"))
    columns = {"positive": kind[target], "below": below, "upto": upto, "negative": kind[~target]}
    return pd.DataFrame({"side": [rows["side"].iat[0]], **{c: [v.astype(np.int64).tobytes()] for c, v in columns.items()}})


ORDER = "side int, positive binary, below binary, upto binary, negative binary"


def areas(counts: np.ndarray, positive: np.ndarray, below: np.ndarray, upto: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """The area of each column of counts (kinds by replicates) along one order; NaN without both classes."""
    under = np.zeros((len(negative) + 1, counts.shape[1]))
    np.cumsum(counts[negative], axis=0, out=under[1:])
    own = counts[positive]
    level = under[below]
    level += under[upto]
    whole = own.sum(0) * under[-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.einsum("ij,ij->j", own, level) / 2 / whole


def _folds(places: str, orders: str, sides: int, n: int, seed: int) -> Callable:
    def read(where: str) -> Iterator[pa.Table]:
        store, path = fs.FileSystem.from_uri(where)
        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.endswith(".parquet"):
                yield pq.read_table(f.path, filesystem=store, partitioning=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replicates = [r for b in batches for r in b.column("replicate").to_pylist()]
        if not replicates:
            return
        kind_of = np.zeros(n, np.int64)
        for found in read(places):
            kind_of[found["place"].to_numpy() - 1] = found["kind"].to_numpy()
        kinds, kind_of = np.unique(kind_of, return_inverse=True)
        counts = np.zeros((len(kinds), len(replicates)))
        for column, replicate in enumerate(replicates):
            tally = np.zeros(len(kinds), np.int64)
            for at in range(0, n, CHUNK):
                tally += np.bincount(kind_of[drawn(replicate * n + at, min(CHUNK, n - at), n, seed)], minlength=len(kinds))
            counts[:, column] = tally
        aucs = np.full((len(replicates), sides), np.nan)
        for side in range(sides):
            for order in (row for found in read(f"{orders}/at={side}") for row in found.to_pylist()):
                positive, negative = (np.searchsorted(kinds, np.frombuffer(order[c], np.int64)) for c in ("positive", "negative"))
                aucs[:, side] = areas(counts, positive, *(np.frombuffer(order[c], np.int64) for c in ("below", "upto")), negative)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(replicates) + 1) * sides, pa.int32()), pa.array(aucs.ravel(), from_pandas=True))
        yield pa.RecordBatch.from_arrays([pa.array(replicates, pa.int64()), values], names=["replicate", "aucs"])

    return run


def folded_aucs(places: DataFrame, known: DataFrame, sides: int, n: int, n_boot: int, seed: int) -> DataFrame:
    """replicate and "0", "1", ...: the area of each side over each replicate; null without both classes
    (a side without any value has no order).
    places: place (1 to n) and kind; known: kind, target, side, score of kinds that take part."""
    spark = places.sparkSession
    ship(spark)
    at = {name: shared_dir(spark) for name in ("places", "orders")}
    places.write.parquet(at["places"])
    known.groupBy("side").applyInPandas(order_of_score, ORDER).withColumn("at", F.col("side")).write.partitionBy("at").parquet(at["orders"])
    a_task = max(1, min(CELLS // n, n_boot // (2 * spark.sparkContext.defaultParallelism)))
    tasks = -(-n_boot // a_task)
    replicates = spark.range(0, n_boot, 1, tasks).withColumnRenamed("id", "replicate")
    found = replicates.mapInArrow(_folds(at["places"], at["orders"], sides, n, seed), "replicate long, aucs array<double>")
    return found.select("replicate", *(F.col("aucs")[i].alias(str(i)) for i in range(sides)))
