"""Connected components of a table of links, as joins and minima over Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _minima(edges: DataFrame) -> DataFrame:
    """Each a with its least b; stored, so that the join back shuffles both sides and a
    node with very many links can be split."""
    return stored(edges.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    minima = _minima(both)
    least = minima.select("a", F.least("a", "m").alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = stored(moved.where("a != b").distinct())
    release(minima)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _minima(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    out = stored(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
    release(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to a smaller one in its component; root
    is the component's smallest node. edges: (a, b), any comparable type, either order.

    Alternates large and small stars until nothing changes (a logarithmic number of rounds
    in practice); each step is written to the shared folder and deleted after the next. Loops and repeated links are
    allowed; no links give no rows.
    """
    now = stored(edges.where("a != b").distinct())
    seen = None
    while True:
        before, large = now, _large_star(now)
        now = _small_star(large)
        release(before, large)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
