"""Ranks and running sums in two levels, so that no partition key gathers in one task.

Groups of at most BUCKET_ROWS rows, however many there are, are sorted whole: one shuffle, no sketch. The rows of
larger ones are cut into buckets that keep the order, as many as their rows ask for; ranks or sums run
inside a bucket, and the small table of the large groups' bucket totals gives what comes before each bucket. Buckets
end at approximate quantiles of the group's keys (or are ranges of a hash), so they are alike in rows
however keys are spread; only rows with the very same key can't be parted.

Hashes and draws are ones that other engines have too: md5 for keys, and for the numbered draws of
a resample a power map modulo two primes (fixed values), which costs less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a group is sorted whole, and of a bucket of a larger one, about; quantiles of a group at most.
BUCKET_ROWS, BOUNDS = 1 << 14, 1024
#: The largest primes below 2^31; x^5 is one to one modulo either.
PRIMES = (2147483647, 2147483629)


def join_groups(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Add to every row the columns of its group; null keys are a group like any other."""
    if not by:
        return df.crossJoin(groups)
    renamed = groups.withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    return df.join(renamed, same).drop(*(f"__by_{c}" for c in by))


def left_groups(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """As join_groups, but rows whose group isn't there stay, with nulls."""
    renamed = groups.withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by] or F.lit(True)
    return df.join(renamed, same, "left").drop(*(f"__by_{c}" for c in by))


def large_groups(df: DataFrame, by: list[str]) -> DataFrame:
    """by and __buckets of the groups of more than BUCKET_ROWS rows; there are fewer of them than buckets in all."""
    counts = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > BUCKET_ROWS)
    return counts.select(*by, F.ceil(F.col("__n") / BUCKET_ROWS).cast("long").alias("__buckets"))


def bucketed(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """df with __bucket, whose numbers rise with the key (null and NaN apart), and __large, whether the
    group has several."""
    marked = join_groups(df, large_groups(df, by), by)
    quantiles = F.percentile_approx(key, [i / BOUNDS for i in range(1, BOUNDS)], 20_000)
    sketches = marked.groupBy(*by).agg(quantiles.alias("__q"), F.least(F.max("__buckets"), F.lit(BOUNDS)).alias("__m"))
    chosen = F.transform(F.sequence(F.lit(1).cast("long"), F.col("__m") - 1), lambda i: F.element_at("__q", F.round(i * BOUNDS / F.col("__m")).cast("int")))
    bounds = sketches.where("__q is not null").select(*by, F.array_distinct(chosen).alias("__bounds"))
    below = F.size(F.filter("__bounds", lambda b: b < F.col(key)))
    found = left_groups(df, bounds, by)
    return found.withColumns({"__large": F.col("__bounds").isNotNull(), "__bucket": F.when(F.col("__bounds").isNotNull(), F.coalesce(below, F.lit(0))).otherwise(0)}).drop("__bounds")


def _before(totals: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """by, __bucket and the sum of value over the buckets before it."""
    order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn(f"__before_{value}", F.coalesce(F.sum(value).over(w), F.lit(0)))


def hashed(seed: int, *keys: str | Column) -> Column:
    """60 bits of the md5 of seed and keys as text, as a number."""
    text = F.concat_ws("|", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def hash_rank(df: DataFrame, by: list[str], keys: list[str], seed: int, name: str = "rank") -> DataFrame:
    """A rank from 1 in the order of a seeded hash of the keys, by group: a shuffled order that
    is the same on every run. Buckets are equal ranges of the hash."""
    parts = left_groups(df.withColumn("__h", hashed(seed, *keys)), large_groups(df, by), by)
    at = F.floor(F.col("__h") / float(1 << 60) * F.col("__buckets")).cast("long")
    marked = parts.withColumns({"__large": F.col("__buckets").isNotNull(), "__bucket": F.coalesce(at, F.lit(0))}).drop("__buckets")
    return _ranked(marked, by, ["__h", *keys], name).drop("__h")


def ordered_rank(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """A rank from 1 in ascending order, by group; the first column of the order is a number."""
    return _ranked(bucketed(df, by, order[0]), by, order, name)


def file_rank(df: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """A rank from 1, by group, of rows that have __bucket (their file) and __at (place in it)."""
    return _ranked(df.withColumn("__large", F.lit(True)), by, ["__at"], name).drop("__at")


def _ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    totals = _before(df.where("__large").groupBy(*by, "__bucket").agg(F.count("*").alias("n")), by, "n").select(*by, "__bucket", "__before_n")
    local = df.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__bucket").orderBy(*order)))
    rank = (F.col("__r") + F.coalesce("__before_n", F.lit(0))).cast("bigint")
    return left_groups(local, totals, [*by, "__bucket"]).withColumn(name, rank).drop("__bucket", "__large", "__r", "__before_n")


def running_sums(df: DataFrame, by: list[str], key: str, values: list[str]) -> DataFrame:
    """Over rows in descending order of key, by group, for each value v: cum_<v>, the sum up to and
    with the row, all_<v>, the sum over the group, and next_<v>, that of the row after it (null for
    the last); and first, whether none comes before. key must be finite and unique in its group."""
    df = bucketed(df, by, key)
    head = F.max_by(F.struct(*values), key)
    totals = df.where("__large").groupBy(*by, "__bucket").agg(head.alias("__head"), *(F.sum(v).alias(v) for v in values))
    for v in values:
        totals = _before(totals, by, v, descending=True)
    order = W.partitionBy(*by).orderBy(F.col("__bucket").desc())
    found = {"__after": F.lead("__head").over(order), "__top": F.row_number().over(order) == 1}
    totals = totals.withColumns(found | {f"__all_{v}": F.sum(v).over(W.partitionBy(*by)) for v in values})
    totals = totals.select(*by, "__bucket", "__after", "__top", *(f"__{w}_{v}" for v in values for w in ("before", "all")))
    whole = W.partitionBy(*by, "__bucket")
    near = whole.orderBy(F.col(key).desc())
    upto = near.rowsBetween(W.unboundedPreceding, 0)
    own = {f"__own_{v}": F.sum(v).over(upto) for v in values} | {f"__whole_{v}": F.sum(v).over(whole) for v in values}
    own |= {"__next": F.lead(F.struct(*values)).over(near), "__n": F.row_number().over(near)}
    local = left_groups(df.withColumns(own), totals, [*by, "__bucket"])
    out: dict[str, Column] = {"first": F.coalesce("__top", F.lit(True)) & (F.col("__n") == 1)}
    for v in values:
        out |= {f"cum_{v}": F.col(f"__own_{v}") + F.coalesce(f"__before_{v}", F.lit(0)), f"all_{v}": F.coalesce(f"__all_{v}", f"__whole_{v}"), f"next_{v}": F.coalesce("__next", "__after")[v]}
    return local.select(*(c for c in df.columns if not c.startswith("__")), *(c.alias(n) for n, c in out.items()))


def draws(df: DataFrame, number: Column, n: Column, name: str, seed: int) -> DataFrame:
    """df with a draw from 0 to n-1 for a number (not negative): for each prime p the steps
    u = number + seed, u^5, 7919 u + 104729, u^5, all modulo p, put together as one number
    modulo n."""
    steps = [f"__u{i}" for i in range(len(PRIMES))]

    def fifth(df: DataFrame) -> DataFrame:
        for power in (2, 4):
            df = df.withColumns({f"{s}_{power}": (F.col(s if power == 2 else f"{s}_2") * F.col(s if power == 2 else f"{s}_2")) % p for s, p in zip(steps, PRIMES, strict=True)})
        return df.withColumns({s: (F.col(f"{s}_4") * F.col(s)) % p for s, p in zip(steps, PRIMES, strict=True)})

    df = fifth(df.withColumns({s: (number % p + seed) % p for s, p in zip(steps, PRIMES, strict=True)}))
    df = fifth(df.withColumns({s: (F.col(s) * 7919 + 104729) % p for s, p in zip(steps, PRIMES, strict=True)}))
    # never null: else a join on it would test it for null below these steps, written out whole
    df = df.withColumn(name, F.coalesce((F.col(steps[0]) * (1 << 31) + F.col(steps[1])) % n, F.lit(0).cast("bigint")))
    return df.drop(*steps, *(f"{s}_{power}" for s in steps for power in (2, 4)))


def draws_sql(number: str, n: str, seed: int) -> str:
    """The same draw as an SQL expression."""
    found = []
    for p in PRIMES:
        u = f"(CAST({number} AS BIGINT) % {p} + {seed}) % {p}"
        for last in (False, True):
            u = f"list_transform([{u}], lambda u: (((u * u % {p}) * (u * u % {p}) % {p}) * u) % {p})[1]"
            if not last:
                u = f"(({u}) * 7919 + 104729) % {p}"
        found.append(u)
    return f"(({found[0]}) * 2147483648 + ({found[1]})) % ({n})"
