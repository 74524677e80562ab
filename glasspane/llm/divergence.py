"""How far the sources of each language differ in their words, exactly.

Terms are counted for each (lang, source) in the tasks that read the texts; a language keeps the
terms in at least 3 of its documents. Kept terms are dealt into blocks of a bounded number of
cells. A block becomes one dense int64 tile, groups by terms; all pairs of groups are broadcast
against each other in it, which gives one partial matrix of pairs, and each group's TOP terms of the
block. Matrices are summed over blocks and the lists merged.

Values: with c occurrences, N their sum over kept terms and V kept terms, p = 1 + floor(10^9 (c + 1)
/ (N + V)); the divergence from q is floor((p - q)^2 / q). Divisions are in steps of 10^3, so that
they are exact in int64 up to N + V of 9 * 10^15; a sum over terms fits up to 2 * 10^9 of them.

Null text, lang and source are empty. A group without terms counts as well; a language without
kept terms has pairs of value 0 and no terms. Repeated rows are documents of their own. No rows
give none.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, release, ship, stored, table

#: A term is kept if it is in so many documents of the language.
LEAST_DOCS = 3
#: Terms listed for each group.
TOP = 200
#: Terms of a tile at most, cells of a tile, cells broadcast at a time.
BLOCK_TERMS, TILE_CELLS, PAIR_CELLS = 4096, 1 << 20, 1 << 20
#: Counts that a task holds before it passes them on, and bytes of a text split at a time.
HELD, PIECE = 400_000, 1 << 22
SCALE_STEPS, STEP = 3, 1000

#: ASCII letters lower-cased, other ASCII to blanks; all else stays.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    at = 0
    while at < len(text):
        stop = min(at + PIECE, len(text))
        folded = text[at:stop].translate(_FOLD)
        while stop < len(text) and folded[-1] != 32:  # no term is cut
            more = text[stop : stop + 4096].translate(_FOLD)
            end = more.find(b" ") + 1 or len(more)
            folded, stop = folded + more[:end], stop + end
        yield folded.split()
        at = stop


TALLY = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, summed over what the task reads."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def passed_on():
        for (lang, source), (n, docs) in found.items():
            keys = list(n)
            own = [pa.array([v] * len(keys), pa.string()) for v in (lang, source)]
            words = pa.array([k.decode("utf-8", "replace") for k in keys], pa.string())
            yield pa.RecordBatch.from_arrays([*own, words, pa.array([n[k] for k in keys], pa.int64()), pa.array([docs[k] for k in keys], pa.int64())], schema=TALLY)
        found.clear()

    for block in blocks(batches, "text"):
        for lang, source, text in zip(*(block.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = found[lang, source]
            own: set[bytes] = set()
            for some in terms(text):
                n.update(some)
                own.update(some)
            docs.update(own)
        if sum(len(n) for n, _ in found.values()) > HELD:
            yield from passed_on()
    yield from passed_on()


def kept_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n: occurrences of the terms that the language keeps. docs: lang, source and text without nulls."""
    tally = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_tallied, "lang string, source string, term string, n long, docs long")
    whole = tally.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return whole.withColumn("docs", seen).where(F.col("docs") >= LEAST_DOCS).drop("docs")


def scaled(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / of)."""
    whole, rest = np.divmod(count + 1, of)
    for _ in range(SCALE_STEPS):
        more, rest = np.divmod(rest * STEP, of)
        whole = whole * STEP + more
    return whole + 1


def pair_sums(p: np.ndarray) -> np.ndarray:
    """For rows i, j of p the sum over columns of floor((p_i - p_j)^2 / p_j)."""
    groups, width = p.shape
    out = np.zeros((groups, groups), np.int64)
    if not width:
        return out
    high = max(1, PAIR_CELLS // width)
    for i in range(0, groups, high):
        wide = max(1, PAIR_CELLS // (width * min(high, groups - i)))
        for j in range(0, groups, wide):
            q = p[None, j : j + wide]
            out[i : i + high, j : j + wide] = ((p[i : i + high, None] - q) ** 2 // q).sum(2)
    return out


PARTS = "lang string, source string, part string, item string, value long"


def tile(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One block: its share of each pair, and each group's first TOP terms. counts: source, term, n;
    groups: lang, source, total (N) and kept (V) of the whole language."""
    groups = groups.sort_values("source")
    names, total, kept = groups["source"].to_numpy(), groups["total"].to_numpy(np.int64), int(groups["kept"].iat[0])
    words = np.array(sorted(set(counts["term"]), key=lambda w: w.encode()), object)
    tally = np.zeros((len(names), len(words)), np.int64)
    row, column = {v: i for i, v in enumerate(names)}, {v: i for i, v in enumerate(words)}
    tally[[row[v] for v in counts["source"]], [column[v] for v in counts["term"]]] = counts["n"].to_numpy(np.int64)
    p = scaled(tally, total[:, None] + kept) if len(words) else tally
    sums = pair_sums(p)
    one, other = np.nonzero(~np.eye(len(names), dtype=bool))
    out = [pd.DataFrame({"source": names[one], "part": "pair", "item": names[other], "value": sums[one, other]})]
    if len(words):
        q = scaled(tally.sum(0), total.sum() + kept)
        for i, name in enumerate(names):
            above = np.flatnonzero((tally[i] > 0) & (p[i] > q))
            value = (p[i, above] - q[above]) ** 2 // q[above]
            first = heapq.nsmallest(TOP, zip((-value).tolist(), above.tolist(), strict=True))  # words are in order, so ties are too
            out.append(pd.DataFrame({"source": name, "part": "term", "item": [words[j] for _, j in first], "value": [-v for v, _ in first]}))
    found = pd.concat(out, ignore_index=True).astype({"value": "int64"})
    found.insert(0, "lang", groups["lang"].iat[0])
    return found


def divergences(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: for each group all other sources of its language
    (part pair), and its first TOP terms above the language's share (part term)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = stored(kept_counts(docs))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    groups = stored(groups)
    held = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TERMS), F.floor(F.lit(TILE_CELLS) / F.col("groups"))))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(held, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    sizes = stored(sizes.select("lang", "kept", F.greatest(F.lit(1), F.ceil(F.col("kept") / width)).cast("long").alias("blocks")))
    counts = kept.join(sizes.select("lang", "blocks"), "lang").select("lang", F.expr("pmod(xxhash64(term), blocks)").alias("block"), "source", "term", "n")
    spread = groups.join(sizes, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")
    tiles = stored(counts.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInPandas(tile, PARTS))
    release(kept, groups, sizes)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    listed = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.union(listed)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
p AS (
  SELECT lang, g.source, term, coalesce(c.c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v))::HUGEINT AS p
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(p.c) + 1)) // ((SELECT sum(n) FROM g WHERE g.lang = p.lang) + any_value(v.v)))::HUGEINT AS q
  FROM p JOIN v USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
listed AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT * FROM listed))
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
