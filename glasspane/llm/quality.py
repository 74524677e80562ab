"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words, hashed into WORDS buckets (a long run without blanks, as of a script that has
none, counts in pieces), and the form of the text: runs of three character kinds (lower case,
capital, digit, space, marks of several sorts, ...), 16 kinds making 4,096 terms, and two for words
that repeat the word before them and lines that repeat a line of the text. Square roots of
the shares of words and of forms, weighted by inverse document frequency and of unit length, are
projected on the leading singular directions of a labelled sample, found by subspace iteration. The
sample's vectors (at most SAMPLE rows of RANK numbers) and the projection go to every task, 3 MB at
most; there exact cosine products with all of them, in blocks of one shape, give the nearest
neighbours of each document, whose labels vote by similarity. Similarities count to five digits;
of equal ones the sample row with the smaller doc_id is nearer.

Only labels of the training part are learned from; of a doc_id with several labels the largest
counts, of several texts the one with the least SHA-1. Null text is empty; a text without terms
scores the sample's mean label. Without training labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_block, ship, table, utf8

#: Labelled rows that are learned from, at most: those with the smallest hashes of doc_id.
SAMPLE = 6_000
RANK, NEIGHBOURS, SHARPNESS, BLOCK = 48, 15, 4.0, 256
TRIGRAMS, WORDS = 4_096, 4_096
FORMS = TRIGRAMS + 2
TERMS = FORMS + WORDS
#: Words weigh so much next to forms; words longer than LONG bytes count in pieces of PIECE bytes.
WORD_WEIGHT, LONG, PIECE = 0.5, 24, 6
#: Directions beyond RANK, and rounds, of the subspace iteration; digits of a similarity that count.
SPARE, ROUNDS, DIGITS = 16, 8, 1e5
#: A repeated word or line counts as so many terms, about as many as its letters make.
REPEAT_WEIGHT = 8


def _kinds() -> bytes:
    kinds = bytearray(256)
    for chars, kind in ((" \t", 1), ("\n\r", 2), ("abcdefghijklmnopqrstuvwxyz", 3), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4), ("0123456789", 5), (".", 6), (",", 7), ("!?", 8), ("\"'`", 9), ("|", 10), ("#$%&*", 11), ("()[]{}<>", 12), ("-_/\\", 13), (":;=", 15)):
        for c in chars:
            kinds[ord(c)] = kind
    for b in range(128, 256):
        kinds[b] = 14
    return bytes(kinds)


KINDS = _kinds()


def term_counts(text: bytes) -> np.ndarray:
    """How often each term occurs: forms, then words."""
    counts = np.zeros(TERMS, np.int64)
    k = np.frombuffer(text.translate(KINDS), np.uint8).astype(np.int32)
    if len(k) >= 3:
        counts[:TRIGRAMS] = np.bincount((k[:-2] << 8) + (k[1:-1] << 4) + k[2:], minlength=TRIGRAMS)
    words, lines = text.split(), text.split(b"\n")
    counts[TRIGRAMS] = REPEAT_WEIGHT * sum(map(eq, words, words[1:]))
    counts[TRIGRAMS + 1] = REPEAT_WEIGHT * (len(lines) - len(set(lines)))
    low = text.lower().split()
    if low and max(map(len, low)) > LONG:
        low = [p for w in low for p in ([w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w), PIECE)])]
    if low:
        counts[FORMS:] = np.bincount(np.fromiter(map(crc32, low), np.int64, len(low)) % WORDS, minlength=WORDS)
    return counts


def _shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of forms and of words."""
    out = np.empty(counts.shape, np.float32)
    for part, weight in ((slice(0, FORMS), 1.0), (slice(FORMS, TERMS), WORD_WEIGHT)):
        own = counts[..., part]
        out[..., part] = weight * np.sqrt(own / np.maximum(own.sum(-1, keepdims=True), 1))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def leading_directions(rows: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of rows, as columns, by subspace iteration from a fixed
    start."""
    width = min(rank + SPARE, *rows.shape)
    space = np.random.default_rng(1).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(ROUNDS):
        space = np.linalg.qr(rows.T @ (rows @ space))[0]
    image = rows @ space
    values, turn = np.linalg.eigh((image.T @ image).astype(np.float64))
    return space @ turn[:, np.argsort(-values)[:rank]].astype(np.float32)


class Neighbours:
    """What a task needs: the projection, and the sample's vectors and labels, by doc_id."""

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray], labels: list[int]):
        self.labels = np.array(labels, np.float32)
        n = len(labels)
        self.mean = float(self.labels.mean()) if n else 0.5
        seen = np.zeros(TERMS, np.int64)
        for i in ids:
            seen[i] += 1
        used = np.flatnonzero(seen >= 2)
        self.projection, self.vectors = np.zeros((TERMS, 0)), np.zeros((n, 0))
        if not len(used):
            return
        rows = np.zeros((n, len(used)), np.float32)
        one = np.zeros(TERMS, np.int64)
        for r, (i, c) in enumerate(zip(ids, counts, strict=True)):
            one[i] = c
            rows[r] = _shares(one)[used]
            one[i] = 0
        idf = np.log((1 + n) / (1 + seen[used])).astype(np.float32) + 1
        rows *= idf
        rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
        lead = leading_directions(rows, RANK)
        # the length of the whole vector has no part in a cosine, so it needn't be known
        self.projection = np.zeros((TERMS, lead.shape[1]))
        self.projection[used] = idf[:, None] * lead
        self.vectors = _unit((rows @ lead).astype(np.float64))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.mean)
        n = len(self.labels)
        if not self.vectors.size:
            return out
        k = min(NEIGHBOURS, n)
        # doubles, always in as large a block: what a row's place does to its products is far below the digits that count
        counts = np.zeros((BLOCK, TERMS), np.int64)
        for at in range(0, len(texts), BLOCK):
            part = texts[at : at + BLOCK]
            for i, t in enumerate(part):
                counts[i] = term_counts(t)
            counts[len(part) :] = 0
            near = np.rint(_unit(_shares(counts).astype(np.float64) @ self.projection) @ self.vectors.T * DIGITS).astype(np.int64)[: len(part)]
            rank = near * n - np.arange(n)  # no two alike
            best = np.argpartition(-rank, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(k), near.shape)
            weight = np.maximum(np.take_along_axis(near, best, 1) / DIGITS, 0) ** SHARPNESS
            total = weight.sum(1)
            vote = (weight * self.labels[best]).sum(1) / np.where(total > 0, total, 1)
            out[at : at + BLOCK] = np.where(total > 1e-9, vote, self.mean)
        return np.clip(out, 0, 1)


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, most: int) -> DataFrame:
    """doc_id, text as UTF-8 and label of the training rows with the smallest hashes of doc_id,
    at most `most` of them (the bound that allows the broadcast); of repeated ids the text with the
    least SHA-1 and the largest label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & training)
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"))
    rows = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label")
    return rows.agg(F.min_by("text", F.sha1("text")).alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", most: int = SAMPLE) -> Neighbours:
    """Neighbours from a bounded sample; only its term counts come to the driver."""

    def make():
        def work(block):
            found = [term_counts(t) for t in block["text"]]
            ids = [np.flatnonzero(c) for c in found]
            packed = lambda x: x.astype(np.int32).tobytes()
            return {"doc_id": block["doc_id"], "label": block["label"], "ids": [packed(i) for i in ids], "counts": [packed(c[i]) for c, i in zip(found, ids, strict=True)]}

        return work

    sample = labelled_sample(docs, labels, label, training, most)
    rows = per_block(sample, "text", make, "doc_id bigint, label int, ids binary, counts binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    read = lambda x: np.frombuffer(x, np.int32)
    return Neighbours([read(r.ids) for r in rows], [read(r.counts) for r in rows], [r.label for r in rows])


def score_column(spark: SparkSession, model: Neighbours, text: str = "text") -> Column:
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(sent.value.scores([t if isinstance(t, bytes) else b"" for t in part]))

    return score(utf8(text))


def scores(docs: DataFrame, model: Neighbours) -> DataFrame:
    """doc_id and score, 0 to 1, for every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score_column(docs.sparkSession, model).alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """The documents that score at least 0.5, with all their columns."""
    model = fit(docs, labels, training)
    return docs.where(score_column(docs.sparkSession, model) >= 0.5)


def op10_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
