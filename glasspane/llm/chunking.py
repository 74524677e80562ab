"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes decides where a text is cut, so an insertion moves only the
cuts near it. Chunking is normalised: before a chunk has its normal length a cut needs 7 zero
bits, after it 5, and none is shorter than 16 or longer than 256 bytes. A fingerprint is the set
of chunk digests with the bytes each covers; the likeness of one to another is the share of its
bytes whose chunks the other has too (containment).

Null text is empty; its fingerprint is the empty string. Two empty texts are alike (1), an empty
and another are not (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, per_block, ship, table, utf8

WINDOW, SHORTEST, NORMAL, LONGEST = 32, 16, 64, 256
EARLY, LATE = np.uint32(0xFE000000), np.uint32(0xF8000000)
DIGEST_BITS = 40


def _gear_table() -> np.ndarray:
    """256 numbers from a rule: the upper half of successive SplitMix64 outputs, seed 1."""
    z = np.arange(2, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear_table()
Sketch = dict[int, int]


def _cuts(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row with gaps, and for each chunk its text, start and stop."""
    gap = bytes(WINDOW)
    joined = gap.join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    end = start + sizes
    h = GEAR[np.frombuffer(joined, np.uint8)]
    for e in end[:-1].tolist():
        h[e : e + WINDOW] = 0
    width = 1
    while width < WINDOW:
        shifted = h[:-width] << np.uint32(width)
        h[width:] += shifted
        width *= 2
    late = np.flatnonzero(h & LATE == 0)
    early = late[h[late] & EARLY == 0]
    late, early = (np.append(x, len(joined) + LONGEST) for x in (late, early))
    owner, begin, stop = [], [], []
    doc, s, e = np.arange(len(texts)), start, end
    while True:
        left = s < e
        doc, s, e = doc[left], s[left], e[left]
        if not len(doc):
            break
        a = early[np.searchsorted(early, s + SHORTEST - 1)] + 1
        b = late[np.searchsorted(late, s + NORMAL - 1)] + 1
        cut = np.minimum(np.where(a < s + NORMAL, a, np.minimum(b, s + LONGEST)), e)
        owner.append(doc)
        begin.append(s)
        stop.append(cut)
        s = cut
    if not owner:
        return joined, *(np.zeros(0, np.int64),) * 3
    return joined, np.concatenate(owner), np.concatenate(begin), np.concatenate(stop)


def sketches(texts: list[bytes]) -> list[Sketch]:
    """For each text its chunk digests and the bytes each covers."""
    joined, owner, begin, stop = _cuts(texts)
    found: list[Sketch] = [{} for _ in texts]
    shift = 64 - DIGEST_BITS
    for d, a, b in zip(owner.tolist(), begin.tolist(), stop.tolist(), strict=True):
        key = xxhash.xxh3_64_intdigest(joined[a:b]) >> shift
        own = found[d]
        own[key] = own.get(key, 0) + b - a
    return found


def written(sketch: Sketch) -> str:
    """The fingerprint as text: digest:bytes, in the order of the digests."""
    return ",".join(f"{d:0{DIGEST_BITS // 4}x}:{sketch[d]}" for d in sorted(sketch))


def parsed(fingerprint: str) -> Sketch:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in fingerprint.split(",") if x)}


def containment(one: Sketch, other: Sketch) -> float:
    """Share of one's bytes in chunks that the other has, each as often at most."""
    if not one:
        return 1.0 if not other else 0.0
    get = other.get
    return sum(min(n, get(d, 0)) for d, n in one.items()) / sum(one.values())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row, in one narrow pass."""

    def make():
        return lambda block: {"doc_id": block["doc_id"], "fingerprint": [written(s) for s in sketches(block["text"])]}

    return per_block(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text")), "text", make, "doc_id bigint, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (place, carried, doc_id, text) so that each place holds a range of doc_ids and the
    first row of the place after it, marked as carried.

    The order is descending doc_id, then text; null doc_ids come last; after the last row
    comes the first. Places are cut at approximate quantiles, eight for each shuffle partition;
    only their bounds and first ids go to the driver. One shuffle of the texts.
    """
    spark = docs.sparkSession
    places = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("double").alias("at"))
    cuts = ids.approxQuantile("at", [i / places for i in range(1, places)], 0.2 / places)
    splits = [-float("inf"), *sorted({*cuts, 0.0}), float("inf")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"), F.col("doc_id").cast("double").alias("at"))
    rows = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep").transform(rows)
    rows = rows.select("doc_id", "text", F.when(F.col("doc_id").isNull(), len(splits)).otherwise(len(splits) - 2 - F.col("bucket")).cast("int").alias("place"))
    firsts = [(r.place, r.first) for r in rows.groupBy("place").agg(F.max("doc_id").alias("first")).orderBy("place").collect()]
    if not firsts:
        return rows.select("place", F.lit(False).alias("carried"), "doc_id", "text")
    sent = spark.createDataFrame([(at, first, firsts[i - 1][0]) for i, (at, first) in enumerate(firsts)], "place int, first long, onto int")
    rows = rows.join(F.broadcast(sent), "place")
    to = F.array(F.struct("place", F.lit(False).alias("carried")))
    also = F.array(F.struct(F.col("onto").alias("place"), F.lit(True).alias("carried")))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.concat(to, also)).otherwise(to)).alias("d"))
    return rows.select("d.place", "d.carried", "doc_id", "text")


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of place, own before carried, to the fingerprints of each own row, of its
    edited text, and their likeness."""
    last: tuple | None = None  # the row before the block: place, carried, doc_id, text, sketch

    def solved(rows, marks):
        out = {k.split(" ")[0]: [] for k in SCHEMA.split(", ")}
        pairs = [(a, b, x, y) for (a, x), (b, y) in zip(zip(rows, marks, strict=True), zip(rows[1:], marks[1:], strict=True), strict=False) if not a[1] and a[0] == b[0]]
        edited = []
        for a, b, _, _ in pairs:
            own, after = a[3].decode("utf-8", "replace"), b[3].decode("utf-8", "replace")
            k = len(own) // 3
            edited.append((own[: len(own) - k] + after[:k]).encode())
            out["n_chars"].append(len(own))
        for (a, _, x, y), text, z in zip(pairs, edited, sketches(edited), strict=True):
            out["doc_id"].append(a[2])
            out["edited_sha256"].append(hashlib.sha256(text).hexdigest())
            out["fingerprint"].append(written(x))
            out["edited_fingerprint"].append(written(z))
            out["near_edited"].append(containment(x, z))
            out["near_next"].append(containment(x, y))
        return pa.RecordBatch.from_pydict({k: pa.array(v, {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}.get(k, pa.string())) for k, v in out.items()})

    for block in blocks(batches, "text", max_bytes=1_000_000):
        rows = list(zip(*(block.column(c).to_pylist() for c in ("place", "carried", "doc_id", "text")), strict=True))
        marks = sketches([r[3] for r in rows])
        ahead = ([last[0]], [last[1]]) if last else ([], [])
        yield solved(ahead[0] + rows, ahead[1] + marks)
        last = rows[-1], marks[-1]


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its text with the last third replaced by the start of
    the next document (descending doc_id), and how much of it these two and the next
    document's fingerprint hold. A single row is its own next; no rows give none."""
    ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs).repartition(n, "place").sortWithinPartitions("place", "carried", F.col("doc_id").desc_nulls_last(), "text")
    return rows.mapInArrow(_with_next, SCHEMA)


def op1_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
