"""Near-duplicates by 64-bit SimHash, found through the binary Golay code (23, 12).

A fingerprint is cut into three segments of at most 22 bits. If two fingerprints differ in at
most 3 bits then either one segment is equal and another agrees up to one bit, or all three agree
up to one bit. A 23-bit word u has one codeword within 3 bits, D(u), and K(u) = the codewords
within 4 bits: one of them or, where D(u) is 3 away, six. If u and v differ in at most one bit
then D(u) is in K(v), and D(v) in K(u): D(u) is at most 3 from u, so at most 4 from v. So every
pair to find shares one of seven kinds of key: a whole segment with D of another on one side and
with each of K on the other, or a codeword of each segment, (D, K, D) on one side and (K, D, K) on
the other. That is about 11 keys of 34 to 36 bits for a fingerprint on one side and 60 on the
other, which join; XOR verifies.

Only distinct fingerprints take part. Within a key, links of a group need not be listed as
pairs: a task finds what is connected and passes on one link for each fingerprint but the
smallest. Of a key with many fingerprints the first side is split over tasks, past which the
second streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_block, placed, release, ship, stored, table, utf8, without
from .components import components

WIDTH, SEED, MAX_BITS = 3, 42, 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Which segment is whole in a key and which gives a codeword.
WHOLE_AND_NEAR = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
#: Generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0xC75
#: Fingerprints of a key's first side that one task holds, about; the other side's it holds at a time.
CHUNK = 16_384


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


class Golay:
    """D and K of 23-bit words, as indices (the 12 data bits) of codewords."""

    def __init__(self):
        single = [1 << i for i in range(23)]
        near = [0, *single]
        near += [a | b for i, a in enumerate(single) for b in single[:i]]
        three = [a | b | c for i, a in enumerate(single) for j, b in enumerate(single[:i]) for c in single[:j]]
        four = [x | a for x in three for a in single if a > x]
        self.high = _syndromes(np.arange(4096, dtype=np.int64) << 11)
        self.error = np.zeros(2048, np.int64)
        for patterns in (near, three):
            p = np.array(patterns, np.int64)
            self.error[_syndromes(p)] = p
        p = np.array(four, np.int64)
        s = _syndromes(p)
        order = np.argsort(s, kind="stable")
        self.far = np.zeros((2048, 5), np.int64)
        self.has_far = np.zeros(2048, bool)
        which = np.unique(s)
        self.far[which] = p[order].reshape(len(which), 5)
        self.has_far[which] = True

    def near_and_all(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """D of each word; K as a matrix of six columns; which of its cells count."""
        s = self.high[words >> 11] ^ (words & 2047)
        d = (words ^ self.error[s]) >> 11
        k = np.concatenate([d[:, None], (words[:, None] ^ self.far[s]) >> 11], 1)
        return d, k, np.concatenate([np.ones((len(words), 1), bool), np.repeat(self.has_far[s][:, None], 5, 1)], 1)


def key_lists(fps: np.ndarray, code: Golay) -> list[tuple[np.ndarray, np.ndarray]]:
    """For either side all keys, flat, and how many each fingerprint has."""
    words = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
    d, k, ok = zip(*map(code.near_and_all, words), strict=True)
    n, always = len(fps), np.ones((len(fps), 1), bool)
    first, second = [], []
    for kind, (i, j) in enumerate(WHOLE_AND_NEAR):
        top = (kind << 40 | words[i] << 12)[:, None]
        first.append((top | d[j][:, None], always))
        second.append((top | k[j], ok[j]))
    top = len(WHOLE_AND_NEAR) << 40
    first.append((top | d[0][:, None] << 24 | k[1] << 12 | d[2][:, None], ok[1]))
    second.append(((top | k[0][:, :, None] << 24 | d[1][:, None, None] << 12 | k[2][:, None, :]).reshape(n, -1), (ok[0][:, :, None] & ok[2][:, None, :]).reshape(n, -1)))
    out = []
    for side in (first, second):
        keys, keep = (np.concatenate(x, 1) for x in zip(*side, strict=True))
        out.append((keys[keep], keep.sum(1)))
    return out


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles (with repeats) of UTF-8 text, A-Z lower-cased; fewer
    words make one shingle, none give 0. A bit is set if over half of the hashes set it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < WIDTH:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -WIDTH]]).tolist()
    stops = (ends[WIDTH - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, more: str = "", **columns: Column) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number), and other columns, whose schema is more; null
    text counts as empty."""

    def make():
        def work(block):
            return {**{c: block[c] for c in kept}, "fp": np.array([fingerprint(t) for t in block["text"]], np.uint64).view(np.int64)}

        return work

    kept = ["doc_id", *columns]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"), *(c.alias(n) for n, c in columns.items()))
    return per_block(rows, "text", make, "doc_id bigint, fp bigint" + (f", {more}" if more else ""))


def _labels(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of a key, and for each the least place it is connected with.

    Links join a left and a right fingerprint; blocks keep memory bounded. Each pass takes
    the minimum over links and then over what that minimum points to.
    """
    both = np.unique(np.concatenate([left, right]))
    at_l, at_r = np.searchsorted(both, np.unique(left)), np.searchsorted(both, np.unique(right))
    label = np.arange(len(both))
    step = max(1, 2_000_000 // max(1, len(at_r)))
    while True:
        before = label.copy()
        for i in range(0, len(at_l), step):
            rows = at_l[i : i + step]
            linked = np.bitwise_count(both[rows][:, None] ^ both[at_r][None, :]) <= MAX_BITS
            np.minimum.at(label, rows, np.where(linked, label[at_r][None, :], len(both)).min(1))
            label[at_r] = np.minimum(label[at_r], np.where(linked, label[rows][:, None], len(both)).min(0))
        label = np.minimum(label, label[label])
        if (label == before).all():
            return both, label


class Forest:
    """Drops links that a task has already implied; bounded by forgetting."""

    def __init__(self, most: int = 200_000):
        self.parent: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def add(self, a: int, b: int) -> bool:
        if len(self.parent) > self.most:
            self.parent.clear()
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _links_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, many, fp) sorted by key and part, to links (a, b)."""
    forest = Forest()
    kept: list[tuple[np.ndarray, ...]] = []

    def solve(key, part, many, fp):
        if not len(key):
            return
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        size = np.diff(np.append(new, len(key)))
        run = np.repeat(np.arange(len(new)), size)
        n_many = np.bincount(run, many, len(new)).astype(np.int64)
        n_one = size - n_many
        pairs = n_one * n_many
        small = (pairs > 0) & (pairs <= 64)
        found = []
        # small keys: all left-right combinations of a slice at once
        order = np.lexsort((many, run))
        l_at, r_at = new, new + n_one
        which = np.flatnonzero(small & (size > 1))
        for i in range(0, len(which), 50_000):
            w = which[i : i + 50_000]
            n = pairs[w]
            base = np.repeat(np.cumsum(n) - n, n)
            k = np.arange(n.sum()) - base
            wide = np.repeat(n_many[w], n)
            a = fp[order[np.repeat(l_at[w], n) + k // wide]]
            b = fp[order[np.repeat(r_at[w], n) + k % wide]]
            hit = (a != b) & (np.bitwise_count(a ^ b) <= MAX_BITS)
            found.append(np.stack([np.minimum(a[hit], b[hit]), np.maximum(a[hit], b[hit])], 1))
        for w in np.flatnonzero(pairs > 64):
            rows = order[new[w] : new[w] + size[w]]
            both, label = _labels(fp[rows[: n_one[w]]], fp[rows[n_one[w] :]])
            away = label != np.arange(len(both))
            found.append(np.stack([both[label[away]], both[away]], 1))
        if not found or not (links := np.concatenate(found)).size:
            return
        links = np.unique(links, axis=0).view(np.int64)
        keep = np.array([forest.add(a, b) for a, b in links.tolist()], bool)
        links = links[keep]
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append((batch["key"].to_numpy(), batch["part"].to_numpy(), batch["many"].to_numpy(zero_copy_only=False), batch["fp"].to_numpy().view(np.uint64)))
        key, part = kept[-1][:2]
        cut = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (key[0], part[0]) != (key[-1], part[-1]) else 0
        if cut:  # the last run may go on
            ready = [*kept[:-1], tuple(x[:cut] for x in kept[-1])]
            kept = [tuple(x[cut:] for x in kept[-1])]
            yield from solve(*(np.concatenate(x) for x in zip(*ready, strict=True)))
        if sum(x[2].sum() for x in kept) > CHUNK:  # of a long run only the first side stays
            run = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
            goes_on = (run[0] == run[0][-1]) & (run[1] == run[1][-1])
            yield from solve(*run)
            kept = [tuple(x[goes_on & ~run[2]] for x in run)]
    if kept:
        yield from solve(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly what pairs of distinct fp at 3 or fewer bits do."""

    def keys(batches):
        code = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                fp = batch.column(0).slice(at, 10_000)
                sides = key_lists(fp.to_numpy().view(np.uint64), code)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v)) for v, n in sides]
                yield pa.RecordBatch.from_arrays([fp, *lists], names=["fp", "one", "many"])

    ship(fps.sparkSession)
    keyed = fps.mapInArrow(keys, "fp bigint, one array<bigint>, many array<bigint>")
    one = keyed.select(F.explode("one").alias("key"), "fp")
    full = stored(one.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts")))
    rows = keyed.select("fp", F.explode(F.array(F.struct(F.lit(False).alias("is_many"), F.col("one").alias("keys")), F.struct(F.lit(True).alias("is_many"), F.col("many").alias("keys")))).alias("s"))
    rows = rows.select("fp", F.col("s.is_many").alias("many"), F.explode("s.keys").alias("key"))
    if full.isEmpty():
        rows = rows.select("key", F.lit(0).alias("part"), "many", "fp")
    else:
        rows = rows.join(full, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        one_part = F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        rows = rows.select("key", F.explode(F.when(F.col("many"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(one_part)).alias("part"), "many", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "part").sortWithinPartitions("key", "part", "many").mapInArrow(_links_of_runs, "a bigint, b bigint")


def _with_roots(first: DataFrame) -> DataFrame:
    """first (fp and other columns, a row for each fp) with root, the least fp that links reach."""
    tree = components(links(first.select("fp")))
    out = stored(first.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    release(tree)
    return out


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, for every row.

    Rows with null doc_id take part (their component is null if it has no other row); rows
    with the same text always share a component; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs))
    first = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    rooted = _with_roots(first)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = stored(rooted.join(ids, "root").select("fp", "component_id"))
    release(first, rooted)
    return marked.join(final, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group, with its columns: the one with the smallest doc_id (none counts as
    the largest), of those that share it the one whose text has the least SHA-1. Rows with one
    doc_id and unlike texts are different rows; of rows with the same doc_id and text one stays.
    """
    rows = placed(docs)
    digest = F.unhex(F.sha1(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    marked = stored(fingerprints(rows, "digest binary, file bigint, row bigint", digest=digest, file=F.col("__file"), row=F.col("__row")))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "file", "row")
    first = stored(marked.groupBy("fp").agg(F.min(row).alias("least")))
    rooted = _with_roots(first)
    kept = stored(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.file", "least.row"))
    out = without(rows, marked.join(kept, ["file", "row"], "left_anti"))
    release(marked, first, rooted, kept)
    return out.select(*docs.columns)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
