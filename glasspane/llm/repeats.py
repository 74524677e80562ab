"""Passages that documents share: suffix trees over prefix-partitioned suffixes of words.

What is asked of a suffix is decided by its first WINDOW words, so suffixes are cut there. Three
passes read the texts, in units of UNIT_ROWS rows of a file; between them only numbers are shuffled,
packed into one row for each unit and bin.

1. Each window is known by the least digest of its GRAM-word grams, which it shares with all windows
   of the same words. Bins of these digests say which are in several rows. A window whose digest is
   not can't be repeated, and its suffix is a leaf of its own: it goes no further. The pass also
   counts prefixes of DEPTHS words in CELLS cells each.
2. What is left, each distinct suffix of a unit once with its smallest and largest doc_id, goes to
   the group of its shortest prefix that has room for all suffixes counted under it, or of all its
   words where even 8 are too common: so a group fits in memory whatever is repeated. Groups are
   dealt into bins. There the suffixes are sorted by words, with the common depth of neighbours:
   the tree. Below a node as deep as a window all is one passage, and its smallest doc_id
   is sent back to the units that have it in a larger one.
3. Each unit looks up its windows; the words under those that are repeated go. Stretches of them
   are the maximal repeats that a document holds.

Words are compared by 16-bit digests one by one, which place a suffix in the tree, and all of a window
by 64 bits more. Texts are never shuffled. Equal doc_ids don't repeat each other; a null doc_id counts as the largest. Null
text has no words. No rows give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.sources.scratch import shared_dir

from .common import blocks, placed, release, ship, stored, table, utf8

WINDOW, GRAM = 13, 5
DEPTHS, CELL_BITS, ROOM = (1, 2, 4, 8), 12, 250_000
#: Rows of a unit, digests that are held before they are passed on, bytes and windows of a bin or so.
UNIT_ROWS, HELD, BIN_BYTES, BIN_WINDOWS = 8192, 600_000, 1 << 24, 500_000
#: Words longer than this are digested one by one: the rolling digest is weak for long periodic ones.
LONG_WORD, HASH_BYTES = 256, 1 << 18
LAST_ID = 2**63 - 1
#: Bytes of text that a task works on at a time.
RUN_BYTES = 1_000_000

_U = np.uint64
_BASE, _STEP = 0xD1342543DE82EF95, _U(0x9FB21C651E98DF25)
_INVERSE = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE, HASH_BYTES + LONG_WORD), _powers(_INVERSE, HASH_BYTES + LONG_WORD)


def word_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of the words of all texts in a row, and how many each text has."""
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    inside = ~((joined == 32) | ((joined >= 9) & (joined <= 13)))
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(start, begin))
    out = np.zeros(len(start), _U)
    a = 0
    while a < len(start):
        # words [a, b) lie within HASH_BYTES, or it is one longer word
        b = max(a + 1, int(np.searchsorted(stop, start[a] + HASH_BYTES, "right")))
        first, size = start[a], int(stop[b - 1] - start[a])
        if b == a + 1 and size > LONG_WORD:
            out[a] = xxhash.xxh3_64_intdigest(joined[first : first + size].tobytes())
        else:
            sums = np.zeros(size + 1, _U)
            np.cumsum(_BYTE[joined[first : first + size]] * _UP[:size], out=sums[1:])
            s, e = start[a:b] - first, stop[a:b] - first
            out[a:b] = mixed((sums[e] - sums[s]) * _DOWN[s] ^ ((e - s).astype(_U) << _U(56)))
            for i in np.flatnonzero(e - s > LONG_WORD):
                out[a + i] = xxhash.xxh3_64_intdigest(joined[start[a + i] : stop[a + i]].tobytes())
        a = b
    return out, counts


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A digest of each size words in a row."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, _U)
    for j in range(size):
        out = out * _STEP + words[j : j + n]
    return out


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start that lie in one text, and the text of each."""
    many = np.maximum(counts - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    first = np.cumsum(counts) - counts
    return np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner], owner


def anchors(words: np.ndarray) -> np.ndarray:
    """For each window the least digest of its grams."""
    low, have, want = grams(words, GRAM), 1, WINDOW - GRAM + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    return low


def _cells(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each depth the cell of the prefix of the suffixes that start at at."""
    return [(mixed(grams(words, d))[at] >> _U(64 - CELL_BITS)).astype(np.int64) for d in DEPTHS]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[bytes], pa.RecordBatch]]:
    """unit, ids and texts of blocks that lie in one unit, and the block."""
    for block in blocks(batches, "text", max_bytes=RUN_BYTES):
        unit = block.column("unit").to_numpy()
        ids, texts = block.column("id").to_numpy(), block.column("text").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(unit[a]), ids[a:b], texts[a:b], block.slice(a, b - a)


def _per_unit(batches: Iterator[pa.RecordBatch], part: Callable, passed_on: Callable) -> Iterator:
    """part() of each run, collected for a unit and passed on when it ends or is large."""
    now, held, size = None, [], 0
    for unit, ids, texts, _ in _runs(batches):
        if held and (unit != now or size > HELD):
            yield from passed_on(now, held)
            size = 0
        words, counts = word_digests(texts)
        held.append(part(unit, ids, words, counts))
        now, size = unit, size + len(held[-1][0])
    if held:
        yield from passed_on(now, held)


def _by_bin(bins: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bin, in the order they have."""
    order = np.argsort(bins, kind="stable")
    bins = bins[order]
    cuts = np.flatnonzero(np.diff(bins, prepend=-1, append=-1)) if len(bins) else np.zeros(1, int)
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(bins[a]), [c[a:b] for c in columns]


def packed(values: np.ndarray) -> bytes:
    """Integers as the least of them and the differences from it in as few bytes as all need."""
    low = values.min(keepdims=True)
    over = values.view(_U) - low.view(_U)
    width = next(w for w in (0, 1, 2, 4, 8) if int(over.max()) < 1 << 8 * w)
    return low.tobytes() + (over.astype(f"u{width}").tobytes() if width else b"")


def unpacked(data: bytes, n: int) -> np.ndarray:
    low, width = np.frombuffer(data, np.int64, 1), (len(data) - 8) // n
    return np.repeat(low, n) if not width else (low.view(_U) + np.frombuffer(data, f"u{width}", offset=8).astype(_U)).view(np.int64)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_MET = pa.schema([("bin", pa.int64()), ("unit", pa.int64()), ("keys", pa.binary()), ("many", pa.binary()), ("cells", pa.list_(pa.int64()))])


def _anchors_met(bins: int) -> Callable:
    def run(batches):
        cells = np.zeros((len(DEPTHS), 1 << CELL_BITS), np.int64)

        def part(unit, ids, words, counts):
            at, owner = window_starts(counts)
            for i, cell in enumerate(_cells(words, at)):
                cells[i] += np.bincount(cell, minlength=1 << CELL_BITS)
            key = anchors(words)[at]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            return key[new], owner[new]

        def passed_on(unit, held):
            sizes = np.cumsum([0] + [int(o[-1]) + 1 if len(o) else 0 for _, o in held])
            key, row = np.concatenate([k for k, _ in held]), np.concatenate([o + s for (_, o), s in zip(held, sizes, strict=False)])
            held.clear()
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            other = np.zeros(len(key), np.int64)
            other[1:] = ~new[1:] & (row[1:] != row[:-1])
            starts = np.flatnonzero(new)
            many = (np.add.reduceat(other, starts) > 0) if len(starts) else new
            key = key[starts]
            found = [(b, unit, k.tobytes(), m.tobytes(), None) for b, (k, m) in _by_bin((mixed(key) % _U(bins)).astype(np.int64), key, many)]
            if found:
                yield _batch(_MET, found)

        yield from _per_unit(batches, part, passed_on)
        yield _batch(_MET, [(-1, 0, b"", b"", cells.ravel().tolist())])

    return run


def _several(met: pd.DataFrame) -> pd.DataFrame:
    """For each unit those of its digests that are in several rows of the table."""
    keys = [np.frombuffer(k, _U) for k in met["keys"]]
    key, of = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    many = np.concatenate([np.frombuffer(m, bool) for m in met["many"]])
    order = np.argsort(key, kind="stable")
    key, of, many = key[order], of[order], many[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    keep = np.repeat((size > 1) | np.logical_or.reduceat(many, starts), size)
    key, of = key[keep], of[keep]
    found = list(_by_bin(of, key))
    return pd.DataFrame({"unit": [met["unit"].iat[i] for i, _ in found], "keys": [k.tobytes() for _, (k,) in found]})


_SUFFIXES = pa.schema([("bin", pa.int64()), ("unit", pa.int64()), ("digest", pa.binary()), ("least", pa.binary()), ("spread", pa.binary()), ("words", pa.binary())])


def _suffixes(bins: int, counted: np.ndarray, several: Callable) -> Callable:
    def run(batches):
        asked: list = [None, None]

        def part(unit, ids, words, counts):
            if asked[0] != unit:
                asked[:] = unit, np.unique(np.concatenate([np.zeros(0, _U)] + [np.frombuffer(k, _U) for k in several(unit)["keys"]]))
            at, owner = window_starts(counts)
            keep = _among(anchors(words)[at], asked[1])[0]
            at, owner = at[keep], owner[keep]
            digest = grams(words, WINDOW)[at]
            group = mixed(digest)
            for i, cell in reversed(list(enumerate(_cells(words, at)))):
                group = np.where(counted[i][cell] <= ROOM, mixed(((i << CELL_BITS) + cell).astype(_U) + _U(1)), group)
            labels = np.lib.stride_tricks.sliding_window_view((words >> _U(48)).astype(np.uint16), WINDOW) if len(at) else np.zeros((0, WINDOW), np.uint16)
            return digest, ids[owner], (group % _U(bins)).astype(np.int64), labels[at]

        def passed_on(unit, held):
            digest, ids, to, labels = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(digest, kind="stable")
            digest, ids = digest[order], ids[order]
            starts = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]])) if len(digest) else np.zeros(0, int)
            if not len(starts):
                return
            first = order[starts]
            low, high, digest = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts), digest[starts]
            rows = [(b, unit, digest[i].tobytes(), packed(low[i]), packed(high[i] - low[i]), labels[first[i]].tobytes()) for b, (i,) in _by_bin(to[first], np.arange(len(first)))]
            yield _batch(_SUFFIXES, rows)

        yield from _per_unit(batches, part, passed_on)

    return run


def _among(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are known (ascending), and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def common_depths(words: np.ndarray) -> np.ndarray:
    """How many words each sorted suffix shares with the one before it."""
    differs = words[1:] != words[:-1]
    depth = np.where(differs.any(1), differs.argmax(1), words.shape[1]) if len(differs) else np.zeros(0, np.int64)
    return np.concatenate([[0], depth])


def _nodes(met: pd.DataFrame) -> pd.DataFrame:
    """The tree of a bin: for each unit its suffixes under deep nodes that a smaller doc_id than one
    of its own has too, and the node's smallest."""
    digests = [np.frombuffer(d, _U) for d in met["digest"]]
    of = np.repeat(np.arange(len(digests)), [len(d) for d in digests])
    digest = np.concatenate(digests)
    least, spread = (np.concatenate([unpacked(v, len(d)) for v, d in zip(met[c], digests, strict=True)]) for c in ("least", "spread"))
    most = least + spread
    words = np.concatenate([np.frombuffer(w, np.uint16).reshape(-1, WINDOW) for w in met["words"]])
    order = np.lexsort((digest, *(words[:, j] for j in range(WINDOW - 1, -1, -1))))
    digest, of, least, most, words = digest[order], of[order], least[order], most[order], words[order]
    deep = common_depths(words) >= WINDOW
    deep[1:] &= digest[1:] == digest[:-1]
    starts = np.flatnonzero(~deep)
    smallest = np.repeat(np.minimum.reduceat(least, starts), np.diff(np.append(starts, len(digest))))
    told = smallest < most
    found = list(_by_bin(of[told], digest[told], smallest[told]))
    return pd.DataFrame({"unit": [met["unit"].iat[i] for i, _ in found], "keys": [k.tobytes() for _, (k, _) in found], "least": [v.tobytes() for _, (_, v) in found]})


def _by_unit(df: DataFrame, units: int) -> Callable[[int], dict[str, list]]:
    """Stores df by unit, in folders of a few units each; a function that reads a unit's rows there."""
    spark = df.sparkSession
    where, folders = shared_dir(spark), min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), units // 4 + 1)
    kept = df.withColumn("folder", F.expr(f"pmod(unit, {folders})").cast("int"))
    kept.repartition(folders, "folder").sortWithinPartitions("folder", "unit").write.partitionBy("folder").parquet(where)
    columns = [c for c in df.columns if c != "unit"]

    def rows(unit: int) -> dict[str, list]:
        store, root = fs.FileSystem.from_uri(where)
        files = store.get_file_info(fs.FileSelector(f"{root}/folder={unit % folders}", allow_not_found=True))
        out: dict[str, list] = {c: [] for c in columns}
        for f in files:
            if f.base_name.endswith(".parquet"):
                for c, values in pq.read_table(f.path, filesystem=store, columns=columns, filters=[("unit", "==", unit)], partitioning=None).to_pydict().items():
                    out[c] += values
        return out

    return rows


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.string())])
KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string"


def _removed(repeated: Callable) -> Callable:
    def run(batches):
        now, keys, least = None, None, None
        for unit, ids, texts, block in _runs(batches):
            if unit != now:
                found = repeated(unit)
                keys = np.concatenate([np.zeros(0, _U)] + [np.frombuffer(k, _U) for k in found["keys"]])
                least = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(v, np.int64) for v in found["least"]])
                keys, first = np.unique(keys, return_index=True)
                now, least = unit, least[first]
            words, counts = word_digests(texts)
            at, owner = window_starts(counts)
            known, place = _among(grams(words, WINDOW)[at], keys)
            at = at[known][least[place[known]] < ids[owner[known]]]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            rows, first = [], 0
            for doc_id, text, n in zip(block.column("doc_id").to_pylist(), texts, counts.tolist(), strict=True):
                own = gone[first : first + n]
                removed = int(own.sum())
                left, spans = text.split(), []
                if removed:
                    left = list(compress(left, (~own).tolist()))
                    edge = np.diff(own.view(np.int8), prepend=np.int8(0), append=np.int8(0))
                    spans = [{"start": a, "stop": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                rows.append((doc_id, n, removed, spans, b" ".join(left).decode("utf-8", "replace")))
                first += n
            yield _batch(_KEPT, rows)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """For every row doc_id, n_words, n_removed, spans (the stretches of words removed, end
    exclusive) and kept (the other words, joined by blanks): words go that lie in a window which
    also starts in a document with a smaller doc_id."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = placed(docs)
    rows = docs.select(
        F.xxhash64("__file", F.floor(F.col("__row") / UNIT_ROWS)).alias("unit"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        utf8().alias("text"),
    )
    size, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    units = n // UNIT_ROWS
    met = stored(rows.mapInArrow(_anchors_met(max(parts, size // BIN_BYTES)), "bin long, unit long, keys binary, many binary, cells array<long>"))
    counted = np.zeros(len(DEPTHS) << CELL_BITS, np.int64)
    for r in met.where("bin < 0").select(F.posexplode("cells").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        counted[r["at"]] = r["n"]
    counted = counted.reshape(len(DEPTHS), -1)
    several = _by_unit(met.where("bin >= 0").groupBy("bin").applyInPandas(_several, "unit long, keys binary"), units)
    release(met)
    suffixes = rows.mapInArrow(_suffixes(max(parts, int(counted[0].sum()) // BIN_WINDOWS), counted, several), "bin long, unit long, digest binary, least binary, spread binary, words binary")
    repeated = _by_unit(suffixes.groupBy("bin").applyInPandas(_nodes, "unit long, keys binary, least binary"), units)
    return rows.mapInArrow(_removed(repeated), KEPT)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT id, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
k AS (
  SELECT id, doc_id, pos, word, string_agg(word, ' ') OVER ahead AS win, count(*) OVER ahead AS n
  FROM w WINDOW ahead AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT id, pos, word, n = 13 AND coalesce(min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY win, n = 13) < coalesce(doc_id, 9223372036854775807), false) AS starts FROM k),
c AS (SELECT id, pos, word, max(starts::INT) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
s AS (SELECT id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '')) AS kept_sha256 FROM c GROUP BY id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN s USING (id)
"""
