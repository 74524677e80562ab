"""Benchmark decontamination: short test items inside long documents.

Words are lower-cased runs of letters and digits; a shingle is five words in a row (a test item
of fewer words is one shingle of its own width). A document is contaminated by an item if it
holds at least 80 % of the item's distinct shingles.

The search is MinHash for containment: only the small side, the item, is sketched, by its least
hashes (bottom-k), and these are looked up among the hashes of the whole document. Likeness of two
sketches would go to zero as documents grow; this doesn't. Items are partitioned by size, powers
of two of their distinct shingles d, and a partition has one sketch size k, over 20 % of its
largest d. A document may lack at most m = d - ceil(0.8 d) of an item's shingles, so it holds at
least k - m >= 1 hashes of the sketch: items that reach this are candidates, and nothing is missed,
whatever the length, form or place. The least hashes are taken in an order that puts shingles
first that few items of the block have, so that a common phrase makes no candidates where an item
has others. Candidates are verified: shingles of the whole document, compared as words, are counted.

Items are a query set: tasks normalise them and write them to the shared folder in blocks of
bounded size, and one task a block sketches it and stores the sketches, once. A task that searches documents
loads one block's sketches after another and keeps the last few. The driver sees only names of blocks; documents
are read once and never shuffled.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import OrderedDict

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.sources.scratch import shared_dir

from .common import per_block, placed, release, ship, stored, table, utf8, without

WIDTH, CONTAINMENT = 5, 0.8
#: Test items, and their characters, of a block, about: a sketched block takes 60 MB at most.
ITEM_BLOCK, ITEM_CHARS = 40_000, 20_000_000
#: Sketched blocks that a Python worker keeps; bytes of documents that meet each block together,
#: where all blocks are kept and where they must be loaded again.
KEPT_BLOCKS, DOC_BYTES, MORE_DOC_BYTES = 2, 1_500_000, 12_000_000
WORD = re.compile(r"[^\W_]+")

STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHash:
    """A number for each word, kept between texts; the same in every process."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 32-bit number for every run of width words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out = hashes[:n].copy()
    for k in range(1, width):
        out ^= out >> np.uint64(29)
        out *= STEP
        out += hashes[k : k + n]
    out ^= out >> np.uint64(29)
    out *= STEP
    return (out >> np.uint64(32)).astype(np.uint32)


def _lacking(d: int, containment: float) -> int:
    """How many of d shingles a document may lack; it must hold one at least."""
    return d - max(1, math.ceil(containment * d))


class Partition:
    """Sketches of items of like size: their hashes in order, with the items that have them, and
    how many an item's sketch must share with a document."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def candidates(self, doc: np.ndarray, values: np.ndarray, need: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) from distinct (document, hash); need: by item."""
        left, right = np.searchsorted(self.keys, values, "left"), np.searchsorted(self.keys, values, "right")
        n = right - left
        if not n.any():
            return []
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs, shared = np.unique(np.repeat(doc, n).astype(np.int64) << 32 | self.owners[at], return_counts=True)
        pairs = pairs[shared >= need[pairs & 0xFFFFFFFF]]
        return list(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True))


class Index:
    """Sketches of the items (id, words, shingle width) of one block, by width and size."""

    def __init__(self, items: list[tuple[int, str, int]], containment: float):
        self.items, self.need = items, np.ones(len(items), np.int64)
        self._sets: dict[int, set[tuple[str, ...]]] = {}
        hasher = WordHash()
        #: By width: a first lookup of 16 to 32 bits a hash, and the partitions by size.
        self.tables: dict[int, tuple[np.ndarray, list[Partition]]] = {}
        for width in sorted({w for _, _, w in items}):
            places = [i for i, item in enumerate(items) if item[2] == width]
            own = [np.unique(shingles(hasher(items[i][1].split(" ")), width)) for i in places]
            every, holders = np.unique(np.concatenate(own), return_counts=True)
            sketches: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, values in zip(places, own, strict=True):
                d = len(self.distinct(i))
                size = d.bit_length()
                k = _lacking((1 << size) - 1, containment) + 1
                least = values[np.lexsort((values, holders[np.searchsorted(every, values)]))[:k]]
                self.need[i] = max(1, len(least) - _lacking(d, containment))
                sketches.setdefault(size, []).append((i, least))
            parts = [Partition(np.concatenate([v for _, v in x]), np.repeat([i for i, _ in x], [len(v) for _, v in x])) for x in sketches.values()]
            n = sum(len(p.keys) for p in parts)
            mask = (1 << max(12, (16 * n).bit_length())) - 1
            seen = np.zeros((mask + 1) >> 3, np.uint8)
            for p in parts:
                low = p.keys & np.uint32(mask & 0xFFFFFFFF)
                np.bitwise_or.at(seen, low >> np.uint32(3), np.uint8(1) << (low & np.uint32(7)).astype(np.uint8))
            self.tables[width] = seen, parts

    def distinct(self, i: int) -> set[tuple[str, ...]]:
        """The shingles of an item."""
        if i not in self._sets:
            if len(self._sets) > 2_000:
                self._sets.clear()
            words, width = self.items[i][1].split(" "), self.items[i][2]
            self._sets[i] = set(zip(*(words[k:] for k in range(width)), strict=False))
        return self._sets[i]

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray, width: int) -> list[tuple[int, int]]:
        """(document, item) places, in order, where the document shares enough of the item's
        sketch. hashes: of all words of some documents; bounds: where each begins, and the end."""
        seen, parts = self.tables[width]
        values = shingles(hashes, width)
        bits = values & np.uint32(min(8 * len(seen) - 1, 0xFFFFFFFF))
        hit = np.flatnonzero(seen[bits >> np.uint32(3)] >> (bits & np.uint32(7)).astype(np.uint8) & 1)
        doc = np.searchsorted(bounds, hit, "right") - 1
        inside = hit + width <= bounds[doc + 1]  # not across the border of two documents
        pairs = np.unique(doc[inside].astype(np.uint64) << np.uint64(32) | values[hit[inside]])
        docs, probes = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return sorted(x for p in parts for x in p.candidates(docs, probes, self.need))


def item_blocks(items: DataFrame, size: int = ITEM_BLOCK) -> DataFrame:
    """item_id, words and width of the items that have words, stored in files of about `size`
    items and ITEM_CHARS characters. Null ids and texts are left out; repeated items stay."""

    def make():
        def work(block):
            words = [words_of(t.decode("utf-8", "replace")) for t in block["text"]]
            return {"item_id": block["item_id"], "words": [" ".join(w) for w in words], "width": [min(WIDTH, len(w)) for w in words]}

        return work

    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), utf8().alias("text"))
    plain = stored(per_block(known, "text", make, "item_id bigint, words string, width int").where("width > 0"))
    sizes = plain.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("chars")).first()
    n = max(1, math.ceil(sizes.n / size), math.ceil(sizes.chars / ITEM_CHARS))
    out = stored(plain.repartition(n))
    release(plain)
    return out


def sketched(path: str, containment: float) -> list[Index]:
    """The items of a stored block, sketched, a part of at most ITEM_CHARS characters (or one item) each."""
    store, where = fs.FileSystem.from_uri(path)
    parts, chars = [[]], 0
    with store.open_input_file(where) as data:
        for batch in pq.ParquetFile(data).iter_batches(2_000):
            for item in zip(*(batch[c].to_pylist() for c in ("item_id", "words", "width")), strict=True):
                if parts[-1] and chars + len(item[1]) > ITEM_CHARS:
                    parts.append([])
                    chars = 0
                parts[-1].append(item)
                chars += len(item[1])
    return [Index(p, containment) for p in parts if p]


def stored_sketches(blocks: DataFrame, containment: float) -> list[str]:
    """A file of sketches for each file of item_blocks(), made by a task each; their names."""
    spark, folder = blocks.sparkSession, blocks._glasspane_folder
    ship(spark)
    store, root = fs.FileSystem.from_uri(folder)
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".parquet"))
    where = shared_dir(spark)
    there, path = fs.FileSystem.from_uri(where)
    there.create_dir(path, recursive=True)

    def make(name: str) -> None:
        out, own = fs.FileSystem.from_uri(where)
        data = pickle.dumps(sketched(f"{folder}/{name}", containment), protocol=5)
        with out.open_output_stream(f"{own}/{name}.sketches") as file:  # the same bytes if a task runs again
            file.write(data)

    if names:
        spark.sparkContext.parallelize(names, len(names)).foreach(make)
    return [f"{where}/{name}.sketches" for name in names]


_LOADED: OrderedDict[str, list[Index]] = OrderedDict()


def loaded(path: str) -> list[Index]:
    """A file of sketches; the last few are kept by the worker."""
    if path not in _LOADED:
        while len(_LOADED) >= KEPT_BLOCKS:
            _LOADED.popitem(last=False)
        store, where = fs.FileSystem.from_uri(path)
        with store.open_input_file(where) as data:
            _LOADED[path] = pickle.loads(data.read())
    _LOADED.move_to_end(path)
    return _LOADED[path]


def _search(docs: DataFrame, own: Column, kind: str, items: DataFrame, containment: float, block: int) -> DataFrame:
    """own (of SQL type kind) of the document rows, and what matches() returns."""
    blocks = item_blocks(items, block)
    paths = stored_sketches(blocks, containment)
    release(blocks)
    columns = ("own", "item_id", "shared", "item_shingles", "containment")

    def make():
        hasher = WordHash()

        def work(batch):
            texts = [words_of(t.decode("utf-8", "replace")) for t in batch["text"]]
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            hashes = hasher([w for t in texts for w in t])
            out = []
            for index in (index for path in paths for index in loaded(path)):
                for width in index.tables:
                    held: dict[int, set] = {}
                    for d, i in index.candidates(hashes, bounds, width):
                        if d not in held:
                            t = texts[d]
                            held = {d: set(zip(*(t[k:] for k in range(width)), strict=False))}
                        distinct = index.distinct(i)
                        shared = len(held[d] & distinct)
                        if shared >= containment * len(distinct):
                            out.append((batch["own"][d], index.items[i][0], shared, len(distinct), shared / len(distinct)))
            return dict(zip(columns, zip(*out, strict=True) if out else ([],) * 5, strict=True))

        return work

    rows = docs.select(own.alias("own"), utf8().alias("text"))
    return per_block(rows, "text", make, f"own {kind}, item_id bigint, shared int, item_shingles int, containment double", max_bytes=DOC_BYTES if len(paths) <= KEPT_BLOCKS else MORE_DOC_BYTES)


def matches(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, shared and item_shingles (counts of distinct shingles), containment:
    one row for each document row and item that reach the containment.

    Null or empty texts and items without words match nothing; repeated rows give repeated
    matches; no items or no documents give no rows.
    """
    return _search(docs, F.col("doc_id").cast("bigint"), "bigint", items, containment, block).withColumnRenamed("own", "doc_id")


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows that no item contaminates, all their columns. Of rows that share a doc_id, or
    have none, only those whose own text is contaminated go."""
    rows = placed(docs)
    found = _search(rows, F.struct(F.col("__file").alias("file"), F.col("__row").alias("row")), "struct<file: bigint, row: bigint>", items, containment, ITEM_BLOCK)
    return without(rows, found.select("own.file", "own.row").distinct()).select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
