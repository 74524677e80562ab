"""Byte-level BPE encoding and decoding with numpy matrices.

A text is cut into the matches of the split pattern, and each distinct match of a block is
encoded once. Those not met before go into padded matrices by length; in each round
every row merges its leftmost pair of minimum rank, found by a hashed pair lookup, and the
matrix closes the gap (compaction) and drops rows that are done. A match longer than LONGEST_ROW
bytes is folded into a matrix of slices of its own, so that a merge closes the gap in one slice.

Null text is empty: no tokens, the digests of nothing. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_block, table, utf8

NONE = np.int32(2**31 - 1)
#: Matches, and their characters, kept between blocks; beyond that a task forgets and fills anew
#: (results stay the same).
CACHE_WORDS, CACHE_CHARS = 250_000, 4_000_000
#: Matches with more bytes are folded into slices: as one row, each round would go over all of it.
LONGEST_ROW, SLICE = 2_048, 512


class PairTable:
    """Rank of an adjacent pair of ids: open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(rank), 1) * 3))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        key, todo, at = left.astype(np.int64) << 32 | right, np.arange(len(rank)), self._slot(left.astype(np.int64) << 32 | right)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.key[at[todo]] < 0
            slots, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.key[slots], self.rank[slots] = key[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE for pairs that don't merge or hold padding (negative ids)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        ok = (left >= 0) & (right >= 0)
        out, at, todo = np.full(key.shape, NONE, np.int32), self._slot(key), ok
        for _ in range(self.probes):
            seen = self.key[at]
            hit = todo & (seen == key)
            out[hit] = self.rank[at[hit]]
            todo = todo & (seen != key) & (seen >= 0)
            if not todo.any():
                break
            at = (at + 1) & (len(self.key) - 1)
        return out


class Tokenizer:
    """Encodes and decodes by a rank file (base64 token and rank a line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*pairs, strict=True)))
        self.pattern = regex.compile(pattern)
        self.words: dict[str, list[int]] = {}
        self.held = 0  # characters of the words

    def _matrix(self, words: list[bytes], width: int) -> list[list[int]]:
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        toks = np.where(np.arange(width) < lengths[:, None], self.byte_id[flat], -1).astype(np.int32)
        ranks = self.pairs.find(toks[:, :-1], toks[:, 1:])
        done: list[list[int]] = [[]] * len(words)
        rows = np.arange(len(words))
        while len(rows):  # each round shortens every row that is left by one
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            alive = best != NONE
            for i, row, n in zip(rows[~alive].tolist(), toks[~alive].tolist(), lengths[~alive].tolist(), strict=True):
                done[i] = row[:n]
            rows, toks, ranks, at, best, lengths = rows[alive], toks[alive], ranks[alive], at[alive], best[alive], lengths[alive] - 1
            if not len(rows):
                break
            r = np.arange(len(rows))
            toks[r, at] = best
            wide = np.arange(toks.shape[1] - 1)
            toks = np.take_along_axis(toks, wide + (wide > at[:, None]), 1)
            wide = wide[:-1]
            ranks = np.take_along_axis(ranks, wide + (wide > at[:, None]), 1)
            if ranks.shape[1]:
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < ranks.shape[1])
                    ranks[r[ok], side[ok]] = self.pairs.find(toks[r[ok], side[ok]], toks[r[ok], side[ok] + 1])
        return done

    def _folded(self, word: bytes) -> list[int]:
        """Ids of one long match, as rows of SLICE tokens; each round merges its leftmost pair of
        minimum rank, which may reach into the next row, and closes the gap in one row."""
        ids, n = self.byte_id[np.frombuffer(word, np.uint8)], len(word)
        height = -(-n // SLICE)
        toks, ranks = np.full((height, SLICE), -1, np.int32), np.full((height, SLICE), NONE, np.int32)
        toks.reshape(-1)[:n] = ids
        ranks.reshape(-1)[: n - 1] = self.pairs.find(ids[:-1], ids[1:])
        size, least = [min(SLICE, n - SLICE * r) for r in range(height)], ranks.min(1)
        after, before = list(range(1, height + 1)), list(range(-1, height - 1))  # rows that hold tokens
        get, names = self.ranks.get, self.bytes_of
        rank = lambda a, b: get(names[a] + names[b], NONE)
        while (best := least[r := int(least.argmin())]) != NONE:
            at = int(ranks[r].argmin())
            row, gap = (r, at + 1) if at + 1 < size[r] else (after[r], 0)
            toks[r, at] = best
            m = size[row] = size[row] - 1
            for matrix, empty in ((toks, -1), (ranks, NONE)):
                matrix[row, gap:m] = matrix[row, gap + 1 : m + 1]
                matrix[row, m] = empty
            if not m:
                after[r] = after[row]
                if after[r] < height:
                    before[after[r]] = r
            right = toks[r, at + 1] if at + 1 < size[r] else toks[after[r], 0] if after[r] < height else -1
            ranks[r, at] = rank(best, right) if right >= 0 else NONE
            if at or before[r] >= 0:
                p, q = (r, at - 1) if at else (before[r], size[before[r]] - 1)
                ranks[p, q] = rank(toks[p, q], best)
                least[p] = ranks[p].min()
            least[r], least[row] = ranks[r].min(), ranks[row].min()
        return toks[toks >= 0].tolist()

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pattern matches, each merged by itself, in buckets of like length."""
        out: list[list[int]] = [[]] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = [whole]
            elif len(w) > LONGEST_ROW:
                out[i] = self._folded(w)
            elif w:
                buckets.setdefault(1 << (len(w) - 1).bit_length() if len(w) < 8 else -(-len(w) // 4) * 4 if len(w) < 64 else 1 << (len(w) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, 400_000 // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._matrix([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, cut = self.words, [self.pattern.findall(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(ids)
        if len(ids) + len(new) > CACHE_WORDS or self.held > CACHE_CHARS:
            ids.clear()
            self.held = 0
            new = set(chain.from_iterable(cut))
        if new:
            words = list(new)
            ids.update(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
            self.held += sum(map(len, words))
        return [list(chain.from_iterable(map(ids.__getitem__, words))) for words in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file, once a Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = Tokenizer(path, pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids (array) if keep_ids.

    One narrow pass over docs; path must be readable at the same place on every executor.
    """

    def make():
        tok = tokenizer(path, pattern)

        def work(block):
            rows = tok.encode([x.decode("utf-8", "replace") for x in block["text"]])
            sha = lambda b: hashlib.sha256(b).hexdigest()
            out = {
                "doc_id": block["doc_id"],
                "n_tokens": [len(r) for r in rows],
                "ids_sha256": [sha(" ".join(map(tok.text_of.__getitem__, r)).encode()) for r in rows],
                "decoded_sha256": [sha(tok.decode(r)) for r in rows],
            }
            return out | ({"ids": rows} if keep_ids else {})

        return work

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return per_block(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text")), "text", make, schema, max_bytes=1_000_000)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
