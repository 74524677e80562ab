import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from glasspane.llm import repeats as r

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    least, last = {}, float("inf")
    for (i, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - 12):
            key = tuple(w[a : a + 13])
            least[key] = min(least.get(key, last), last if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if least[tuple(w[a : a + 13])] < (last if i is None else i):
                gone[a : a + 13] = [True] * 13
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out.append((i, len(w), sum(gone), spans, " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((x["doc_id"], x["n_words"], x["n_removed"], [tuple(s) for s in x["spans"]], x["kept"]) for x in df.collect()), key=str)


def made(n, seed, shared=4):
    g = random.Random(seed)
    passages = [" ".join(g.choice("the of a to in it is on as be".split()) for _ in range(g.randint(10, 30))) for _ in range(shared)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(g.randint(0, 4)):
            own = " ".join(f"w{g.randint(0, 60)}" for _ in range(g.randint(0, 25)))
            parts += [own, g.choice([*passages, "", "a  b\tc\nd"])]
        rows.append((g.randint(0, n * 2), " ".join(parts)))
    return rows


COPY = " ".join(f"word{i}" for i in range(40))
CASES = [
    made(80, 1),
    made(200, 2, shared=1),
    [(None, COPY), (None, COPY + " x"), (5, COPY[:-2] + "zz"), (5, COPY), (-3, None), (4, ""), (6, " \t\n ")],
    [(2**63 - 1, COPY), (7, COPY), (7, COPY)],
    [(1, "a " * 30), (2, "a " * 13), (3, "a " * 12), (4, "a " * 300)],
    [(3, " ".join(f"n{i}" for i in range(30_000))), (1, " ".join(f"n{i}" for i in range(29_000, 29_020))), (2, "é" * 100_000 + " " + COPY), (9, COPY)],
    [(i, COPY if i % 3 else f"{i} " + COPY) for i in range(300)],
]
SCHEMA = "doc_id long, text string, unit int, bin string, id int"


@pytest.mark.parametrize("rows", CASES)
def test_rows_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(*x, 1, "clash", 2) for x in rows], SCHEMA)
    assert got(r.without_repeats(docs)) == expected(rows)


@pytest.mark.parametrize("room", [0, 40])
def test_small_units_bins_and_groups_give_the_same(spark, monkeypatch, room):
    for name, value in (("UNIT_ROWS", 7), ("HELD", 200), ("BIN_BYTES", 500), ("BIN_WINDOWS", 100), ("ROOM", room)):
        monkeypatch.setattr(r, name, value)
    rows = made(120, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(r.without_repeats(docs)) == expected(rows)


def test_empty_table(spark):
    assert r.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_and_their_digests(monkeypatch):
    monkeypatch.setattr(r, "HASH_BYTES", 64)
    texts = [b"", b" ", b"a", b"a b\x0bc \x1f \xc2\xa0d", b"x" * 300 + b" " + b"y" * 300 + b" a", "é b".encode() * 50]
    digests, counts = r.word_digests(texts)
    assert counts.tolist() == [len(WORD.findall(t.decode())) for t in texts]
    known = {}
    for word, digest in zip([w for t in texts for w in WORD.findall(t.decode())], digests.tolist(), strict=True):
        assert known.setdefault(word, digest) == digest
    assert len(set(known.values())) == len(known)


def test_packed_integers():
    for values in ([5], [-3, -3], [2**63 - 1, -(2**63), 0], [10, 300, 7], [0, 70_000], list(range(-9, 2**33, 2**29))):
        got = np.array(values, np.int64)
        assert r.unpacked(r.packed(got), len(got)).tolist() == values


def test_anchors_are_the_least_grams():
    words = np.random.default_rng(1).integers(0, 2**63, 60, dtype=np.uint64)
    low = r.grams(words, r.GRAM).tolist()
    assert r.anchors(words).tolist() == [min(low[a : a + 9]) for a in range(60 - 12)]
    assert r.anchors(words[:12]).tolist() == [] and r.anchors(words[:0]).tolist() == []


def test_depths_of_sorted_suffixes():
    words = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 2, 3]], np.uint32)
    assert r.common_depths(words).tolist() == [0, 3, 2, 1, 0]


def test_whole_table_against_brute_force_and_sql(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{D}/documents.parquet").collect()]
    found = sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in r.op13_substring_dedup(spark, D).collect())
    assert found == sorted((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, _, k in expected(rows))
    assert sum(x[2] for x in found) > 1000
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    assert sorted(con.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({r.OP13_SQL})").fetchall()) == found
