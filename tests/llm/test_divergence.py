import os
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from glasspane.llm import divergence as d

D = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    """rows: lang, source, text."""
    rows = [tuple(v or "" for v in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, TERM.findall(t.translate(LOWER))) for la, s, t in rows if la == lang]
        seen = Counter(w for _, t in own for w in set(t))
        kept = {w for w, n in seen.items() if n >= 3}
        counts = {s: Counter() for s, _ in own}
        for s, t in own:
            counts[s].update(w for w in t if w in kept)
        whole = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = [(sum((p(c, w) - p(o, w)) ** 2 // p(o, w) for w in kept), i) for i, o in counts.items() if i != s]
            terms = [((p(c, w) - p(whole, w)) ** 2 // p(whole, w), w) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found, top in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (v, i) in enumerate(found[:top])]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


SOME = [("en", f"s{i % 4}", " ".join(f"W{(i * j) % (17 + i % 5)}ord é{'abc'[j % 3]}" for j in range(i % 40))) for i in range(120)]
CASES = [
    SOME,
    [(None, None, None), ("", "", ""), ("", "b", "one two"), (None, "c", "one, ONE! two")],
    [("fr", "a", "un deux trois")] * 4 + [("fr", "b", ""), ("fr", "c", None), ("de", "only", "eins eins"), ("de", "only", "eins"), ("de", "only", "EINS")],
    [("en", "a", "x " * 200_000), ("en", "b", "x y"), ("en", "b", "y x"), ("en", "c", "y" * 200_000)],
    [("en", f"s{i % 3}", " ".join("".join(chr(97 + (n // 26**k) % 26) for k in range(3)) for n in range(i % 3 * 100, 900))) for i in range(9)],
]


@pytest.mark.parametrize("rows", CASES)
def test_rows_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "lang string, source string, text string, n int, term string, block int")
    assert got(d.divergences(docs)) == expected(rows)


def test_small_tiles_and_flushes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_TERMS", 3)
    monkeypatch.setattr(d, "TILE_CELLS", 7)
    docs = spark.createDataFrame(SOME, "lang string, source string, text string")
    assert got(d.divergences(docs)) == expected(SOME)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert d.divergences(docs).collect() == []


def test_terms_are_whole_at_the_cuts(monkeypatch):
    monkeypatch.setattr(d, "PIECE", 5)
    text = "ab cdefghij É2kl--mnop qr stuvwxyz".encode() * 3
    assert [w for some in d.terms(text) for w in some] == [w.encode() for w in TERM.findall(text.decode().translate(LOWER))]


def test_shares_are_exact_for_large_counts():
    counts, of = np.array([0, 1, 10**15, 4 * 10**15]), np.array([9 * 10**15 + 7] * 4)
    assert d.scaled(counts, of).tolist() == [1 + 10**9 * (int(c) + 1) // int(n) for c, n in zip(counts, of, strict=True)]


def test_pairs_in_parts_equal_the_whole(monkeypatch):
    p = np.random.default_rng(3).integers(1, 10**9, (7, 50))
    want = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in p]
    assert d.pair_sums(p).tolist() == want
    monkeypatch.setattr(d, "PAIR_CELLS", 120)
    assert d.pair_sums(p).tolist() == want


def test_a_tile_lists_ties_in_order():
    counts = pd.DataFrame({"source": ["a"] * 300, "term": [f"t{i:03d}" for i in range(300)][::-1], "n": [1] * 300})
    groups = pd.DataFrame({"lang": ["x"] * 2, "source": ["a", "b"], "total": [300, 0], "kept": [300] * 2})
    found = d.tile(counts, groups)
    assert found[found.part == "term"]["item"].tolist() == []
    groups["total"] = [300, 700]
    found = d.tile(counts, groups)
    assert found[found.part == "term"]["item"].tolist() == [f"t{i:03d}" for i in range(d.TOP)]


def test_whole_table_against_brute_force_and_sql(spark):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    found = got(d.op12_source_divergence(spark, D))
    assert found == expected(rows)
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    assert sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({d.OP12_SQL})").fetchall()) == found
