import hashlib
import os
import zlib

import duckdb
import pytest

from glasspane.llm import merkle as m

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and for each node its siblings with their side, bottom up."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, at in enumerate(where):
            beside = at ^ 1
            paths[i].append((at & 1, level[beside] if beside < len(level) else None))
            where[i] = at >> 1
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    done = []
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        done.append((own, *tree([leaf(*r) for r in own])))
    root, above = tree([d[1] for d in done])
    out = []
    for (own, subroot, paths), more in zip(done, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            told = list(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                told[3] += 1
            end = leaf(*told)
            for side, other in path + more:
                end = h(end) if other is None else h(other, end) if side else h(end, other)
            proof = h(*(s for _, s in path + more if s is not None))
            out.append((r[0], leaf(*r), subroot, root, proof, end, end == root))
    return sorted(out, key=str)


def rows_of(n, langs=("en", "de", None, "")):
    return [(i * 7 % (n + 3), f"s{i % 3}", langs[min(i % 9, len(langs) - 1)], i, f"text {i} é") for i in range(n)]


CASES = [
    rows_of(200),
    rows_of(1),
    rows_of(2, ("en",)),
    [(i, "s", "en", 5, "x") for i in range(65)] + [(3, "s", "fr", 1, "")],
    [(None, None, None, None, None), (None, "a", "en", 3, None), (4, None, "en", None, "t" * 100_000), (-5, "", "", 0, ""), (2**63 - 1, "s", "é", 2**63 - 1, "z")],
    [(5, "s", "en", 5, "same")] * 40 + [(5, "s", "en", 5, "other")] * 3,
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("height", [2, 10])
def test_rows_equal_brute_force(spark, rows, height):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, m.manifest(docs, height).collect()), key=str) == expected(rows)


def test_one_level_a_superstep(spark):
    rows = rows_of(37)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, m.manifest(docs, 1).collect()), key=str) == expected(rows)


def test_tampering_is_found_where_it_is(spark):
    rows = [(i, "s", "en", i, "t") for i in range(300)]
    got = m.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    got = m.manifest(docs)
    assert got.collect() == [] and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_vertex_that_lacks_a_message_is_an_error(spark):
    nodes = spark.createDataFrame([("=en", 0, 3, bytes(32)), ("=en", 2, 3, bytes(32))], m.NODE)
    with pytest.raises(Exception, match="has 2 messages of 3 nodes"):
        m.climb(nodes)


def test_whole_table_against_brute_force_and_sql(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    got = sorted(map(tuple, m.op11_merkle_manifest(spark, D).collect()), key=str)
    assert got == expected(rows)
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({m.OP11_SQL})").fetchall(), key=str) == got
