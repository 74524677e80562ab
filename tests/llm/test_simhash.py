import hashlib
import random
import re

import numpy as np
import xxhash

from glasspane.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: id to fingerprint."""
    label = {i: i for i in fps}
    ids = list(fps)
    while True:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
        if not changed:
            return label


def test_fingerprints():
    for t in ["", " ", "a", "A b", "a b c", "A  B\tc d", "É x é\x1cq  z", "a b c " * 50, "  x y"]:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_every_pair_within_three_bits_shares_a_key():
    rng = random.Random(3)
    code = simhash.Golay()
    base = [rng.getrandbits(64) for _ in range(4000)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for x in base]
    sides = [simhash.key_lists(np.array(x, np.uint64), code) for x in (base, near)]
    of = lambda side, i: set(side[0][sum(side[1][:i]) : sum(side[1][: i + 1])].tolist())
    for i in random.Random(4).sample(range(len(base)), 300):
        assert of(sides[0][0], i) & of(sides[1][1], i) and of(sides[1][0], i) & of(sides[0][1], i)
    for _, n in sides[0]:
        assert n.min() >= 7 and n.max() <= 72


def planted(n, rng):
    fps = []
    for _ in range(n):
        if fps and rng.random() < 0.6:
            x = rng.choice(fps)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.append(x)
        else:
            fps.append(rng.getrandbits(64))
    return fps


def run_components(spark, fps):
    from glasspane.llm.components import components

    signed = sorted({int(np.uint64(x).astype(np.int64)) for x in fps})
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df)).collect()}
    return {x: found.get(x, x) for x in signed}


def test_components_equal_brute_force(spark, monkeypatch):
    for chunk in (4096, 8):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        fps = planted(250, random.Random(chunk))
        got = run_components(spark, fps)
        want = brute_components({int(np.uint64(x).astype(np.int64)): x for x in fps})
        assert got == want
    assert 1 < len(set(got.values())) < len(got)


def test_rows(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(20_000))
    near = text.replace(text.split()[300], "other", 1)
    rows = [(5, text, 1), (3, near, 2), (9, text, 3), (9, text, 3), (4, None, 4), (7, "", 5), (8, "one two", 6), (None, "ONE two", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.groups(docs).collect()}
    by = {i: brute_fingerprint(t) for i, t, _ in rows if i is not None}
    want = brute_components(by)
    assert {(i, c) for i, _, c in got if i is not None} == set(want.items())
    assert (None, int(np.uint64(by[8]).astype(np.int64)), 8) in got
    assert want[5] == 3 and want[7] == 4
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 8]
    assert simhash.groups(docs.where("false")).collect() == []


def brute_kept(rows):
    """Places of the rows that stay: the first of each component by (no id, id, digest)."""
    label = brute_components({i: brute_fingerprint(t) for i, (_, t) in enumerate(rows)})
    digest = lambda r: hashlib.sha1((r[1] or "").encode()).digest()
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, digest(r))
        best[label[i]] = min(best.get(label[i], (key, r)), (key, r), key=lambda x: x[0])
    return sorted(((r[0], r[1] or "") for _, r in best.values()), key=str)


def test_unlike_texts_of_one_id_stay(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(20_000)
    near = long.replace(long.split()[300], "other", 1)
    rows = [(5, text(50)), (5, text(50)), (7, text(50)), (5, long), (6, near), (6, near), (None, long), (None, text(50)), (None, text(50)), (8, None), (8, ""), (9, "")]
    rows += [(2, text(30))] * 5 + [(None, text(30))] * 3
    docs = spark.createDataFrame([(i, t, n, "k") for n, (i, t) in enumerate(rows)], "doc_id long, text string, fp int, key string")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == brute_kept(rows)
    assert simhash.deduplicated(docs.where("false")).collect() == []


def test_full_keys_are_streamed(spark, monkeypatch):
    """Fingerprints that share a whole segment, in many small chunks."""
    monkeypatch.setattr(simhash, "CHUNK", 4)
    rng = random.Random(6)
    fps = [(x & 0x1FFFFF) << 22 | 0x15555 for x in planted(150, rng)]
    want = brute_components({int(np.uint64(x).astype(np.int64)): x for x in set(fps)})
    assert run_components(spark, fps) == want and len(set(want.values())) > 1


def test_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash_groups(spark, d).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in docs}
