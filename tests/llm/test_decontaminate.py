import pickle
import random
import re
import time

import pytest

from glasspane.llm import decontaminate as d

R = random.Random(11)
VOCABULARY = ["w%d" % i for i in range(400)]


def words(n):
    return [R.choice(VOCABULARY) for _ in range(n)]


def brute(docs, items, limit=0.8):
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for item_id, text in items:
        w = norm(text)
        if not w or item_id is None:
            continue
        k = min(5, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for doc_id, t in docs:
            v = norm(t)
            shared = len(own & {tuple(v[i : i + k]) for i in range(len(v) - k + 1)})
            if shared >= limit * len(own):
                out.append((doc_id, item_id, shared, len(own), shared / len(own)))
    return sorted(out, key=str)


def planted():
    items = [(i, " ".join(words(n))) for i, n in enumerate([1, 3, 5, 6, 9, 12, 13, 20, 40, 59, 70, 200])]
    docs = []
    for i in range(150):
        body = words(R.choice([0, 3, 30, 300, 3000]))
        for item_id, text in R.sample(items, 2):
            part = text.split()
            if R.random() < 0.4 and len(part) > 20:
                part[R.randrange(len(part))] = "changed"
            if R.random() < 0.6:
                at = R.randrange(len(body) + 1)
                body[at:at] = [w.upper() + R.choice(["", ",", "."]) for w in part] if R.random() < 0.5 else part
        docs.append((i, " ".join(body)))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, shared int"), spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")


def test_equal_to_brute_force_in_any_block_size(spark):
    docs, items = planted()
    want = brute(docs, items)
    assert len(want) > 100 and any(r[4] < 1 for r in want)
    for block in (40_000, 5):
        got = sorted(map(tuple, d.matches(*frames(spark, docs, items), block=block).collect()), key=str)
        assert got == want


def test_blocks_are_bounded_and_loaded_in_turn(spark, monkeypatch):
    """More blocks than a worker keeps; the driver has only their names."""
    docs, items = planted()
    blocks = d.item_blocks(frames(spark, docs, items)[1], 4)
    files = [r.f for r in blocks.selectExpr("_metadata.file_path f").distinct().collect()]
    assert len(files) == 3 and blocks.count() == len(items)
    sketches = d.stored_sketches(blocks, 0.8)
    with monkeypatch.context() as no:  # sketched once, by the task that stored it
        no.setattr(d.Index, "__init__", lambda *a: pytest.fail("a worker sketches items"))
        for f in sketches:
            assert sum(len(i.items) for i in d.loaded(f)) == 4
    assert len(d._LOADED) == d.KEPT_BLOCKS
    monkeypatch.setattr(d, "ITEM_CHARS", 100)
    parts = [i for f in files for i in d.sketched(f, 0.8)]
    assert len(parts) > 3 and all(len(i.items) == 1 or sum(len(x[1]) for x in i.items) <= 100 for i in parts)


def test_ten_thousand_items_are_sketched_in_seconds():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30_000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(60)), 5) for i in range(10_000)]
    began = time.process_time()
    index = d.Index(items, 0.8)
    took = time.process_time() - began
    again = pickle.loads(pickle.dumps(index))
    assert took < 8 and again.items == items and (again.need == index.need).all()


def test_sketch_sizes(spark):
    """k of a partition, and how many of its hashes a document at 80 % has at least."""
    texts = [" ".join(words(n + 4)) for n in (1, 4, 5, 9, 10, 31, 32, 63, 100)]
    index = d.Index([(i, t, 5) for i, t in enumerate(texts)], 0.8)
    for i, n in enumerate([1, 4, 5, 9, 10, 31, 32, 63, 100]):
        top = (1 << n.bit_length()) - 1
        assert index.need[i] == min(n, top // 5 + 1) - n // 5 >= 1


def test_odd_rows(spark):
    items = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, "?!"), (None, "a b c d e"), (5, "one")]
    docs = [(1, None), (2, ""), (3, "A, b. c D e f"), (3, "A, b. c D e f"), (None, "x a b c d e f"), (4, "one " * 40_000)]
    got = sorted(map(tuple, d.matches(*frames(spark, docs, items)).collect()), key=str)
    assert got == brute(docs, items)
    a, b = frames(spark, docs, items)
    kept = d.clean(a, b)
    assert kept.columns == a.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2]
    mixed = [(7, "a b c d e f"), (7, "another text"), (None, "a b c d e f"), (None, "another text"), (None, "another text")]
    left = [(r.doc_id, r.text) for r in d.clean(frames(spark, mixed, items)[0], b).collect()]
    assert sorted(left, key=str) == [(7, "another text"), (None, "another text"), (None, "another text")]
    assert d.matches(a.where("false"), b).collect() == [] and d.matches(a, b.where("false")).collect() == []
    assert d.clean(a, b.where("false")).count() == len(docs)


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    assert sorted(map(tuple, d.op5_decontamination(spark, sf).collect()), key=str) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_short_and_repetitive_items_in_long_documents(spark):
    """Items of one shingle and items whose shingles repeat, at 80 % and just below, also dealt out
    over a document; all of them in many long documents."""
    r = random.Random(5)
    own = lambda n: [f"x{r.randrange(10**6)}" for _ in range(n)]
    items = [own(n) for n in (1, 2, 4, 5, 5, 5)] + [own(1) * 40, own(5) * 12, own(5) * 25, own(7) * 6, own(3) * 30, own(60), own(104)]
    docs = []
    for i in range(120):
        body = [r.choice(VOCABULARY) for _ in range(r.choice([400, 2500]))]
        for part in r.sample(items, 4):
            cut = r.choice([len(part), len(part), max(1, len(part) // 4)])
            for piece in (part[cut:], part[:cut]):
                at = r.randrange(len(body) + 1)
                body[at:at] = piece
        docs.append((i, " ".join(body)))
    named = [(i, " ".join(w)) for i, w in enumerate(items)]
    want = brute(docs, named)
    assert len(want) > 200
    assert sorted(map(tuple, d.matches(*frames(spark, docs, named)).collect()), key=str) == want
    for limit in (0.05, 0.5, 1.0):
        assert sorted(map(tuple, d.matches(*frames(spark, docs, named), containment=limit).collect()), key=str) == brute(docs, named, limit)
