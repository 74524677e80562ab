import hashlib
import random

import pytest
import xxhash

from glasspane.llm import chunking as c


def brute_sketch(text: bytes):
    h, hashes = 0, []
    for b in text:
        h = ((h << 1) + int(c.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    out, s = {}, 0
    while s < len(text):
        cut = next((i + 1 for i in range(s + c.SHORTEST - 1, len(text)) if i + 1 < s + c.NORMAL and not hashes[i] & int(c.EARLY)), None)
        if cut is None:
            cut = next((i + 1 for i in range(s + c.NORMAL - 1, len(text)) if not hashes[i] & int(c.LATE)), s + c.LONGEST)
        cut = min(cut, s + c.LONGEST, len(text))
        key = xxhash.xxh3_64_intdigest(text[s:cut]) >> (64 - c.DIGEST_BITS)
        out[key] = out.get(key, 0) + cut - s
        s = cut
    return out


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghéñ") for _ in range(r.randint(1, 8))) for _ in range(n))


TEXTS = ["", "a", words(5, 1), words(300, 2), words(3000, 3), "x" * 3000, words(40, 4) * 50, "\x00" * 100]


def test_sketches_equal_brute_force():
    raw = [t.encode() for t in TEXTS]
    assert c.sketches(raw) == [brute_sketch(t) for t in raw]
    assert c.sketches(raw[::-1]) == [brute_sketch(t) for t in raw[::-1]]
    assert c.sketches([]) == []


def test_text_form_and_likeness():
    sketch = brute_sketch(TEXTS[3].encode())
    assert c.parsed(c.written(sketch)) == sketch and c.written({}) == "" and c.parsed("") == {}
    assert sum(sketch.values()) == len(TEXTS[3].encode())
    assert c.containment(sketch, sketch) == 1 and c.containment({}, {}) == 1
    assert c.containment({}, sketch) == 0 and c.containment(sketch, {}) == 0


def test_an_insertion_moves_only_near_chunks():
    text = words(2000, 9)
    shifted = text[:3000] + "something new " + text[3000:]
    a, b = c.sketches([text.encode(), shifted.encode()])
    assert c.containment(a, b) > 0.95


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        x, y, z = (brute_sketch(t.encode()) for t in (text, after, edited))
        near = [c.containment(x, z), c.containment(x, y)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), c.written(x), c.written(z), *near))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [(i * 7 % 50, words(i * 5 % 90, i)) for i in range(50)],
    [(3, "one text that is here")],
    [(2, None), (5, ""), (9, words(50, 1)), (None, "no id"), (1, words(4000, 2)), (-4, words(50, 1))],
    [(2, "b b b"), (2, "a a a"), (2, "a a a"), (1, "c c c")],
])
def test_rows_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, place int, carried string")
    got = sorted(map(tuple, c.edited_likeness(docs).collect()), key=str)
    assert got == expected(rows)
    marks = {(r.doc_id, r.fingerprint) for r in c.fingerprints(docs).collect()}
    assert marks == {(r[0], r[3]) for r in got}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert c.edited_likeness(docs).collect() == [] and c.fingerprints(docs).collect() == []


def test_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, c.op1_chunk_fingerprints(spark, d).collect()), key=str) == expected(rows)
