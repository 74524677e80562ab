import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from glasspane.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def brute():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(7)
    odd = ["", "a", " ", "  a", "\n\n b c", "x" * 5000, "ab" * 1500, "don't we'll  \t\n x y \x1c z", "é　  q 12 3.5 !!", "🙂🙂", "<|endoftext|>", "\x00a\x00"]
    return odd + ["".join(r.choice("ab \n\t'sé1!\x1c\x85  🙂") for _ in range(60)) for _ in range(300)]


def test_same_ids_as_the_public_library(brute):
    tok = bpe.Tokenizer(PATH, P.PATTERN)
    assert tok.encode(texts()) == [brute.encode_ordinary(t) for t in texts()]
    assert [tok.decode(ids).decode() for ids in tok.encode(texts())] == texts()


def test_long_matches_are_folded(brute, monkeypatch):
    """Slices that empty, merges across their borders, at slices of 2 to 512 tokens."""
    r = random.Random(5)
    long = ["a" * 40, "the" * 900, "".join(r.choice("etaoinshr") for _ in range(3000)), "".join(r.choice("abé🙂") for _ in range(1500)), "=" * 4099, "q" * 2049]
    for width in (2, 3, 7, 64, 512):
        monkeypatch.setattr(bpe, "SLICE", width)
        monkeypatch.setattr(bpe, "LONGEST_ROW", 8)
        tok = bpe.Tokenizer(PATH, P.PATTERN)
        assert [tok.encode([t])[0] for t in long] == [brute.encode_ordinary(t) for t in long]


@pytest.mark.parametrize("limit", ["CACHE_WORDS", "CACHE_CHARS"])
def test_forgetting_changes_nothing(brute, monkeypatch, limit):
    monkeypatch.setattr(bpe, limit, 3)
    tok = bpe.Tokenizer(PATH, P.PATTERN)
    assert [tok.encode([t])[0] for t in texts()] == [brute.encode_ordinary(t) for t in texts()]


def test_table_with_nulls_repeats_and_clashing_names(spark, brute):
    rows = [(1, "the cat", 5, "x"), (1, "the cat", 5, "x"), (None, "a", 1, "y"), (2, None, None, "z"), (3, "", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids_sha256 string")
    got = sorted(map(tuple, bpe.encode_decode(docs, PATH, P.PATTERN, keep_ids=True).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = brute.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), ids))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(docs.where("false"), PATH, P.PATTERN).collect() == []


def test_query_over_a_whole_table(spark, brute):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op4_byte_bpe(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = brute.encode_ordinary(r.text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
