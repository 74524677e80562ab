import base64
import re

import public_tokenizers as P
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    from glasspane.llm.common import stored

    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], D)))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_columns_and_only_drop_rows(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii_redaction", "byte_bpe"]
    for before, after in zip(steps[:4], steps[1:5], strict=True):
        assert after.columns == steps[0].columns and after.dtypes == steps[0].dtypes
        assert by_id(after).keys() <= by_id(before).keys()


def test_quality_rejects_labelled_junk_and_keeps_the_rest(spark, steps):
    kept = by_id(steps[1])
    wrong = [(r.quality == 1) != (r.doc_id in kept) for r in spark.read.parquet(f"{D}/labels.parquet").collect()]
    assert sum(wrong) <= 0.02 * len(wrong)


def test_one_of_each_group_stays(steps):
    from test_simhash import brute_components, brute_fingerprint

    docs = by_id(steps[1])
    label = brute_components({i: brute_fingerprint(r.text) for i, r in docs.items()})
    assert by_id(steps[2]).keys() == {i for i, first in label.items() if i == first}


def test_contaminated_documents_go(spark, steps):
    norm = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [grams(norm(r.text)) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clean = set()
    for i, r in by_id(steps[2]).items():
        own = grams(norm(r.text))
        if not any(len(own & item) >= 0.8 * len(item) for item in items):
            clean.add(i)
    assert by_id(steps[3]).keys() == clean and len(clean) < steps[2].count()


def test_personal_data_is_gone(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) and r.n_chars == len(r.text)
        if "<" not in r.text:
            assert r.text == before[i].text
    assert any("<EMAIL>" in r.text for r in after.values())


def test_tokens(steps):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, found = by_id(steps[4]), by_id(steps[5])
    assert docs.keys() == found.keys()
    assert all(found[i].ids == enc.encode_ordinary(r.text) for i, r in docs.items())


def test_run_equals_the_stages(spark, steps):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, D).collect()}
    assert got == {i: r.ids_sha256 for i, r in by_id(steps[5]).items()}


@pytest.fixture()
def odd_tables(spark, tmp_path):
    """Null and repeated ids and texts, unlike texts of one id, a very long text, extra columns."""
    good = spark.read.parquet(f"{D}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    some = [r.text for r in docs.join(good, "doc_id").orderBy("doc_id").limit(40).collect()]
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").limit(5).collect()]
    texts = list(dict.fromkeys(some))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(0, texts[0]), (0, texts[0]), (1, texts[2]), (None, texts[3]), (None, None), (500, None), (501, ""), (502, texts[4] * 200)]
    rows += [(600, texts[5] + " " + items[0]), (2, texts[6] + " " + items[1]), (None, texts[7] + " " + items[2]), (601, texts[8] + " write to ann@example.org")]
    data = [(i, t, "en", "s", len(t or ""), 1, "k") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp int, __own string"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    # the classifier learns from labelled documents of the same table
    docs.selectExpr("doc_id + 10000 doc_id", "text", "lang", "source", "cast(n_chars as long) n_chars", "2 fp", "'k' __own").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{D}/labels.parquet").selectExpr("doc_id + 10000 doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_odd_tables_from_end_to_end(spark, odd_tables):
    from test_decontaminate import brute
    from test_simhash import brute_kept

    from glasspane.llm import pii
    from glasspane.llm.common import stored

    where, _ = odd_tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stored(stage(spark, docs, where))
        assert docs.columns == columns, name
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "simhash_near_dedup":
            assert sorted(((i, t or "") for i, t in after), key=str) == brute_kept(before)
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
            hit = {place for place, *_ in brute(list(enumerate(t for _, t in before)), items)}
            assert hit and sorted(after, key=str) == sorted((r for n, r in enumerate(before) if n not in hit), key=str)
        if name == "pii_redaction":
            machine = pii.automaton()
            assert sorted(after, key=str) == sorted(((i, t if t is None else pii.redact(t, pii.find(t, machine))) for i, t in before), key=str)
        if name != "pii_redaction":
            assert not set(after) - set(before)
    got = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, where).collect()]
    assert sorted((i for i, _ in got), key=str) == sorted((i for i, _ in after), key=str) and len(got) > 20


def test_no_documents_no_rows(spark, odd_tables, tmp_path):
    where, _ = odd_tables
    import shutil

    shutil.copytree(where, tmp_path / "none", ignore=shutil.ignore_patterns("documents.parquet", "none"))
    spark.read.parquet(f"{where}/documents.parquet").where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
