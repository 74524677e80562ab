import os
import random

import pytest

from glasspane.llm.shards import ARRIVALS, SMALLEST, Store, op6_tiered_shards


def rows(spark, ids):
    return spark.createDataFrame([(i, f"text {i} " * 50 if i % 7 else None, "p", 3) for i in ids], "doc_id long, text string, path string, bytes int")


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def test_appends_and_compaction_keep_every_row(spark, tmp_path):
    s = store(spark, tmp_path)
    parts = [range(i * 500, i * 500 + 500) for i in range(6)]
    for i, p in enumerate(parts):
        assert s.append(rows(spark, p).repartition(2)) == i + 1
    want = content(rows(spark, range(3000)))
    before = s.manifest().count()
    assert content(s.read()) == want and before == 12
    version = s.compact(target=200_000, fanout=3)
    assert version > 6 and s.manifest().count() < before and content(s.read()) == want
    assert content(s.read(3)) == content(rows(spark, range(1500)))
    assert s.manifest().agg({"rows": "sum"}).first()[0] == 3000
    s.expire()
    assert content(s.read()) == want
    live = {r.path.rsplit("/", 1)[1] for r in s.manifest().collect()}
    on_disk = {f for _, _, fs in os.walk(tmp_path / "s" / "data") for f in fs if f.endswith(".parquet") and not f.startswith(".")}
    assert on_disk == live


def test_merged_files_reach_about_the_target(spark, tmp_path):
    s = store(spark, tmp_path)
    for i in range(8):
        s.append(rows(spark, range(i * 2000, i * 2000 + 2000)).coalesce(1))
    one = s.manifest().agg({"bytes": "max"}).first()[0]
    s.compact(target=one * 4, fanout=4)
    sizes = [r.bytes for r in s.manifest().collect()]
    assert len(sizes) <= 4 and max(sizes) <= one * 6


def test_few_small_shards_stay(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(rows(spark, range(10)).coalesce(1))
    assert s.compact() == 1


def test_what_was_not_committed_is_not_there(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.version() == 0 and s.manifest().collect() == []
    s.append(rows(spark, range(10)))
    rows(spark, range(50, 60)).write.parquet(f"file://{tmp_path}/s/data/a00000002-dead")  # a writer that died
    assert content(s.read()) == content(rows(spark, range(10)))
    s.append(rows(spark, range(10, 20)))
    assert content(s.read()) == content(rows(spark, range(20)))
    with pytest.raises(FileExistsError):
        s._commit([], rows(spark, []).schema, 2)
    assert not [f for f in os.listdir(tmp_path / "s" / "manifest") if f.startswith(".new")]


def test_two_writers_race(spark, tmp_path):
    """Both look before either commits: the loser commits after the winner, no row is lost."""
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    commit, calls = s._commit, []

    def late(*args):
        if not calls:
            calls.append(other.append(rows(spark, range(10, 20))))
        return commit(*args)

    s._commit = late
    assert s.append(rows(spark, range(10))) == 2 and calls == [1]
    assert content(s.read()) == content(rows(spark, range(20)))


def test_an_append_while_tiers_merge_and_versions_expire(spark, tmp_path):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    for i in range(4):
        s.append(rows(spark, range(i * 10, i * 10 + 10)).coalesce(1))
    commit, calls = s._commit, []

    def late(*args):
        if not calls:
            calls.append(other.append(rows(spark, range(40, 50)).coalesce(1)))
        return commit(*args)

    s._commit = late
    s.compact()
    assert calls == [5] and content(s.read()) == content(rows(spark, range(50)))
    data = tmp_path / "s" / "data"
    held = {r.path.rsplit("/", 2)[1] for r in s.manifest().collect()}
    assert {f for f in os.listdir(data) if f.startswith("c")} <= held  # what the lost race merged is gone

    slow, seen = store(spark, tmp_path), []
    listing = slow._list

    def expiring(entries):
        if not seen:
            seen.append(True)
            s.append(rows(spark, range(60, 70)))
            s.expire()
        return listing(entries)

    slow._list = expiring
    slow.append(rows(spark, range(50, 60)))
    assert content(slow.read()) == content(rows(spark, range(70)))
    slow.expire()
    assert content(slow.read()) == content(rows(spark, range(70))) and len(slow.versions()) == 1
    lists = [f for f in os.listdir(tmp_path / "s" / "manifest") if f.startswith("list-")]
    assert sorted(lists) == sorted(slow._marker(slow.version())["lists"])


def test_tiers_equal_a_brute_force_plan(spark, tmp_path):
    s = store(spark, tmp_path)
    r = random.Random(3)
    for fanout in (2, 3, 4):
        target = 64 * SMALLEST
        sizes = [r.choice([0, 1, SMALLEST - 1, SMALLEST, fanout * SMALLEST - 1, fanout * SMALLEST, fanout**2 * SMALLEST, r.randrange(target)]) for _ in range(40)]

        def number(size, fanout=fanout):
            n = 0
            while size >= SMALLEST * fanout ** (n + 1):
                n += 1
            return n

        want = {}
        for i, size in enumerate(sizes):
            if size < target // 2:
                want.setdefault(number(size), []).append(f"p{i:02d}")
        manifest = spark.createDataFrame([(f"p{i:02d}", size, 1) for i, size in enumerate(sizes)], "path string, bytes long, rows long")
        assert s.due(manifest, target, fanout) == {t: sorted(p) for t, p in want.items() if len(p) >= fanout}


def test_empty_and_repeated_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(rows(spark, []))
    assert s.read().collect() == [] and s.read().columns == ["doc_id", "text", "path", "bytes"]
    s.append(rows(spark, [1, 1, 1]))
    assert content(s.read()) == content(rows(spark, [1, 1, 1]))
    s.compact()
    s.expire()
    assert content(s.read()) == content(rows(spark, [1, 1, 1]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_over_a_whole_table(spark, sf):
    import hashlib

    d = f"/root/testdata/{sf}"
    got = op6_tiered_shards(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = sorted((r.doc_id, len(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs)
    assert sorted((r.doc_id, r.n_chars, r.text_sha256) for r in got) == want
    assert all(r.shard.startswith(("a0", "c0")) and "/0" in r.shard for r in got)
    merged = {r.shard for r in got if r.shard.startswith("c0")}
    assert merged and len({r.shard for r in got}) < ARRIVALS
