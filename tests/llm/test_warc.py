import base64
import gzip
import hashlib
import os

import pytest

from glasspane.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, kind int"


def archive(tmp_path, name):
    return f"file://{tmp_path}/{name}"


def brute(rows, min_bytes=0):
    """(page_id, bytes, digest, kind, refers_to) with ids unique."""
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = best[html or ""] == i or len(body) < min_bytes
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else best[html or ""]))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))


ROWS = [(i, f"http://x/{i}\r\nx" if i == 5 else f"http://x/{i}", [None, "", "one", "é two", "<p>\r\n\r\nWARC/1.1\r\n", "z" * 200_000][i % 6] if i < 30 else f"page {i}") for i in range(60)]


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_round_trip(spark, tmp_path, min_bytes):
    pages = spark.createDataFrame([(*r, "d", 7) for r in ROWS], SCHEMA)
    where = archive(tmp_path, "a")
    warc.write(pages, where, target_bytes=2_000, min_bytes=min_bytes)
    found = warc.read(spark, where)
    assert rows_of(found) == brute(ROWS, min_bytes)
    by = {r.page_id: r for r in found.collect()}
    for i, url, html in ROWS:
        if by[i].record_type == "response":
            assert by[i].payload == (html or "").encode()
        else:
            assert by[i].payload is None and by[by[i].refers_to].payload == (html or "").encode()
        assert by[i].url == url.replace("\r\n", "%0D%0A")


def test_files_are_rolled_sorted_deterministic_and_listed(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "d", 7) for r in ROWS], SCHEMA).coalesce(1)
    listed = []
    for name in ("a", "b"):
        warc.write(pages, archive(tmp_path, name), target_bytes=2_000)
        listed.append(sorted(map(tuple, spark.read.parquet(f"{archive(tmp_path, name)}/files").collect())))
    assert listed[0] == listed[1] and len(listed[0]) > 4
    assert sum(f[1] for f in listed[0]) == len(ROWS)
    for name, _, size, sha, *_ in listed[0]:
        data = (tmp_path / "a" / name).read_bytes()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
    spans = sorted((f[4], f[5]) for f in listed[0])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith(".tmp")]


def listed(spark, where):
    return sorted(map(tuple, spark.read.parquet(f"{where}/files").collect()))


def test_same_files_whatever_the_partitions(spark, tmp_path):
    """All of sf0.1, in several ranges, from other partitions and with other settings."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name, n, df in (("a", 4, pages), ("b", 11, pages.repartition(7, "url")), ("c", 2, pages.repartition(23))):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            warc.write(df, archive(tmp_path, name), target_bytes=300_000, range_bytes=1 << 20)
            found.append(listed(spark, archive(tmp_path, name)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    assert len({f[0].rsplit("-", 1)[0] for f in found[0]}) > 3 and sum(f[1] for f in found[0]) == pages.count()
    in_order = [(f[4], f[5]) for f in found[0]]
    assert all(a[1] <= b[0] for a, b in zip(in_order, in_order[1:], strict=False))


def test_a_hot_id_has_ranges_of_its_own(spark, tmp_path):
    """A third of the rows share an id, a third have none; every record has an id of its own."""
    rows = [([7, None, i][i % 3], f"http://x/{i}", f"page {i // 6} " * 40) for i in range(600)]
    where = archive(tmp_path, "a")
    warc.write(spark.createDataFrame([(*r, "d", 7) for r in rows], SCHEMA), where, range_bytes=20_000)
    files = listed(spark, where)
    for i in (7, None):
        own = [f for f in files if f[4] == i and f[5] == i]
        assert len(own) > 2 and sum(f[1] for f in own) == 200
    ids = []
    for f in files:
        data = gzip.decompress((tmp_path / "a" / f[0]).read_bytes())
        ids += [line for line in data.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == 600 == len(set(ids))
    got = warc.read(spark, where).collect()
    best = {}
    for i, _, t in rows:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert sorted((r.page_id or -1, r.payload_bytes) for r in got) == sorted((-1 if i is None else i, len(t)) for i, _, t in rows)
    assert sum(r.record_type == "response" for r in got) == len(best)
    assert all(r.refers_to in best.values() for r in got if r.record_type == "revisit" and r.refers_to is not None)


def test_headers(spark, tmp_path):
    record = warc.record(7, "http://x/", b"body", "revisit", "D", 4, 9)
    parsed = warc.parse(record)
    assert parsed["headers"]["warc-refers-to"] == "<urn:x-page:9:D:0>" and parsed["headers"]["warc-record-id"] == "<urn:x-page:7:D:0>" and parsed["payload"] == b"" and "Content-Length: 4" in parsed["http"]
    block = base64.b32encode(hashlib.sha1(parsed["block"]).digest()).decode()
    assert parsed["headers"]["warc-block-digest"] == f"sha1:{block}"


def test_no_manifest_no_archive_and_no_overwriting(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "d", 7) for r in ROWS[:3]], SCHEMA)
    where = archive(tmp_path, "a")
    warc.write(pages, where)
    with pytest.raises(FileExistsError):
        warc.write(pages, where)
    os.remove(tmp_path / "a" / "MANIFEST")
    with pytest.raises(FileNotFoundError):
        warc.read(spark, where)


def test_a_changed_payload_is_found(spark, tmp_path):
    where = archive(tmp_path, "a")
    warc.write(spark.createDataFrame([(1, "u", "hello", "d", 0)], SCHEMA), where)
    name = next(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    data = gzip.decompress((tmp_path / "a" / name).read_bytes())
    (tmp_path / "a" / name).write_bytes(gzip.compress(data.replace(b"hello", b"hullo")))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, where).collect()


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "a"), (1, None, "a"), (2, "u", "a"), (None, "n", "b"), (3, "v", "c"), (3, "w", "c")]
    where = archive(tmp_path, "a")
    warc.write(spark.createDataFrame([(*r, "d", 0) for r in rows], SCHEMA), where)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, where).collect()), key=str)
    assert got == sorted([(1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (None, "response", None), (3, "response", None), (3, "revisit", 3)], key=str)
    empty = archive(tmp_path, "b")
    warc.write(spark.createDataFrame([], SCHEMA), empty)
    assert warc.read(spark, empty).collect() == []


def test_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert rows_of(warc.op7_warc_archive(spark, d)) == brute(rows)
