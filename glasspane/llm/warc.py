"""A deterministic sharded WARC writer, and its reader.

Records are sorted by page_id and payload digest and cut into ranges. Their bounds depend on the
data alone: the number of ranges comes from the payloads' bytes, the bounds are quantiles of the
page_ids whose hash is low enough, and a page_id (or none at all) with more bytes than two ranges
has ranges of its own, by digest. A task streams each of its ranges into gzip files (one member a
record) and begins a new file when the compressed size reaches a target. Headers and digests are
made anew from the payload. A file is written under a temporary name of its own and renamed when
whole; its name and bytes depend on the range alone, so a task that runs again, and another run with
other partitions or settings, leaves the same file. The files, with size and digest, are listed in
a manifest, which is written last and renamed into place: without it there is no archive.

Of records with equal payloads of at least min_bytes bytes the one with the largest page_id is
the response, others are revisits that refer to it and carry only headers; smaller payloads are
all responses. Null html is an empty payload, null url an empty one. Of rows that repeat page_id
and payload the first written counts as the larger. A null page_id is written as such, sorts
first and is referred to only if no other record has the payload. A record's id is its page_id,
its digest and its place among records that repeat both, so no two are alike. Rows that repeat
page_id and payload are written by one task, which holds one of them at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import blocks, release, shared_dir, ship, stored, table, utf8

TARGET_BYTES, MIN_BYTES, LEVEL = 64 << 20, 0, 4
#: Payload bytes of a range, about, while there are at most MAX_RANGES; page_ids that place a bound.
RANGE_BYTES, MAX_RANGES, PER_RANGE = 16 << 20, 100_000, 32
#: Bytes that a record takes besides its payload, about.
HEAD_BYTES = 512
#: The date in every header: records must not depend on when they are written.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_SCHEMA = "file string, records bigint, bytes bigint, sha256 string, first_id bigint, last_id bigint"


def _uri(page_id: int | None, digest: str, place: int = 0) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}:{place}>"


def _page_of(uri: str | None) -> int | None:
    value = uri.split(":")[2] if uri else "null"
    return None if value == "null" else int(value)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str, payload: bytes, kind: str, digest: str, size: int, refers_to: int | None, place: int = 0) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP headers, which hold the size. place: of
    records that repeat page_id and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page_id, digest, place)}", f"WARC-Date: {DATE}", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record's headers (lower-case names), block, HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:]))
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "block": block, "http": http.decode(), "payload": payload}


class Roller:
    """Files of one range after another: opened under a temporary name, rolled by compressed size."""

    def __init__(self, where: str, attempt: int, target: int):
        self.store, self.root = fs.FileSystem.from_uri(where)
        self.attempt, self.target = attempt, target
        self.range: tuple[int, int] | None = None
        self.done: list[dict] = []
        self.out = None

    def write(self, place: tuple[int, int], page_id: int | None, member: bytes) -> None:
        if place != self.range:
            self.close()
            self.range, self.n = place, 0
        if self.out is None:
            self.name = f"part-{place[0]:06d}-{place[1]:04d}-{self.n:04d}.warc.gz"
            self.temp = f"{self.root}/.tmp-{self.attempt}-{self.name}"
            self.out = self.store.open_output_stream(self.temp, compression=None)
            self.sha, self.size, self.records, self.first = hashlib.sha256(), 0, 0, page_id
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        self.last = page_id
        if self.size >= self.target:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        self.store.move(self.temp, f"{self.root}/{self.name}")
        self.done.append({"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest(), "first_id": self.first, "last_id": self.last})
        self.n += 1


def kinds_of(pages: DataFrame) -> DataFrame:
    """page_id, digest (hexadecimal), size and the number n of rows of each page_id and payload."""
    body = pages.select(F.col("page_id").cast("bigint").alias("page_id"), utf8("html").alias("html"))
    return body.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").cast("bigint").alias("size")).groupBy("page_id", "digest", "size").agg(F.count("*").alias("n"))


def decisions(marked: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, digest, size, and response with revisit: what each (page_id, payload) is."""
    most = stored(marked.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("kinds")).where("kinds > 1").select("digest", "response"))
    repeats = marked.join(most, "digest", "left")
    revisit = (F.col("size") >= min_bytes) & F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    return repeats.select("page_id", "digest", "size", F.coalesce(revisit, F.lit(False)).alias("revisit"), "response")


def ranges(marked: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[list[float], DataFrame]:
    """Bounds of the ranges, and the page_ids (hot) that have several, with their number (parts)."""
    weight = (F.col("size") + HEAD_BYTES) * F.col("n")
    whole = marked.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    n = min(MAX_RANGES, max(1, -(-whole.bytes // range_bytes)))
    each = max(1, whole.bytes // n)
    hot = stored(marked.groupBy(F.col("page_id").alias("hot")).agg(F.sum(weight).alias("bytes")).where(F.col("bytes") > 2 * each).select("hot", F.ceil(F.col("bytes") / each).cast("int").alias("parts")))
    chosen = F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < int(min(1.0, PER_RANGE * n / max(1, whole.n)) * (1 << 20))
    ids = sorted(r.id for r in marked.where(chosen & F.col("page_id").isNotNull()).select(F.col("page_id").cast("double").alias("id")).distinct().collect())
    bounds = {ids[i * len(ids) // n] for i in range(1, n)} if ids else set()
    for r in hot.where("hot is not null").toLocalIterator():
        bounds |= {float(r.hot), math.nextafter(float(r.hot), math.inf)}
    return sorted(bounds), hot


def _placed(rows: DataFrame, bounds: list[float], hot: DataFrame) -> DataFrame:
    """rows (page_id, digest, ...) with place, the range, and part, that of a hot page_id."""
    rows = rows.withColumn("at", F.col("page_id").cast("double"))
    rows = Bucketizer(splits=[-math.inf, *(bounds or [0.0]), math.inf], inputCol="at", outputCol="bucket", handleInvalid="keep").transform(rows)
    rows = rows.withColumn("place", F.when(F.col("page_id").isNull(), 0).otherwise(F.col("bucket") + 1).cast("int"))
    rows = rows.join(hot, rows["page_id"].eqNullSafe(hot["hot"]), "left")
    top = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("part", F.coalesce(F.floor(top * F.col("parts") / float(1 << 32)), F.lit(0)).cast("int")).drop("at", "bucket", "hot", "parts")


def write(pages: DataFrame, where: str, target_bytes: int = TARGET_BYTES, min_bytes: int = MIN_BYTES, range_bytes: int = RANGE_BYTES) -> None:
    """Write pages (page_id, url, html) as an archive in the folder where, a URI that all
    executors reach. An archive that is there already is an error."""
    spark = pages.sparkSession
    ship(spark)
    store, root = fs.FileSystem.from_uri(where)
    if store.get_file_info(f"{root}/MANIFEST").type != fs.FileType.NotFound:
        raise FileExistsError(f"{where} holds an archive")
    store.create_dir(root, recursive=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = stored(kinds_of(pages))
    bounds, hot = ranges(marked, range_bytes)
    # decisions sort before the records they are about, so that html is shuffled once
    notes = decisions(marked, min_bytes).select("page_id", F.lit(0).alias("kind"), "digest", "revisit", "response", F.lit("").alias("url"), F.lit(b"").alias("html"))
    body = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.lit(1).alias("kind"), utf8("html").alias("html"), F.coalesce("url", F.lit("")).alias("url"))
    body = body.select("page_id", "kind", F.sha1("html").alias("digest"), F.lit(False).alias("revisit"), F.lit(None).cast("bigint").alias("response"), "url", "html")
    rows = _placed(notes.union(body), bounds, hot).select("place", "part", "page_id", "kind", "digest", "revisit", "response", "url", "html")
    rows = rows.repartition(n, "place", "part").sortWithinPartitions("place", "part", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(where, TaskContext.get().taskAttemptId(), target_bytes)
        revisit, response, seen = False, None, 0
        for block in blocks(batches, "html"):
            for place, part, page_id, kind, digest, *note, url, html in zip(*(block.column(i).to_pylist() for i in range(9)), strict=True):
                if kind == 0:
                    (revisit, response), seen = note, 0
                    continue
                again = seen > 0 and len(html) >= min_bytes
                form = "revisit" if revisit or again else "response"
                refers_to = response if revisit else page_id
                roller.write((place, part), page_id, gzip.compress(record(page_id, url, html, form, base32(digest), len(html), refers_to, seen), LEVEL, mtime=0))
                seen += 1
        roller.close()
        columns = [x.split(" ")[0] for x in MANIFEST_SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in roller.done], t) for c, t in zip(columns, types, strict=True)], names=columns)

    files = stored(rows.mapInArrow(run, MANIFEST_SCHEMA), f"{where}/files")
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    with store.open_output_stream(f"{root}/.tmp-MANIFEST") as out:
        out.write(json.dumps({"version": 1, "list": "files", "files": total.files, "records": total.records, "bytes": total.bytes}).encode())
    store.move(f"{root}/.tmp-MANIFEST", f"{root}/MANIFEST")
    release(marked, hot)


READ_SCHEMA = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(spark: SparkSession, where: str, payloads: bool = True) -> DataFrame:
    """The records of a committed archive; one task reads whole files, whose size the writer
    bounds. Digests are checked: a record that doesn't match its headers is an error. The
    payload of a revisit is null."""
    ship(spark)
    store, root = fs.FileSystem.from_uri(where)
    with store.open_input_stream(f"{root}/MANIFEST") as manifest:
        listed = json.loads(manifest.read())["list"]
    files = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{where}/{listed}").select("file", "bytes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]

    def rows(name: str):
        store, root = fs.FileSystem.from_uri(where)
        with store.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as data:
            while line := data.readline():
                if line != b"WARC/1.1\r\n":
                    raise ValueError(f"{name}: not a record")
                headers = {}
                while (line := data.readline()) != b"\r\n":
                    k, _, v = line.decode().rstrip("\r\n").partition(": ")
                    headers[k.lower()] = v
                block = data.read(int(headers["content-length"]))
                data.read(4)
                http, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x.split(": ")[1]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size):
                    raise ValueError(f"{name}: {headers['warc-record-id']} doesn't match its digest")
                yield _page_of(headers["warc-record-id"]), headers["warc-target-uri"], payload if payloads and kind == "response" else None, size, digest, kind, _page_of(headers.get("warc-refers-to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                for r in rows(name):
                    held.append(r)
                    size += len(r[2] or b"") + 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return files.repartition(n, "file").mapInArrow(run, READ_SCHEMA)


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_dir(spark)
    write(table(spark, sf_dir, "pages"), where)
    return read(spark, where, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
