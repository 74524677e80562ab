"""Merkle manifest of a table: a hash tree for each language, and one above their roots.

Built in Pregel-like supersteps over RDDs. A vertex holds up to 2 ** HEIGHT neighbouring nodes of
one level as its children. Upward, children message their parent; a parent that has heard all of
them hashes the levels that it spans and forwards its digest. Downward, each vertex that has its
path to the root sends every child that path with the child's own siblings before it; leaves fold
theirs to a root and compare. So a tree of n leaves takes log n / HEIGHT supersteps each way,
no vertex has more than 2 ** HEIGHT messages, and only digests are shuffled, never texts. Each superstep
ends in the shared folder, so that a lost executor costs at most one.

Values: H is sha256, digests go into it as lowercase hex. A leaf is H of doc_id, source, lang,
n_chars and text, each `-` if null, else its UTF-8 length, `:` and itself. Leaves of a language
ascend by doc_id (null first; equal doc_ids by leaf); while a level has several nodes, each two
neighbours (or a last one alone) become their H. A proof's steps are one byte (0: the sibling
comes after, 1: before, 2: none) and the sibling. Null and empty languages are trees of their own;
equal rows are leaves next to each other; no rows give none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, ship, stored, table

#: Levels of the tree that a vertex spans.
HEIGHT = 10

NODE = "tree string, at long, n long, digest binary"
VERTEX = "tree string, at long, n long, below long, kids binary, digest binary"
PATH = "tree string, at long, path binary, tops binary"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def joined_hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def spanned(kids: list[bytes], below: int, height: int) -> list[list[bytes]]:
    """The levels that a vertex spans, from its children up; below: nodes of the children's whole
    level. Ends early where the tree does."""
    levels = [kids]
    for _ in range(height):
        if below == 1:
            break
        last = levels[-1]
        levels.append([joined_hash(last[i : i + 2]) for i in range(0, len(last), 2)])
        below = (below + 1) // 2
    return levels


def steps(levels: list[list[bytes]], slot: int) -> bytes:
    """The proof of child slot within its vertex."""
    found = b""
    for level in levels[:-1]:
        beside = slot ^ 1
        found += bytes([slot & 1]) + level[beside] if beside < len(level) else b"\2"
        slot >>= 1
    return found


def siblings(path: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(path):
        size = 0 if path[at] == 2 else 32
        yield path[at], path[at + 1 : at + 1 + size]
        at += 1 + size


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and a proof lead to."""
    for side, other in siblings(path):
        leaf = joined_hash([leaf, other] if side == 0 else [other, leaf] if side == 1 else [leaf])
    return leaf


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (empty for a null lang, else `=` and lang), digest, and told: the digest with
    one added to n_chars where 7 divides crc32 of the decimal doc_id. A null doc_id or n_chars is
    never changed."""
    own = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))))

    def part(value):
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    def leaf(n_chars):
        return F.unhex(F.sha2(F.concat(*(part(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256))

    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return own.select("doc_id", tree.alias("tree"), leaf(F.col("n_chars")).alias("digest"), F.when(changed, leaf(more)).alias("told"))


def placed_in_tree(rows: DataFrame, *order: str) -> DataFrame:
    """rows with at, their place in their tree by order, and n, the tree's rows; stored.

    Ranges over all trees are sorted; the rows of each tree in a range, a small table, give the
    offsets. Rows alike in all of order are dealt out, so that one doc_id may hold any share.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "salt"]
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = stored(salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("salt").withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.shiftright("place", 33)))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("tree", "range").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    counts = counts.select("tree", "range", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    found = stored(ranged.join(counts, ["tree", "range"]).withColumn("at", F.col("place") + F.col("shift")).drop("range", "place", "shift"))
    release(ranged)
    return found


def _dealt(key: tuple[str, int]) -> int:
    return zlib.crc32(repr(key).encode())


def _grouped(rdd, parts: int):
    return rdd.groupByKey(parts, _dealt)


def climb(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The vertices of all trees, one table a superstep, from the leaves up."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def complete(item):
        (tree, at), messages = item
        messages = sorted(messages)
        below = messages[0][1]
        if len(messages) != min(1 << height, below - (at << height)):
            raise ValueError(f"vertex {at} of {tree!r} has {len(messages)} messages of {below} nodes")
        kids = [m[2] for m in messages]
        return tree, at, -(-below >> height), below, b"".join(kids), spanned(kids, below, height)[-1][0]

    levels, messages = [], nodes
    while True:
        told = messages.select("tree", "at", "n", "digest").rdd.map(lambda m: ((m[0], m[1] >> height), (m[1] & (1 << height) - 1, m[2], bytes(m[3]))))
        levels.append(stored(spark.createDataFrame(_grouped(told, parts).map(complete), VERTEX, verifySchema=False)))
        messages = levels[-1].where("n > 1")
        if messages.isEmpty():
            return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree and digest of every finished tree."""
    found = levels[0].where("n = 1")
    for level in levels[1:]:
        found = found.union(level.where("n = 1"))
    return found.select("tree", "digest")


def descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, finish: Callable, schema: str, height: int = HEIGHT) -> DataFrame:
    """finish(node, path, tops) for every node, where path is its proof up to the tree's root and
    on along the tree's path in tops (tree, path, tops)."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entering(level):
        return level.where("n = 1").join(tops, "tree").select("tree", "at", "path", "tops")

    def told(paths):
        return paths.rdd.map(lambda r: ((r[0], r[1]), (True, (bytes(r[2]), bytes(r[3])))))

    def passed(item):
        (tree, at), found = item
        found = dict(found)
        (path, above), (below, kids) = found[True], found[False]
        span = spanned([kids[i : i + 32] for i in range(0, len(kids), 32)], below, height)
        for slot in range(len(span[0])):
            yield tree, at << height | slot, steps(span, slot) + path, above

    def finished(item):
        _, found = item
        found = list(found)
        path, above = next(x for known, x in found if known)
        rows = sorted((x for known, x in found if not known), key=lambda r: r["at"])
        span = spanned([bytes(r["digest"]) for r in rows], rows[0]["n"], height)
        for slot, row in enumerate(rows):
            yield finish(row, steps(span, slot) + path, above)

    paths, old = entering(levels[-1]), None
    for level, under in zip(levels[:0:-1], levels[-2::-1], strict=True):
        own = level.rdd.map(lambda r: ((r["tree"], r["at"]), (False, (r["below"], bytes(r["kids"])))))
        sent = stored(spark.createDataFrame(_grouped(own.union(told(paths)), parts).flatMap(passed), PATH, verifySchema=False))
        if old is not None:
            release(old)
        old, paths = sent, sent.union(entering(under))
    own = nodes.rdd.map(lambda r: ((r["tree"], r["at"] >> height), (False, r)))
    return spark.createDataFrame(_grouped(own.union(told(paths)), parts).flatMap(finished), schema, verifySchema=False)


def _proof(row, path: bytes, tops: bytes) -> tuple:
    leaf, told = bytes(row["digest"]), bytes(row["told"] or row["digest"])
    subroot, root, end = tops[:32], tops[32:], folded(told, path)
    return row["doc_id"], leaf.hex(), subroot.hex(), root.hex(), joined_hash([d for _, d in siblings(path)]).hex(), end.hex(), end == root


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """For every row its leaf, subroot, root and proof, and whether its record as told leads to the root."""
    ship(docs.sparkSession)
    hashed = stored(leaves(docs))
    nodes = placed_in_tree(hashed, "doc_id", "digest")
    release(hashed)
    levels = climb(nodes, height)
    # the trees' roots are the leaves of the last tree
    above = placed_in_tree(roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "of")
    top = climb(above, height)
    tops = stored(descend(above, top, roots(top).select("tree", F.lit(b"").alias("path"), F.col("digest").alias("tops")), lambda row, path, root: (row["of"], path, bytes(row["digest"]) + root), "tree string, path binary, tops binary", height))
    release(above, *top)
    found = stored(descend(nodes, levels, tops, _proof, PROOF, height))
    release(nodes, tops, *levels)
    return found


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
fields AS (
  SELECT doc_id, lang, n_chars,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS changed,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents, crc),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS h,
         CASE WHEN changed THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS told
  FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
up(level, lang, pos, n, h) AS (
  SELECT 0, lang, pos, n, h FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, lang, pos // 2, n),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over_sub(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM over_sub WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT p.doc_id, p.h AS own, 0 AS part, u.level, u.pos % 2 AS odd, s.h
  FROM placed p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.pos = p.pos >> u.level AND u.n > 1
  LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = u.level AND s.pos = xor(u.pos, 1)
  UNION ALL
  SELECT p.doc_id, p.h, 1, u.level, u.pos % 2, s.h
  FROM placed p JOIN sub b ON b.lang IS NOT DISTINCT FROM p.lang JOIN over_sub u ON u.pos = b.pos >> u.level AND u.n > 1
  LEFT JOIN over_sub s ON s.level = u.level AND s.pos = xor(u.pos, 1)),
paths AS (SELECT doc_id, own, sha256(coalesce(string_agg(h, '' ORDER BY part, level), '')) AS proof_sha256, list({'odd': odd, 'h': h} ORDER BY part, level) AS path FROM steps GROUP BY doc_id, own),
done AS (
  SELECT p.doc_id, p.h AS leaf, b.h AS subroot, (SELECT h FROM over_sub WHERE n = 1) AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
         list_reduce(list_prepend({'odd': 0::BIGINT, 'h': coalesce(p.told, p.h)}, coalesce(q.path, [])),
                     lambda a, s: {'odd': 0::BIGINT, 'h': sha256(CASE WHEN s.h IS NULL THEN a.h WHEN s.odd = 1 THEN s.h || a.h ELSE a.h || s.h END)}).h AS folded_root
  FROM placed p JOIN sub b ON b.lang IS NOT DISTINCT FROM p.lang LEFT JOIN paths q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.own = p.h)
SELECT *, folded_root = root AS verified FROM done
"""
