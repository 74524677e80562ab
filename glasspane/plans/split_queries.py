"""Splits, folds, weights, samples, resampled comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasspane.operators import checks, splits, statistics, tiling
from glasspane.operators.ranks import draws_sql
from glasspane.operators.splits import SEED
from glasspane.plans.frames import LABELLED_SQL, digits, labelled, table
from glasspane.plans.registry import query

#: Resamples of a comparison, as in the reference.
REPLICATES = 10_000


def _hash_sql(*keys: str) -> str:
    """ranks.hashed in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(keys)})), 1, 15) AS BIGINT)"


@query("SELECT o_custkey AS grp, count(DISTINCT o_orderkey % 5) AS n_folds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 5) > 1")
def group_leak_check(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), (F.col("o_orderkey") % 5).alias("fold"))
    return checks.leaking_groups(rows, "grp")


@query("SELECT c_custkey, c_mktsegment, round(1 / CAST(count(*) OVER (PARTITION BY c_mktsegment) AS DOUBLE), 9) AS weight FROM customer")
def class_weights(spark, sf_dir):
    return digits(splits.inverse_class_weights(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"), "weight", n=9)


@query("""WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT *, ceil(sum(n) OVER () * CAST(0.2 AS DOUBLE)) AS test, ceil(sum(n) OVER () * CAST(0.2 AS DOUBLE)) * n / CAST(sum(n) OVER () AS DOUBLE) AS x FROM c),
q AS (SELECT c_mktsegment, n, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, c_mktsegment) <= test - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS k FROM e)
SELECT c_mktsegment, 'test' AS split, k AS n FROM q UNION ALL SELECT c_mktsegment, 'train', n - k FROM q""")
def stratified_split_sizes(spark, sf_dir):
    rows = splits.stratified_split(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"], 0.2)
    return rows.groupBy("c_mktsegment", "split").agg(F.count("*").alias("n"))


@query("SELECT 'row' AS what, count(*) AS n FROM customer UNION ALL SELECT 'group', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'leak', 0 UNION ALL SELECT 'fold', 5")
def group_fold_invariants(spark, sf_dir):
    """Every row has a fold, no group has two, all five folds are used."""
    rows = splits.with_folds(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", 5).where("fold is not null")
    n = lambda what, count: count.select(F.lit(what).alias("what"), F.col("n").cast("bigint").alias("n"))
    leaks = checks.leaking_groups(rows, "c_nationkey").agg(F.count("*").alias("n"))
    return n("row", rows.agg(F.count("*").alias("n"))).union(n("group", rows.agg(F.count_distinct("c_nationkey").alias("n")))).union(n("leak", leaks)).union(n("fold", rows.agg(F.count_distinct("fold").alias("n"))))


def _folds_sql(k: int) -> str:
    """Common tables up to folds(c_nationkey, fold): whole rounds of each kind (the class counts' four
    leading bits, with the mean counts of its groups) are dealt evenly, the rest one after another to the fold that stays most even (see splits._deal)."""
    after = f"list_transform(range(1, len(total) + 1), lambda c: list_stddev_pop(list_transform(range(1, {k} + 1), lambda f: (state[f][c] + CASE WHEN f = x.f THEN kind[c] ELSE 0 END) / greatest(total[c], 1))))"
    return f"""WITH RECURSIVE m AS (SELECT DISTINCT c_mktsegment FROM customer), n AS (SELECT DISTINCT c_nationkey FROM customer),
g AS (SELECT c_nationkey, list(CAST(n AS DOUBLE) ORDER BY c_mktsegment) AS kind FROM (SELECT n.c_nationkey, m.c_mktsegment, count(c_custkey) AS n FROM n CROSS JOIN m LEFT JOIN customer c ON c.c_nationkey = n.c_nationkey AND c.c_mktsegment = m.c_mktsegment GROUP BY 1, 2) GROUP BY 1),
gq AS (SELECT c_nationkey, kind AS counts, list_transform(kind, lambda v: CAST(floor(v / (1 << greatest(length(bin(CAST(v AS BIGINT))) - 4, 0))) * (1 << greatest(length(bin(CAST(v AS BIGINT))) - 4, 0)) AS BIGINT)) AS cell FROM g),
h AS (SELECT cell, list(a ORDER BY c) AS kind, any_value(n) AS n FROM (SELECT cell, c, avg(counts[c]) AS a, count(*) AS n FROM gq, range(1, (SELECT count(*) FROM m) + 1) t(c) GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT c, sum(kind[c] * n) AS total, sum(kind[c] * (n // {k})) AS base FROM h, range(1, (SELECT count(*) FROM m) + 1) t(c) GROUP BY 1),
tot AS (SELECT list(total ORDER BY c) AS total, list(base ORDER BY c) AS base FROM e),
item AS (SELECT cell, kind, row_number() OVER (ORDER BY round(list_stddev_pop(kind), 9) DESC, cell, i) AS step FROM h, range({k}) t(i) WHERE i < n % {k}),
deal AS (SELECT CAST(0 AS BIGINT) AS step, list_transform(range({k}), lambda f: base) AS state, CAST(-1 AS BIGINT) AS fold FROM tot
 UNION ALL SELECT * FROM (SELECT item.step, list_transform(range(1, {k} + 1), lambda f: CASE WHEN f = x.f THEN list_transform(range(1, len(kind) + 1), lambda c: state[f][c] + kind[c]) ELSE state[f] END) AS state, x.f - 1 AS fold
  FROM deal JOIN item ON item.step = deal.step + 1, tot, range(1, {k} + 1) x(f) ORDER BY round(list_avg({after}), 12), list_sum(state[x.f]), x.f LIMIT 1)),
quota AS (SELECT h.cell, f AS fold, n // {k} + count(deal.step) AS q FROM h CROSS JOIN range({k}) t(f) LEFT JOIN item ON item.cell = h.cell LEFT JOIN deal ON deal.step = item.step AND deal.fold = f GROUP BY h.cell, f, n),
ends AS (SELECT cell, fold, q, sum(q) OVER (PARTITION BY cell ORDER BY fold) AS upto FROM quota),
ranked AS (SELECT c_nationkey, cell, row_number() OVER (PARTITION BY cell ORDER BY {_hash_sql("c_nationkey")}, c_nationkey) AS rank FROM gq),
folds AS (SELECT c_nationkey, CAST(fold AS INT) AS fold FROM ranked JOIN ends USING (cell) WHERE rank > upto - q AND rank <= upto)"""


@query(_folds_sql(5) + " SELECT c_nationkey, fold FROM folds")
def stratified_group_fold(spark, sf_dir):
    return splits.group_folds(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", 5)


@query(_folds_sql(5) + """, f AS (SELECT fold, c_mktsegment, count(*) AS n FROM customer JOIN folds USING (c_nationkey) GROUP BY 1, 2),
w AS (SELECT c_mktsegment, sum(n) / CAST(sum(sum(n)) OVER () AS DOUBLE) AS share FROM f GROUP BY 1),
s AS (SELECT fold, c_mktsegment, n / CAST(sum(n) OVER (PARTITION BY fold) AS DOUBLE) AS share FROM f),
d AS (SELECT s.fold, CASE WHEN count(*) < (SELECT count(*) FROM w) THEN CAST('Infinity' AS DOUBLE) ELSE round(sum(abs(s.share - w.share)), 12) END AS gap FROM s JOIN w USING (c_mktsegment) GROUP BY 1),
b AS (SELECT fold AS best FROM d ORDER BY gap, fold LIMIT 1)
SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN fold = best THEN 'test' ELSE 'train' END AS split FROM customer JOIN folds USING (c_nationkey), b""")
def group_split(spark, sf_dir):
    return splits.group_split(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_mktsegment", "c_nationkey", 0.2)


@query(f"""WITH c AS (SELECT c_mktsegment, count(*) AS n, row_number() OVER (ORDER BY c_mktsegment) - 1 AS class, count(*) OVER () AS k FROM customer GROUP BY 1),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_hash_sql("c_custkey")}, c_custkey) AS rank FROM customer),
d AS (SELECT i AS draw, {draws_sql("2 * i", "(SELECT max(k) FROM c)", SEED)} AS class FROM range((SELECT count(*) FROM customer)) t(i)),
e AS (SELECT draw, c_mktsegment, {draws_sql("2 * draw + 1", "n", SEED)} + 1 AS rank FROM d JOIN c USING (class))
SELECT c_custkey, c_mktsegment, draw FROM e JOIN r USING (c_mktsegment, rank)""")
def weighted_sample(spark, sf_dir):
    return splits.weighted_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"])


def _resampled_sql(scores: dict[str, str]) -> str:
    """Common tables up to a(replicate, side, auc): draws by number, counts by kind of row, areas."""
    sides = ", ".join(f"CAST({sql} AS DOUBLE) AS s{i}" for i, sql in enumerate(scores.values()))
    names = ", ".join(f"s{i}" for i in range(len(scores)))
    long = " UNION ALL ".join(f"SELECT replicate, {i} AS side, s{i} AS score, t, n FROM c" for i in range(len(scores)))
    return f"""WITH l AS (SELECT doc_id, CAST(quality AS INT) AS t, {sides} FROM ({LABELLED_SQL})),
o AS (SELECT *, row_number() OVER (ORDER BY {_hash_sql("doc_id")}, doc_id) - 1 AS place, count(*) OVER () AS size FROM l),
d AS (SELECT r AS replicate, {draws_sql("r * size + i", "size", SEED)} AS place FROM (SELECT max(size) AS size FROM o), range({REPLICATES}) t(r), range((SELECT count(*) FROM l)) u(i)),
c AS (SELECT replicate, t, {names}, count(*) AS n FROM d JOIN o USING (place) GROUP BY ALL),
p AS (SELECT replicate, side, score, CAST(sum(n * t) AS DOUBLE) AS tp, CAST(sum(n * (1 - t)) AS DOUBLE) AS fp FROM ({long}) GROUP BY 1, 2, 3),
q AS (SELECT *, sum(fp) OVER (PARTITION BY replicate, side ORDER BY score ROWS UNBOUNDED PRECEDING) AS below FROM p),
a AS (SELECT replicate, side, sum(tp * (below - fp / 2)) / nullif(sum(tp) * sum(fp), 0) AS auc FROM q GROUP BY 1, 2)"""


_NI_SQL = """count(*) AS n, round(avg(delta), 9) AS mean_delta, round(quantile_cont(delta, CAST(0.025 AS DOUBLE)), 9) AS ci_95_lower, round(quantile_cont(delta, CAST(0.975 AS DOUBLE)), 9) AS ci_95_upper,
 round(quantile_cont(delta, CAST(0.95 AS DOUBLE)), 9) AS upper_95, quantile_cont(delta, CAST(0.95 AS DOUBLE)) < CAST(0.02 AS DOUBLE) AS non_inferior"""
_NI_DIGITS = ("mean_delta", "ci_95_lower", "ci_95_upper", "upper_95")


@query(_resampled_sql({"base": "n_chars", "other": "n_chars % 977"}) + f""", v AS (SELECT o.auc - b.auc AS delta FROM a b JOIN a o USING (replicate) WHERE b.side = 0 AND o.side = 1 AND o.auc - b.auc IS NOT NULL)
SELECT {_NI_SQL} FROM v""")
def bootstrap_ni(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "quality", F.col("n_chars").cast("double").alias("base"), (F.col("n_chars") % 977).cast("double").alias("other"))
    return digits(statistics.non_inferiority(statistics.bootstrap_auc_differences(rows, "doc_id", "quality", "base", "other", REPLICATES)), *_NI_DIGITS, n=9)


#: Fourteen models, each with a score by maximum, mean-pool-max, top-k and span.
MODELS, METHODS = [f"m{i:02d}" for i in range(14)], ["mpm", "topk", "span"]
_SCORES = {f"{m}__{x}": f"n_chars % {(977, 7 + i, 10 + 13 * i, 2 + i % 3)[j]}" if j or i % 2 else f"{'-' if i % 4 else ''}n_chars" for i, m in enumerate(MODELS) for j, x in enumerate(["max", *METHODS])}
_PAIRS = ", ".join(f"('{m}', '{x}', {list(_SCORES).index(f'{m}__max')}, {list(_SCORES).index(f'{m}__{x}')})" for m in MODELS for x in METHODS)


@query(_resampled_sql(_SCORES) + f""", v AS (SELECT model, method, o.auc - b.auc AS delta FROM (VALUES {_PAIRS}) x(model, method, i, j) JOIN a b ON b.side = i JOIN a o ON o.side = j AND o.replicate = b.replicate WHERE o.auc - b.auc IS NOT NULL)
SELECT model, method, {_NI_SQL} FROM v GROUP BY 1, 2""")
def ni_table(spark, sf_dir):
    """Fourteen models, each with its maximum against mean-pool-max, top-k and span."""
    rows = labelled(spark, sf_dir).select(F.col("doc_id").alias("slide_name"), F.col("quality").alias("target"), *(F.expr(c).cast("double").alias(k) for k, c in _SCORES.items()))
    return digits(statistics.non_inferiority_table(rows, MODELS, METHODS, REPLICATES), *_NI_DIGITS, n=9)


@query("SELECT 'row' AS what, count(*) AS n FROM orders UNION ALL SELECT 'leak', 0 UNION ALL SELECT 'fold', 5")
def kfold_pipeline_invariants(spark, sf_dir):
    """Orders as slides, grouped by customer: every slide has one of five folds, no group two."""
    orders = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/d/"), F.col("o_orderkey").cast("string"), F.lit(".mrxs"))
    slides = orders.select("o_orderkey", path.alias("path"), (F.col("o_orderstatus") == "F").alias("carcinoma"))
    metadata = orders.select(path.alias("slide_path"), F.col("o_custkey").alias("patient_id"))
    folds = tiling.with_group_folds(slides, metadata, "carcinoma", "patient_id", 5)
    leaks = checks.leaking_groups(folds.join(orders, "o_orderkey"), "o_custkey").agg(F.count("*").alias("n"))
    n = lambda what, count: count.select(F.lit(what).alias("what"), F.col("n").cast("bigint").alias("n"))
    return n("row", folds.agg(F.count("*").alias("n"))).union(n("leak", leaks)).union(n("fold", folds.agg(F.count_distinct("fold").alias("n"))))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return statistics.difference(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'view'")
def set_union(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return statistics.union_distinct(*(events.where(F.col("event_type") == t).select("user_id") for t in ("click", "view")))


@query("SELECT NOT EXISTS (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM documents WHERE lang <> 'en') AS is_empty")
def set_intersect_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    both = docs.where("lang = 'en'").select("doc_id").intersect(docs.where("lang <> 'en'").select("doc_id"))
    return both.agg((F.count("*") == 0).alias("is_empty"))


@query("SELECT doc_id, lang, CAST(NULL AS DOUBLE) AS quality FROM documents UNION ALL SELECT doc_id, NULL, CAST(quality AS DOUBLE) FROM labels")
def union_by_name(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return statistics.union_by_name(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels)
