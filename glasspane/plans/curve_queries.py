"""ROC and precision-recall curves, thresholds, confusion metrics, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasspane.operators import curves, filters, labels, statistics
from glasspane.plans.frames import COUNTS_SQL, LABELLED_SQL, digits, labelled, table
from glasspane.plans.registry import query

INF = "CAST('Infinity' AS DOUBLE)"


@query(f"""WITH {COUNTS_SQL} SELECT {INF} AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr UNION ALL SELECT threshold, round(cfp / n, 9), round(ctp / p, 9) FROM c""")
def roc_curve_points(spark, sf_dir):
    return digits(curves.roc_points(labelled(spark, sf_dir), "n_chars", "quality"), "fpr", "tpr", n=9)


@query(f"""WITH {COUNTS_SQL}, k AS (SELECT *, row_number() OVER w = 1 OR lead(fp) OVER w IS NULL OR lead(fp) OVER w <> fp OR lead(tp) OVER w <> tp AS keep FROM c WINDOW w AS (ORDER BY threshold DESC))
SELECT {INF} AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr UNION ALL SELECT threshold, round(cfp / n, 9), round(ctp / p, 9) FROM k WHERE keep""")
def roc_curve_corners(spark, sf_dir):
    return digits(curves.roc_points(labelled(spark, sf_dir), "n_chars", "quality", drop_intermediate=True), "fpr", "tpr", n=9)


@query(f"WITH {COUNTS_SQL} SELECT round(sum(fp * (ctp - tp / CAST(2 AS DOUBLE))) / max(p * n), 9) AS auc FROM c")
def roc_auc(spark, sf_dir):
    return digits(curves.roc_auc(labelled(spark, sf_dir), "n_chars", "quality"), "auc", n=9)


@query(f"""WITH {COUNTS_SQL}, r AS (SELECT {INF} AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr UNION ALL SELECT threshold, cfp / n, ctp / p FROM c)
SELECT threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, round(tpr - fpr, 9) AS j FROM r ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1""")
def j_threshold(spark, sf_dir):
    return digits(curves.j_threshold(labelled(spark, sf_dir), "n_chars", "quality"), "fpr", "tpr", "j", n=9)


@query(f"WITH {COUNTS_SQL} SELECT threshold, round(cfp / n, 9) AS fpr FROM c WHERE ctp = p ORDER BY threshold DESC LIMIT 1")
def full_tpr_threshold(spark, sf_dir):
    return digits(curves.full_sensitivity_threshold(labelled(spark, sf_dir), "n_chars", "quality"), "fpr", n=9)


@query(f"""WITH {COUNTS_SQL}, r AS (SELECT threshold, ctp / (ctp + cfp) AS "precision", ctp / p AS recall FROM c),
f AS (SELECT *, 2 * "precision" * recall / ("precision" + recall + CAST(0.00000001 AS DOUBLE)) AS f1 FROM r)
SELECT threshold, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1""")
def pr_best_f1(spark, sf_dir):
    return digits(curves.best_f1_threshold(labelled(spark, sf_dir), "n_chars", "quality"), "precision", "recall", "f1", n=9)


@query(f"""WITH {COUNTS_SQL} SELECT threshold, round(ctp / (ctp + cfp), 9) AS "precision", round(ctp / p, 9) AS recall FROM c""")
def pr_curve_points(spark, sf_dir):
    return digits(curves.pr_points(labelled(spark, sf_dir), "n_chars", "quality"), "precision", "recall", n=9)


@query(f"""WITH {COUNTS_SQL}, k AS (SELECT *, row_number() OVER w = 1 OR lead(fp) OVER w IS NULL OR lead(fp) OVER w <> fp OR lead(tp) OVER w <> tp AS keep FROM c WINDOW w AS (ORDER BY threshold DESC))
SELECT threshold, round(cfp / n, 9) AS fpr, round(ctp / p, 9) AS tpr FROM k WHERE keep ORDER BY abs(threshold - 1000), threshold DESC LIMIT 1""")
def nearest_threshold(spark, sf_dir):
    points = curves.roc_points(labelled(spark, sf_dir), "n_chars", "quality", drop_intermediate=True)
    return digits(curves.nearest_threshold(points, 1000.0), "fpr", "tpr", n=9)


_SWEEP_SQL = f"""WITH l AS (SELECT quality, 'a_1' AS parameter, CAST(n_chars AS DOUBLE) AS s FROM ({LABELLED_SQL}) UNION ALL SELECT quality, 'a_2', CAST(n_chars % 97 AS DOUBLE) FROM ({LABELLED_SQL}) UNION ALL SELECT quality, 'a_3', CAST(-n_chars AS DOUBLE) FROM ({LABELLED_SQL})),
s AS (SELECT parameter, s, sum(quality) AS tp, sum(1 - quality) AS fp FROM l GROUP BY 1, 2),
c AS (SELECT parameter, tp, fp, sum(tp) OVER (PARTITION BY parameter ORDER BY s DESC) AS ctp, sum(tp) OVER (PARTITION BY parameter) AS p, sum(fp) OVER (PARTITION BY parameter) AS n FROM s),
a AS (SELECT parameter, round(sum(CAST(fp AS DOUBLE) * (CAST(ctp AS DOUBLE) - CAST(tp AS DOUBLE) / 2)) / (CAST(max(p) AS DOUBLE) * CAST(max(n) AS DOUBLE)), 9) AS auc FROM c GROUP BY 1)"""


def _sweep(spark, sf_dir):
    wide = labelled(spark, sf_dir).select("quality", F.col("n_chars").alias("pred_a=1"), (F.col("n_chars") % 97).alias("pred_a=2"), (-F.col("n_chars")).alias("pred_3"))
    return digits(curves.sweep_auc(wide, "quality", {f"a={i}": f"pred_a={i}" for i in (1, 2, 3)}, {f"a={i}": f"pred_{i}" for i in (1, 2, 3)}), "auc", n=9)


@query(_SWEEP_SQL + " SELECT parameter, auc FROM a")
def sweep_auc(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(_SWEEP_SQL + " SELECT parameter, auc FROM a ORDER BY auc DESC, parameter LIMIT 1")
def best_parameter(spark, sf_dir):
    return curves.best_parameter(_sweep(spark, sf_dir))


def _predicted(spark, sf_dir):
    return labelled(spark, sf_dir).withColumn("p", labels.binary_prediction("n_chars", 1000.0)).withColumn("t", F.col("quality") == 1)


_CELLS = "count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn"
_RATES = """tp, fp, fn, tn, round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0.0), 6) AS accuracy, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6) AS "precision",
 round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0), 6) AS specificity, round(coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0.0), 6) AS npv"""
_PREDICTED = f"SELECT *, n_chars >= 1000 AS p, quality = 1 AS t FROM ({LABELLED_SQL})"


@query(f"WITH c AS (SELECT {_CELLS} FROM ({_PREDICTED})) SELECT {_RATES} FROM c")
def confusion_metrics(spark, sf_dir):
    return digits(curves.confusion_metrics(_predicted(spark, sf_dir), "p", "t"), "accuracy", "precision", "recall", "specificity", "npv")


@query(f"SELECT CAST(a AS INT) AS actual, CAST(b AS INT) AS predicted, count(doc_id) AS n FROM (VALUES (0), (1)) x(a) CROSS JOIN (VALUES (0), (1)) y(b) LEFT JOIN ({_PREDICTED}) ON CAST(t AS INT) = a AND CAST(p AS INT) = b GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return curves.confusion_matrix(_predicted(spark, sf_dir), "p", "t")


@query(f"SELECT doc_id, n_chars, p, t FROM ({_PREDICTED}) WHERE p IS DISTINCT FROM t")
def mispredictions(spark, sf_dir):
    return filters.mispredictions(_predicted(spark, sf_dir).select("doc_id", "n_chars", "p", "t"), "p", "t")


@query(f"SELECT doc_id AS slide_name, n_chars AS prediction, quality = 1 AS target, p AS bin_prediction, p AND NOT t AS is_fp FROM ({_PREDICTED})")
def prediction_table(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.col("doc_id").alias("slide_name"), F.col("n_chars").alias("prediction"), (F.col("quality") == 1).alias("target"))
    return labels.prediction_table(rows, 1000.0)


@query(f"""WITH c AS (SELECT lang, {_CELLS} FROM ({_PREDICTED}) GROUP BY 1), s AS (SELECT lang, n_chars, sum(quality) AS k, sum(1 - quality) AS f FROM ({LABELLED_SQL}) GROUP BY 1, 2),
w AS (SELECT lang, k, f, sum(k) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS ck, sum(k) OVER (PARTITION BY lang) AS pk, sum(f) OVER (PARTITION BY lang) AS nf FROM s),
a AS (SELECT lang, round(sum(CAST(f AS DOUBLE) * (CAST(ck AS DOUBLE) - CAST(k AS DOUBLE) / 2)) / nullif(CAST(max(pk) AS DOUBLE) * CAST(max(nf) AS DOUBLE), 0), 9) AS auc FROM w GROUP BY 1)
SELECT lang, {_RATES}, auc FROM c LEFT JOIN a USING (lang)""")
def nested_metrics(spark, sf_dir):
    found = curves.nested_metrics(_predicted(spark, sf_dir), "p", "n_chars", "t", ["lang"])
    return digits(digits(found, "accuracy", "precision", "recall", "specificity", "npv"), "auc", n=9)


@query("SELECT event_type, CAST(least(floor(value / CAST(500 AS DOUBLE) * 20), 19) AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2")
def score_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 500.0).alias("s"))
    return curves.score_histogram(rows, "s", ["event_type"])


@query("""SELECT CAST(i AS INT) AS step, round(i * (CAST(1 AS DOUBLE) / 99), 9) AS threshold, count(*) FILTER (value / CAST(500 AS DOUBLE) > i * (CAST(1 AS DOUBLE) / 99)) AS n FROM range(100) t(i), events GROUP BY i""")
def icdf(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("value") / 500.0).alias("s"))
    return digits(statistics.inverse_cdf(rows, "s"), "threshold", n=9)


@query("""SELECT 'median_coverage(Piqe)' AS measure, count(*) FILTER (l_quantity / CAST(50 AS DOUBLE) >= CAST(0.2 AS DOUBLE)) AS n FROM lineitem
UNION ALL SELECT 'median_coverage(Folding)', count(*) FILTER (l_discount * CAST(10 AS DOUBLE) >= CAST(0.3 AS DOUBLE)) FROM lineitem""")
def quality_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50.0).alias("median_coverage(Piqe)"), (F.col("l_discount") * 10.0).alias("median_coverage(Folding)"))
    return statistics.quality_sweep(rows, {"median_coverage(Piqe)": 0.2, "median_coverage(Folding)": 0.3})


_CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS channel, count({c}) AS n, round_even(avg({c}), 4) AS mean, round_even(stddev_pop({c}), 4) AS std FROM lineitem" for c in _CHANNELS))
def channel_mean_std(spark, sf_dir):
    return statistics.channel_moments(table(spark, sf_dir, "lineitem"), _CHANNELS)


@query("SELECT c_mktsegment AS value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM customer GROUP BY 1")
def value_share(spark, sf_dir):
    return digits(statistics.value_shares(table(spark, sf_dir, "customer"), "c_mktsegment"), "share", n=9)


_PARTS = "'low' AS source, c_nationkey AS value FROM customer WHERE c_acctbal < 2000"
_OTHER = "'high' AS source, c_nationkey AS value FROM customer WHERE c_acctbal >= 2000"


def _two(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return {"low": customers.where("c_acctbal < 2000"), "high": customers.where("c_acctbal >= 2000")}


_SHARES = f"""l AS (SELECT {_PARTS} UNION ALL SELECT {_OTHER}), s AS (SELECT source, value, count(*) / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE) AS share FROM l GROUP BY 1, 2)"""


@query(f"WITH {_SHARES}, v AS (SELECT DISTINCT value FROM l) SELECT source, value, round(coalesce(share, 0.0), 9) AS share FROM v CROSS JOIN (VALUES ('low'), ('high')) t(source) LEFT JOIN s USING (source, value)")
def aligned_share(spark, sf_dir):
    return digits(statistics.aligned_shares(_two(spark, sf_dir), "c_nationkey"), "share", n=9)


@query(f"""WITH {_SHARES}, a AS (SELECT value, share FROM s WHERE source = 'low'), b AS (SELECT value, share FROM s WHERE source = 'high')
SELECT round(CASE WHEN count(*) FILTER (a.share IS NULL OR b.share IS NULL) > 0 THEN {INF} ELSE coalesce(sum(abs(a.share - b.share)), 0.0) END, 9) AS distance FROM a FULL JOIN b ON a.value = b.value""")
def share_distance(spark, sf_dir):
    two = _two(spark, sf_dir)
    return digits(statistics.distribution_distance(two["low"], two["high"], "c_nationkey"), "distance", n=9)


@query(f"SELECT count(*) AS n, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM ({LABELLED_SQL})")
def class_counts(spark, sf_dir):
    return statistics.class_counts(labelled(spark, sf_dir), "quality")


@query("SELECT max(n) AS largest FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def largest_bag(spark, sf_dir):
    return statistics.largest_group(table(spark, sf_dir, "lineitem"), "l_orderkey")
