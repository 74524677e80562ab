"""Tables written in each form and read back, listings, annotations, remote calls, bags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from glasspane.functions.vectors import layer
from glasspane.operators.attention import bags, map_bags
from glasspane.plans.frames import digits, table
from glasspane.plans.registry import query
from glasspane.sources import tables
from glasspane.sources.scratch import shared_dir

_CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(*_CUSTOMER.split(", "))


@query(f"SELECT {_CUSTOMER} FROM customer")
def csv_round_trip(spark, sf_dir):
    rows, where = _customer(spark, sf_dir), shared_dir(spark)
    tables.write_csv(rows, where)
    return tables.read_csv(spark, where, rows.schema)


@query("SELECT l_orderkey AS slide_id, count(*) AS n_tiles, any_value(o_orderstatus) AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def dataset_round_trip(spark, sf_dir):
    where = shared_dir(spark)
    slides = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    tables.write_dataset(slides, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide_id"), "l_linenumber"), where)
    slides, tiles = tables.read_dataset(spark, where)
    counts = tiles.groupBy("slide_id").agg(F.count("*").alias("n_tiles"))
    return counts.join(slides, F.col("slide_id") == F.col("id")).select("slide_id", "n_tiles", F.col("o_orderstatus").alias("status"))


@query(f"SELECT {_CUSTOMER} FROM customer WHERE c_acctbal < 0 UNION ALL SELECT {_CUSTOMER} FROM customer UNION ALL SELECT {_CUSTOMER} FROM customer WHERE c_acctbal >= 0")
def several_paths(spark, sf_dir):
    rows, where = _customer(spark, sf_dir), shared_dir(spark)
    parts = {"below": rows.where("c_acctbal < 0"), "all": rows, "above": rows.where("c_acctbal >= 0")}
    for name, part in parts.items():
        part.write.parquet(f"{where}/{name}")
    return tables.read_all(spark, [f"{where}/{name}" for name in parts])


@query("SELECT c_mktsegment, count(*) AS n, true AS within FROM customer GROUP BY 1")
def sharded_round_trip(spark, sf_dir):
    """Rows by segment, and whether no file has more than 50 rows."""
    where = shared_dir(spark)
    tables.write_sharded(_customer(spark, sf_dir), where, max_rows=50)
    rows = spark.read.parquet(where).select("c_mktsegment", F.col("_metadata.file_path").alias("file"))
    largest = rows.groupBy("file").agg(F.count("*").alias("n")).agg((F.max("n") <= 50).alias("within"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n")).crossJoin(largest)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark, sf_dir):
    where, nation = shared_dir(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    tables.write_json_split(nation, where)
    return tables.read_json_split(spark, where, {c: k for c, k in nation.dtypes if c != "n_name"})


@query("SELECT n_regionkey AS region, 'csv' AS suffix FROM nation GROUP BY 1")
def directory_listing(spark, sf_dir):
    """The folders of the CSV files below a folder."""
    where, nation = shared_dir(spark), table(spark, sf_dir, "nation")
    for suffix in ("csv", "parquet"):
        nation.select("n_name", "n_regionkey").repartition(1).write.partitionBy("n_regionkey").format(suffix).save(f"{where}/{suffix}")
    found = tables.list_files(spark, where, "*.csv", nested=True)
    region = F.regexp_extract("path", r"n_regionkey=(\d+)/", 1).cast(dict(nation.dtypes)["n_regionkey"])
    return found.where("length > 0").select(region.alias("region"), F.element_at(F.split("path", r"\."), -1).alias("suffix"))


def _annotations(spark, sf_dir):
    """An XML file for each region, with an annotation for each nation, of 3 to 5 points in falling order."""
    nation, where = table(spark, sf_dir, "nation"), shared_dir(spark)
    point = lambda i: F.format_string('<Coordinate Order="%d" X="%d.5" Y="%d"/>', i, i + F.col("n_nationkey"), 2 * i)
    points = F.concat_ws("", F.reverse(F.transform(F.sequence(F.lit(0), (2 + F.col("n_nationkey") % 3).cast("int")), point)))
    group = F.when(F.col("n_regionkey") > 2, "Carcinoma").otherwise("Other")
    line = F.format_string('<Annotation Name="%s" PartOfGroup="%s"><Coordinates>%s</Coordinates></Annotation>', "n_name", group, points)
    whole = F.concat(F.lit("<Annotations>\n"), F.concat_ws("\n", F.collect_list("line")), F.lit("\n</Annotations>"))
    nation.select("n_regionkey", line.alias("line")).groupBy("n_regionkey").agg(whole.alias("value")).write.partitionBy("n_regionkey").text(where)
    return where


@query("SELECT CASE WHEN n_regionkey > 2 THEN 'Carcinoma' ELSE 'Other' END AS part_of_group, 3 + n_nationkey % 3 AS n_points, count(*) AS n FROM nation GROUP BY 1, 2")
def annotation_groups(spark, sf_dir):
    rows = tables.read_annotations(spark, _annotations(spark, sf_dir))
    return rows.groupBy("part_of_group", F.size("vertices").cast("bigint").alias("n_points")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey + CAST(0.5 AS DOUBLE) AS first_x, CAST(2 * (2 + n_nationkey % 3) AS DOUBLE) AS last_y FROM nation WHERE n_regionkey > 2")
def annotations_of_a_group(spark, sf_dir):
    rows = tables.read_annotations(spark, _annotations(spark, sf_dir), "Carcinoma")
    return rows.select(F.col("vertices")[0]["x"].alias("first_x"), F.element_at("vertices", -1)["y"].alias("last_y"))


@query("SELECT CAST(doc_id AS VARCHAR) AS stem, CAST(n_chars AS DOUBLE) AS value FROM documents UNION ALL SELECT 'patch', CAST(0.5 AS DOUBLE)")
def metric_rows(spark, sf_dir):
    """Maps of metrics as rows; one entry is added."""
    key = F.concat(F.lit("score_"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".svs"))
    entries = table(spark, sf_dir, "documents").select(F.create_map(key, F.col("n_chars")).alias("metrics"))
    return tables.metrics_as_rows(entries, extra={"patch": 0.5})


@query("SELECT s_suppkey AS id, s_acctbal AS folds, CAST(NULL AS DOUBLE) AS blur FROM supplier UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def quality_reports(spark, sf_dir):
    where = shared_dir(spark)
    tables.write_csv(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("folds")), f"{where}/a")
    tables.write_csv(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("blur")), f"{where}/b")
    return tables.read_quality_reports(spark, [f"{where}/a", f"{where}/b"]).select(F.col("id").cast("bigint").alias("id"), "folds", "blur")


def _remote(value: str) -> str:
    """Stands for a remote service: fails each time, times out, is wrong, or answers."""
    if value.endswith("7"):
        raise RuntimeError("Internal Server Error")
    if value.endswith("9"):
        raise TimeoutError("60 s")
    if value.endswith("3"):
        raise ValueError(value)
    return value[::-1]


@query("""SELECT k AS key, CASE WHEN k[-1] IN ('7', '9', '3') THEN NULL ELSE reverse(k) END AS result,
 CASE k[-1] WHEN '7' THEN 'Internal Server Error' WHEN '9' THEN 'timeout: 60 s' WHEN '3' THEN 'ValueError: ' || k END AS error FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer)""")
def enriched_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return tables.enriched(rows, "key", _remote, wait=lambda seconds: None)


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + CAST(0.5 AS DOUBLE), 6) AS sum_value,
 round(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE), 6) AS difference FROM embeddings""")
def wide_layer(spark, sf_dir):
    """A layer with two outputs, a batch at a time."""
    weights = np.zeros((2, 64))
    weights[0], weights[1, 0], weights[1, 1] = 1, 1, -1
    out = table(spark, sf_dir, "embeddings").select("vec_id", layer(weights, np.array([0.5, 0.0]))("embedding").alias("out"))
    return digits(out.select("vec_id", F.col("out")[0].alias("sum_value"), F.col("out")[1].alias("difference")), "sum_value", "difference")


@query("SELECT label, count(*) AS n, round(median(CAST(embedding[1] AS DOUBLE)), 9) AS middle FROM embeddings GROUP BY 1")
def bag_medians(spark, sf_dir):
    """A function of all rows of a bag at once."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))

    def medians(bag):
        return bag.groupby("label", as_index=False).agg(n=("x", "size"), middle=("x", "median"))

    return digits(map_bags(rows, "label", medians, f"label {dict(rows.dtypes)['label']}, n bigint, middle double"), "middle", n=9)


@query("SELECT label, list_sum(list_transform(l, lambda x, i: x * i)) AS weighted, len(l) AS n FROM (SELECT label, list(vec_id ORDER BY vec_id) AS l FROM embeddings GROUP BY 1)")
def bag_arrays(spark, sf_dir):
    """Each bag's vectors in order, as one array (for export), here of vectors that hold vec_id."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.array(F.col("vec_id")).alias("embedding"))
    sums = F.aggregate(F.transform("embeddings", lambda e, i: e[0] * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return bags(rows, "label", "vec_id").select("label", sums.alias("weighted"), F.size("embeddings").cast("bigint").alias("n"))
