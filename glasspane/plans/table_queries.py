"""Metadata: names and ranges parsed, cases looked up, tables matched and merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasspane.functions import text
from glasspane.operators import checks, filters, joins, labels, splits
from glasspane.plans.frames import table
from glasspane.plans.registry import query


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def exclude_anti(spark, sf_dir):
    return filters.excluding(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def keep_semi(spark, sf_dir):
    return filters.keeping(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query(r"SELECT page_id, regexp_extract(url, '[^/]*$') AS file_name, regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS stem FROM pages")
def stem_parse(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.file_name(url).alias("file_name"), text.stem(url).alias("stem"))


@query(r"SELECT c_custkey, regexp_extract(c_name, '^(\w+)#(\d+)$', 1) AS kind, ltrim(regexp_extract(c_name, '^(\w+)#(\d+)$', 2), '0') AS number FROM customer")
def regex_parse(spark, sf_dir):
    pattern = r"^(\w+)#(\d+)$"
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", text.group_or_null(name, pattern, 1).alias("kind"), text.without_leading_zeros(text.group_or_null(name, pattern, 2)).alias("number"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'c' WHEN l_linenumber IN (1, 2, 5) THEN 'a' ELSE 'b' END AS case_id FROM lineitem
WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2, 5, 3, 6) OR l_returnflag = 'A' AND l_linenumber BETWEEN 2 AND 9""")
def range_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    cases = spark.createDataFrame([("a", "R", "1-2,5"), ("b", "R", "3,6,6"), ("c", "A", "2-9")], "case_id string, l_returnflag string, listed string")
    found = joins.range_join(lines, cases.select("case_id", "l_returnflag", text.parsed_ranges(F.col("listed")).alias("ranges")), "l_returnflag", "l_linenumber", "l_orderkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "case_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def case_lookup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("s_suppkey"))
    with_nation = joins.lookup(lines, table(spark, sf_dir, "supplier"), "s_suppkey", ["s_nationkey"]).withColumnRenamed("s_nationkey", "n_nationkey")
    return joins.lookup(with_nation, table(spark, sf_dir, "nation"), "n_nationkey", ["n_name"]).select("l_orderkey", "l_linenumber", "l_partkey", "n_name")


@query("""WITH f AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT c_custkey, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM f WHERE n = 1) ON c_custkey = o_custkey""")
def first_label(spark, sf_dir):
    first = joins.first_match(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"), "c_custkey", "o_orderkey")
    return joins.lookup(table(spark, sf_dir, "customer").select("c_custkey"), first, "c_custkey", ["o_orderstatus"], strict=False)


@query("SELECT p_partkey, p_size <> 17 AS carcinoma, p_brand FROM part WHERE p_size > 10")
def graded_metadata(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", (size > 10).alias("has_annotation"), F.lit(True).alias("has_segmentation"), F.lit("s").alias("segmentation_id"), F.when(size != 17, size).otherwise(0).alias("isup_grade")
    )
    return labels.graded_metadata(rows).select("p_partkey", "carcinoma", "p_brand")


@query("""SELECT doc_id AS slide_name, CAST(quality AS INT) AS target, CAST(n_chars AS DOUBLE) AS a__max, CAST(n_chars % 10 AS DOUBLE) AS a__topk FROM documents JOIN labels USING (doc_id) WHERE toxic = 0""")
def master_table(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("slide_name"), F.col("n_chars").alias("prediction"), F.col("quality").alias("target"), "toxic")
    return joins.master_table({"a__max": rows, "a__topk": rows.where("toxic = 0").withColumn("prediction", F.col("prediction") % 10)})


@query("""SELECT doc_id AS slide_name, quality AS target, CAST(n_chars AS DOUBLE) AS a_pred_score, CAST(n_chars % 10 AS DOUBLE) AS b_pred_score, n_chars % 10 >= 5 AS b_pred_binary FROM documents JOIN labels USING (doc_id)""")
def merged_predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("slide_name"), F.col("n_chars").cast("double").alias("prediction"), F.col("quality").alias("target"))
    other = rows.withColumn("prediction", F.col("prediction") % 10).withColumn("bin_prediction", labels.binary_prediction("prediction", 5.0))
    return joins.merged_predictions({"a": rows, "b": other})


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def longest_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)


@query("""WITH g AS (SELECT DISTINCT CASE WHEN p_size % 10 = 0 THEN 'negative' ELSE (3 + p_size % 3) || '+' || (3 + p_size % 2) END AS grade FROM part)
SELECT grade, row_number() OVER (ORDER BY grade <> 'negative', CASE WHEN grade = 'negative' THEN 0 ELSE CAST(grade[1] AS INT) END, CASE WHEN grade = 'negative' THEN 0 ELSE CAST(grade[3] AS INT) END) AS place FROM g""")
def grade_order(spark, sf_dir):
    from pyspark.sql import Window as W

    size = F.col("p_size")
    grade = F.when(size % 10 == 0, "negative").otherwise(F.concat((3 + size % 3).cast("string"), F.lit("+"), (3 + size % 2).cast("string")))
    found = table(spark, sf_dir, "part").select(grade.alias("grade")).distinct()
    return found.select("grade", F.row_number().over(W.orderBy(text.grade_key(F.col("grade")))).cast("bigint").alias("place"))


@query(r"SELECT page_id, 'tiles/' || regexp_extract(url, '[^/]*$') AS target FROM pages WHERE regexp_extract(url, '[^/]*$') LIKE '1%'")
def organised_files(spark, sf_dir):
    from glasspane.sources.tables import organised

    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return pages.join(organised(pages.select("path").distinct(), {"1": "tiles"}), "path").select("page_id", "target")


@query("""WITH s AS (SELECT o_custkey, 1 + o_orderkey % 9 AS n FROM orders), c AS (SELECT c_custkey, c_mktsegment <> 'MACHINERY' AS positive, c_acctbal > 0 AS invaded FROM customer),
r AS (SELECT *, positive AND n IN (2, 3, 6) AS l FROM s JOIN c ON o_custkey = c_custkey WHERE n BETWEEN 1 AND 4 OR n = 6)
SELECT '/d/' || o_custkey || '-24-' || n || '-HE.czi' AS slide_path, l AS carcinoma, c_custkey || '/24 - 1-4, 6' AS case_id, CAST(c_custkey AS INT) AS patient_id, positive AS case_carcinoma,
 l AND invaded AS perineural_invasions, CASE WHEN l THEN CAST(2 AS DOUBLE) END AS isup_grade, CASE WHEN l THEN '3+4' END AS gleason_score FROM r""")
def metadata_from_ranges(spark, sf_dir):
    """Orders as slides <patient>-24-<number>-HE.czi, customers as cases with the ranges 1-4 and 6."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/d/"), F.col("o_custkey").cast("string"), F.lit("-24-"), (1 + F.col("o_orderkey") % 9).cast("string"), F.lit("-HE.czi"))
    slides = orders.select(path.alias("slide_path")).union(orders.select(F.concat(F.lit("/d/other-"), F.col("o_orderkey").cast("string"))))
    cases = customer.select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("/24 - 1-4, 6")).alias("Biopsy_No"), F.when(F.col("c_mktsegment") != "MACHINERY", "Yes").otherwise("no").alias("Cancer_in_case"), F.lit("2, 3,6").alias("Cancer_in_slides"),
        F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("Perineural_invasion"), F.lit(2).alias("ISUP_grade_ group"), F.lit(" 3+4 ").alias("Gleason_score"),
    )
    return labels.metadata_from_ranges(slides, labels.parse_case_table(cases))


@query("""SELECT '/d/2021_0' || c_custkey || '-0' || n || '.mrxs' AS slide_path, p AND n IN (1, 2) AS carcinoma, '21/' || c_custkey AS case_id, 'p' || c_custkey AS patient_id, p AS case_carcinoma,
 p AND n IN (1, 2) AS perineural_invasions, CASE WHEN p AND n IN (1, 2) THEN CAST(1 AS DOUBLE) END AS isup_grade, CASE WHEN p AND n IN (1, 2) THEN '3+3' END AS gleason_score
FROM (SELECT c_custkey + 1 AS c_custkey, c_nationkey > 10 AS p FROM customer), (VALUES (1), (2), (3)) t(n)""")
def metadata_from_index(spark, sf_dir):
    """Three slides <year>_<request>-<number>.mrxs of each customer, looked up as yy/request; the list
    of positive slides was read as the number 1.2."""
    customer = table(spark, sf_dir, "customer")
    own = (F.col("c_custkey") + 1).cast("string")
    name = F.concat(F.lit("/d/2021_0"), own, F.lit("-0"), F.col("n").cast("string"), F.lit(".mrxs"))
    slides = customer.withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select(name.alias("slide_path"))
    cases = customer.select(
        F.concat(F.lit(" 21/"), own).alias("Biopsy_No"), F.concat(F.lit("p"), own).alias("Patient_ID"), F.when(F.col("c_nationkey") > 10, "yes").alias("Cancer_in_case"),
        F.lit(1.2).alias("Cancer_in_slides"), F.lit("yes").alias("Perineural_invasion"), F.lit(1).alias("ISUP_grade_ group"), F.lit("3+3").alias("Gleason_score"),
    )
    return labels.metadata_from_index(slides, cases)


@query("SELECT count(*) AS in_whole, count(*) AS in_parts, 0 AS shared_keys, true AS complete FROM customer")
def partition_completeness(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    split = splits.stratified_split(customer, "c_mktsegment", ["c_custkey"], 0.2)
    return checks.partition_counts(customer, list(filters.split_by(split, "split", ["train", "test"]).values()), "c_custkey")


@query("SELECT count(*) AS in_whole, count(*) + count(*) FILTER (c_nationkey < 5) AS in_parts, count(*) FILTER (c_nationkey < 5) AS shared_keys, count(*) FILTER (c_nationkey < 5) = 0 AS complete FROM customer")
def partition_overlap(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return checks.partition_counts(customer, [customer, customer.where("c_nationkey < 5")], "c_custkey")


@query("SELECT doc_id, 'new/' || doc_id || '.tiff' AS path FROM documents")
def repathed(spark, sf_dir):
    path = lambda top: F.concat(F.lit(top), F.col("doc_id").cast("string"), F.lit(".tiff")).alias("path")
    docs = table(spark, sf_dir, "documents")
    return joins.repathed(docs.select("doc_id", path("old/deep/")), docs.select(path("new/")))


@query("SELECT c_mktsegment AS provider, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def split_by_provider(spark, sf_dir):
    parts = filters.split_by(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    counts = [df.agg(F.lit(name).alias("provider"), F.count("*").alias("n")) for name, df in parts.items()]
    return counts[0].union(counts[1])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT min(n_name) FROM nation UNION ALL SELECT max(n_name) FROM nation)")
def not_listed(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ends = nation.agg(F.min("n_name").alias("a"), F.max("n_name").alias("b")).first()
    return filters.not_listed(nation, "n_name", [ends.a, ends.b])


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '/\d+\.html$')")
def matching_names(spark, sf_dir):
    return filters.matching(table(spark, sf_dir, "pages").select("page_id", "url"), "url", r"/\d+\.html$")


@query("SELECT 'slide_' || c_custkey || '_' || c_nationkey % 2 AS stem, c_nationkey % 2 = 1 AS label FROM customer")
def last_digit_labels(spark, sf_dir):
    stem = F.concat(F.lit("slide_"), F.col("c_custkey").cast("string"), F.lit("_"), (F.col("c_nationkey") % 2).cast("string"))
    return table(spark, sf_dir, "customer").select(stem.alias("stem")).select("stem", filters.last_digit_label(F.col("stem")).alias("label"))


@query("SELECT 'd/' || doc_id || '.svs' AS slide_path, quality = 1 AS carcinoma FROM labels WHERE doc_id NOT IN (1, 2, 3)")
def labelled_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("stem"), F.col("quality").cast("double").alias("value"))
    return labels.labelled_listing(rows.select(F.concat(F.lit("d/"), "stem", F.lit(".svs")).alias("slide_path")), rows, ["1", "2", "3"])


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS id, c_acctbal < 0 AS lost FROM customer""")
def row_ids(spark, sf_dir):
    """A digest of each row; and the null test of a floating column (negative balances as NaN)."""
    balance = F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.row_id("c_custkey", "c_name").alias("id"), text.missing(balance, floating=True).alias("lost"))


@query("""SELECT doc_id, trim(lang) || '+' || trim(source) AS items, ' ' || source AS last, 'a/' || source || '.tiff' AS path, lower(source) AS source FROM documents""")
def cell_items(spark, sf_dir):
    """Items of a comma-separated cell, its last token, and a path with another suffix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("lang", F.lit(", "), "source").alias("l"), F.concat(F.lit("a/"), "source", F.lit(".svs")).alias("p"))
    items = F.concat_ws("+", text.list_items(F.col("l")))
    return docs.select("doc_id", items.alias("items"), text.last_token(F.col("l"), ",").alias("last"), text.with_suffix(F.col("p"), ".tiff").alias("path"), F.lower("source").alias("source"))
