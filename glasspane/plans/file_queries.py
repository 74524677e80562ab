"""Files of other programs, written from a table and read back: slide headers, tensors, spreadsheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasspane.operators import grid, joins, labels
from glasspane.plans.frames import table
from glasspane.plans.registry import query
from glasspane.sources import headers, sheets, tensors
from glasspane.sources.scratch import shared_dir

_SLIDES_SQL = "SELECT 'p' || p_partkey AS id, 1000 + 40 * p_size + p_partkey % 3 AS width, 600 + 25 * p_size AS height, CASE WHEN p_size % 2 = 0 THEN 0.25 ELSE 0.5 END AS mpp, 1 + p_size % 4 AS levels FROM part"
_LEVELS_SQL = f"""s AS ({_SLIDES_SQL}), l AS (SELECT id, levels, mpp, width, height, i AS level, greatest(1, width >> i) AS w, greatest(1, height >> i) AS h FROM s, range(0, 4) r(i) WHERE i < levels),
m AS (SELECT *, mpp * width / CAST(w AS DOUBLE) AS mpp_x FROM l)"""


def _headers(spark, sf_dir):
    """A file of headers for each part, of 1 to 4 levels, classic or big; read back."""
    size, key, where = F.col("p_size").cast("int"), F.col("p_partkey").cast("int"), shared_dir(spark)
    slides = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("id"), (1000 + 40 * size + key % 3).alias("width"), (600 + 25 * size).alias("height"), F.when(size % 2 == 0, 0.25).otherwise(0.5).alias("mpp"), (1 + size % 4).alias("levels")
    )
    headers.write_pyramids(slides, where)
    return headers.read_headers(spark, where)


@query(f"WITH {_LEVELS_SQL} SELECT id, CAST(level AS INT) AS level, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, round(mpp_x, 4) AS mpp_x FROM m")
def slide_headers(spark, sf_dir):
    """Levels of every slide, from the headers of its file."""
    rows = _headers(spark, sf_dir)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.tiff$", 1).alias("id"), "level", "width", "height", F.round("mpp_x", 4).alias("mpp_x"))


@query(f"""WITH {_LEVELS_SQL}, n AS (SELECT id, w, h, row_number() OVER (PARTITION BY id ORDER BY round(abs(ln(mpp_x)), 3), level) AS r FROM m)
SELECT id AS slide_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM n, range(0, 3200, 128) a(x), range(0, 3200, 128) b(y) WHERE r = 1 AND x <= w - 256 AND y <= h - 256""")
def tiles_of_slide_files(spark, sf_dir):
    """Grid tiles of slides whose sizes come from their files' headers, at the level nearest to 1 micrometre a pixel."""
    slides = headers.slides_at(_headers(spark, sf_dir), 1.0, 256, 128)
    return grid.grid_tiles(slides).withColumnRenamed("id", "slide_id")


@query("""WITH p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, embedding FROM embeddings)
SELECT 'slide' || label AS slide_id, pos, vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM p""")
def tensor_round_trip(spark, sf_dir):
    """Embeddings written as a tensor file a slide, read back by place, and attached to their tiles."""
    where = shared_dir(spark)
    rows = table(spark, sf_dir, "embeddings").withColumn("slide_id", F.concat(F.lit("slide"), F.col("label").cast("string")))
    numbered = joins.positions(rows, "slide_id", ["vec_id"])
    tensors.write_tensors(numbered.select("slide_id", "pos", "embedding"), where)
    found = joins.attach_embeddings(numbered.select("slide_id", "pos", "vec_id"), tensors.read_tensors(spark, where))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("slide_id", "pos", "vec_id", F.round(total, 6).alias("total"))


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(f"SELECT {', '.join(_CUSTOMER)} FROM customer")
def sheet_round_trip(spark, sf_dir):
    where = shared_dir(spark)
    rows = table(spark, sf_dir, "customer").select(*(F.col(c).cast(k).alias(c) for c, k in _CUSTOMER.items()))
    sheets.write_sheets(rows.repartition(4, "c_custkey"), where)
    return sheets.read_sheets(spark, where, _CUSTOMER)


@query("""SELECT '/d/2021_0' || k || '-0' || n || '.mrxs' AS slide_path, p AND n IN (1, 2) AS carcinoma, '21/' || k AS case_id, 'p' || k AS patient_id, p AS case_carcinoma,
 p AND n IN (1, 2) AS perineural_invasions, CASE WHEN p AND n IN (1, 2) THEN CAST(1 AS DOUBLE) END AS isup_grade, CASE WHEN p AND n IN (1, 2) THEN '3+3' END AS gleason_score
FROM (SELECT c_custkey + 1 AS k, c_nationkey > 10 AS p FROM customer), (VALUES (1), (2), (3)) t(n)""")
def metadata_from_sheets(spark, sf_dir):
    """metadata_from_index with its cases in spreadsheets, where the list of slides was typed as the number 1.2."""
    customer, where = table(spark, sf_dir, "customer"), shared_dir(spark)
    own = (F.col("c_custkey") + 1).cast("string")
    slides = customer.withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select(F.concat(F.lit("/d/2021_0"), own, F.lit("-0"), F.col("n").cast("string"), F.lit(".mrxs")).alias("slide_path"))
    cases = customer.select(
        F.concat(F.lit(" 21/"), own).alias("Biopsy_No"), F.concat(F.lit("p"), own).alias("Patient_ID"), F.when(F.col("c_nationkey") > 10, "yes").alias("Cancer_in_case"),
        F.lit(1.2).alias("Cancer_in_slides"), F.lit("yes").alias("Perineural_invasion"), F.lit(1).alias("ISUP_grade_ group"), F.lit("3+3").alias("Gleason_score"),
    )
    sheets.write_sheets(cases, where)
    return labels.metadata_from_index(slides, sheets.read_sheets(spark, where, dict(cases.dtypes)))
