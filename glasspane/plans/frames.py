"""The generic tables in the roles of slides, tiles, scores and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as tiles of slides: quantity is tissue, tax blur, discount residue."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("x"), F.col("l_suppkey").alias("y"),
        (F.col("l_quantity") / 50.0).alias("tissue_roi_percentage"), (F.col("l_tax") * 10.0).alias("blur_percentage"),
        (F.col("l_discount") * 10.0).alias("residual_percentage"), (F.col("l_extendedprice") / 100000.0).alias("carcinoma_roi_percentage"),
    )


TILES_SQL = """SELECT l_orderkey AS slide_id, l_linenumber AS x, l_suppkey AS y, l_quantity / CAST(50 AS DOUBLE) AS tissue_roi_percentage,
 l_tax * CAST(10 AS DOUBLE) AS blur_percentage, l_discount * CAST(10 AS DOUBLE) AS residual_percentage,
 l_extendedprice / CAST(100000 AS DOUBLE) AS carcinoma_roi_percentage FROM lineitem"""

THRESHOLDS = {"tissue_roi_t": 0.5, "blur_t": 0.25, "residual_t": 0.25}
FILTER_SQL = "tissue_roi_percentage > CAST(0.5 AS DOUBLE) AND blur_percentage <= CAST(0.25 AS DOUBLE) AND residual_percentage <= CAST(0.25 AS DOUBLE)"


def scored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored tiles: a user is a slide, the day x and the hour y."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("slide_id"), F.dayofmonth("ts").alias("x"), F.hour("ts").alias("y"), (F.col("value") / 500.0).alias("score"))


SCORED_SQL = "SELECT user_id AS slide_id, CAST(day(ts) AS INT) AS x, CAST(hour(ts) AS INT) AS y, value / CAST(500 AS DOUBLE) AS score FROM events"
CELLS_SQL = f"SELECT slide_id, x AS gx, y AS gy, avg(score) AS score FROM ({SCORED_SQL}) GROUP BY 1, 2, 3"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as predictions: the length is the score, quality the target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


LABELLED_SQL = "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)"
COUNTS_SQL = f"""s AS (SELECT CAST(n_chars AS DOUBLE) AS threshold, CAST(sum(quality) AS BIGINT) AS tp, CAST(sum(1 - quality) AS BIGINT) AS fp FROM ({LABELLED_SQL}) GROUP BY 1),
c AS (SELECT threshold, tp, fp, CAST(sum(tp) OVER (ORDER BY threshold DESC) AS DOUBLE) AS ctp, CAST(sum(fp) OVER (ORDER BY threshold DESC) AS DOUBLE) AS cfp,
 CAST(sum(tp) OVER () AS DOUBLE) AS p, CAST(sum(fp) OVER () AS DOUBLE) AS n FROM s)"""


def digits(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})
