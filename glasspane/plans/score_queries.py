"""Slide scores from tile scores and embeddings, their sweeps and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasspane.functions import vectors
from glasspane.operators import attention, grid, joins, rasters
from glasspane.plans.frames import CELLS_SQL, SCORED_SQL, digits, scored_tiles, table
from glasspane.plans.registry import query
from glasspane.sources.scratch import shared_dir
from glasspane.streaming import aggregators
from glasspane.streaming.scores import running_slide_scores, windowed_slide_scores

#: Weights of a small example head over 64 inputs.
ATTENTION = [((i * 7) % 11 - 5) / 10 for i in range(64)], 0.1
CLASSIFIER = [((i * 5) % 13 - 6) / 10 for i in range(64)], -0.2
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * {w}))"


def _sql_dot(shift: int, modulus: int, centre: int, bias: float) -> str:
    return _DOT.format(w=f"(((i - 1) * {shift}) % {modulus} - {centre}) / CAST(10 AS DOUBLE)") + f" + CAST({bias} AS DOUBLE)"


A_SQL, C_SQL = _sql_dot(7, 11, 5, 0.1), _sql_dot(5, 13, 6, -0.2)
POOLED_SQL = f"""cells AS ({CELLS_SQL}),
ends AS (SELECT slide_id, min(gx) AS lx, greatest(max(gx) - 1, min(gx)) AS hx, min(gy) AS ly, greatest(max(gy) - 1, min(gy)) AS hy FROM cells GROUP BY 1),
pooled AS (SELECT c.slide_id, gx - dx AS wx, gy - dy AS wy, sum(score) / CAST(4 AS DOUBLE) AS score FROM cells c JOIN ends e USING (slide_id), (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)
 WHERE gx - dx BETWEEN lx AND hx AND gy - dy BETWEEN ly AND hy GROUP BY 1, 2, 3)"""


def _cells(spark, sf_dir):
    return grid.heatmap(scored_tiles(spark, sf_dir), extent=1, stride=1)


@query(f"SELECT slide_id, round(max(score), 9) AS prediction FROM ({CELLS_SQL}) GROUP BY 1")
def max_score(spark, sf_dir):
    return digits(grid.slide_max(_cells(spark, sf_dir)), "prediction", n=9)


@query(f"SELECT c_custkey AS slide_id, coalesce(n, 0) AS num_positive FROM customer LEFT JOIN (SELECT slide_id, count(*) FILTER (score > CAST(0.5 AS DOUBLE)) AS n FROM ({SCORED_SQL}) GROUP BY 1) ON slide_id = c_custkey")
def num_positive(spark, sf_dir):
    slides = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return grid.num_positive(scored_tiles(spark, sf_dir), slides, 0.5, "score")


@query(f"WITH {POOLED_SQL} SELECT slide_id, round(max(score), 9) AS prediction FROM pooled GROUP BY 1")
def mean_pool_max(spark, sf_dir):
    return digits(grid.slide_mean_pool_max(_cells(spark, sf_dir), 2), "prediction", n=9)


@query(f"""WITH {POOLED_SQL}, r AS (SELECT slide_id, score, row_number() OVER (PARTITION BY slide_id ORDER BY score DESC, wx, wy) AS n FROM pooled)
SELECT slide_id, round(avg(score), 6) AS prediction FROM r WHERE n <= 3 GROUP BY 1""")
def topk_mean(spark, sf_dir):
    return digits(grid.slide_top_k(_cells(spark, sf_dir), 2, 3), "prediction")


@query(f"""WITH cells AS ({CELLS_SQL}),
r AS (SELECT slide_id, (min(score) OVER a >= CAST(0.05 AS DOUBLE) AND count(*) OVER a = 3) OR (min(score) OVER b >= CAST(0.05 AS DOUBLE) AND count(*) OVER b = 3) AS hit FROM cells
 WINDOW a AS (PARTITION BY slide_id, gy ORDER BY gx RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS (PARTITION BY slide_id, gx ORDER BY gy RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT slide_id, bool_or(hit) AS prediction FROM r GROUP BY 1""")
def span_any(spark, sf_dir):
    return grid.slide_span(_cells(spark, sf_dir), 3, 0.05)


#: Kernels and counts that the published sweeps try.
KERNELS, TOP_KERNELS, TOPS, RUNS = [1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5], [2, 3, 4], [2, 3, 4, 5]
_SWEEP_SQL = f"""WITH cells AS ({CELLS_SQL}), ker AS (SELECT unnest({KERNELS}) AS ks),
ends AS (SELECT slide_id, ks, min(gx) AS lx, greatest(max(gx) - ks + 1, min(gx)) AS hx, min(gy) AS ly, greatest(max(gy) - ks + 1, min(gy)) AS hy FROM cells, ker GROUP BY 1, 2),
pooled AS (SELECT slide_id, ks AS kernel_size, gx - dx AS wx, gy - dy AS wy, sum(score) / CAST(ks * ks AS DOUBLE) AS score FROM cells JOIN ends USING (slide_id), range(0, 7) a(dx), range(0, 7) b(dy)
 WHERE dx < ks AND dy < ks AND gx - dx BETWEEN lx AND hx AND gy - dy BETWEEN ly AND hy GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY slide_id, kernel_size ORDER BY score DESC, wx, wy) AS n FROM pooled)"""


@query(_SWEEP_SQL + f" SELECT slide_id, kernel_size, k, round(avg(score), 12) AS prediction FROM r, (SELECT unnest({TOPS}) AS k) WHERE kernel_size <= 5 AND n <= k GROUP BY 1, 2, 3")
def sweep_topk_long(spark, sf_dir):
    return digits(grid.sweep_top_k(_cells(spark, sf_dir), TOP_KERNELS, TOPS), "prediction", n=12)


@query(_SWEEP_SQL + " SELECT slide_id, " + ", ".join(f'round(avg(score) FILTER (kernel_size = {a} AND n <= {b}), 12) AS "pred_kernel_size={a}_k={b}"' for a in TOP_KERNELS for b in TOPS) + " FROM r GROUP BY 1")
def sweep_topk_wide(spark, sf_dir):
    long = digits(grid.sweep_top_k(_cells(spark, sf_dir), TOP_KERNELS, TOPS), "prediction", n=12)
    return grid.sweep_wide(long, ["kernel_size", "k"], [f"pred_kernel_size={a}_k={b}" for a in TOP_KERNELS for b in TOPS])


@query(_SWEEP_SQL + " SELECT slide_id, kernel_size, round(max(score), 9) AS prediction FROM pooled GROUP BY 1, 2")
def sweep_mean_pool_max(spark, sf_dir):
    return digits(grid.sweep_mean_pool_max(_cells(spark, sf_dir), KERNELS), "prediction", n=9)


@query(f"""WITH cells AS ({CELLS_SQL}), k AS (SELECT unnest({RUNS}) AS k),
a AS (SELECT x.slide_id, k, min(y.score) AS least FROM cells x, k JOIN cells y ON y.slide_id = x.slide_id AND y.gy = x.gy AND y.gx BETWEEN x.gx AND x.gx + k - 1 GROUP BY x.slide_id, x.gx, x.gy, k HAVING count(*) = k),
b AS (SELECT x.slide_id, k, min(y.score) AS least FROM cells x, k JOIN cells y ON y.slide_id = x.slide_id AND y.gx = x.gx AND y.gy BETWEEN x.gy AND x.gy + k - 1 GROUP BY x.slide_id, x.gx, x.gy, k HAVING count(*) = k),
m AS (SELECT slide_id, k, max(least) AS best FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT s.slide_id, k.k, threshold, coalesce(best >= threshold, false) AS prediction FROM (SELECT DISTINCT slide_id FROM cells) s CROSS JOIN k CROSS JOIN (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.3 AS DOUBLE))) t(threshold) LEFT JOIN m ON m.slide_id = s.slide_id AND m.k = k.k""")
def sweep_span(spark, sf_dir):
    return grid.sweep_span(_cells(spark, sf_dir), RUNS, [0.05, 0.3])


@query("SELECT CAST(kernel_size AS BIGINT) AS kernel_size, CAST(k AS BIGINT) AS k, 'kernel_size=' || kernel_size || '_k=' || k AS key FROM (VALUES (1), (2)) a(kernel_size), (VALUES (1), (3), (5)) b(k)")
def parameter_grid(spark, sf_dir):
    return joins.parameter_grid(spark, {"kernel_size": [1, 2], "k": [1, 3, 5]})


@query(f"SELECT vec_id, round(1 / (1 + exp(-({C_SQL}))), 6) AS prediction FROM embeddings")
def linear_score(spark, sf_dir):
    return digits(attention.linear_scores(table(spark, sf_dir, "embeddings"), *CLASSIFIER).select("vec_id", "prediction"), "prediction")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: abs(CAST(x AS DOUBLE)) > CAST(0.000001 AS DOUBLE))) > 0 AS present FROM embeddings")
def pad_mask(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.present(F.col("embedding")).alias("present"))


@query(f"""WITH e AS (SELECT label, {A_SQL} AS a, {C_SQL} AS c FROM embeddings), m AS (SELECT label, max(a) AS m FROM e GROUP BY 1),
s AS (SELECT label, count(*) AS n, sum(exp(a - m) * c) / sum(exp(a - m)) AS logit FROM e JOIN m USING (label) GROUP BY 1)
SELECT label, n, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS prediction FROM s""")
def attention_mil(spark, sf_dir):
    return digits(attention.bag_scores(table(spark, sf_dir, "embeddings"), "label", ATTENTION, CLASSIFIER), "logit", "prediction")


@query(f"""WITH e AS (SELECT vec_id, label, {A_SQL} AS a, {C_SQL} AS c FROM embeddings), m AS (SELECT label, max(a) AS m FROM e GROUP BY 1), z AS (SELECT label, sum(exp(a - m)) AS z FROM e JOIN m USING (label) GROUP BY 1)
SELECT vec_id, label, round(c, 6) AS logit, round(exp(a - m) / z, 6) AS weight FROM e JOIN m USING (label) JOIN z USING (label)""")
def attention_weights(spark, sf_dir):
    found = attention.attended(table(spark, sf_dir, "embeddings"), "label", ATTENTION, CLASSIFIER)
    return digits(found.select("vec_id", "label", "logit", "weight"), "logit", "weight")


@query("""WITH m AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT event_id, round((value - lo) / nullif(hi - lo, 0), 6) AS scaled FROM events JOIN m USING (user_id)""")
def minmax_norm(spark, sf_dir):
    found = attention.min_max(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", ["user_id"], "scaled")
    return digits(found.select("event_id", "scaled"), "scaled")


@query("""WITH v AS (SELECT event_id, user_id, value / CAST(500 AS DOUBLE) AS v FROM events), m AS (SELECT user_id, max(v) AS m FROM v GROUP BY 1), z AS (SELECT user_id, sum(exp(v - m)) AS z FROM v JOIN m USING (user_id) GROUP BY 1)
SELECT event_id, round(exp(v - m) / z, 9) AS weight FROM v JOIN m USING (user_id) JOIN z USING (user_id)""")
def softmax_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 500.0).alias("v"))
    return digits(attention.softmax(rows, "v", ["user_id"]).select("event_id", "weight"), "weight", n=9)


@query("""WITH e AS (SELECT user_id, value / CAST(500 AS DOUBLE) AS z, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS t, value > 100 AS m FROM events),
l AS (SELECT user_id, m, (1 - t) * z + (1 + CAST(8.65 AS DOUBLE) * t) * (ln(1 + exp(-abs(z))) + greatest(-z, 0)) AS loss FROM e),
b AS (SELECT user_id, sum(CASE WHEN m THEN loss ELSE 0 END) / greatest(count(*) FILTER (m), 1) AS x FROM l GROUP BY 1) SELECT round(avg(x), 6) AS loss FROM b""")
def masked_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", vectors.bce_with_logits(F.col("value") / 500.0, F.when(F.col("event_type") == "purchase", 1).otherwise(0), 9.65).alias("loss"), (F.col("value") > 100).alias("m"))
    return digits(attention.masked_bag_loss(rows, "user_id", "loss", "m"), "loss")


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS cls, round(list_sum(list_transform(embedding[6:64], lambda x: CAST(x AS DOUBLE))) / 59, 6) AS rest, round(CAST(embedding[1] AS DOUBLE), 6) AS first_token,
 round((CAST(embedding[1] AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(0.25 AS DOUBLE), 6) AS red, round((CAST(embedding[2] AS DOUBLE) + CAST(1 AS DOUBLE)) / CAST(2 AS DOUBLE), 6) AS green FROM embeddings""")
def token_and_channels(spark, sf_dir):
    """Numbers of an embedding as tokens of one: the first with the mean from the sixth on; and as
    channels, normalised."""
    vec = table(spark, sf_dir, "embeddings")
    tokens = F.transform("embedding", lambda x: F.array(x.cast("double")))
    both, scaled = vectors.cls_and_mean(tokens), vectors.normalised(F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")), [0.5, -1.0], [0.25, 2.0])
    found = vec.select("vec_id", both[0].alias("cls"), both[1].alias("rest"), vectors.cls_token(tokens)[0].alias("first_token"), scaled[0].alias("red"), scaled[1].alias("green"))
    return digits(found, "cls", "rest", "first_token", "red", "green")


@query(f"SELECT x, y, CAST(floor(255 / (1 + exp(-sum(score) / count(*)))) AS INT) AS pixel FROM ({SCORED_SQL}) GROUP BY 1, 2")
def cam_pixels(spark, sf_dir):
    return scored_tiles(spark, sf_dir).groupBy("x", "y").agg(vectors.cam_pixel(F.sum("score"), F.count("*")).alias("pixel"))


@query("""WITH t AS (SELECT label AS slide_id, (vec_id * 3) % 40 AS x, (vec_id * 5) % 24 AS y, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT slide_id, CAST(x + i % 8 AS INT) AS px, CAST(y + i // 8 AS INT) AS py, avg(CAST(v AS DOUBLE)) AS mean, CAST(count(*) AS INT) AS n FROM t GROUP BY 1, 2, 3)
SELECT slide_id, px, py, round(mean, 9) AS mean, n, CAST(floor(255 / (1 + exp(-mean))) AS INT) AS pixels FROM p""")
def cam_rasters(spark, sf_dir):
    """Embeddings as activation maps of 8 x 8 pixels, added up where they overlap on their slide."""
    tiles = table(spark, sf_dir, "embeddings").select(F.col("label").alias("slide_id"), (F.col("vec_id") * 3 % 40).alias("x"), (F.col("vec_id") * 5 % 24).alias("y"), F.col("embedding").alias("values"))
    blocks = rasters.grey(rasters.raster_blocks(tiles, 8, 8, 16))
    return digits(rasters.block_pixels(blocks, 16), "mean", n=9)


@query(f"SELECT slide_id, max(score) AS prediction, count(*) FILTER (score > CAST(0.5 AS DOUBLE)) AS num_positive, count(*) AS n_tiles FROM ({SCORED_SQL}) GROUP BY 1")
def running_scores(spark, sf_dir):
    return running_slide_scores(scored_tiles(spark, sf_dir), 0.5, "score")


@query("SELECT date_trunc('day', ts) AS window_start, user_id AS slide_id, max(value) AS prediction, count(*) AS n_tiles FROM events GROUP BY 1, 2")
def windowed_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("slide_id"), "ts", F.col("value").alias("prediction"))
    return windowed_slide_scores(rows, "ts", "1 day", "1 hour")


@query(f"""WITH {POOLED_SQL}, t AS (SELECT slide_id, score, row_number() OVER (PARTITION BY slide_id ORDER BY score DESC, gx, gy) AS n FROM cells),
r AS (SELECT slide_id, (min(score) OVER a >= CAST(0.05 AS DOUBLE) AND count(*) OVER a = 3) OR (min(score) OVER b >= CAST(0.05 AS DOUBLE) AND count(*) OVER b = 3) AS hit FROM cells
 WINDOW a AS (PARTITION BY slide_id, gy ORDER BY gx RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS (PARTITION BY slide_id, gx ORDER BY gy RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT slide_id, span, round(top, 9) AS top, round(largest, 9) AS largest FROM (SELECT slide_id, bool_or(hit) AS span FROM r GROUP BY 1) JOIN (SELECT slide_id, avg(score) AS top FROM t WHERE n <= 3 GROUP BY 1) USING (slide_id)
JOIN (SELECT slide_id, max(score) AS largest FROM pooled GROUP BY 1) USING (slide_id)""")
def incremental_scores(spark, sf_dir):
    """Events as a stream of three batches; the scores of slides from what the batches told of their bands."""
    where = shared_dir(spark)
    rows = scored_tiles(spark, sf_dir)
    files = spark.sparkContext.defaultParallelism
    rows.repartitionById(3 * files, F.pmod(F.hash("slide_id", "x", "y", "score"), F.lit(3 * files))).write.parquet(f"{where}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{where}/in")
    told = aggregators.run_to_the_end(aggregators.band_scores(stream, 1, 1, 0.05, 3), f"{where}/out", f"{where}/checkpoint")
    aggregators.last_told(told).write.parquet(f"{where}/last")
    last = spark.read.parquet(f"{where}/last")
    span = aggregators.span_scores(last, 3).withColumnRenamed("prediction", "span")
    top = aggregators.top_scores(last, 3).withColumnRenamed("prediction", "top")
    largest = grid.slide_mean_pool_max(aggregators.cells_so_far(last), 2).withColumnRenamed("prediction", "largest")
    return digits(span.join(top, "slide_id").join(largest, "slide_id"), "top", "largest", n=9)
