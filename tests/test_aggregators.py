"""Scores that grow over batches against the batch operators, for any split of the tiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.operators import grid
from glasspane.streaming import aggregators as a

NAN = float("nan")
SCHEMA = "slide_id long, x int, y int, score double"


def made(seed, n=120):
    g = random.Random(seed)
    rows = [(g.randint(0, 2), g.randint(-2, 9), g.randint(0, 6), g.choice([g.random(), 0.5, 0.9])) for _ in range(n)]
    return rows + [(0, 1, 1, None), (7, 1, 1, NAN), (8, 3, 3, 0.6)]


def values(df):
    return {tuple(r[:-1]): round(r[-1], 9) if isinstance(r[-1], float) else r[-1] for r in df.collect()}


def told(spark, tmp_path, batches, extent, stride, top=3):
    where = str(tmp_path)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{where}/in/batch={n}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{where}/in/*")
    return a.run_to_the_end(a.band_scores(stream, extent, stride, 0.5, top), f"{where}/out", f"{where}/checkpoint")


@pytest.mark.parametrize("cuts", [[], [40], [5, 6, 100]])
def test_any_split_gives_the_batch_scores(spark, tmp_path, monkeypatch, cuts):
    monkeypatch.setattr(a, "BAND", 1 + 3 * len(cuts))
    rows = made(len(cuts))
    random.Random(4).shuffle(rows)
    batches = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    lines = told(spark, tmp_path, batches, 2, 1)
    last = a.last_told(lines).cache()
    cells = grid.heatmap(spark.createDataFrame(rows, SCHEMA), 2, 1).cache()
    assert values(a.cells_so_far(last)) == values(cells)
    assert values(a.span_scores(last, 3)) == values(grid.slide_span(cells, 3, 0.5))
    assert values(a.top_scores(last, 3)) == values(grid.slide_top_k(cells, 1, 3))
    assert values(grid.slide_mean_pool_max(a.cells_so_far(last), 2)) == values(grid.slide_mean_pool_max(cells, 2))
    versions = lines.groupBy("slide_id", "axis", "band").count().agg({"count": "max"}).first()[0]
    assert versions <= len(batches)


def test_a_later_run_goes_on_where_the_first_stopped(spark, tmp_path):
    rows = made(9)
    told(spark, tmp_path, [rows[:50]], 1, 1)
    spark.createDataFrame(rows[50:], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/batch=9")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    lines = a.run_to_the_end(a.band_scores(stream, 1, 1, 0.5, 3), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    cells = grid.heatmap(spark.createDataFrame(rows, SCHEMA), 1, 1)
    assert values(a.cells_so_far(a.last_told(lines))) == values(cells)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != a.STORE


def test_merging_is_the_same_in_any_order():
    g = np.random.default_rng(2)
    parts = [(np.unique(g.integers(0, 20, 8)),) for _ in range(3)]
    parts = [(p, g.random(len(p)), g.integers(1, 5, len(p))) for (p,) in parts]
    left, right = a.merged(a.merged(*parts[:2]), parts[2]), a.merged(parts[0], a.merged(*parts[:0:-1]))
    assert all(np.allclose(x, y) for x, y in zip(left, right, strict=True))


def test_runs():
    assert [a.longest_run(np.array(p, int)) for p in ([], [4], [1, 2, 3, 5, 6], [0, 2, 4], [-2, -1, 0, 1])] == [0, 1, 3, 1, 4]


def test_no_python_runs_for_a_key(spark, tmp_path):
    spark.createDataFrame(made(1), SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for rows in (stream, spark.read.parquet(f"{tmp_path}/in")):
        text = a.band_scores(rows, 1, 1, 0.5, 3)._jdf.queryExecution().analyzed().toString()
        assert "Aggregate" in text and "Python" not in text and "PySpark" not in text and "Pandas" not in text


def test_runs_of_arrays_are_those_of_the_model(spark):
    g = random.Random(3)
    arrays = [[], [4], [1, 2, 3, 5, 6], [0, 2, 4], [-2, -1, 0, 1]] + [sorted(g.sample(range(-20, 20), g.randint(0, 30))) for _ in range(40)]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(arrays)], "i int, p array<long>").select("i", a.run_length(F.col("p"))).collect()
    assert dict(map(tuple, got)) == {i: a.longest_run(np.array(p, int)) for i, p in enumerate(arrays)}


def test_the_bands_of_a_batch_and_of_an_empty_stream(spark, tmp_path):
    rows = spark.createDataFrame(made(2), SCHEMA)
    last, cells = a.last_told(a.band_scores(rows, 2, 1, 0.5, 3)), grid.heatmap(rows, 2, 1)
    assert values(a.cells_so_far(last)) == values(cells)
    assert values(a.span_scores(last, 3)) == values(grid.slide_span(cells, 3, 0.5)) and values(a.top_scores(last, 3)) == values(grid.slide_top_k(cells, 1, 3))
    (tmp_path / "in").mkdir()
    lines = a.run_to_the_end(a.band_scores(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 1, 1, 0.5, 3), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert a.last_told(lines).count() == 0


def test_of_a_cell_the_last_that_was_told_counts(spark, tmp_path):
    """Cells that a later batch doesn't touch keep what an earlier one told, however many tiles it adds beside them."""
    rows = [(1, 0, y, 0.9) for y in range(20)]
    lines = told(spark, tmp_path, [rows, [(1, 0, 3, 0.0), (1, 0, 18, 0.0), (1, 5, 3, 1.0)], [(1, 0, 3, 0.9)]], 1, 1)
    got = a.last_told(lines)
    assert {(r.axis, r.band): r.longest for r in got.collect()} == {("row", 0): 1, ("row", 1): 1, ("column", 0): 18}
    assert values(a.cells_so_far(got))[(1, 0, 3)] == 0.6 and values(a.top_scores(got, 3)) == {(1,): round(2.8 / 3, 9)}
    assert values(a.span_scores(got, 18)) == {(1,): True} and values(a.span_scores(got, 19)) == {(1,): False}
