"""Every registered query against its SQL in DuckDB, and the form of the entry points."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from glasspane.plans import registry

D = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


def rows(frame: pd.DataFrame):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (float, np.floating)):
            return f"{float(v) + 0.0:.8g}"
        return str(v)

    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, D).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_corpus_part(tmp_path):
    """A copy of the library without glasspane/llm and corpus_pipeline.py still imports."""
    import shutil

    shutil.copytree(ROOT / "glasspane", tmp_path / "glasspane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'roc_auc' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(importlib.util.find_spec("glasspane.llm") is None, reason="the corpus part is not there")
def test_only_the_entry_point_knows_the_corpus_part():
    for path in (ROOT / "glasspane").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.QUERIES["tiles_to_confusion_metrics"](spark, D))
    scan = next(line for line in text.split("\n") if "ReadSchema" in line and "l_quantity" in line)
    assert "PushedFilters" in scan and "l_comment" not in scan and "l_shipdate" not in scan


#: Queries whose point is a Python function: remote calls, a matrix product a batch, a function of a bag,
#: arrays of pixels, arrays of counts, files of other programs.
PYTHON = {"slide_headers", "tiles_of_slide_files", "tensor_round_trip", "sheet_round_trip", "metadata_from_sheets", "enriched_rows", "wide_layer", "bag_medians", "cam_rasters", "bootstrap_ni", "ni_table"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - PYTHON))
def test_no_python_in_the_plans(spark, name):
    text = plan(registry.QUERIES[name](spark, D))
    assert "Python" not in text and "Pandas" not in text and "MapInArrow" not in text
