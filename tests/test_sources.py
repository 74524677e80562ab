"""Files read and written, remote calls, streams."""

import json

import pytest
from pyspark.sql import functions as F

from glasspane.operators import joins
from glasspane.sources import tables
from glasspane.streaming.scores import running_slide_scores, windowed_slide_scores

XML = """<?xml version="1.0"?><Root><Annotations>
<Annotation Name="1" PartOfGroup="Carcinoma"><Coordinates><Coordinate Order="1" X="3.5" Y="4"/><Coordinate Order="0" X="1" Y="2"/></Coordinates></Annotation>
<Annotation Name="2" PartOfGroup="Exclude"><Coordinates><Coordinate Order="0" X="9" Y="9"/></Coordinates></Annotation>
</Annotations></Root>"""


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("/a,b.tiff", True, None), ("c", False, 2.0)], "slide_path string, carcinoma boolean, isup_grade double")
    tables.write_csv(df, f"{tmp_path}/m.csv")
    schema = "slide_path string, carcinoma boolean, isup_grade double"
    assert sorted(tables.read_csv(spark, f"{tmp_path}/m.csv", schema).collect()) == sorted(df.collect())
    assert tables.read_csv(spark, f"{tmp_path}/m.csv").count() == 2


def test_datasets_and_shards(spark, tmp_path):
    slides, tiles = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", i, 0) for i in range(100)], tables.TILES)
    tables.write_dataset(slides, tiles, f"{tmp_path}/d")
    a, b = tables.read_dataset(spark, f"{tmp_path}/d")
    assert a.count() == 1 and b.count() == 100 and tables.read_dataset(spark, "") == (None, None)
    tables.write_sharded(tiles.coalesce(1), f"{tmp_path}/s", max_rows=30)
    assert len(list((tmp_path / "s").glob("part-*"))) == 4
    tables.write_sharded(tiles.repartition(20), f"{tmp_path}/t", min_rows=40)
    assert len(list((tmp_path / "t").glob("part-*"))) == 2
    assert tables.read_all(spark, [f"{tmp_path}/s", f"{tmp_path}/t"]).count() == 200


def test_many_shards_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_FILES", 5)
    tables.write_sharded(spark.range(600).coalesce(1), f"{tmp_path}/s", max_rows=10)
    files = list((tmp_path / "s").glob("part-*"))
    assert len({f.name.split("-")[1] for f in files}) == 12
    assert all(spark.read.parquet(str(f)).count() <= 10 for f in files[:5])
    assert spark.read.parquet(f"{tmp_path}/s").distinct().count() == 600


def test_stored_positions(spark, tmp_path):
    spark.createDataFrame([("s", x) for x in (9, 3, 7)], "slide_id string, x int").coalesce(1).write.parquet(f"{tmp_path}/p")
    got = joins.stored_positions(spark.read.parquet(f"{tmp_path}/p"), "slide_id").orderBy("pos").collect()
    assert [r.x for r in got] == [9, 3, 7]


def test_json_split(spark, tmp_path):
    path = f"{tmp_path}/t.json"
    df = spark.createDataFrame([("a", 0.5, True), ("b", None, None)], "slide_name string, prediction double, target boolean")
    tables.write_json_split(df, path)
    (written,) = (tmp_path / "t.json").glob("part-*")
    assert set(json.loads(written.read_text())) == {"columns", "index", "data"}
    got = tables.read_json_split(spark, path, {"prediction": "double", "target": "boolean"})
    assert got.columns == df.columns and sorted(got.collect()) == sorted(df.collect())


def test_listing_and_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.txt").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in tables.list_files(spark, str(tmp_path), "*.xml").collect()] == ["a.xml"]
    rows = {r.part_of_group: r.vertices for r in tables.read_annotations(spark, f"{tmp_path}/a.xml").collect()}
    assert rows["Carcinoma"] == [(1.0, 2.0), (3.5, 4.0)] and len(rows) == 2
    assert tables.read_annotations(spark, f"{tmp_path}/a.xml", "Exclude").count() == 1
    (tmp_path / "c.xml").write_text(XML.replace(' PartOfGroup="Exclude"', ""))
    with pytest.raises(Exception, match="without PartOfGroup"):
        tables.read_annotations(spark, f"{tmp_path}/c.xml").collect()


def test_metrics_and_reports(spark, tmp_path):
    df = spark.createDataFrame([({"run_x_a.svs": 1.0, "b.svs": 0.0},)], "metrics map<string,double>")
    assert sorted(map(tuple, tables.metrics_as_rows(df, extra={"c": 1.0}).collect())) == [("a", 1.0), ("b", 0.0), ("c", 1.0)]
    (tmp_path / "1.csv").write_text("slide_name,x\na,1\n")
    (tmp_path / "2.csv").write_text("slide_name,y\nb,2\n")
    got = tables.read_quality_reports(spark, [f"{tmp_path}/1.csv", f"{tmp_path}/2.csv"])
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1, None), ("b", None, 2)]


def test_remote_calls(spark, tmp_path):
    folder = str(tmp_path)

    def call(name):
        import os

        if name == "late":
            raise TimeoutError("too long")
        if name == "odd":
            raise KeyError("odd")
        if name == "twice":
            mark = os.path.join(folder, name)
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("500")
        if name == "never":
            raise RuntimeError("500 always")
        return name.upper()

    df = spark.createDataFrame([(n,) for n in ("a", "late", "odd", "twice", "never")], "name string").coalesce(1)
    got = {r.name: (r.result, r.error) for r in tables.enriched(df, "name", call, attempts=3, wait=lambda s: None).collect()}
    assert got["a"] == ("A", None) and got["twice"] == ("TWICE", None)
    assert got["late"] == (None, "timeout: too long") and got["never"] == (None, "500 always") and "KeyError" in got["odd"][1]


def test_organised(spark):
    df = spark.createDataFrame([("/x/blur_1.tiff",), ("/x/blur_fold_2.tiff",), ("/x/other",)], "path string")
    got = dict(map(tuple, tables.organised(df, {"blur_": "b", "blur_fold_": "f"}).collect()))
    assert got == {"/x/blur_1.tiff": "b/blur_1.tiff", "/x/blur_fold_2.tiff": "f/blur_fold_2.tiff"}


def test_streams_equal_batches(spark, tmp_path):
    schema = "slide_id string, prediction double, ts timestamp"
    for i, rows in enumerate([[("a", 0.2, 0), ("b", 0.9, 10)], [("a", 0.8, 3600), ("a", float("nan"), 7200)]]):
        spark.createDataFrame(rows, "slide_id string, prediction double, s int").select("slide_id", "prediction", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    both = spark.read.schema(schema).parquet(f"{tmp_path}/in0", f"{tmp_path}/in1")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in*")
    for name, make, mode in (("running", lambda df: running_slide_scores(df, 0.5), "complete"), ("windowed", lambda df: windowed_slide_scores(df, "ts", "1 hour", "10 minutes"), "complete")):
        query = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(tuple, spark.sql(f"SELECT * FROM {name}").collect()), key=str) == sorted(map(tuple, make(both).collect()), key=str)
