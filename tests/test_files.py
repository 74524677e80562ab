"""Slide headers, tensor files and spreadsheets: forms, ranges, hostile and damaged files, round trips."""

import io
import pickle
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glasspane.sources import headers, sheets, tensors

# slide headers


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("order", "<>")
def test_levels_of_a_pyramid(big, order):
    data = headers.pyramid(4096, 2048, 0.25, 4, big, order)
    got = list(headers.levels("a.tiff", io.BytesIO(data)))
    assert [r[1:6] for r in got] == [(i, 4096 >> i, 2048 >> i, 256, 256) for i in range(4)]
    assert [round(r[6], 4) for r in got] == [0.25, 0.5, 1.0, 2.0] and [r[8] for r in got] == [1, 2, 4, 8]


def test_only_headers_are_read():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    source = Counted(headers.pyramid(999, 777, 0.5, 3) + bytes(5_000_000))
    assert len(list(headers.levels("a.tif", source))) == 3 and source.taken < 2000


def test_damaged_headers_name_the_file():
    good = headers.pyramid(64, 64, 0.5, 2)
    circle = bytearray(good)
    at = struct.unpack_from("<I", good, 4)[0]
    (count,) = struct.unpack_from("<H", good, at)
    struct.pack_into("<I", circle, at + 2 + 12 * count, at)
    for data, why in ((b"", "not a TIFF"), (b"II*\0", "beyond the end"), (b"PK\3\4....", "not a TIFF"), (good[:40], "beyond the end"), (bytes(circle), "circle"), (struct.pack("<2sHI", b"II", 42, 0), "no image")):
        with pytest.raises(ValueError, match=f"b.tif: .*{why}"):
            list(headers.levels("b.tif", io.BytesIO(data)))


def test_headers_of_a_folder_and_the_nearest_level(spark, tmp_path):
    slides = [(f"s{i}", 3000 + i, 2000, 0.25 * (1 + i % 2), 1 + i % 5) for i in range(40)]
    headers.write_pyramids(spark.createDataFrame(slides, "id string, width int, height int, mpp double, levels int"), f"file://{tmp_path}/in")
    (tmp_path / "in" / "notes.txt").write_text("no slide")
    rows = headers.read_headers(spark, f"file://{tmp_path}/in")
    assert rows.count() == sum(s[4] for s in slides)
    found = {r.id: r for r in headers.slides_at(rows, 1.0, 256, 128).collect()}
    for name, width, height, mpp, count in slides:
        level = min(range(count), key=lambda i, m=mpp: (round(abs(np.log(m * 2**i)), 6), i))
        assert (found[name].level, found[name].extent_x, found[name].extent_y) == (level, width >> level, height >> level)
        assert found[name].mpp_x == pytest.approx(mpp * width / (width >> level), rel=1e-3)


def test_large_folders_are_few_tasks_and_large_trees_are_listed_by_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(headers, "FOLDER_FILES", 5)
    slides = spark.range(700).selectExpr("'s' || id AS id", "1000 width", "500 height", "CAST(0.5 AS DOUBLE) mpp", "1 levels")
    headers.write_pyramids(slides, f"{tmp_path}/in")
    assert len(list((tmp_path / "in").iterdir())) == 140
    reader = headers.HeaderReader({"path": f"{tmp_path}/in"})
    parts = reader.partitions()
    assert not any(p.paths for p in parts) and sum(len(p.folders) for p in parts) == 140
    assert len({r[0] for p in parts for r in reader.read(p)}) == 700
    monkeypatch.setattr(headers.HeaderReader, "WIDE", 1000)
    monkeypatch.setattr(headers.HeaderReader, "MOST", 7)
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [100] * 7 and len({r[0] for p in parts for r in reader.read(p)}) == 700


def test_many_folders_are_written_by_few_tasks_and_read_as_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(headers, "FOLDER_FILES", 5)
    monkeypatch.setattr(headers, "WRITERS", 8)
    slides = spark.range(700).selectExpr("'s' || id AS id", "1000 + CAST(id AS INT) AS width", "500 height", "CAST(0.5 AS DOUBLE) mpp", "2 levels")
    context = spark.sparkContext
    context.setJobGroup("pyramids", "")
    headers.write_pyramids(slides, f"{tmp_path}/in")
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("pyramids")]
    stages = [context.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) <= 16
    found = sorted((tmp_path / "in").glob("*/*.tiff"))
    assert len({f.parent for f in found}) > 100 and sorted(f.stem for f in found) == sorted(f"s{i}" for i in range(700))
    source = headers.SlideHeaders({"path": f"{tmp_path}/in"})
    reader = source.reader(None)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in batches) and sum(b.num_rows for b in batches) == 1400
    rows = headers.read_headers(spark, f"{tmp_path}/in")
    assert rows.dtypes == [tuple(f.split()) if f.split()[1] != "long" else (f.split()[0], "bigint") for f in headers.HEADER.split(", ")]
    assert {(r.width, r.level) for r in rows.collect()} == {((1000 + i) >> level, level) for i in range(700) for level in (0, 1)}


# tensor files


def test_tensors_round_trip_and_join_by_place(spark, tmp_path):
    g = np.random.default_rng(1)
    rows = [(f"s{i % 4}", i // 4 + 1, g.normal(size=6).astype("f4").tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "slide_id string, pos long, embedding array<float>").repartition(5)
    tensors.write_tensors(df, f"file://{tmp_path}/t")
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == [f"s{i}.pt" for i in range(4)]
    assert sorted(map(tuple, tensors.read_tensors(spark, f"{tmp_path}/t").collect())) == sorted(rows)


def test_large_tensors_are_read_in_ranges(spark, tmp_path, monkeypatch):
    values = np.arange(5000 * 3, dtype="f4").reshape(5000, 3)
    (tmp_path / "a.pt").write_bytes(tensors.tensor_bytes(values))
    (tmp_path / "b.pt").write_bytes(tensors.tensor_bytes(values[:7].astype("f8"), "DoubleStorage"))
    monkeypatch.setattr(tensors, "TASK_BYTES", 8000)
    reader = tensors.TensorReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) > 5
    got = [r for p in parts for r in reader.read(p)]
    assert [r[1] for r in got if r[0] == "a"] == list(range(1, 5001))
    assert np.array_equal(np.array([r[2] for r in got if r[0] == "a"]), values)
    assert np.array_equal(np.array([r[2] for r in got if r[0] == "b"]), values[:7])


def packed(description, name="x/data.pkl"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(name, description)
        archive.writestr("x/data/0", bytes(16))
    return out.getvalue()


class Hostile:
    def __reduce__(self):
        import os

        return os.system, ("touch /tmp/glasspane-was-here",)


def test_hostile_and_damaged_tensors_are_errors():
    whole = tensors.description(2, 2)
    cases = {
        "isn't part of a plain tensor": pickle.dumps(Hostile()),
        "holds no tensor": pickle.dumps([1, 2]),
        "truncated": whole[:-9],
        "underflow": b"\x80\x02K\x01R.",
        "damaged": b"\x80\x02ctorch._utils\n_rebuild_tensor_v2\n)R.",
        "not a whole tensor": whole.replace(tensors._number(2) + tensors._number(1) + b"\x86", tensors._number(1) + tensors._number(2) + b"\x86"),
    }
    for why, description in cases.items():
        with pytest.raises(ValueError, match=f"h.pt: .*{why}"):
            tensors.described("h.pt", zipfile.ZipFile(io.BytesIO(packed(description))))
    with pytest.raises(ValueError, match="not a tensor file"):
        tensors.described("h.pt", zipfile.ZipFile(io.BytesIO(packed(b"", "x/other"))))


def test_a_written_description_is_what_the_form_asks():
    calls = []

    class Seen(pickle.Unpickler):
        def find_class(self, module, name):
            return (lambda *a: calls.append((name, a)) or a) if name == "_rebuild_tensor_v2" else dict if name == "OrderedDict" else f"{module}.{name}"

        def persistent_load(self, found):
            return found

    Seen(io.BytesIO(tensors.description(300, 64))).load()
    assert calls == [("_rebuild_tensor_v2", (("storage", "torch.FloatStorage", "0", "cpu", 19200), 0, (300, 64), (64, 1), False, {}))]


def test_rows_of_unlike_length_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, [1.0, 2.0]), ("s", 2, [1.0])], "slide_id string, pos long, embedding array<float>")
    with pytest.raises(Exception, match="differ in length"):
        tensors.write_tensors(df, f"file://{tmp_path}/t")
    assert not [p for p in (tmp_path / "t").iterdir() if p.suffix == ".pt"]


# spreadsheets

ROWS = [(1, "a", 1.5, True, None), (2, "x & <y>", -0.25, False, "1,2"), (3, " kept  blanks ", 1e300, None, "é\n2\r\t"), (4, "a", 7.0, True, "")]
SCHEMA = "n bigint, name string, v double, ok boolean, items string"


def test_sheets_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    sheets.write_sheets(df.repartition(3), f"file://{tmp_path}/s")
    got = sheets.read_sheets(spark, f"file://{tmp_path}/s", dict(df.dtypes))
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect())) == ROWS
    part = sheets.read_sheets(spark, f"{tmp_path}/s", {"ok": "string", "n": "string"})
    assert sorted(map(tuple, part.collect()), key=str) == sorted([("true", "1"), ("false", "2"), (None, "3"), ("true", "4")], key=str)
    with pytest.raises(Exception, match="no column other in"):
        sheets.read_sheets(spark, f"{tmp_path}/s", {"other": "string"}).collect()


def book(sheet, strings=None, name="Cases"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for member, text in sheets._PARTS.items():
            archive.writestr(member, text.replace("Sheet1", name))
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{sheets.MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        if strings:
            archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets.MAIN}">{strings}</sst>')
    return out.getvalue()


def test_cells_as_other_programs_write_them():
    strings = "<si><t>Patient</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si><si><t/></si>"
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Slides</t></is></c></row><row r="2"/>'
        '<row r="5"><c r="A5" t="s"><v>1</v></c><c r="C5"><v>1.2</v></c></row><row r="6"><c r="C6"><f>1+2</f><v>3</v></c></row>'
        '<row r="7"><c r="A7" t="b"><v>1</v></c><c r="B7" t="e"><v>#N/A</v></c><c r="C7" t="str"><v>f</v></c><c r="AB7"><v>9</v></c></row><row><c t="s"><v>2</v></c><c><v>1E-5</v></c></row>'
    )
    rows = list(sheets.sheet_rows(zipfile.ZipFile(io.BytesIO(book(sheet, strings))), "Cases"))
    assert rows == [["Patient", None, "Slides"], ["two runs", None, "1.2"], [None, None, "3"], ["true", None, "f", *[None] * 24, "9"], ["", "1E-5"]]
    with pytest.raises(ValueError, match="no sheet 'Other' among"):
        list(sheets.sheet_rows(zipfile.ZipFile(io.BytesIO(book(sheet))), "Other"))


def test_damaged_sheets_name_the_file(tmp_path):
    for data in (b"no zip", book("<row><c"), book('<row><c t="s"><v>5</v></c></row>'), packed(b"")):
        (tmp_path / "d.xlsx").write_bytes(data)
        reader = sheets.SheetReader({"path": str(tmp_path)})
        with pytest.raises(ValueError, match="d.xlsx"):
            [r for p in reader.partitions() for r in reader.read(p)]


def test_full_sheets_go_on_in_another_file(tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 4)
    writer = sheets.SheetWriter({"path": str(tmp_path)}, ["a"])
    done = writer.write([(i,) for i in range(7)])
    writer.commit([done])
    reader = sheets.SheetReader({"path": str(tmp_path)})
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(int(r[3][0]) for r in got) == list(range(7)) and len({r[0] for r in got}) == 3
    assert [sheets.column_number(sheets.column_name(n)) for n in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]


def test_an_aborted_write_leaves_nothing(tmp_path):
    writer = sheets.SheetWriter({"path": str(tmp_path)}, ["a"])
    writer.abort([writer.write([(1,)]), None])
    assert list(tmp_path.iterdir()) == []
