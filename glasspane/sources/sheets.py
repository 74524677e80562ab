"""Spreadsheets: tables in the zipped sheet form, read as a stream of rows and written likewise.

A file's shared strings are read once, its rows as XML events, one at a time. Numbers come as the text
that the file has for them, so that a list of slides that was typed as 1.2 is still `1.2` and 3 isn't
`3.0`; Spark casts them where the schema says so. Cells that a row lacks, and error values, are null; true and
false are `true` and `false`; dates are the numbers that the form keeps for them. The first row names the columns.
Characters that XML has no form for are left out when a text is written.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree.ElementTree import Element, ParseError, iterparse
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from glasspane.sources.files import FileReader, FileWriter, Written, load, registered

#: Fixed values of the form: its names, and the rows that a sheet can have.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


_RETURN = {"\r": "&#13;"}


def _children(element: Element, name: str) -> Iterator[Element]:
    return element.iter(f"{{{MAIN}}}{name}")


def _text(element: Element) -> str:
    """The text of a string: its runs one after another, without phonetic hints."""
    hints = {t for hint in _children(element, "rPh") for t in _children(hint, "t")}
    return "".join(t.text or "" for t in _children(element, "t") if t not in hints)


def _events(source: BinaryIO, name: str) -> Iterator[Element]:
    """Elements of a name, each freed once it has been used."""
    events = iterparse(source, ("start", "end"))
    _, root = next(events)
    for event, element in events:
        if event == "end" and element.tag == f"{{{MAIN}}}{name}":
            yield element
            element.clear()
            root.clear()


def shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    with archive.open("xl/sharedStrings.xml") as source:
        return [_text(e) for e in _events(source, "si")]


def sheet_member(archive: zipfile.ZipFile, sheet: str | None) -> str:
    """The member of a sheet by its name; without one the first."""
    with archive.open("xl/workbook.xml") as source:
        sheets = [(e.get("name"), e.get(f"{{{OFFICE}}}id")) for _, e in iterparse(source) if e.tag == f"{{{MAIN}}}sheet"]
    found = next((i for n, i in sheets if sheet is None or n == sheet), None)
    if found is None:
        raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")
    with archive.open("xl/_rels/workbook.xml.rels") as source:
        targets = {e.get("Id"): e.get("Target") for _, e in iterparse(source) if e.get("Id")}
    return targets[found].lstrip("/") if targets[found].startswith("/") else f"xl/{targets[found]}"


def column_number(reference: str) -> int:
    """A is 0, Z 25, AA 26."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(n: int) -> str:
    name = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def _value(cell: Element, strings: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{{{MAIN}}}v")
    if kind == "inlineStr":
        return _text(cell)
    if value is None or value.text is None or kind == "e":
        return "" if kind == "str" else None
    if kind == "s":
        return strings[int(value.text)]
    return ("true" if value.text == "1" else "false") if kind == "b" else value.text


def sheet_rows(archive: zipfile.ZipFile, sheet: str | None) -> Iterator[list[str | None]]:
    """The rows of a sheet that have cells, as wide as their last one."""
    strings = shared_strings(archive)
    with archive.open(sheet_member(archive, sheet)) as source:
        for row in _events(source, "row"):
            values: list[str | None] = []
            for cell in _children(row, "c"):
                at = column_number(cell.get("r", "")) if cell.get("r") else len(values)
                values += [None] * (at + 1 - len(values))
                values[at] = _value(cell, strings)
            if values:
                yield values


class SheetReader(FileReader):
    PATTERN = "*.xlsx"

    def rows_of(self, path: str, source: BinaryIO) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(source) as archive:
                rows = sheet_rows(archive, self.sheet)
                head = next(rows, [])
                for n, row in enumerate(rows):
                    yield path, n, head, row + [None] * (len(head) - len(row))
        except (zipfile.BadZipFile, KeyError, IndexError, ParseError, ValueError) as error:
            raise ValueError(f"{path}: {error}") from error

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.sheet = options.get("sheet")


class SheetWriter(FileWriter):
    """A task's rows as one file, or as several where a sheet is full."""

    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        super().__init__(options)
        self.names = names

    def write(self, iterator) -> Written:
        store, root = self.begun()
        done: list[tuple[str, str]] = []
        rows = iter(iterator)
        row = next(rows, None)
        while row is not None:
            name = uuid.uuid4().hex
            done.append((f"{root}/.{name}", f"{root}/part-{name}.xlsx"))
            with store.open_output_stream(done[-1][0]) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                strings: dict[str, int] = {}
                with archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>{self._row(1, self.names, strings)}'.encode())
                    n = 1
                    while row is not None and n < MOST_ROWS:
                        n += 1
                        sheet.write(self._row(n, row, strings).encode())
                        row = next(rows, None)
                    sheet.write(b"</sheetData></worksheet>")
                with archive.open("xl/sharedStrings.xml", "w", force_zip64=True) as shared:
                    shared.write(f'<?xml version="1.0" encoding="UTF-8"?><sst xmlns="{MAIN}">'.encode())
                    for s in strings:
                        shared.write(f'<si><t xml:space="preserve">{escape(_CONTROL.sub("", s), _RETURN)}</t></si>'.encode())
                    shared.write(b"</sst>")
                for member, text in _PARTS.items():
                    archive.writestr(member, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        return Written(done)

    def _row(self, n: int, values, strings: dict[str, int]) -> str:
        cells = []
        for i, v in enumerate(values):
            at = f"{column_name(i)}{n}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)) and abs(v) < float("inf"):
                cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
            else:
                cells.append(f'<c r="{at}" t="s"><v>{strings.setdefault(str(v), len(strings))}</v></c>')
        return f'<row r="{n}">{"".join(cells)}</row>'


_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>'
    f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{_TYPE}.sharedStrings+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{OFFICE}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
}


class Sheets(DataSource):
    """format("sheets"): options path, pattern of names, and sheet (its name)."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> StructType:
        texts = ArrayType(StringType())
        return StructType([StructField("path", StringType()), StructField("row", StringType()), StructField("names", texts), StructField("cells", texts)])

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options)

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options, schema.names)


def read_sheets(spark: SparkSession, path: str, columns: dict[str, str], pattern: str = "*.xlsx", sheet: str | None = None) -> DataFrame:
    """The named columns, cast to their types (string keeps a number's own text); files may have them in
    any order. A column that a file lacks raises when its rows are read."""
    options = {"pattern": pattern} | ({"sheet": sheet} if sheet is not None else {})
    rows = load(spark, Sheets, path, **options)

    def cell(name: str, kind: str):
        at = F.array_position("names", name)
        text = F.when(at > 0, F.try_element_at("cells", at.cast("int"))).otherwise(F.raise_error(F.concat(F.lit(f"no column {name} in "), F.col("path"))).cast("string"))
        # whole numbers may be written as 3.0
        whole = F.regexp_replace(text, r"\.0+$", "") if kind in ("int", "bigint", "long", "smallint", "tinyint") else text
        return whole.cast(kind).alias(name)

    return rows.select(*(cell(n, k) for n, k in columns.items()))


def write_sheets(df: DataFrame, path: str) -> None:
    """Files of at most a sheet's rows, one or more for each task that has rows; dates and nested values are text."""
    plain = {"string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double"}
    texts = df.select(*(F.col(f"`{c}`") if kind in plain else F.col(f"`{c}`").cast("string").alias(c) for c, kind in df.dtypes))
    texts.write.format(registered(df.sparkSession, Sheets)).mode("append").save(path)
