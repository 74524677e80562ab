"""Text expressions: file stems, name patterns, slide ranges, list cells, parameter keys.

All are Catalyst expressions. Where the meaning of bad input is an error the cast raises (ANSI
mode); where it means "no value" the result is null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of names and case indices (fixed values).
#: <patient>-24-<slide>-HE.czi
CZI_NAME = r"^(\d+)-24-(\d+)-HE\.czi$"
#: <year>[_-]<request>-<slide>.mrxs
MRXS_NAME = r"^(\d{4})[_-](\d+)-(\d+)\.mrxs$"
#: <patient>/<year> - <ranges>; the dash and spaces vary
CASE_INDEX = r"^\s*(\d+)\s*/\s*(\d+)\s*-?\s*(.+?)\s*$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix ("x.tar.gz" gives "x.tar", ".x" stays)."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", suffix)


def group_or_null(text: Column, pattern: str, group: int) -> Column:
    """A group of the pattern; null, not an empty string, where the text doesn't match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def without_leading_zeros(text: Column) -> Column:
    return F.regexp_replace(text, "^0+", "")


def parsed_ranges(text: Column) -> Column:
    """"1-11,13-16,20" as array<struct<start,end>>; an entry that isn't a number raises."""

    def one(part: Column) -> Column:
        ends = F.split(F.trim(part), "-")
        start = F.trim(F.element_at(ends, 1)).cast("int")
        return F.struct(start.alias("start"), F.trim(F.element_at(ends, -1)).cast("int").alias("end"))

    return F.transform(F.split(text, ","), one)


def in_ranges(number: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (r["start"] <= number) & (number <= r["end"]))


def list_items(cell: Column, trim: bool = True) -> Column:
    """Items of a comma-separated cell."""
    items = F.split(cell, ",")
    return F.transform(items, lambda x: F.trim(x)) if trim else items


def number_cell_items(cell: Column) -> Column:
    """A cell that a spreadsheet took for a number: 1.2 means slides 1 and 2."""
    return F.split(cell.cast("string"), r"\.")


def case_key(year: Column, request: Column) -> Column:
    """yy/request, the request without leading zeros."""
    return F.concat_ws("/", F.substring(year, 3, 2), without_leading_zeros(request))


def last_token(text: Column, separator: str = "_") -> Column:
    return F.element_at(F.split(text, separator), -1)


def parameter_key(values: Mapping[str, Column | float | int]) -> Column:
    """a=1_b=2, in the order of the mapping."""
    return F.concat_ws("_", *(F.concat(F.lit(f"{k}="), (v if isinstance(v, Column) else F.lit(v)).cast("string")) for k, v in values.items()))


def missing(value: Column, floating: bool = False) -> Column:
    """Null or, for floating columns, NaN."""
    return value.isNull() | F.isnan(value) if floating else value.isNull()


def row_id(*columns: str) -> Column:
    """A stable id of a row: the digest of its columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def grade_key(score: Column) -> Column:
    """Sort key of "negative" < "3+3" < "3+4" < ...: a struct of numbers; anything else is last."""
    a, b = (F.regexp_extract(score, r"^\s*(\d+)\s*\+\s*(\d+)\s*$", i) for i in (1, 2))
    return F.struct(
        F.when(score == "negative", 0).when(a != "", 1).otherwise(2).alias("kind"),
        F.when(a != "", a.cast("int")).otherwise(0).alias("a"),
        F.when(b != "", b.cast("int")).otherwise(0).alias("b"),
    )
