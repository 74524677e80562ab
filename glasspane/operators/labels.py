"""Labels of slides, cases and tiles, and the metadata tables they are derived in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspane.functions import text
from glasspane.operators.checks import drop_columns
from glasspane.operators.filters import above, at_least, complete_cases


def tile_label(column: str, threshold: float) -> Column:
    """Strictly above the threshold; false for NaN and null."""
    return F.coalesce(above(F.col(column), threshold), F.lit(False))


def binary_prediction(column: str, threshold: float) -> Column:
    """At or above the threshold (inclusive, unlike tile_label)."""
    return F.coalesce(at_least(F.col(column), threshold), F.lit(False))


def false_positive(prediction: Column, target: Column) -> Column:
    return prediction & ~target.cast("boolean")


def graded_positive(grade: Column) -> Column:
    """Any grade but 0; a missing grade counts as positive."""
    return F.coalesce(grade != 0, F.lit(True))


def is_yes(cell: Column) -> Column:
    return F.coalesce(F.lower(cell.cast("string")) == "yes", F.lit(False))


def slide_label(case_positive: Column, positive_slides: Column, number: Column, trim: bool = True) -> Column:
    """Positive if the case is and its list names the slide; a missing list names none."""
    listed = F.array_contains(text.list_items(positive_slides, trim), number.cast("string"))
    return case_positive & F.coalesce(listed, F.lit(False))


def case_columns(label: Column, invasion: Column, grade: Column, score: Column) -> dict[str, Column]:
    """Columns that only a positive slide has: invasion false, grade and score null otherwise."""
    graded = label & score.isNotNull()
    return {
        "perineural_invasions": label & is_yes(invasion),
        "isup_grade": F.when(graded, grade.cast("double")),
        "gleason_score": F.when(graded, F.trim(score)),
    }


def parse_case_table(annotations: DataFrame, index: str = "Biopsy_No") -> DataFrame:
    """patient_no, year and ranges from index strings like "68/24 - 1-11,13-16"; a string of
    another form raises when its row is read."""
    ok = F.col(index).rlike(text.CASE_INDEX)
    bad = F.raise_error(F.concat(F.lit("can't parse index "), F.coalesce(F.col(index), F.lit("null"))))
    get = lambda i: F.when(ok, F.regexp_extract(F.col(index), text.CASE_INDEX, i)).otherwise(bad)
    return annotations.withColumns({"patient_no": get(1).cast("int"), "year": get(2).cast("int"), "ranges": text.parsed_ranges(get(3))})


def metadata_from_ranges(slides: DataFrame, annotations: DataFrame) -> DataFrame:
    """Metadata of slides named <patient>-24-<number>-HE.czi from a parsed case table.

    A slide of another name or in no range is skipped; one in ranges of two cases raises. The
    list of positive slides is searched for the number as it is written in the name.
    slides: slide_path. annotations: see parse_case_table.
    """
    from glasspane.operators.joins import range_join

    name = text.file_name(F.col("slide_path"))
    named = slides.select("slide_path", text.group_or_null(name, text.CZI_NAME, 1).cast("int").alias("patient_no"), text.group_or_null(name, text.CZI_NAME, 2).alias("slide_text"))
    cases = annotations.withColumnRenamed("ISUP_grade_ group", "ISUP_grade")
    rows = range_join(named.where("patient_no is not null").withColumn("slide_no", F.col("slide_text").cast("int")), cases, "patient_no", "slide_no", "slide_path")
    case_positive = is_yes(F.col("Cancer_in_case"))
    label = slide_label(case_positive, F.col("Cancer_in_slides").cast("string"), F.col("slide_text"))
    extra = case_columns(label, F.col("Perineural_invasion"), F.col("ISUP_grade"), F.col("Gleason_score"))
    return rows.select("slide_path", label.alias("carcinoma"), F.col("Biopsy_No").alias("case_id"), F.col("patient_no").alias("patient_id"), case_positive.alias("case_carcinoma"), *(c.alias(n) for n, c in extra.items()))


def metadata_from_index(slides: DataFrame, annotations: DataFrame) -> DataFrame:
    """Metadata of slides named <year>[_-]<request>-<number>.mrxs, looked up as yy/request in
    Biopsy_No; a name of another form is skipped, an unknown case raises. List items aren't
    trimmed; a list that was read as a number (1.2) is repaired."""
    name = text.file_name(F.col("slide_path"))
    get = lambda i: text.group_or_null(name, text.MRXS_NAME, i)
    named = slides.where(name.rlike(text.MRXS_NAME)).select("slide_path", text.case_key(get(1), get(2)).alias("key"), text.without_leading_zeros(get(3)).alias("number"))
    cases = annotations.withColumnRenamed("ISUP_grade_ group", "ISUP_grade")
    numeric = dict(cases.dtypes)["Cancer_in_slides"] in ("double", "float", "int", "bigint")
    rows = named.join(cases, F.trim(cases["Biopsy_No"]) == named["key"], "left")
    known = F.when(F.col("Biopsy_No").isNotNull(), F.trim("Biopsy_No")).otherwise(F.raise_error(F.concat(F.lit("no case "), F.col("key"))))
    items = text.number_cell_items(F.col("Cancer_in_slides")) if numeric else text.list_items(F.col("Cancer_in_slides"), trim=False)
    case_positive = is_yes(F.col("Cancer_in_case"))
    label = case_positive & F.coalesce(F.array_contains(items, F.col("number")), F.lit(False))
    extra = case_columns(label, F.col("Perineural_invasion"), F.col("ISUP_grade"), F.col("Gleason_score"))
    return rows.select("slide_path", label.alias("carcinoma"), known.alias("case_id"), F.trim("Patient_ID").alias("patient_id"), case_positive.alias("case_carcinoma"), *(c.alias(n) for n, c in extra.items()))


def graded_metadata(metadata: DataFrame) -> DataFrame:
    """Rows with annotation and segmentation, labelled by grade, without the columns that were
    only needed for that."""
    rows = complete_cases(metadata, "has_annotation", "has_segmentation")
    return drop_columns(rows.withColumn("carcinoma", graded_positive(F.col("isup_grade"))), "segmentation_id", "has_segmentation")


def labelled_listing(slides: DataFrame, annotations: DataFrame, blacklist: list[str]) -> DataFrame:
    """Slides (slide_path) not in the blacklist of stems, with the label of their stem;
    annotations: stem, value (1 is positive). A slide without one raises."""
    rows = slides.withColumn("stem", text.stem(F.col("slide_path"))).where(~F.col("stem").isin(*blacklist))
    found = rows.join(annotations.select("stem", "value"), "stem", "left")
    value = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no annotation for "), F.col("stem"))).cast("double"))
    return found.select("slide_path", (value == 1).alias("carcinoma"))


def prediction_table(df: DataFrame, threshold: float, prediction: str = "prediction", key: str = "slide_name") -> DataFrame:
    """bin_prediction and is_fp added, largest prediction first (ties by key)."""
    rows = df.withColumn("bin_prediction", binary_prediction(prediction, threshold))
    return rows.withColumn("is_fp", false_positive(F.col("bin_prediction"), F.col("target"))).orderBy(F.desc_nulls_last(prediction), key)
