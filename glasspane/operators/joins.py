"""Joins of slides, tiles, embeddings, annotations and predictions.

Small sides are left to Catalyst and AQE, which broadcast by measured size; no hint forces one.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glasspane.functions.text import in_ranges, parameter_key, stem
from glasspane.operators.checks import require_columns
from glasspane.operators.ranks import file_rank, ordered_rank


def join_one_to_one(left: DataFrame, right: DataFrame, left_key: str, right_key: str, columns: list[str], required: bool = True) -> DataFrame:
    """LEFT join that adds columns of right. A key that repeats on either side and, if required, a
    missing added value raise when the row is read."""
    right_rows = right.groupBy(F.col(right_key).alias("__key")).agg(F.count("*").alias("__of_right"), F.any_value(F.struct(*columns)).alias("__added"))
    left_rows = left.groupBy(F.col(left_key).alias("__own")).agg(F.count("*").alias("__of_left"))
    out = left.join(right_rows, F.col(left_key) == F.col("__key"), "left").join(left_rows, F.col(left_key) == F.col("__own"), "left")
    repeated = F.raise_error(F.concat(F.lit(f"{left_key} isn't unique, e.g. "), F.col(left_key).cast("string")))
    once = (F.coalesce("__of_left", F.lit(1)) == 1) & (F.coalesce("__of_right", F.lit(1)) == 1)
    for c in columns:
        value, kind = F.col("__added")[c], right.schema[c].dataType
        if required:
            value = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"missing {c} after the join")).cast(kind))
        out = out.withColumn(c, F.when(once, value).otherwise(repeated.cast(kind)))
    return out.drop("__key", "__own", "__of_left", "__of_right", "__added")


def relabel(rows: DataFrame, source: DataFrame, key: str, label: str = "carcinoma") -> DataFrame:
    """LEFT join: the label is the source's, null where it has none; columns keep their order."""
    new = source.select(key, F.col(label).alias("__label"))
    return rows.drop(label).join(new, key, "left").withColumnRenamed("__label", label).select(rows.columns)


def relabel_by_stem(slides: DataFrame, source: DataFrame, label: str = "carcinoma", path: str = "path", source_path: str = "slide_path") -> DataFrame:
    """INNER join on the path's stem: slides that the source doesn't list go."""
    new = source.select(stem(F.col(source_path)).alias("__stem"), F.col(label).alias("__label"))
    joined = slides.drop(label).withColumn("__stem", stem(F.col(path))).join(new, "__stem")
    return joined.withColumnRenamed("__label", label).select(slides.columns)


def with_slide_columns(tiles: DataFrame, slides: DataFrame, columns: list[str], tile_key: str = "slide_id", slide_key: str = "id") -> DataFrame:
    """LEFT join of slide attributes to their tiles."""
    dim = slides.select(F.col(slide_key).alias("__id"), *columns)
    return tiles.join(dim, F.col(tile_key) == F.col("__id"), "left").drop("__id")


def with_slide_label(tiles: DataFrame, slides: DataFrame, label: str = "carcinoma", name: str = "slide_label") -> DataFrame:
    """As with_slide_columns, but a tile of an unknown slide raises when it is read."""
    joined = with_slide_columns(tiles, slides.withColumn("__known", F.lit(True)), [label, "__known"]).withColumnRenamed(label, name)
    checked = F.when(F.col("__known"), F.col(name)).otherwise(F.raise_error(F.concat(F.lit("unknown slide "), F.col("slide_id"))).cast("boolean"))
    return joined.withColumn(name, checked).drop("__known")


def positions(rows: DataFrame, partition: str, order: list[str], name: str = "pos") -> DataFrame:
    """Place of each row in its partition, from 1, by an explicit order whose first column is a
    number."""
    return ordered_rank(rows, [partition], order, name)


def stored_positions(path_rows: DataFrame, partition: str | None, name: str = "pos") -> DataFrame:
    """Places in stored order (by file, then row), by partition or over all, for a frame just read from files."""
    rows = path_rows.withColumns({"__bucket": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    return file_rank(rows, [partition] if partition else [], name)


def in_input_order(rows: DataFrame, file: str = "__file", row: str = "__row") -> DataFrame:
    """Rows in the order in which they were read (see with_input_order), without those columns."""
    return rows.orderBy(file, row).drop(file, row)


def with_input_order(path_rows: DataFrame) -> DataFrame:
    """A frame just read from files with __file and __row, by which in_input_order restores its order
    after joins."""
    return path_rows.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def attach_embeddings(tiles: DataFrame, embeddings: DataFrame, key: str = "slide_id", pos: str = "pos") -> DataFrame:
    """Tiles with the embedding at their place; a slide whose counts differ raises when rows are read. Both
    have (key, pos)."""
    a = tiles.groupBy(key).agg(F.count("*").alias("n_tiles"))
    b = embeddings.groupBy(key).agg(F.count("*").alias("n_embeddings"))
    unequal = F.raise_error(F.concat(F.lit("tiles and embeddings differ in number for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    alike = F.when(F.col("n_tiles").eqNullSafe(F.col("n_embeddings")), F.lit(True)).otherwise(unequal.cast("boolean"))
    counted = a.join(b, key, "full").where(alike).select(key)
    return tiles.join(embeddings.select(key, pos, "embedding"), [key, pos]).join(counted, key, "left_semi")


def surviving_embeddings(embeddings: DataFrame, tiles: DataFrame, key: str = "slide_id", pos: str = "pos") -> DataFrame:
    """Embeddings of tiles that a filter left; places are those before the filter."""
    return embeddings.join(tiles.select(key, pos), [key, pos], "left_semi").select(embeddings.columns)


def range_join(rows: DataFrame, cases: DataFrame, group: str, number: str, key: str, ranges: str = "ranges", exactly_one: bool = True) -> DataFrame:
    """INNER join of rows to the case of their group one of whose ranges (inclusive) holds their
    number; overlapping ranges of one case count once, as do repeated cases. With exactly_one a row
    in ranges of two cases raises when it is read. The cases of a group (a few) come as one array,
    so rows are joined once and none is compared with another."""
    extra = [c for c in cases.columns if c not in rows.columns and c != ranges]
    of_group = cases.groupBy(F.col(group).alias("__group")).agg(F.collect_set(F.struct(F.col(ranges).alias("__ranges"), *extra)).alias("__cases"))
    hits = F.filter("__cases", lambda c: in_ranges(F.col(number), c["__ranges"]))
    found = rows.join(of_group, F.col(group) == F.col("__group")).withColumn("__hits", hits).where(F.size("__hits") > 0)
    if exactly_one:
        two = F.raise_error(F.concat(F.lit("more than one case for "), F.col(key).cast("string")))
        found = found.withColumn("__hits", F.when(F.size("__hits") > 1, two.cast(found.schema["__hits"].dataType)).otherwise(F.col("__hits")))
    return found.select(*rows.columns, F.explode("__hits").alias("__case")).select(*rows.columns, *(F.col("__case")[c].alias(c) for c in extra))


def lookup(rows: DataFrame, table: DataFrame, key: str, columns: list[str], strict: bool = True) -> DataFrame:
    """Adds columns of the table by key; a missing key raises when strict, else gives null."""
    dim = table.select(key, *columns).withColumn("__known", F.lit(True))
    out = rows.join(dim, key, "left")
    if strict:
        bad = F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        out = out.withColumn(key, F.when(F.col("__known"), F.col(key)).otherwise(bad.cast(dict(rows.dtypes)[key])))
    return out.drop("__known")


def first_match(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by order."""
    return table.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def merged_predictions(tables: Mapping[str, DataFrame], score: str = "prediction", key: str = "slide_name") -> DataFrame:
    """Columns <model>_pred_score (and <model>_pred_binary where there is bin_prediction) of
    several prediction tables side by side. Joined by key, not by row order, so that tables in
    different orders don't mix; a key that repeats in a table raises when it is read."""
    merged = None
    for model, df in tables.items():
        require_columns(df, key, score)
        own = {score: f"{model}_pred_score"} | ({"bin_prediction": f"{model}_pred_binary"} if "bin_prediction" in df.columns else {})
        if merged is None:
            kept = [c for c in df.columns if c not in ("is_fp", score, "bin_prediction")]
            merged = df.select(*kept)
        merged = join_one_to_one(merged, df.select(F.col(key).alias("__of"), *(F.col(a).alias(b) for a, b in own.items())), key, "__of", list(own.values()), required=False)
    return merged


def master_table(tables: Mapping[str, DataFrame], key: str = "slide_name", score: str = "prediction", target: str = "target") -> DataFrame:
    """One row for each key that all tables have: the target of the first table and a column for
    each. Long and pivoted, so one shuffle serves any number of tables; repeated keys raise."""
    names = list(tables)
    long = reduce(DataFrame.unionByName, (t.select(key, F.col(score).cast("double").alias("score"), (F.col(target) if i == 0 else F.lit(None)).cast("int").alias(target), F.lit(n).alias("name")) for i, (n, t) in enumerate(tables.items())))
    own = [F.sum(F.when(F.col("name") == n, 1).otherwise(0)).alias(f"__n{i}") for i, n in enumerate(names)]
    wide = long.groupBy(key).agg(F.max(target).alias(target), *(F.max(F.when(F.col("name") == n, F.col("score"))).alias(n) for n in names), *own)
    counts = [F.col(f"__n{i}") for i in range(len(names))]
    repeated = F.raise_error(F.concat(F.lit(f"repeated {key} "), F.col(key).cast("string")))
    wide = wide.where(F.least(*counts, F.lit(1)) == 1)
    return wide.select(F.when(F.greatest(*counts, F.lit(1)) == 1, F.col(key)).otherwise(repeated.cast(dict(tables[names[0]].dtypes)[key])).alias(key), target, *(F.col(f"`{n}`") for n in names))


def parameter_grid(spark, values: Mapping[str, list]) -> DataFrame:
    """All combinations of parameter values (the last varies fastest) with their key."""
    frames = [spark.createDataFrame([(v,) for v in vs], [k]) for k, vs in values.items()]
    return reduce(DataFrame.crossJoin, frames).withColumn("key", parameter_key({k: F.col(k) for k in values}))


def mask_paths(slides: DataFrame, listing: DataFrame, fallback: str, path: str = "path", listed: str = "path") -> DataFrame:
    """mask_path of each slide: the listed file of the same stem, else the fallback."""
    masks = listing.select(stem(F.col(listed)).alias("__stem"), F.col(listed).alias("mask_path"))
    out = slides.withColumn("__stem", stem(F.col(path))).join(masks, "__stem", "left").drop("__stem")
    return out.withColumn("mask_path", F.coalesce("mask_path", F.lit(fallback)))


def repathed(slides: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """Slides with the path that the other table has for their stem; a stem it lacks raises."""
    new = paths.select(stem(F.col("path")).alias("__stem"), F.col("path").alias("__new"))
    out = slides.withColumn("__stem", stem(F.col(path))).join(new, "__stem", "left")
    known = F.when(F.col("__new").isNotNull(), F.col("__new")).otherwise(F.raise_error(F.concat(F.lit("no path for "), F.col("__stem"))))
    return out.withColumn(path, known).select(slides.columns)
