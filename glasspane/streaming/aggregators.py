"""Slide scores from heatmaps that grow: keyed state for each cell of a slide.

The state of a cell is the sum and number of the scores of the tiles over it, a streaming aggregation that Spark
keeps itself: no Python runs for a key, and tiles of one slide spread over all tasks. States merge by adding,
so any split of the tiles into batches, in any order, leads to the same one. A batch tells the cells that it
changed, by bands (BAND rows of cells) of their slide. Of what has been told the last of each cell counts: bands of rows
and of columns with their longest run of cells that reach a threshold, their largest cells, and their cells. These merge
into the scores of a slide: the longest run of any band, the largest cells of all rows, or the whole heatmap for
pooling. No row holds more than a band.

Cells are what grid.heatmap makes of all tiles so far: means of the tiles over them, and rows whose
score is null or NaN take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glasspane.operators.grid import heatmap

TOLD = "axis string, band int, version long, threshold double, most int, cells array<struct<gx: int, gy: int, score: double>>"
#: Lines of a band. A cell's place is its line times 2^32 and, from 2^31 on, its place in the line, so that
#: neighbours of a line differ by one and those of two lines never do.
BAND, LINE, ZERO = 16, 1 << 32, 1 << 31
#: State that Spark keeps on disk, with checkpoints: it needn't fit in the executors' memory.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Heat = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged(one: Heat, other: Heat) -> Heat:
    """Two sparse heatmaps (places ascending, sums, counts) added up: what the states of cells come to, in arrays."""
    places, back = np.unique(np.concatenate([one[0], other[0]]), return_inverse=True)
    totals, counts = np.zeros(len(places)), np.zeros(len(places), np.int64)
    np.add.at(totals, back, np.concatenate([one[1], other[1]]))
    np.add.at(counts, back, np.concatenate([one[2], other[2]]))
    return places, totals, counts


def longest_run(places: np.ndarray) -> int:
    """The most places, ascending, that follow each other without a hole; run_length as a function of arrays."""
    if not len(places):
        return 0
    ends = np.flatnonzero(np.diff(places) != 1)
    return int(np.diff(np.concatenate([[-1], ends, [len(places) - 1]])).max())


def run_length(places: Column) -> Column:
    """longest_run of an array of ascending places."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def grown(state: Column, place: Column) -> Column:
        run = F.when(place == state["last"] + 1, state["run"] + 1).otherwise(1)
        return F.struct(place.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(places, start, grown, lambda state: state["best"])


def band_scores(tiles: DataFrame, extent: int, stride: int, threshold: float, top: int, score: str = "score") -> DataFrame:
    """What a batch of tiles changes. Of a stream, the changed cells with threshold and top, for update output, as
    run_to_the_end writes it by bands; of a batch, the bands themselves. tiles: slide_id, x, y and a score."""
    cells = heatmap(tiles, extent, stride, score).withColumns({"threshold": F.lit(float(threshold)), "most": F.lit(top)})
    return cells if tiles.isStreaming else in_bands(cells, 1)


def in_bands(cells: DataFrame, version: int) -> DataFrame:
    """slide_id and TOLD from changed cells, one row a band of rows."""
    kept = F.collect_list(F.struct("gx", "gy", "score")).alias("cells")
    found = cells.groupBy("slide_id", F.floor(F.col("gy") / BAND).cast("int").alias("band")).agg(F.first("threshold").alias("threshold"), F.first("most").alias("most"), kept)
    return found.select("slide_id", F.lit("row").alias("axis"), "band", F.lit(version).cast("long").alias("version"), "threshold", "most", "cells")


def last_told(bands: DataFrame) -> DataFrame:
    """Bands of rows and of columns (axis "row" or "column") from the last of the versions of each cell: slide_id, axis,
    band, longest, top and cells. Columns hold the same cells, so only rows list them."""
    told = bands.select("slide_id", "version", "threshold", "most", F.explode("cells").alias("c"))
    last = {name: F.max_by(column, "version").alias(name) for name, column in (("score", "c.score"), ("threshold", "threshold"), ("most", "most"))}
    cells = told.groupBy("slide_id", F.col("c.gx").alias("gx"), F.col("c.gy").alias("gy")).agg(*last.values())

    def entry(axis: str, line: str, along: str) -> Column:
        place = F.col(line).cast("long") * LINE + F.col(along) + ZERO
        return F.struct(F.lit(axis).alias("axis"), F.floor(F.col(line) / BAND).cast("int").alias("band"), place.alias("place"))

    both = F.explode(F.array(entry("row", "gy", "gx"), entry("column", "gx", "gy")))
    lines = cells.withColumn("e", both).select("slide_id", "gx", "gy", "score", "threshold", "most", "e.*")
    own = F.when(F.col("axis") == "row", F.struct((-F.col("score")).alias("less"), "gx", "gy"))
    found = lines.groupBy("slide_id", "axis", "band").agg(
        F.sort_array(F.collect_list(F.when(F.col("score") >= F.col("threshold"), F.col("place")))).alias("reach"), F.sort_array(F.collect_list(own)).alias("own"), F.max("most").alias("most")
    )
    cells = F.transform("own", lambda c: F.struct(c["gx"].alias("gx"), c["gy"].alias("gy"), (-c["less"]).alias("score")))
    found = found.select("slide_id", "axis", "band", run_length(F.col("reach")).alias("longest"), cells.alias("cells"), "most")
    return found.select("slide_id", "axis", "band", "longest", F.slice("cells", F.lit(1), F.col("most")).alias("top"), "cells")


def span_scores(last: DataFrame, k: int) -> DataFrame:
    """grid.slide_span from the last of each band: whether any has a run of k."""
    return last.groupBy("slide_id").agg((F.max("longest") >= k).alias("prediction"))


def top_scores(last: DataFrame, top: int) -> DataFrame:
    """grid.slide_top_k of single cells: the largest of all bands' largest (each must tell as many)."""
    rows = last.where("axis = 'row'").select("slide_id", F.explode("top").alias("c")).select("slide_id", "c.*")
    order = W.partitionBy("slide_id").orderBy(F.desc("score"), "gx", "gy")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).groupBy("slide_id").agg(F.avg("score").alias("prediction"))


def cells_so_far(last: DataFrame) -> DataFrame:
    """The whole heatmap, slide_id, gx, gy, score, for what pools over several lines."""
    return last.where("axis = 'row'").select("slide_id", F.explode("cells").alias("c")).select("slide_id", "c.*")


def run_to_the_end(told: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write the stream of band_scores to Parquet files, by bands, a folder for each batch (a batch that is repeated
    writes the same one), until its input is used up; what was told so far. Called again with the same folders it goes on
    where it stopped."""
    spark: SparkSession = told.sparkSession
    schema = f"slide_id {dict(told.dtypes)['slide_id']}, {TOLD}"

    def tell(cells: DataFrame, batch: int) -> None:
        in_bands(cells, batch).drop("version").write.mode("overwrite").parquet(f"{path}/version={batch}")

    # no rows, so that there is a table where no batch tells anything
    spark.createDataFrame([], schema).drop("version").write.mode("ignore").parquet(f"{path}/version=-1")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        told.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(schema).parquet(path)
