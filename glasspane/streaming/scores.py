"""Slide scores that grow as tiles are scored: the incremental aggregates as streams.

A slide's state is a few numbers, whatever its tiles; late tiles within the watermark count.
Windows of event time are an addition of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_slide_scores(tiles: DataFrame, threshold: float, score: str = "prediction") -> DataFrame:
    """slide_id, prediction (largest), num_positive and n_tiles so far; for update or complete
    output mode, and as well for a batch."""
    ok = ~F.isnan(score)
    return tiles.groupBy("slide_id").agg(
        F.max(F.when(ok, F.col(score))).alias("prediction"), F.count_if(ok & (F.col(score) > threshold)).alias("num_positive"), F.count("*").alias("n_tiles")
    )


def windowed_slide_scores(tiles: DataFrame, time: str, width: str, late: str, score: str = "prediction") -> DataFrame:
    """window_start, slide_id, prediction and n_tiles for each window of event time; a window is
    final once the watermark has passed it."""
    rows = tiles.withWatermark(time, late) if tiles.isStreaming else tiles
    found = rows.groupBy(F.window(time, width).alias("w"), "slide_id").agg(F.max(F.when(~F.isnan(score), F.col(score))).alias("prediction"), F.count("*").alias("n_tiles"))
    return found.select(F.col("w.start").alias("window_start"), "slide_id", "prediction", "n_tiles")
