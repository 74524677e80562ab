"""Tiles on a grid, heatmaps as sparse relations, and slide scores from them.

Choices that are ours: a tile must lie whole inside its slide unless partial tiles are asked for;
cells under several tiles get the mean of their scores; a pooling window counts missing cells as
0 and lies inside the bounding grid of the slide (whose shorter side it may exceed: then one
window covers it). Rows whose score is null or NaN take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of windows that pooling takes as one group.
BAND = 64


def _starts(extent: Column, tile: Column, stride: Column, partial: bool) -> Column:
    last = extent - 1 if partial else extent - tile
    return F.when(last >= 0, F.sequence(F.lit(0).cast("int"), last.cast("int"), stride.cast("int")))


def grid_tiles(slides: DataFrame, partial: bool = False) -> DataFrame:
    """slide_id, x, y of every tile of every slide; a slide smaller than a tile has none."""
    xs = _starts(F.col("extent_x"), F.col("tile_extent_x"), F.col("stride_x"), partial)
    ys = _starts(F.col("extent_y"), F.col("tile_extent_y"), F.col("stride_y"), partial)
    columns = slides.select(F.col("id").alias("slide_id"), F.explode(xs).alias("x"), ys.alias("ys"))
    return columns.select("slide_id", "x", F.explode("ys").alias("y"))


def covered_cells(tiles: DataFrame, extent: int, stride: int, keep: list[str] | None = None) -> DataFrame:
    """slide_id, gx, gy of every stride-sized cell that a tile covers, one row a tile and cell."""

    def span(at: str) -> Column:
        first = F.floor(F.col(at) / stride).cast("int")
        return F.sequence(first, F.floor((F.col(at) + (extent - 1)) / stride).cast("int"))

    rows = tiles.select("slide_id", *(keep or []), F.explode(span("x")).alias("gx"), span("y").alias("gys"))
    return rows.select("slide_id", *(keep or []), "gx", F.explode("gys").alias("gy"))


def heatmap(tiles: DataFrame, extent: int, stride: int, score: str = "score") -> DataFrame:
    """slide_id, gx, gy, score: mean score of the tiles over each cell."""
    scored = tiles.where(F.col(score).isNotNull() & ~F.isnan(score))
    return covered_cells(scored, extent, stride, [score]).groupBy("slide_id", "gx", "gy").agg(F.avg(score).alias("score"))


def filled_mask(tiles: DataFrame, extent: int, stride: int) -> DataFrame:
    """The covered cells, each once, with value 255."""
    return covered_cells(tiles, extent, stride).distinct().withColumn("value", F.lit(255))


def _strips(first: Column, size: Column, extent: int) -> Column:
    """Array of (level, strip): the fewest strips, of 2^level lines from strip * 2^level on, that make up
    size lines from the first; at most two of each level."""
    found = []
    for level in range(extent.bit_length()):
        lo, hi = -F.shiftright(-first, level), F.shiftright(first + size, level)
        odd = lo.bitwiseAND(F.lit(1))
        found.append(F.when((odd == 1) & (lo < hi), F.struct(F.lit(level).alias("level"), lo.alias("strip"))))
        found.append(F.when((hi.bitwiseAND(F.lit(1)) == 1) & (lo + odd < hi), F.struct(F.lit(level).alias("level"), (hi - 1).alias("strip"))))
    return F.array_compact(F.array(*found))


def overlap_maps(tiles: DataFrame, mask: DataFrame, extent: int) -> DataFrame:
    """slide_id, x, y and overlap, a map of class to its share, of the tiles with a pixel, each once.

    mask: slide_id, mx, my, cls in tile coordinates. Pixels are counted once, in square cells whose side
    is the greatest that divides every tile's place and size. Lines of cells are added up in strips of 1, 2, 4, ...
    lines, up to a tile's height; a tile is a few strips, and what lies in it of each is the difference of two
    running sums along the strip. Only cells with a pixel and corners of tiles are rows: twice the cells and, for a class,
    at most four of each level for a tile, however many tiles lie over a pixel.
    """
    # sides of exploded tiles look small to the planner: what they are joined with is never a broadcast of them
    fits = (F.when(F.bool_and((F.col("x") % d == 0) & (F.col("y") % d == 0)), d) for d in range(1, extent + 1) if extent % d == 0)
    grain = tiles.agg(F.greatest(F.lit(1), *fits).alias("grain"))
    cell = lambda at: F.floor(F.col(at) / F.col("grain")).cast("int")
    pixels = mask.where("cls is not null").join(tiles.select("slide_id").distinct().hint("merge"), "slide_id", "left_semi").crossJoin(grain)
    cells = pixels.groupBy("slide_id", "cls", cell("mx").alias("cx"), cell("my").alias("cy")).agg(F.count("*").alias("n"))
    size = (F.lit(extent) / F.col("grain")).cast("int")
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright("cy", i).alias("strip")) for i in range(extent.bit_length()))))
    lines = cells.crossJoin(grain).select("slide_id", "cls", "cx", "n", size.alias("size"), levels.alias("s")).where("shiftleft(1, s.level) <= size")
    lines = lines.groupBy("slide_id", "cls", "s.level", "s.strip", "cx").agg(F.sum("n").alias("n"))

    classes = cells.groupBy("slide_id").agg(F.collect_set("cls").alias("classes"))
    over = tiles.select("slide_id", "x", "y").hint("merge").join(classes, "slide_id").dropDuplicates(["slide_id", "x", "y"]).crossJoin(grain)
    ends = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), (cell("x") - 1).alias("cx")), F.struct(F.lit(1).alias("sign"), (cell("x") + size - 1).alias("cx"))))
    asked = over.select("slide_id", "x", "y", F.explode("classes").alias("cls"), cell("x").alias("__cx"), "grain").withColumn("s", F.explode(_strips(cell("y"), size, extent)))
    asked = asked.select("slide_id", "cls", "s.level", "s.strip", "x", "y", ends.alias("e")).select("slide_id", "cls", "level", "strip", "e.cx", "x", "y", "e.sign", F.lit(0).cast("long").alias("n"))
    held = lines.select("slide_id", "cls", "level", "strip", "cx", F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"), F.lit(0).alias("sign"), "n")
    upto = W.partitionBy("slide_id", "cls", "level", "strip").orderBy("cx", F.col("sign") != 0).rowsBetween(W.unboundedPreceding, 0)
    sums = held.unionByName(asked).withColumn("n", F.sum("n").over(upto)).where("sign != 0 and n > 0")
    counts = sums.groupBy("slide_id", "x", "y", "cls").agg(F.sum(F.col("sign") * F.col("n")).alias("n")).where("n > 0")
    entry = F.struct(F.col("cls").cast("string").alias("key"), F.col("n").cast("double").alias("n"))
    maps = counts.groupBy("slide_id", "x", "y").agg(F.collect_list(entry).alias("e"), F.sum("n").alias("total"))
    return maps.select("slide_id", "x", "y", F.map_from_entries(F.transform("e", lambda p: F.struct(p["key"], p["n"] / F.col("total")))).alias("overlap"))


def with_overlap(tiles: DataFrame, maps: DataFrame) -> DataFrame:
    """tiles with their map of overlap_maps, an empty one where they have none."""
    return tiles.join(maps, ["slide_id", "x", "y"], "left").withColumn("overlap", F.coalesce("overlap", F.create_map().cast("map<string,double>")))


def overlap_fractions(tiles: DataFrame, mask: DataFrame, extent: int) -> DataFrame:
    """slide_id, x, y and overlap of every tile, each once; tiles without a pixel have an empty map."""
    return with_overlap(tiles.select("slide_id", "x", "y").distinct(), overlap_maps(tiles, mask, extent))


def pooled_sums(cells: DataFrame, kernels: list[int]) -> DataFrame:
    """slide_id, kernel_size, wx, wy, score: means over windows of each size by their first cell.

    Cells are shuffled once for all sizes, to the bands of BAND lines of windows that they may be in (of a slide, so that
    it spreads over tasks). A task adds them up to windows along rows, and these along columns. Only windows
    with a cell are ever rows, and those of a slide that has few cells in a large box are few.
    """
    ends = cells.groupBy("slide_id").agg(*(f("g" + a).alias(n + a) for a in "xy" for f, n in ((F.min, "lo_"), (F.max, "hi_"))))

    def windows(axis: str, k: Column) -> tuple[Column, Column]:
        """The first and last place of a window of the size over a cell: inside the grid, or at its start where it is shorter."""
        at, lo, hi = (F.col(f"{p}{axis}") for p in ("g", "lo_", "hi_"))
        return F.greatest(at - (k - 1), lo), F.least(at, F.greatest(hi - (k - 1), lo))

    top = F.greatest(F.col("gy") - (max(kernels) - 1), F.col("lo_y"))
    bands = F.explode(F.sequence(F.floor(top / BAND).cast("int"), F.floor(F.col("gy") / BAND).cast("int")))
    sides = cells.join(ends, "slide_id").select("slide_id", bands.alias("band"), "gx", "gy", "lo_x", "hi_x", "lo_y", "hi_y", "score")
    # windows outnumber the cells that are shuffled, so tasks aren't merged by the size of these
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = sides.repartition(tasks, "slide_id", "band").withColumn("kernel_size", F.explode(F.array(*map(F.lit, kernels))))
    across = sizes.withColumn("wx", F.explode(F.sequence(*windows("x", F.col("kernel_size")))))
    across = across.groupBy("slide_id", "band", "kernel_size", "gy", "wx").agg(F.sum("score").alias("s"), F.first("lo_y").alias("lo_y"), F.first("hi_y").alias("hi_y"))
    first, last = windows("y", F.col("kernel_size"))
    first, last = F.greatest(first, F.col("band") * BAND), F.least(last, F.col("band") * BAND + (BAND - 1))
    down = across.where(first <= last).withColumn("wy", F.explode(F.sequence(first, last)))
    down = down.groupBy("slide_id", "band", "kernel_size", "wx", "wy").agg(F.sum("s").alias("s"))
    return down.select("slide_id", "kernel_size", "wx", "wy", (F.col("s") / (F.col("kernel_size") * F.col("kernel_size")).cast("double")).alias("score"))


def pooled(cells: DataFrame, k: int) -> DataFrame:
    """slide_id, wx, wy, score: means over k x k windows by their first cell."""
    if k == 1:
        return cells.select("slide_id", F.col("gx").alias("wx"), F.col("gy").alias("wy"), "score")
    return pooled_sums(cells, [k]).drop("kernel_size")


def slide_max(cells: DataFrame) -> DataFrame:
    return cells.groupBy("slide_id").agg(F.max("score").alias("prediction"))


def slide_mean_pool_max(cells: DataFrame, k: int) -> DataFrame:
    return slide_max(pooled(cells, k))


def ranked(cells: DataFrame, k: int, most: int) -> DataFrame:
    """The `most` largest pooled scores of each slide with their rank; ties by place."""
    w = W.partitionBy("slide_id").orderBy(F.desc("score"), "wx", "wy")
    return pooled(cells, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def slide_top_k(cells: DataFrame, k: int, top: int) -> DataFrame:
    """Mean of the `top` largest pooled scores (of all, where there are fewer)."""
    return ranked(cells, k, top).groupBy("slide_id").agg(F.avg("score").alias("prediction"))


def slide_span(cells: DataFrame, k: int, threshold: float) -> DataFrame:
    """True where k cells in a row or a column, without a hole, all reach the threshold."""

    def run(line: str, along: str) -> Column:
        w = W.partitionBy("slide_id", line).orderBy(along).rangeBetween(0, k - 1)
        return (F.min("score").over(w) >= threshold) & (F.count("*").over(w) == k)

    marked = cells.select("slide_id", (run("gy", "gx") | run("gx", "gy")).alias("hit"))
    return marked.groupBy("slide_id").agg(F.bool_or("hit").alias("prediction"))


def num_positive(tiles: DataFrame, slides: DataFrame, threshold: float, score: str = "prediction") -> DataFrame:
    """Tiles strictly above the threshold for each slide, 0 for a slide without tiles."""
    above = ~F.isnan(score) & (F.col(score) > threshold)
    counts = tiles.groupBy("slide_id").agg(F.count_if(above).alias("num_positive"))
    return slides.select(F.col("id").alias("slide_id")).join(counts, "slide_id", "left").select("slide_id", F.coalesce("num_positive", F.lit(0)).alias("num_positive"))


def sweep_top_k(cells: DataFrame, kernels: list[int], tops: list[int]) -> DataFrame:
    """slide_id, kernel_size, k, prediction for all pairs of parameters: one pooling serves all sizes,
    one ranking for each of them every k."""
    w = W.partitionBy("slide_id", "kernel_size").orderBy(F.desc("score"), "wx", "wy")
    ranks = pooled_sums(cells, kernels).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(tops))
    rows = ranks.withColumn("k", F.explode(F.array(*map(F.lit, tops)))).where("rank <= k")
    return rows.groupBy("slide_id", "kernel_size", "k").agg(F.avg("score").alias("prediction"))


def sweep_mean_pool_max(cells: DataFrame, kernels: list[int]) -> DataFrame:
    """slide_id, kernel_size, prediction: the largest pooled score for each kernel."""
    return pooled_sums(cells, kernels).groupBy("slide_id", "kernel_size").agg(F.max("score").alias("prediction"))


def sweep_span(cells: DataFrame, lengths: list[int], thresholds: list[float]) -> DataFrame:
    """slide_id, k, threshold, prediction: whether k cells in line reach the threshold, for all pairs
    of parameters. Of each k the best run's least score is found once, and compared with every
    threshold."""

    def weakest(line: str, along: str, k: int) -> Column:
        w = W.partitionBy("slide_id", line).orderBy(along).rangeBetween(0, k - 1)
        return F.when(F.count("*").over(w) == k, F.min("score").over(w))

    runs = cells.select("slide_id", *(F.greatest(weakest("gy", "gx", k), weakest("gx", "gy", k)).alias(f"k{k}") for k in lengths))
    best = runs.groupBy("slide_id").agg(*(F.max(f"k{k}").alias(f"k{k}") for k in lengths))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"k{k}") >= F.lit(float(t)), F.lit(False)).alias("prediction")) for k in lengths for t in thresholds)))
    return best.select("slide_id", pairs.alias("p")).select("slide_id", "p.*")


def sweep_wide(long: DataFrame, parameters: list[str], values: list[str]) -> DataFrame:
    """One pred_<a>=<v>_<b>=<w> column for each listed combination."""
    key = F.concat(F.lit("pred_"), F.concat_ws("_", *(F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in parameters)))
    return long.withColumn("__key", key).groupBy("slide_id").pivot("__key", values).agg(F.first("prediction"))


def outlines(tiles: DataFrame, extent: int) -> DataFrame:
    """The four sides of each tile as (slide_id, x0, y0, x1, y1)."""
    x, y = F.col("x"), F.col("y")
    corners = [(x, y), (x + extent, y), (x + extent, y + extent), (x, y + extent)]
    sides = F.array(*(F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)))
    return tiles.select("slide_id", F.explode(sides).alias("s")).select("slide_id", "s.*")
