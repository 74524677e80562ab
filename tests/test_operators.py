"""Operators on hand-made rows: nulls, NaN, ties, empty tables, errors; brute force for grids,
curves and vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.functions import overlap, text, vectors
from glasspane.operators import attention, checks, curves, filters, grid, joins, labels, ranks, resampling, splits, statistics

NAN = float("nan")


def one(df, column):
    return [r[0] for r in df.select(column.alias("v")).collect()]


# text


def test_stems_and_names(spark):
    df = spark.createDataFrame([("/a/b/x.tar.gz",), ("x",), ("a/.hidden",), ("dir.d/file",)], "p string")
    assert one(df, text.stem(F.col("p"))) == ["x.tar", "x", ".hidden", "file"]
    assert one(df, text.with_suffix(F.col("p"), ".tiff")) == ["/a/b/x.tar.tiff", "x", "a/.hidden", "dir.d/file"]


def test_ranges(spark):
    df = spark.createDataFrame([("1-11, 13-16",), ("7",)], "r string")
    assert one(df, text.parsed_ranges(F.col("r"))) == [[(1, 11), (13, 16)], [(7, 7)]]
    assert one(df, text.in_ranges(F.lit(12), text.parsed_ranges(F.col("r")))) == [False, False]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark.createDataFrame([("a-b",)], "r string"), text.parsed_ranges(F.col("r")))


def test_cells_keys_and_missing_values(spark):
    df = spark.createDataFrame([(1.2, "a_b_c", "2021", "007", None), (3.0, "x", "1999", "0100", NAN)], "c double, k string, y string, q string, v double")
    assert one(df, text.number_cell_items(F.col("c"))) == [["1", "2"], ["3", "0"]]
    assert one(df, text.last_token(F.col("k"))) == ["c", "x"]
    assert one(df, text.case_key(F.col("y"), F.col("q"))) == ["21/7", "99/100"]
    assert one(df, text.missing(F.col("v"), floating=True)) == [True, True]
    assert one(df, text.parameter_key({"a": 1, "b": F.col("q")})) == ["a=1_b=007", "a=1_b=0100"]
    assert one(df, text.group_or_null(F.col("k"), r"^(\w)_", 1)) == ["a", None]


def test_row_ids_are_stable(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "a int, b string")
    ids = one(df, text.row_id("a", "b"))
    assert ids[0] == ids[1] != ids[2]


# filters and labels


def test_threshold_filter_edges(spark):
    rows = [(0.5, 0.25), (0.51, 0.25), (0.51, 0.26), (NAN, 0.1), (0.9, NAN), (None, 0.1), (0.9, None)]
    df = spark.createDataFrame(rows, "tissue_roi_percentage double, blur_percentage double").withColumn("carcinoma_roi_percentage", F.lit(NAN))
    kept = filters.filter_tiles(df, {"tissue_roi_t": 0.5, "blur_t": 0.25}).collect()
    assert [(r[0], r[1]) for r in kept] == [(0.51, 0.25)]
    with pytest.raises(KeyError, match="blur_t"):
        filters.filter_tiles(df, {"tissue_roi_t": 0.5})
    assert filters.filter_tiles(df.where("false"), {"tissue_roi_t": 0.5, "blur_t": 0.25}).collect() == []


def test_strict_and_inclusive_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (NAN,), (None,)], "p double")
    assert one(df, labels.tile_label("p", 0.5)) == [False, True, False, False]
    assert one(df, labels.binary_prediction("p", 0.5)) == [True, True, False, False]


def test_stratified_filter_and_unknown_slides(spark):
    slides = spark.createDataFrame([("a", True), ("b", False)], "id string, carcinoma boolean")
    tiles = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "slide_id string, t boolean")
    kept = filters.stratified_filter(joins.with_slide_label(tiles, slides), "slide_label", "t").collect()
    assert sorted((r.slide_id, r.t) for r in kept) == [("a", True), ("b", False)]
    with pytest.raises(Exception, match="unknown slide c"):
        joins.with_slide_label(spark.createDataFrame([("c", True)], "slide_id string, t boolean"), slides).collect()


def test_missing_values_differ(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (None, None)], "p int, t int")
    assert filters.mispredictions(df, "p", "t").count() == 2
    assert one(spark.createDataFrame([(0.0,), (2.0,), (None,), (NAN,)], "g double"), labels.graded_positive(F.col("g"))) == [False, True, True, True]


def test_last_digit_label(spark):
    df = spark.createDataFrame([("x_1",), ("y0",)], "s string")
    assert one(df, filters.last_digit_label(F.col("s"))) == [True, False]
    with pytest.raises(Exception, match="no label in zz"):
        one(spark.createDataFrame([("zz",)], "s string"), filters.last_digit_label(F.col("s")))


def test_drop_of_a_missing_column(spark):
    with pytest.raises(KeyError, match="zzz"):
        checks.drop_columns(spark.range(1), "zzz")


CASES = "Biopsy_No string, Patient_ID string, Cancer_in_case string, Cancer_in_slides string, Perineural_invasion string, Gleason_score string, `ISUP_grade_ group` double"


def test_metadata_from_ranges(spark):
    cases = spark.createDataFrame(
        [("68/24 - 1-11,13-16", "p1", "Yes", "2, 13", "yes", " 3+4 ", 2.0), ("86/24  1-10", "p2", "no", None, None, None, None), ("68/24 - 20-22", "p1", "yes", None, "yes", "4+4", 4.0)], CASES
    )
    names = ["68-24-02-HE.czi", "68-24-13-HE.czi", "68-24-12-HE.czi", "86-24-1-HE.czi", "68-24-20-HE.czi", "other.czi", "99-24-1-HE.czi"]
    slides = spark.createDataFrame([(f"/d/{n}",) for n in names], "slide_path string")
    got = {r.slide_path[3:]: r for r in labels.metadata_from_ranges(slides, labels.parse_case_table(cases)).collect()}
    assert set(got) == {names[0], names[1], names[3], names[4]}
    a, b, c = got[names[1]], got[names[3]], got[names[4]]
    assert (a.carcinoma, a.case_carcinoma, a.isup_grade, a.gleason_score, a.perineural_invasions) == (True, True, 2.0, "3+4", True)
    assert (b.carcinoma, b.case_carcinoma, b.isup_grade, b.perineural_invasions) == (False, False, None, False)
    assert (c.carcinoma, c.case_carcinoma, c.gleason_score) == (False, True, None)
    with pytest.raises(Exception, match="can't parse index"):
        labels.parse_case_table(spark.createDataFrame([("bad", "p", "yes", "1", None, None, None)], CASES)).collect()
    twice = labels.parse_case_table(spark.createDataFrame([("1/24 - 1-5", "p", "no", None, None, None, None), ("1/24 - 5-9", "p", "no", None, None, None, None)], CASES))
    with pytest.raises(Exception, match="more than one case"):
        labels.metadata_from_ranges(spark.createDataFrame([("1-24-5-HE.czi",)], "slide_path string"), twice).collect()


def test_metadata_from_index(spark):
    cases = spark.createDataFrame([("21/7", " p1 ", "yes", "1, 3", "no", "3+3", 1.0), ("21/8", "p2", "no", None, None, None, None)], CASES)
    slides = spark.createDataFrame([(f"/d/{n}",) for n in ("2021_007-01.mrxs", "2021-7-03.mrxs", "2021_08-1.mrxs", "x.mrxs")], "slide_path string")
    got = {r.slide_path[3:]: (r.carcinoma, r.case_id, r.patient_id) for r in labels.metadata_from_index(slides, cases).collect()}
    assert got == {"2021_007-01.mrxs": (True, "21/7", "p1"), "2021-7-03.mrxs": (False, "21/7", "p1"), "2021_08-1.mrxs": (False, "21/8", "p2")}
    numeric = spark.createDataFrame([("21/7", "p", "yes", 1.2, None, None, None)], CASES.replace("Cancer_in_slides string", "Cancer_in_slides double"))
    assert labels.metadata_from_index(slides.where("slide_path like '%-01%'"), numeric).first().carcinoma
    with pytest.raises(Exception, match="no case 21/9"):
        labels.metadata_from_index(spark.createDataFrame([("2021_9-1.mrxs",)], "slide_path string"), cases).collect()


def test_listing_with_blacklist(spark):
    slides = spark.createDataFrame([("/d/a.tiff",), ("/d/b.tiff",), ("/d/c.tiff",)], "slide_path string")
    notes = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "stem string, value double")
    assert sorted(map(tuple, labels.labelled_listing(slides, notes, ["c"]).collect())) == [("/d/a.tiff", True), ("/d/b.tiff", False)]
    with pytest.raises(Exception, match="no annotation for c"):
        labels.labelled_listing(slides, notes, []).collect()


def test_prediction_table_order(spark):
    df = spark.createDataFrame([("a", 0.2, 0), ("b", 0.9, 0), ("c", 0.9, 1), ("d", None, 1)], "slide_name string, prediction double, target int")
    got = labels.prediction_table(df, 0.9).collect()
    assert [r.slide_name for r in got] == ["b", "c", "a", "d"] and [r.is_fp for r in got] == [True, False, False, False]


# joins


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "j int, g string")
    assert sorted(map(tuple, joins.join_one_to_one(a, b, "k", "j", ["g"]).collect())) == [(1, "x"), (2, "y")]
    more = a.union(spark.createDataFrame([(3,)], "k int"))
    with pytest.raises(Exception, match="missing g"):
        joins.join_one_to_one(more, b, "k", "j", ["g"]).collect()
    assert sorted(map(tuple, joins.join_one_to_one(more, b, "k", "j", ["g"], required=False).collect()))[2] == (3, None)
    for left, right in ((a, b.union(b)), (a.union(a), b)):
        with pytest.raises(Exception, match="isn't unique"):
            joins.join_one_to_one(left, right, "k", "j", ["g"]).collect()


def test_range_join(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 1, "a"), ("g", 4, "b"), ("g", 9, "c"), ("h", 1, "d"), (None, 1, "e")], "g string, n int, k string")
    cases = spark.createDataFrame([("g", [(1, 2), (2, 3)], "one"), ("g", [(1, 2), (2, 3)], "one"), ("g", [(4, 5)], "two"), ("g", [(20, 30)], "three")], "g string, ranges array<struct<start: int, end: int>>, case_id string")
    got = joins.range_join(rows, cases, "g", "n", "k")
    assert got.columns == ["g", "n", "k", "case_id"]
    assert sorted(map(tuple, got.collect())) == [("g", 1, "a", "one"), ("g", 1, "a", "one"), ("g", 4, "b", "two")]
    both = cases.union(spark.createDataFrame([("g", [(4, 4)], "also")], cases.schema))
    with pytest.raises(Exception, match="more than one case for b"):
        joins.range_join(rows, both, "g", "n", "k").collect()
    assert sorted(r.case_id for r in joins.range_join(rows, both, "g", "n", "k", exactly_one=False).collect()) == ["also", "one", "one", "two"]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_embeddings_by_place(spark):
    tiles = spark.createDataFrame([("s", 3), ("s", 1), ("t", 5)], "slide_id string, x int")
    vecs = spark.createDataFrame([("s", 1, [1.0]), ("s", 2, [2.0]), ("t", 1, [3.0])], "slide_id string, pos int, embedding array<double>")
    got = joins.attach_embeddings(joins.positions(tiles, "slide_id", ["x"]), vecs).collect()
    assert sorted((r.slide_id, r.x, r.embedding[0]) for r in got) == [("s", 1, 1.0), ("s", 3, 2.0), ("t", 5, 3.0)]
    numbered = joins.positions(tiles, "slide_id", ["x"])
    for t, v in ((numbered, vecs.where("pos = 1")), (numbered.where("slide_id = 's'"), vecs), (numbered, vecs.where("slide_id = 's'"))):
        found = joins.attach_embeddings(t, v)
        with pytest.raises(Exception, match="differ in number for"):
            found.collect()


def test_master_table(spark):
    a = spark.createDataFrame([("x", 0.1, 1), ("y", 0.2, 0)], "slide_name string, prediction double, target int")
    b = a.where("slide_name = 'x'").withColumn("target", F.lit(9))
    assert [tuple(r) for r in joins.master_table({"m__max": a, "m__topk": b}).collect()] == [("x", 1, 0.1, 0.1)]
    with pytest.raises(Exception, match="repeated slide_name"):
        joins.master_table({"m": a.union(a), "n": a}).collect()


def test_merge_ignores_row_order(spark):
    a = spark.createDataFrame([("x", 0.1, 1, True), ("y", 0.2, 0, False)], "slide_name string, prediction double, target int, is_fp boolean")
    got = joins.merged_predictions({"a": a, "b": a.orderBy(F.desc("slide_name"))}).collect()
    assert sorted(map(tuple, got)) == [("x", 1, 0.1, 0.1), ("y", 0, 0.2, 0.2)]
    with pytest.raises(Exception, match="isn't unique"):
        joins.merged_predictions({"a": a, "b": a.union(a)}).collect()


def test_repath(spark):
    slides = spark.createDataFrame([("/old/a.tiff", 1)], "path string, n int")
    assert joins.repathed(slides, spark.createDataFrame([("/new/a.mrxs",)], "path string")).first().path == "/new/a.mrxs"
    with pytest.raises(Exception, match="no path for a"):
        joins.repathed(slides, spark.createDataFrame([("/new/b.mrxs",)], "path string")).collect()


# grids


def random_cells(seed, w=7, h=9, keep=0.8):
    r = random.Random(seed)
    return {(x, y): round(r.random(), 3) for x in range(w) for y in range(h) if r.random() < keep}


@pytest.fixture(scope="module")
def cells(spark):
    grids = {f"s{i}": random_cells(i, keep=1.0 if i % 2 else 0.75) for i in range(12)} | {"dot": {(3, 4): 0.9}, "row": {(x, 0): 0.6 for x in range(5)}}
    rows = [(s, x, y, v) for s, g in grids.items() for (x, y), v in g.items()]
    return grids, spark.createDataFrame(rows, "slide_id string, gx int, gy int, score double")


@pytest.mark.parametrize("k, t", [(1, 0.99), (2, 0.7), (3, 0.5), (4, 0.4), (20, 0.0)])
def test_span(cells, k, t):
    grids, df = cells
    want = {}
    for s, g in grids.items():
        runs = [all(g.get((x + i * dx, y + i * dy), -1) >= t for i in range(k)) for x, y in g for dx, dy in ((1, 0), (0, 1))]
        want[s] = any(runs)
    assert {r.slide_id: r.prediction for r in grid.slide_span(df, k, t).collect()} == want


@pytest.mark.parametrize("k", [1, 2, 3, 10])
def test_pooling(cells, k):
    grids, df = cells
    got = {r.slide_id: r.prediction for r in grid.slide_mean_pool_max(df, k).collect()}
    for s, g in grids.items():
        xs, ys = [x for x, _ in g], [y for _, y in g]
        firsts = [(x, y) for x in range(min(xs), max(max(xs) - k + 1, min(xs)) + 1) for y in range(min(ys), max(max(ys) - k + 1, min(ys)) + 1)]
        best = max(sum(g.get((x + i, y + j), 0) for i in range(k) for j in range(k)) / k / k for x, y in firsts)
        assert math.isclose(got[s], best)


@pytest.mark.parametrize(("extent", "stride"), [(4, 1), (8, 4), (5, 3), (16, 16)])
def test_overlaps_of_any_size_equal_brute_force(spark, extent, stride):
    g = random.Random(extent)
    pixels = [(s, g.randint(-5, 40), g.randint(3, 30), g.choice("01a")) for s in range(3) for _ in range(150)] + [(9, 0, 0, "0")]
    places = [(s, x, y) for s in (0, 1, 5) for x in range(-8, 44, stride) for y in range(0, 36, stride)]
    found = grid.overlap_fractions(spark.createDataFrame(places * 2, "slide_id long, x int, y int"), spark.createDataFrame(pixels, "slide_id long, mx int, my int, cls string"), extent)
    got = {(r.slide_id, r.x, r.y): r.overlap for r in found.collect()}
    assert got.keys() == set(places)
    for s, x, y in places:
        inside = [c for t, mx, my, c in pixels if t == s and x <= mx < x + extent and y <= my < y + extent]
        assert got[s, x, y] == {c: inside.count(c) / len(inside) for c in set(inside)}


def test_overlaps_make_rows_of_cells_and_corners_only(spark):
    """Two pixels far apart and one tile: no row for what lies between them."""
    mask = spark.createDataFrame([(1, 0, 0, "a"), (1, 1 << 28, 1 << 28, "b")], "slide_id long, mx int, my int, cls string")
    found = grid.overlap_fractions(spark.createDataFrame([(1, (1 << 28) - 1, (1 << 28) - 2)], "slide_id long, x int, y int"), mask, 3)
    assert [r.overlap for r in found.collect()] == [{"b": 1.0}]


def test_windows_of_far_cells_are_few(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1 << 28, 1 << 28, 0.25)], "slide_id long, gx int, gy int, score double")
    assert grid.pooled_sums(cells, [2]).count() == 2
    assert grid.slide_top_k(cells, 2, 3).first().prediction == (0.5 + 0.25) / 4 / 2


def test_exploded_tiles_are_never_broadcast(spark):
    """Few slides look small to the planner, however many tiles they are cut into."""
    from glasspane.operators import tiling

    slides = spark.range(3).selectExpr("id", "40 extent_x", "40 extent_y", "10 tile_extent_x", "10 tile_extent_y", "5 stride_x", "5 stride_y")
    mask = tiling.Mask("tissue_roi", spark.createDataFrame([(0, 3, 3, "0"), (1, 12, 3, "1")], "slide_id long, mx int, my int, cls string"))
    found = tiling.tile_table(slides, [mask, tiling.Mask("blur", mask.pixels, centre=True)], 10)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    assert found.count() == 3 * 49 - 1


def test_overlaps_without_tiles_or_mask(spark):
    tiles, mask = "slide_id long, x int, y int", "slide_id long, mx int, my int, cls string"
    assert grid.overlap_fractions(spark.createDataFrame([], tiles), spark.createDataFrame([(1, 2, 3, "a")], mask), 4).collect() == []
    assert [r.overlap for r in grid.overlap_fractions(spark.createDataFrame([(1, 2, 3)], tiles), spark.createDataFrame([], mask), 4).collect()] == [{}]


def test_windows_of_all_sizes_equal_brute_force(spark):
    g = random.Random(8)
    held = {(s, gx, gy): g.random() for s, w, h in ((0, 9, 6), (1, 2, 12), (2, 1, 1), (3, 5, 5)) for gx in range(-1, w - 1) for gy in range(3, h + 3) if g.random() < 0.4 or (gx, gy) == (-1, 3)}
    rows = spark.createDataFrame([(*k, v) for k, v in held.items()], "slide_id long, gx int, gy int, score double")
    got = {(r.slide_id, r.kernel_size, r.wx, r.wy): r.score for r in grid.pooled_sums(rows, [1, 2, 3, 5, 7]).collect()}
    want = {}
    for s in range(4):
        xs, ys = [x for i, x, _ in held if i == s], [y for i, _, y in held if i == s]
        for k in (1, 2, 3, 5, 7):
            for wx in range(min(xs), max(max(xs) - k + 1, min(xs)) + 1):
                for wy in range(min(ys), max(max(ys) - k + 1, min(ys)) + 1):
                    inside = [held[s, wx + i, wy + j] for i in range(k) for j in range(k) if (s, wx + i, wy + j) in held]
                    if inside:
                        want[s, k, wx, wy] = sum(inside) / k**2
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert {k[2:]: v for k, v in got.items() if k[:2] == (0, 1)} == {k[1:]: v for k, v in held.items() if k[0] == 0}


def test_top_k_and_sweep(cells):
    grids, df = cells
    got = {r.slide_id: r.prediction for r in grid.slide_top_k(df, 1, 3).collect()}
    sweep = {(r.slide_id, r.k): r.prediction for r in grid.sweep_top_k(df, [1], [1, 3]).collect()}
    for s, g in grids.items():
        top = sorted(g.values(), reverse=True)[:3]
        assert math.isclose(got[s], sum(top) / len(top)) and sweep[s, 3] == got[s] and sweep[s, 1] == top[0]


def test_grid_of_small_slides(spark):
    slides = spark.createDataFrame([("a", 5, 20, 10, 10, 5, 5), ("b", 10, 20, 10, 10, 5, 5)], "id string, extent_x int, extent_y int, tile_extent_x int, tile_extent_y int, stride_x int, stride_y int")
    assert sorted(map(tuple, grid.grid_tiles(slides).collect())) == [("b", 0, 0), ("b", 0, 5), ("b", 0, 10)]
    assert grid.grid_tiles(slides, partial=True).where("slide_id = 'a'").count() == 4


def test_heatmap_skips_missing_scores(spark):
    tiles = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 0, 0.0), ("a", 1, 0, NAN), ("a", 9, 9, None)], "slide_id string, x int, y int, score double")
    got = {(r.gx, r.gy): r.score for r in grid.heatmap(tiles, 2, 1).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (1, 0): 0.5, (1, 1): 0.5, (2, 0): 0.0, (2, 1): 0.0}


def test_overlap_fractions(spark):
    tiles = spark.createDataFrame([("a", 1, 1), ("a", 8, 8)], "slide_id string, x int, y int")
    mask = spark.createDataFrame([("a", x, y, int(x > 2)) for x in range(6) for y in range(6)], "slide_id string, mx int, my int, cls int")
    got = {(r.x, r.y): r.overlap for r in grid.overlap_fractions(tiles, mask, 4).collect()}
    assert got == {(1, 1): {"0": 0.5, "1": 0.5}, (8, 8): {}}


def test_foreground(spark):
    df = spark.createDataFrame([({"0": 0.25, "255": 0.75},), ({"255": 1.0},), ({"0": None},), ({},)], "m map<string,double>")
    assert one(df, overlap.foreground(F.col("m"))) == [0.75, 1.0, 1.0, 1.0]


def test_empty_slides_count_zero(spark):
    tiles = spark.createDataFrame([("a", 0.6), ("a", 0.5), ("a", NAN)], "slide_id string, prediction double")
    slides = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(map(tuple, grid.num_positive(tiles, slides, 0.5).collect())) == [("a", 1), ("b", 0)]


def test_resolution(spark):
    df = spark.createDataFrame([(0.5, 0.52)], "x double, y double")
    assert one(df, overlap.resolution_scale(F.col("x"), F.col("y"), 0.25)) == [2.0]
    with pytest.raises(Exception, match="mpp_x and mpp_y differ"):
        one(df, overlap.resolution_scale(F.col("x"), F.col("y") * 2, 0.25))


# curves


def scored(n=300, seed=4, ties=40):
    r = random.Random(seed)
    return [(r.choice("ab"), r.randint(0, ties) / ties, int(r.random() < 0.4)) for _ in range(n)]


def test_auc_is_the_share_of_ordered_pairs(spark):
    rows = scored()
    df = spark.createDataFrame([*rows, ("a", NAN, 1), ("b", None, 0), ("b", 0.5, None)], "g string, s double, t int")
    brute = lambda rs: np.mean([(a > b) + (a == b) / 2 for _, a, x in rs for _, b, y in rs if x == 1 and y == 0])
    got = {r.g: r.auc for r in curves.roc_auc(df, "s", "t", ["g"]).collect()}
    for g in "ab":
        assert math.isclose(got[g], brute([r for r in rows if r[0] == g]), rel_tol=1e-12)
    assert math.isclose(curves.roc_auc(df, "s", "t").first().auc, brute(rows), rel_tol=1e-12)
    reverse = curves.roc_auc(df.withColumn("s", -F.col("s")), "s", "t").first().auc
    assert math.isclose(reverse, 1 - brute(rows), rel_tol=1e-9)
    assert curves.roc_auc(df.where("t = 1"), "s", "t").first().auc is None
    assert curves.roc_points(df.where("false"), "s", "t").count() == 1


def test_thresholds_equal_brute_force(spark):
    rows = scored(seed=9, ties=15)
    df = spark.createDataFrame(rows, "g string, s double, t int")
    s, t = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    thresholds = sorted(set(s), reverse=True)
    tpr, fpr = [[((s >= x) & (t == c)).sum() / (t == c).sum() for x in thresholds] for c in (1, 0)]
    j = np.array(tpr) - np.array(fpr)
    assert curves.j_threshold(df, "s", "t").first().threshold == (thresholds[int(j.argmax())] if j.max() > 0 else math.inf)
    assert curves.full_sensitivity_threshold(df, "s", "t").first().threshold == thresholds[tpr.index(1.0)]
    p = np.array([t[s >= x].mean() for x in thresholds])
    f1 = 2 * p * tpr / (p + tpr + 1e-8)
    assert curves.best_f1_threshold(df, "s", "t").first().threshold == min(x for x, f in zip(thresholds, f1, strict=True) if f == f1.max())
    points = curves.roc_points(df, "s", "t")
    assert curves.nearest_threshold(points, 0.5, descending=True).first().threshold == min(thresholds, key=lambda x: (abs(x - 0.5), -x))


def test_worse_than_chance_chooses_infinity(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 0)], "s double, t int")
    assert curves.j_threshold(df, "s", "t").first().threshold == math.inf


def test_corners(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0), (0.4, 1)], "s double, t int")
    kept = sorted(r.threshold for r in curves.roc_points(df, "s", "t", drop_intermediate=True).collect())
    assert kept == [0.4, 0.5, 0.7, 0.9, math.inf]


def test_metrics_without_rows_are_zero(spark):
    df = spark.createDataFrame([], "p boolean, t boolean")
    assert curves.confusion_metrics(df, "p", "t").first()["precision"] == 0.0
    assert curves.confusion_matrix(df, "p", "t").count() == 4


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.999,), (0.05,), (-0.1,), (1.1,), (NAN,), (None,)], "s double")
    assert {r.bin: r.n for r in curves.score_histogram(df, "s").collect()} == {0: 1, 1: 1, 19: 2}


def test_missing_parameter_column(spark):
    df = spark.createDataFrame([(1, 0.5)], ["t", "pred_a=1"])
    with pytest.raises(KeyError, match="a=2"):
        curves.sweep_auc(df, "t", {"a=2": "pred_a=2"})


# ranks, splits, statistics


@pytest.mark.parametrize("rows", [3, 30, 10_000])
def test_ranks_and_running_sums(spark, monkeypatch, rows):
    """All groups in many buckets, one of two, and all sorted whole."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", rows)
    df = spark.createDataFrame([("a" if i % 8 else "b", i, float(i * i % 101) + i / 1000) for i in range(200)], "g string, i int, x double")
    got = ranks.hash_rank(df, ["g"], ["i"], 1).collect()
    for g in "ab":
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(1, sum(r.g == g for r in got) + 1))
    assert {r.i: r["rank"] for r in got if r.g == "b"} == {r.i: n + 1 for n, r in enumerate(df.where("g = 'b'").orderBy(ranks.hashed(1, "i")).collect())}
    for r in ranks.running_sums(df, ["g"], "x", ["i"]).collect():
        above = sorted((y.x, y.i) for y in got if y.g == r.g)[::-1]
        at = above.index((r.x, r.i))
        assert r.cum_i == sum(i for _, i in above[: at + 1]) and r.all_i == sum(i for _, i in above)
        assert r.first == (at == 0) and r.next_i == (above[at + 1][1] if at + 1 < len(above) else None)
    for r in ranks.ordered_rank(df, ["g"], ["x"]).collect():
        assert r["rank"] == sum(y.x <= r.x for y in got if y.g == r.g)
    assert [r["rank"] for r in ranks.ordered_rank(df, [], ["x"]).orderBy("x").collect()] == list(range(1, 201))


def test_buckets_are_alike_however_keys_are_spread(spark, monkeypatch):
    """Keys below 0.02 and one of a billion; and keys close to 1. They grow in number with the rows."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 200)
    for keys in ([(i / 1e6,) for i in range(20_000)] + [(1e9,)], [(1 - 1 / (1 + i),) for i in range(20_000)], [(float(i),) for i in range(3000)]):
        df = spark.createDataFrame(keys, "x double")
        sizes = [r["count"] for r in ranks.bucketed(df, [], "x").groupBy("__bucket").count().collect()]
        assert len(sizes) > 0.9 * len(keys) / 200 and max(sizes) < 2.5 * 200


def test_a_million_small_groups_need_no_sketch(spark):
    """One large group among very many small ones: only the large one is cut."""
    df = spark.range(1_000_000).select(F.when(F.col("id") < 40_000, -1).otherwise(F.col("id") % 900_000).alias("g"), F.col("id").cast("double").alias("x"))
    assert ranks.large_groups(df, ["g"]).collect() == [(-1, 3)]
    ranked = ranks.ordered_rank(df, ["g"], ["x"])
    assert ranked.where("g = -1").agg(F.max("rank"), F.count_distinct("rank")).first() == (40_000, 40_000)
    assert ranked.where("g >= 0").agg(F.max("rank"), F.count("*")).first() == (2, 960_000)


def test_ranks_of_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, i int")
    assert sorted((str(r.g), r.i, r["rank"]) for r in ranks.ordered_rank(df, ["g"], ["i"]).collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 3, 1)]


def test_draws_are_even_and_equal_to_plain_arithmetic(spark):
    def plain(x, n, seed):
        u = []
        for p in ranks.PRIMES:
            v = pow((x % p + seed) % p, 5, p)
            u.append(pow((v * 7919 + 104729) % p, 5, p))
        return (u[0] * 2**31 + u[1]) % n

    got = ranks.draws(spark.range(0, 10**12, 10**7), F.col("id"), F.lit(97), "d", 42).collect()
    assert all(r.d == plain(r.id, 97, 42) for r in got)
    share = [0] * 97
    for r in got:
        share[r.d] += 1
    expected = len(got) / 97
    assert sum((s - expected) ** 2 / expected for s in share) < 160  # chi squared, 96 degrees: beyond 1 in 10,000


def test_stratified_split_sizes(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 7, 2)]) for i in range(101)], "i int, c string")
    got = splits.stratified_split(df, "c", ["i"], 0.3).collect()
    n = {c: sum(r.c == c for r in got) for c in "abc"}
    test = {c: sum(r.c == c and r.split == "test" for r in got) for c in "abc"}
    assert len(got) == 101 and sum(test.values()) == math.ceil(101 * 0.3) and all(abs(test[c] - n[c] * 31 / 101) < 1 for c in n)
    again = splits.stratified_split(df.repartition(3), "c", ["i"], 0.3).collect()
    assert {(r.i, r.split) for r in got} == {(r.i, r.split) for r in again}


def test_group_folds(spark):
    r = random.Random(3)
    rows = [(g, int(r.random() < 0.3)) for g in range(60) for _ in range(r.randint(1, 6))]
    df = spark.createDataFrame([(i, g, c) for i, (g, c) in enumerate(rows)], "i int, g int, c int")
    got = splits.with_folds(df, "c", "g", 5).collect()
    assert len(got) == len(rows) and all(row.fold is not None for row in got)
    assert len({(row.g, row.fold) for row in got}) == 60
    share = sum(c for _, c in rows) / len(rows)
    for f in range(5):
        own = [row.c for row in got if row.fold == f]
        assert abs(len(own) - len(rows) / 5) < 0.25 * len(rows) / 5 and abs(sum(own) / len(own) - share) < 0.08
    checks.assert_no_leak(splits.with_folds(df, "c", "g", 5), "g")
    with pytest.raises(ValueError, match="more than one fold"):
        checks.assert_no_leak(df.withColumn("fold", F.col("i") % 2), "g")


@pytest.mark.parametrize("spread", [1.5, 4.0, 7.0])
def test_folds_by_kinds_are_about_as_even_as_one_by_one(spark, spread):
    """Many groups of very unlike sizes, hardly two alike in their counts: few kinds, and class shares
    by fold nearly as even as when every group is dealt by itself."""
    r = random.Random(11)
    sizes = [(max(0, int(r.lognormvariate(2, spread / 2))) % 3000, max(0, int(r.lognormvariate(1, spread / 2))) % 2000) for _ in range(600)]
    rows = [(g, c, n) for g, own in enumerate(sizes) for c, n in enumerate(own) if n]
    df = spark.createDataFrame(rows, "g int, c int, n int").select("g", "c", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    fold = {x.g: x.fold for x in splits.group_folds(df, "c", "g", 5).collect()}
    used = [g for g, own in enumerate(sizes) if sum(own)]
    assert sorted(fold) == used

    def worst(found):
        total = np.array([[sum(sizes[g][c] for g in used if found[g] == f) for c in (0, 1)] for f in range(5)], float)
        return np.abs(total / total.sum(0) - 0.2).max()

    exact = sorted({sizes[g] for g in used})
    quota = splits._deal(np.array(exact, float), np.array([sum(sizes[g] == e for g in used) for e in exact]), 5)
    order = {e: [f for f in range(5) for _ in range(quota[i, f])] for i, e in enumerate(exact)}
    single = worst({g: order[sizes[g]].pop() for g in used})
    assert worst(fold) < max(2.5 * single, 0.015), (worst(fold), single)
    again = splits.group_folds(df.repartition(7), "c", "g", 5).collect()
    assert {x.g: x.fold for x in again} == fold


def test_counts_keep_their_leading_bits(spark):
    values = [0, 1, 15, 16, 17, 31, 32, 35, 1000, 2**40 + 12345]
    got = one(spark.createDataFrame([(v,) for v in values], "v bigint"), splits._kind(F.col("v")))
    assert got == [v >> max(v.bit_length() - 4, 0) << max(v.bit_length() - 4, 0) for v in values]


def test_group_split(spark):
    df = spark.createDataFrame([(i, i // 4, i % 2) for i in range(200)], "i int, g int, c int")
    got = splits.group_split(df, "c", "g", 0.2).collect()
    assert sum(r.split == "test" for r in got) == 40 and len({(r.g, r.split) for r in got}) == 50
    with pytest.warns(UserWarning, match="not 0.42"):
        splits.group_split(df, "c", "g", 0.42)
    with pytest.raises(ValueError, match="single fold"):
        splits.group_split(df, "c", "g", 0.9)


def test_weights_and_sampling(spark):
    df = spark.createDataFrame([(i, "x" if i < 90 else "y") for i in range(100)], "i int, c string")
    assert math.isclose(splits.inverse_class_weights(df, "c").agg(F.sum("weight")).first()[0], 2.0)
    drawn = splits.weighted_sample(df, "c", ["i"], 2000).collect()
    assert len(drawn) == 2000 and abs(sum(r.c == "y" for r in drawn) - 1000) < 150


def test_distances(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in v], "v string") for v in ("aabb", "abbb", "aaaa"))
    assert statistics.distribution_distance(a, b, "v").first().distance == 0.5
    assert statistics.distribution_distance(a, c, "v").first().distance == math.inf


def test_moments_skip_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, NAN), (None, 4.0)], "r double, g double")
    assert {x.channel: (x.n, x.mean, x["std"]) for x in statistics.channel_moments(df, ["r", "g"]).collect()} == {"r": (2, 2.0, 1.0), "g": (2, 3.0, 1.0)}


def test_inverse_cdf(spark):
    values = [0.0, 0.01, 0.5, 0.505050505, 1.0, 1.5, -1.0] + [i / 99 for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values] + [(NAN,), (None,)], "s double")
    for r in statistics.inverse_cdf(df, "s").collect():
        assert r.n == sum(v > r.threshold for v in values), r


def test_bootstrap(spark):
    rows = [(i, i % 2, i % 2 + random.Random(i).random(), random.Random(-i).random()) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, t int, base double, other double")
    deltas = statistics.bootstrap_auc_differences(df, "k", "t", "base", "other", 50)
    got = statistics.non_inferiority(deltas).first()
    assert got.n == 50 and got.mean_delta < -0.3 and got.non_inferior and got.ci_95_lower <= got.mean_delta <= got.ci_95_upper
    assert all(r.delta == 0 for r in statistics.bootstrap_auc_differences(df, "k", "t", "base", "base", 5).collect())


@pytest.mark.parametrize("held", [0, 10**6])
def test_resampled_table_equals_brute_force(spark, monkeypatch, held):
    """The draws, taken one by one in Python: ties, missing scores and targets, all models at once;
    folded as arrays, and by joins as for more rows than a task holds."""
    monkeypatch.setattr(statistics, "HELD_ROWS", held)
    from glasspane.operators.ranks import hash_rank

    r, n, boot = random.Random(3), 37, 60
    odd = lambda v: r.choice([v, v, v, v, v, None, NAN, float("inf")])
    rows = [(i, r.choice([0, 1, 1, None]), *(odd(float(r.randrange(m))) for m in (4, 50, 9, 50))) for i in range(n)]
    df = spark.createDataFrame(rows, "slide_name int, target int, a__max double, a__mpm double, b__max double, b__mpm double")
    place = {x.place: x.slide_name for x in hash_rank(df.withColumn("all", F.lit(0)), ["all"], ["slide_name"], 42, "place").collect()}
    draws = [place[x.p + 1] for x in ranks.draws(spark.range(n * boot), F.col("id"), F.lit(n), "p", 42).orderBy("id").collect()]

    def auc(some, column):
        seen = [(x[1], x[column]) for x in some if x[1] is not None and x[column] is not None and abs(x[column]) < float("inf")]
        pos, neg = [s for t, s in seen if t], [s for t, s in seen if not t]
        return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None

    want = {}
    for model, base in (("a", 2), ("b", 4)):
        pairs = [(auc(some, base), auc(some, base + 1)) for k in range(boot) for some in [[rows[i] for i in draws[k * n : k * n + n]]]]
        want[model] = [o - b for b, o in pairs if b is not None and o is not None]
    got = {x.model: x for x in statistics.non_inferiority_table(df, ["a", "b"], ["mpm"], boot).collect()}
    for model, deltas in want.items():
        assert got[model].n == len(deltas) and got[model].mean_delta == pytest.approx(sum(deltas) / len(deltas))
    deltas = statistics.bootstrap_auc_differences(df, "slide_name", "target", "a__max", "a__mpm", boot)
    assert sorted(x.delta for x in deltas.collect()) == pytest.approx(sorted(want["a"]))
    assert statistics.bootstrap_auc_differences(df.where("false"), "slide_name", "target", "a__max", "a__mpm", 5).collect() == []


def test_draws_as_arrays_are_those_as_columns(spark):
    for first, n in ((0, 1), (5, 37), (10**9 * 7, 99_991), (2**61, 12)):
        want = [r.p for r in ranks.draws(spark.range(first, first + 50), F.col("id"), F.lit(n), "p", 42).orderBy("id").collect()]
        assert resampling.drawn(first, 50, n, 42).tolist() == want


def test_areas_along_an_order():
    import pandas as pd

    g = np.random.default_rng(4)
    rows = pd.DataFrame({"side": 0, "kind": np.arange(40) * 3, "target": g.integers(0, 2, 40), "score": g.integers(0, 9, 40).astype(float)})
    counts = g.integers(0, 4, (40, 7)).astype(float)
    counts[rows["target"] == 1, 6] = 0
    order = resampling.order_of_score(rows.sample(frac=1, random_state=1)).iloc[0]
    at = {c: np.frombuffer(order[c], np.int64) for c in ("positive", "below", "upto", "negative")}
    got = resampling.areas(counts, at["positive"] // 3, at["below"], at["upto"], at["negative"] // 3)
    for j in range(6):
        pairs = [(counts[a, j] * counts[b, j], rows["score"][a], rows["score"][b]) for a in range(40) for b in range(40) if rows["target"][a] and not rows["target"][b]]
        assert math.isclose(got[j], sum(w * ((p > q) + (p == q) / 2) for w, p, q in pairs) / sum(w for w, _, _ in pairs))
    assert math.isnan(got[6])


@pytest.mark.parametrize("name", ["bootstrap_ni", "ni_table"])
def test_registered_comparisons_draw_as_often_as_the_reference(spark, name):
    from glasspane.plans import registry

    assert {x.n for x in registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()} == {10_000}


def test_partitions(spark):
    ids = spark.range(10)
    checks.assert_partition(ids, [ids.where("id < 4"), ids.where("id >= 4")], "id")
    with pytest.raises(ValueError, match="share"):
        checks.assert_partition(ids, [ids.where("id < 5"), ids.where("id >= 4")], "id")
    with pytest.raises(ValueError, match="add up"):
        checks.assert_partition(ids, [ids.where("id < 4")], "id")


# vectors and attention


def test_vector_expressions(spark):
    v = [[1.0, -2.0], [3.0, 4.0], [5.0, 0.0]]
    df = spark.createDataFrame([(v, v[0])], "t array<array<double>>, e array<double>")
    assert one(df, vectors.mean_vector(F.col("t"))) == [[3.0, 2 / 3]]
    assert one(df, vectors.cls_and_mean(F.col("t"), 2)) == [[1.0, -2.0, 4.0, 2.0]]
    assert one(df, vectors.max_pooled(F.col("t"))) == [[1.0, 4.0, 5.0]]
    assert one(df, vectors.padded(F.col("t"), 4, 2)) == [[*v, [0.0, 0.0]]] and one(df, vectors.padded(F.col("t"), 2, 2)) == [v]
    assert one(df, vectors.normalised(F.col("e"), [1.0, 0.0], [2.0, 4.0])) == [[0.0, -0.5]]
    assert one(df, vectors.dot(F.col("e"), [2.0, 3.0], 1.0)) == [-3.0]
    weights, bias = np.array([[1.0, 2.0], [0.0, 1.0], [1.0, 1.0]]), np.array([0.0, 1.0, 2.0])
    assert one(df, vectors.layer(weights, bias)(F.col("e"))) == [[-3.0, -1.0, 1.0]]


def test_loss_does_not_overflow(spark):
    df = spark.createDataFrame([(800.0, 0), (-800.0, 1), (0.3, 1)], "z double, t int")
    got = one(df, vectors.bce_with_logits(F.col("z"), F.col("t"), 2.0))
    assert got[:2] == [800.0, 1600.0] and math.isclose(got[2], -2 * math.log(1 / (1 + math.exp(-0.3))))


def test_attention_ignores_padding(spark):
    r = np.random.default_rng(0)
    bag = {k: np.concatenate([r.normal(size=(n, 4)), np.zeros((2, 4))]) for k, n in (("a", 5), ("b", 1))}
    df = spark.createDataFrame([(k, i, x.tolist()) for k, m in bag.items() for i, x in enumerate(m)], "bag string, i int, embedding array<double>")
    wa, wc = [0.5, -1.0, 2.0, 0.1], [1.0, 1.0, -1.0, 0.5]
    got = {x.bag: x for x in attention.bag_scores(df, "bag", (wa, 0.2), (wc, -0.1)).collect()}
    rows = attention.attended(df, "bag", (wa, 0.2), (wc, -0.1)).collect()
    for k, m in bag.items():
        m = m[:-2]
        a, c = m @ wa + 0.2, m @ wc - 0.1
        w = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
        assert math.isclose(got[k].logit, w @ c) and got[k].n == len(m)
        assert np.allclose([x.weight for x in sorted(rows, key=lambda x: x.i) if x.bag == k], w)


def test_min_max_of_equal_values_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    assert sorted(map(str, one(attention.min_max(df, "x", ["g"], "s"), F.col("s")))) == ["0.0", "1.0", "None", "None"]


def test_softmax_with_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), ("b", 800.0), ("b", -800.0)], "g string, x double")
    got = attention.softmax(df, "x", ["g"], "w")
    assert got.columns == ["g", "x", "w"] and sorted(r.w for r in got.collect()) == [0.0, 0.5, 0.5, 1.0]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_functions_of_bags(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, x double")
    got = attention.map_bags(df, "g", lambda bag: bag.assign(x=bag.x - bag.x.mean()), "g string, x double").collect()
    assert sorted(map(tuple, got)) == [("a", -1.0), ("a", 1.0), ("b", 0.0)]


def test_masks_by_name(spark):
    from glasspane.operators import tiling

    pixels = spark.createDataFrame([("s", 0, 0, "7"), ("s", 1, 0, "0")], "slide_id string, mx int, my int, cls string")
    tiles = spark.createDataFrame([("s", 0, 0)], "slide_id string, x int, y int")

    @tiling.kind_of_mask("sevens")
    def _sevens(name, m):
        return {f"{name}_percentage": overlap.fraction(m, "7")}

    try:
        (mask,) = tiling.configured([{"name": "seven", "kind": "sevens"}], {"seven": pixels})
        assert tiling.with_mask(tiles, mask, 2).first().seven_percentage == 0.5
    finally:
        del tiling.KINDS["sevens"]
    with pytest.raises(ValueError, match="no such kind of mask: sevens; there are foreground, hybrid, marked"):
        tiling.configured([{"name": "seven", "kind": "sevens"}], {"seven": pixels})
    with pytest.raises(TypeError):
        tiling.configured([{"name": "seven", "form": "x"}], {"seven": pixels})


def test_sweeps(spark):
    cells = spark.createDataFrame([("s", x, 0, v) for x, v in enumerate([0.9, 0.8, 0.1, 0.7])] + [("t", 0, 0, 0.2)], "slide_id string, gx int, gy int, score double")
    got = {(r.slide_id, r.k, r.threshold): r.prediction for r in grid.sweep_span(cells, [1, 2, 3], [0.05, 0.75]).collect()}
    assert len(got) == 12
    for (slide, k, t), hit in got.items():
        assert hit == bool({r.slide_id: r.prediction for r in grid.slide_span(cells, k, t).collect()}[slide])
    long = {(r.slide_id, r.kernel_size): r.prediction for r in grid.sweep_mean_pool_max(cells, [1, 2]).collect()}
    assert long == {(r.slide_id, k): r.prediction for k in (1, 2) for r in grid.slide_mean_pool_max(cells, k).collect()}


def test_bag_loss(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 9.0, False), ("b", 3.0, True), ("b", 5.0, True), ("c", 7.0, False)], "g string, l double, m boolean")
    assert attention.masked_bag_loss(df, "g", "l", "m").first().loss == (1.0 + 4.0 + 0.0) / 3
    ordered = attention.bags(df.select("g", F.col("l").alias("o"), F.array("l").alias("embedding")), "g", "o").where("g = 'b'").first().embeddings
    assert ordered == [[3.0], [5.0]]
