"""From slides to filtered tiles with mask percentages, and from those to folds: the two long
preparations, each one lazy plan.

A mask is a specification with its pixels as a relation (slide_id, mx, my, cls). Masks are
applied tissue first, and tiles without tissue go before the other masks are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspane.functions import overlap
from glasspane.operators import checks, filters, grid, joins, splits


@dataclass(frozen=True)
class Mask:
    """name: prefix of the percentage column. kind: "foreground" (1 less class 0), "marked" (class
    255), "hybrid" (tissue and carcinoma from classes 0 to 5) or one registered with kind_of_mask.
    centre: only the tile's middle."""

    name: str
    pixels: DataFrame
    kind: str = "foreground"
    centre: bool = False

    def columns(self) -> dict[str, Column]:
        if self.kind not in KINDS:
            raise ValueError(f"no such kind of mask: {self.kind}; there are {', '.join(sorted(KINDS))}")
        return KINDS[self.kind](self.name, F.col("overlap"))


#: How the columns of a mask come from its overlap, by the name that a configuration gives.
KINDS: dict[str, Callable[[str, Column], dict[str, Column]]] = {}


def kind_of_mask(name: str):
    """Register a function (mask name, overlap) to columns as a kind of mask."""

    def add(f: Callable[[str, Column], dict[str, Column]]):
        KINDS[name] = f
        return f

    return add


@kind_of_mask("foreground")
def _foreground(name: str, m: Column) -> dict[str, Column]:
    return {f"{name}_percentage": overlap.foreground(m)}


@kind_of_mask("marked")
def _marked(name: str, m: Column) -> dict[str, Column]:
    return {f"{name}_percentage": overlap.fraction(m, "255")}


@kind_of_mask("hybrid")
def _hybrid(name: str, m: Column) -> dict[str, Column]:
    return overlap.hybrid_percentages(F.transform_keys(m, lambda k, _: k.cast("int")))


def configured(specifications: Sequence[Mapping[str, object]], pixels: Mapping[str, DataFrame]) -> list[Mask]:
    """Masks from configuration entries (name, kind, centre) and the pixels of each name; an unknown
    kind or field is an error here, not when tiles are read."""
    masks = [Mask(pixels=pixels[str(s["name"])], **s) for s in specifications]
    for m in masks:
        m.columns()
    return masks


def with_mask(tiles: DataFrame, mask: Mask, extent: int, of: DataFrame | None = None) -> DataFrame:
    """tiles with the percentages of one mask, counted for the tiles `of` (among which they are) if given: a table that
    is cheaper to make again than one with other masks joined."""
    box = overlap.region(F.lit(0), F.lit(0), extent, mask.centre)
    shift, side = (extent // 4, extent // 2) if mask.centre else (0, extent)
    regions = (tiles if of is None else of).select("slide_id", (F.col("x") + box["left"]).alias("x"), (F.col("y") + box["top"]).alias("y"))
    found = grid.overlap_maps(regions, mask.pixels, side)
    found = found.select("slide_id", (F.col("x") - shift).alias("x"), (F.col("y") - shift).alias("y"), "overlap")
    return grid.with_overlap(tiles, found).withColumns(mask.columns()).drop("overlap")


def tile_table(slides: DataFrame, masks: Sequence[Mask], extent: int) -> DataFrame:
    """Tiles of all slides (whose tiles have that extent) with the percentages of all masks, in
    columns sorted by name; tiles without tissue are left out."""
    # few slides are many tiles: they are spread before they are cut
    tiles = cut = grid.grid_tiles(slides.repartition("id"))
    for mask in sorted(masks, key=lambda m: (m.kind != "hybrid" and filters.TISSUE not in m.name, m.name)):
        tiles = with_mask(tiles, mask, extent, cut)
        if "tissue_roi_percentage" in mask.columns():
            tiles = filters.drop_empty_tissue(tiles)
    return tiles.select("slide_id", "x", "y", *sorted(c for c in tiles.columns if c.endswith("_percentage")))


def with_group_folds(slides: DataFrame, metadata: DataFrame, label: str, group: str, k: int, path: str = "path", metadata_path: str = "slide_path") -> DataFrame:
    """slides with a fold by group: the group is looked up one to one in the metadata, missing
    groups and groups in two folds raise when the row is read."""
    grouped = joins.join_one_to_one(slides, metadata, path, metadata_path, [group])
    folds = splits.with_folds(grouped, label, group, k)
    checked = checks.without_leak(folds, group)
    return checked.select(*slides.columns, F.when(F.col("fold").isNotNull(), F.col("fold")).otherwise(F.raise_error(F.lit("no fold for a slide")).cast("int")).alias("fold"))
