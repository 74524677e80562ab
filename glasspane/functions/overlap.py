"""Fractions of a tile by mask class, from map columns (class to fraction)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(overlap: Column, key: str | int) -> Column:
    """Share of a class; 0 if the key is missing or its value null."""
    return F.coalesce(F.try_element_at(overlap, F.lit(key)), F.lit(0.0))


def foreground(overlap: Column) -> Column:
    """1 less the share of class "0"; a missing or null share counts as none."""
    return 1.0 - fraction(overlap, "0")


def hybrid_percentages(overlap: Column) -> dict[str, Column]:
    """Columns of a mask with classes 0 (background) to 5 (grades 3, 4, 5 are carcinoma)."""
    return {
        "tissue_roi_percentage": 1.0 - fraction(overlap, 0),
        "carcinoma_roi_percentage": fraction(overlap, 3) + fraction(overlap, 4) + fraction(overlap, 5),
    }


def region(x: Column, y: Column, extent: int, centre: bool) -> dict[str, Column]:
    """The whole tile, or its centred half, as left, top, width, height."""
    offset, side = (extent // 4, extent // 2) if centre else (0, extent)
    return {"left": x + offset, "top": y + offset, "width": F.lit(side), "height": F.lit(side)}


def remapped(cls: Column, groups: Mapping[str, Sequence[int]]) -> dict[str, Column]:
    """For each named group 255 where the class is in it, else 0."""
    return {name: F.when(cls.isin(*members), 255).otherwise(0) for name, members in groups.items()}


def resolution_scale(mpp_x: Column, mpp_y: Column, desired: float, relative: float = 0.1) -> Column:
    """mpp_x / desired; raises where the two axes differ by more than the tolerance."""
    alike = F.abs(mpp_x - mpp_y) <= relative * F.greatest(F.abs(mpp_x), F.abs(mpp_y))
    return F.when(alike, mpp_x / desired).otherwise(F.raise_error(F.lit("mpp_x and mpp_y differ")).cast("double"))
