"""Arithmetic of cell ids: row-major ids in the width x width grid, and in its central third."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_of(dem_id: Column, width: int) -> Column:
    return F.floor(dem_id / width).cast("int")


def column_of(dem_id: Column, width: int) -> Column:
    return (dem_id % width).cast("int")


def is_computable(dem_id: Column, width: int) -> Column:
    """Strictly inside the circle about the central third."""
    reach = width // 3
    radius = (reach - 1) / 2
    y, x = row_of(dem_id, width) - reach - F.lit(radius), column_of(dem_id, width) - reach - F.lit(radius)
    return y * y + x * x < radius * radius


def in_central_square(dem_id: Column, width: int) -> Column:
    reach = width // 3
    return row_of(dem_id, width).between(reach, 2 * reach - 1) & column_of(dem_id, width).between(reach, 2 * reach - 1)


def tvs_id(dem_id: Column, width: int) -> Column:
    """Id in the central third; -1 outside the circle."""
    reach = width // 3
    inner = (row_of(dem_id, width) - reach) * reach + column_of(dem_id, width) - reach
    return F.when(is_computable(dem_id, width), inner).otherwise(F.lit(-1)).cast("int")


def dem_id_of(tvs: Column, width: int) -> Column:
    reach = width // 3
    return ((F.floor(tvs / reach) + reach) * width + tvs % reach + reach).cast("long")


def turned(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    """A point turned counter-clockwise about the origin, y up."""
    cos, sin = F.lit(math.cos(math.radians(degrees))), F.lit(math.sin(math.radians(degrees)))
    return x * cos - y * sin, x * sin + y * cos


def nearest_cell(x: Column, y: Column, width: int) -> Column:
    """The id of the cell nearest to fractional grid coordinates."""
    return (away_from_zero(y) * width + away_from_zero(x)).cast("long")


def neighbourhood_id(dem_id: Column, width: int, size: int) -> Column:
    """The block of sqrt(size) x sqrt(size) cells a cell lies in; blocks are counted along rows."""
    side = math.isqrt(size)
    per_row = width // side
    return (F.floor(row_of(dem_id, width) / side) * per_row + F.floor(column_of(dem_id, width) / side)).cast("long")


def away_from_zero(value: Column) -> Column:
    """Round half away from zero."""
    return F.signum(value) * F.floor(F.abs(value) + 0.5)
