"""Integer geometry on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column) -> Column:
    """Floor of a / b for any sign of a; exact while |a| is below 2**53."""
    return F.floor(a / b).cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def tile_span(start: Column, extent: Column, tile: Column, count: Column) -> tuple[Column, Column]:
    """First tile and the one after the last that [start, start + extent) touches, clamped to the grid."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(c, count))
    return clamp(floor_div(start, tile)), clamp(ceil_div(start + extent, tile))


def span_array(start: Column, end: Column) -> Column:
    """start to end - 1; empty when there is none (a plain sequence would run backwards)."""
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))


def edge_extent(index: Column, tile: Column, total: Column) -> Column:
    """What a tile at this index covers of a level that ends at total."""
    return F.least(tile, F.greatest(total - index * tile, F.lit(0)))
