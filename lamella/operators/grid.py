"""Tile grids: which tiles a region touches, what a tile shows, which tiles to select.

Range joins are written as two exploded index spans per request: no shuffle, no theta join, and the number of rows is
the number of hits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.geometry import edge_extent, span_array, tile_span


def regular_hits(requests: DataFrame, keep_empty: bool = False) -> DataFrame:
    """requests: x, y, w, h and the level's tile_w, tile_h, tiles_across, tiles_down. Adds col, row, dest_x, dest_y, in
    row-major order by ``ordinal``. Grids without tiles give no hits."""
    c = F.col
    c0, c1 = tile_span(c("x"), c("w"), c("tile_w"), c("tiles_across"))
    r0, r1 = tile_span(c("y"), c("h"), c("tile_h"), c("tiles_down"))
    explode = F.explode_outer if keep_empty else F.explode
    spans = requests.withColumns({"c0": c0, "c1": c1, "r0": r0, "r1": r1})
    rows = spans.withColumn("row", explode(span_array(c("r0"), c("r1"))))
    hits = rows.withColumn("col", explode(span_array(c("c0"), c("c1"))))
    return hits.withColumns(
        {"dest_x": c("col") * c("tile_w") - c("x"), "dest_y": c("row") * c("tile_h") - c("y"), "ordinal": (c("row") - c("r0")) * (c("c1") - c("c0")) + c("col") - c("c0")}
    ).drop("c0", "c1", "r0", "r1")


def irregular_hits(requests: DataFrame, tiles: DataFrame, on: list[str]) -> DataFrame:
    """requests: x, y, w, h, adv_x, adv_y, extra_left, extra_right, extra_top, extra_bottom and the keys ``on``.
    tiles: the keys, col, row, off_x, off_y, tile_w, tile_h. The start truncates toward zero and the end is a ceiling, both
    widened by the extra tiles; candidates equi-join the tiles, and those that overlap strictly are hits."""
    c = F.col
    widened = requests.withColumns(
        {
            "c0": (c("x") / c("adv_x")).cast("long") - c("extra_left"), "c1": F.ceil((c("x") + c("w")) / c("adv_x")) + c("extra_right"),
            "r0": (c("y") / c("adv_y")).cast("long") - c("extra_top"), "r1": F.ceil((c("y") + c("h")) / c("adv_y")) + c("extra_bottom"),
        }
    )
    candidates = widened.withColumn("row", F.explode(span_array(c("r0"), c("r1")))).withColumn("col", F.explode(span_array(c("c0"), c("c1")))).drop("c0", "c1", "r0", "r1")
    placed = candidates.join(tiles, [*on, "col", "row"]).withColumns({"dest_xf": c("col") * c("adv_x") + c("off_x") - c("x"), "dest_yf": c("row") * c("adv_y") + c("off_y") - c("y")})
    return placed.filter((c("dest_xf") < c("w")) & (c("dest_xf") + c("tile_w") > 0) & (c("dest_yf") < c("h")) & (c("dest_yf") + c("tile_h") > 0))


def extra_tiles(offset: Column, advance: Column, tile: Column) -> tuple[Column, Column]:
    """How many tiles before and after the nominal ones an offset tile of this size can reach."""
    before = F.greatest(F.lit(0), F.ceil((offset + tile - advance) / advance))
    after = F.greatest(F.lit(0), F.ceil(-offset / advance))
    return before.cast("long"), after.cast("long")


def display_tiles(levels: DataFrame, tile: int) -> DataFrame:
    """Every display tile of each level, clipped to it, and one column of tiles past the edge marked as errors."""
    c = F.col
    grid = levels.withColumns({"across": F.ceil(c("width") / tile), "down": F.ceil(c("height") / tile)})
    grid = grid.withColumn("row", F.explode(span_array(F.lit(0).cast("long"), c("down")))).withColumn("col", F.explode(span_array(F.lit(0).cast("long"), c("across") + 1)))
    t = F.lit(tile).cast("long")
    return grid.withColumns(
        {
            "x": c("col") * t, "y": c("row") * t, "w": edge_extent(c("col"), t, c("width")), "h": edge_extent(c("row"), t, c("height")),
            "error": F.when((c("col") * t >= c("width")) | (c("row") * t >= c("height")), "OriginOutsideLevel"),
        }
    ).drop("across", "down")


def window_selections(requests: DataFrame, margin: int) -> DataFrame:
    """Tiles under a window and ``margin`` tiles around it. The window starts at origin, else around center, else in the
    middle of the level, never below zero, and ends with the level."""
    c = F.col
    axes = (("x", "w", "width", "tile_w", "tiles_across", "col"), ("y", "h", "height", "tile_h", "tiles_down", "row"))
    out = requests
    for x, w, size, tile, count, name in axes:
        around = F.when(c(f"center_{x}").isNotNull(), F.greatest(c(f"center_{x}") - F.floor(c(w) / 2), F.lit(0)))
        start = F.coalesce(c(f"origin_{x}"), around, F.floor(F.greatest(c(size) - c(w), F.lit(0)) / 2))
        first = F.greatest(F.floor(start / c(tile)) - margin, F.lit(0))
        end = F.least(start + F.greatest(c(w) - 1, F.lit(0)), F.greatest(c(size) - 1, F.lit(0)))
        last = F.least(F.floor(end / c(tile)) + margin, c(count) - 1)
        out = out.withColumn(name, F.explode(span_array(first, last + 1)))
    return out


def centered_coords(levels: DataFrame, count: int, by: list[str]) -> DataFrame:
    """``count`` tiles of each grid: a square block around its middle, row-major, then the rest of the grid, row-major."""
    c, side = F.col, math.isqrt(count - 1) + 1 if count > 0 else 0
    first = lambda n: F.floor(F.greatest(c(n) - side, F.lit(0)) / 2)
    grid = levels.withColumns({"c0": first("tiles_across"), "r0": first("tiles_down")})
    in_block = (c("col") >= c("c0")) & (c("col") < c("c0") + side) & (c("row") >= c("r0")) & (c("row") < c("r0") + side)
    cols, rows = (span_array(c(a), F.least(c(a) + side, c(n))) for a, n in (("c0", "tiles_across"), ("r0", "tiles_down")))
    block = grid.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols)).withColumn("rest", F.lit(0))
    # no more than count + side ** 2 tiles of the rest can be needed
    some = F.least(c("tiles_across") * c("tiles_down"), F.lit(count + side * side).cast("long"))
    rest = grid.withColumn("i", F.explode(span_array(F.lit(0).cast("long"), some))).withColumns({"row": F.floor(c("i") / c("tiles_across")), "col": c("i") % c("tiles_across")}).drop("i")
    both = block.unionByName(rest.filter(~in_block).withColumn("rest", F.lit(1)))
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("rest", "row", "col")))
    return ranked.filter(c("n") <= count).drop("c0", "r0", "rest", "n")
