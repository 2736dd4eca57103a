"""Rules of single formats over metadata rows: DICOM levels and frames, scaled shards, subblocks, profiles, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.geometry import ceil_div, floor_div, span_array

DEFAULT_ASSOCIATED = ["label", "macro", "thumbnail"]
HUGE_TILES, HUGE_SIDE = 4096, 32768


def dicom_levels(instances: DataFrame, by: str) -> DataFrame:
    """instances: by, sop, width, height. Instances of equal size are parts of one level, each SOP once; levels fall by
    area, then width, then height; downsample is the ratio of widths."""
    c = F.col
    parts = instances.select(by, "sop", "width", "height").distinct().groupBy(by, "width", "height").agg(F.count("*").alias("parts"))
    w = Window.partitionBy(by).orderBy(F.desc(c("width") * c("height")), F.desc("width"), F.desc("height"))
    return parts.withColumns({"level": F.row_number().over(w) - 1, "downsample": F.first("width").over(w) / c("width")})


def huge_base_only(levels: DataFrame, by: str) -> DataFrame:
    """Slides with one level that is too large to show whole: many tiles or a long side."""
    c = F.col
    only = levels.groupBy(by).agg(F.count("*").alias("n"), F.max("width").alias("w"), F.max("height").alias("h"), F.max(c("tiles_across") * c("tiles_down")).alias("tiles"))
    return only.filter((c("n") == 1) & ((c("tiles") >= HUGE_TILES) | (F.greatest("w", "h") >= HUGE_SIDE)))


def sparse_tile_map(frames: DataFrame, by: str) -> DataFrame:
    """frames: by, frame, x, y (positions from 1), tile_w, tile_h. The frame of each tile; the last one counts."""
    at = lambda p, t: F.floor((F.col(p) - 1) / F.col(t))
    return frames.groupBy(by, at("x", "tile_w").alias("col"), at("y", "tile_h").alias("row")).agg(F.max("frame").alias("frame"))


def frame_of_fragments(fragments: DataFrame, frames: DataFrame, by: str) -> DataFrame:
    """fragments: by, offset. frames: by, frame, start. A fragment is of the last frame that starts at or before it: an
    as-of match by one ordered pass over both, not a range join."""
    starts = frames.select(by, F.col("start").alias("offset"), "frame", F.lit(0).alias("side"))
    both = starts.unionByName(fragments.select(by, "offset", F.lit(None).cast("long").alias("frame"), F.lit(1).alias("side")))
    w = Window.partitionBy(by).orderBy("offset", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("frame", F.last("frame", ignorenulls=True).over(w)).filter("side = 1").drop("side")


def scaled_levels(images: DataFrame, by: str) -> DataFrame:
    """images: by, place (0 the base, 1 the map), width, height. Each at 1, 2, 4, 8 where both sides divide; of equal widths
    the later one counts; widest first."""
    c = F.col
    grown = images.withColumn("scale", F.explode(F.array(*[F.lit(s).cast("long") for s in (1, 2, 4, 8)]))).filter((c("width") % c("scale") == 0) & (c("height") % c("scale") == 0))
    sized = grown.select(by, "place", "scale", floor_div(c("width"), c("scale")).alias("width"), floor_div(c("height"), c("scale")).alias("height"))
    last = sized.groupBy(by, "width").agg(F.max_by(F.struct("place", "scale", "height"), F.struct("place", "scale")).alias("x")).select(by, "width", "x.*")
    return last.withColumn("level", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("width"))) - 1)


def subblock_ratio(w: Column, h: Column, stored_w: Column, stored_h: Column) -> Column:
    """How much smaller a subblock is stored, if the same on both axes."""
    x, y = F.round(w / stored_w).cast("long"), F.round(h / stored_h).cast("long")
    return F.when((stored_w > 0) & (stored_h > 0) & (x == y), x)


def canvas(subblocks: DataFrame, by: str) -> DataFrame:
    """The box around all subblocks, where the metadata has no size."""
    end = lambda p, n: F.max(F.col(p) + F.col(n))
    return subblocks.groupBy(by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), end("x", "w").alias("x1"), end("y", "h").alias("y1")).withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")})


def subblock_tiles(subblocks: DataFrame, tile: int) -> DataFrame:
    """subblocks: x, y, w, h relative to the canvas, and ratio. A row for each tile of its level that it covers."""
    c, t = F.col, F.lit(tile)
    span = lambda p, n: span_array(floor_div(floor_div(c(p), c("ratio")), t), ceil_div(ceil_div(c(p) + c(n), c("ratio")), t))
    return subblocks.withColumn("col", F.explode(span("x", "w"))).withColumn("row", F.explode(span("y", "h")))


def profile_conflicts(profiles: DataFrame, by: list[str]) -> DataFrame:
    """profiles: by, ifd, bytes. The one profile of a series, from its first image; conflict where there are several."""
    out = profiles.groupBy(*by).agg(F.count_distinct("bytes").alias("n"), F.min_by("bytes", "ifd").alias("first"))
    return out.select(*by, (F.col("n") > 1).alias("conflict"), F.when(F.col("n") <= 1, F.col("first")).alias("bytes"))


def associated_names(declared: Column) -> Column:
    """Declared names, else the usual three; sorted, each once."""
    names = F.when(F.size(declared) > 0, declared).otherwise(F.array(*map(F.lit, DEFAULT_ASSOCIATED)))
    return F.array_sort(F.array_distinct(names))


def slot(col: Column, row: Column, across: Column, down: Column) -> Column:
    """A tile's place in a row-major level; null outside it."""
    return F.when((col >= 0) & (row >= 0) & (col < across) & (row < down), row * across + col)


def level_errors(levels: DataFrame) -> DataFrame:
    """levels: width, height, tile_w, tile_h, tiles_across, tiles_down, n_dense, n_sparse. The first rule that is broken."""
    c = F.col
    grid = (c("tiles_across") != F.ceil(c("width") / c("tile_w"))) | (c("tiles_down") != F.ceil(c("height") / c("tile_h")))
    error = F.when((c("tile_w") <= 0) | (c("tile_h") <= 0), "ZeroTile").when(grid, "GridMismatch").when((c("n_dense") > 0) & (c("n_sparse") > 0), "DenseAndSparse")
    return levels.withColumn("error", error.when((c("n_dense") > 0) & (c("n_dense") != c("tiles_across") * c("tiles_down")), "DenseCount"))


def tile_size(layout: Column, tile: Column, advance: Column) -> Column:
    """The tile size that a caller sees: the grid's or the virtual tile's, else the rounded advance."""
    return F.when(layout.isin("Regular", "WholeLevel"), tile).when(layout == "Irregular", F.greatest(F.round(advance), F.lit(1)).cast("long"))


def tag_rgb(color: Column) -> Column:
    """Red in the low byte, then green, then blue."""
    byte = lambda n: F.shiftright(color, n).bitwiseAND(F.lit(255)).cast("int")
    return F.array(byte(0), byte(8), byte(16))
