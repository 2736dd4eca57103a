"""Pyramid levels: building, choosing, checking, and the vendors' own rules for dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regular_levels(images: DataFrame) -> DataFrame:
    """images: width, height, tile_w, tile_h. Adds the grid; tiles of no size are an error."""
    c = F.col
    bad = (c("tile_w") <= 0) | (c("tile_h") <= 0)
    grid = lambda n, t: F.when(~bad, F.ceil(c(n) / c(t)))
    return images.withColumns({"tiles_across": grid("width", "tile_w"), "tiles_down": grid("height", "tile_h"), "error": F.when(bad, "ZeroTile")})


def mean_downsample(levels: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Levels by falling area; downsample is the mean of both axis ratios to the largest."""
    w = Window.partitionBy(key).orderBy(F.desc(F.col("width") * F.col("height")), "level")
    base = lambda n: F.first(n).over(w)
    return levels.withColumns({"rank": F.row_number().over(w) - 1, "mean_downsample": (base("width") / F.col("width") + base("height") / F.col("height")) / 2})


def best_level(asked: DataFrame, levels: DataFrame, key: str = "dataset_id") -> DataFrame:
    """asked: key, wanted. The level whose downsample is nearest, the first on ties; -1 where wanted is not finite. A row out
    for each row in: a slide's few levels are one array beside its requests. Both sides are sorted by key: either may be
    millions of rows that look small by their file, and must not be gathered on the driver."""
    of = levels.groupBy(key).agg(F.collect_list(F.struct("downsample", "level")).alias("_levels"))
    near = F.array_min(F.transform("_levels", lambda x: F.struct(F.abs(x["downsample"] - F.col("wanted")).alias("d"), x["level"].alias("level"))))["level"]
    finite = ~F.isnan("wanted") & (F.abs("wanted") < float("inf"))
    return asked.join(of.hint("merge"), key).withColumn("best_level", F.when(finite, near).otherwise(-1)).drop("_levels")


def power_of_two_factor(base_w: Column, base_h: Column, w: Column, h: Column) -> Column:
    """The power of two that both axes divide by exactly, else null."""
    f = F.floor(base_w / w)
    ok = (w > 0) & (h > 0) & (f * w == base_w) & (f * h == base_h) & (F.bit_count(f) == 1)
    return F.when(ok, f)


def synthesized(levels: DataFrame, key: str = "dataset_id") -> DataFrame:
    """levels: key, factor (physical powers of two), width0, height0. Every power up to the largest that divides the base
    exactly, with the source kind; a synthetic one names the nearest finer physical factor."""
    c = F.col
    bases = levels.groupBy(key, "width0", "height0").agg(F.array_sort(F.collect_set("factor")).alias("have"))
    grown = bases.withColumn("factor", F.explode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    grown = grown.filter((c("width0") % c("factor") == 0) & (c("height0") % c("factor") == 0) & (c("factor") <= F.array_max("have")))
    finer = F.array_max(F.filter("have", lambda x: x <= c("factor")))
    return grown.withColumns({"source_kind": F.when(F.array_contains("have", c("factor")), "Physical").otherwise("SyntheticDownsample"), "base_factor": finer}).drop("have")


def monotonic(levels: DataFrame, key: str, order: str) -> DataFrame:
    """Levels that are wider or higher than the one before them."""
    w = Window.partitionBy(key).orderBy(order)
    out = levels.withColumns({"prev_w": F.lag("width").over(w), "prev_h": F.lag("height").over(w)})
    return out.filter((F.col("width") > F.col("prev_w")) | (F.col("height") > F.col("prev_h")))


def public_dimension(base: Column, level: Column) -> Column:
    """base div 2**level, at least 1."""
    return F.greatest(F.call_function("shiftright", base, level), F.lit(1))
