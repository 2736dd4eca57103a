"""Checks of requests: ordered error codes, size limits, builders, batch contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_REGION_PIXELS = 256 << 20


def first_error(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that holds, else null."""
    out = F
    for bad, code in checks:
        out = out.when(bad, code)
    return out


def validate_region(requests: DataFrame, max_pixels: int = MAX_REGION_PIXELS) -> DataFrame:
    """requests: scene, series, level, z, c, t, w, h and the extents n_scenes, n_series, n_levels, n_z, n_c, n_t.
    Adds error: the size limit comes first, then scene, series, level, z, c, t."""
    c = F.col
    outside = lambda name, n: (c(name) < 0) | (c(name) >= c(n))
    return requests.withColumn(
        "error",
        first_error(
            (c("w") * c("h") > max_pixels, "RegionTooLarge"), (outside("scene", "n_scenes"), "SceneOutOfRange"), (outside("series", "n_series"), "SeriesOutOfRange"),
            (outside("level", "n_levels"), "LevelOutOfRange"), (outside("z", "n_z"), "ZOutOfRange"), (outside("c", "n_c"), "COutOfRange"), (outside("t", "n_t"), "TOutOfRange"),
        ),
    )


def missing_field(fields: list[str]) -> Column:
    """The first required field that is null."""
    return first_error(*((F.col(f).isNull(), f"missing {f}") for f in fields))


def checked_samples(width: Column, height: Column, channels: Column) -> Column:
    """width x height x channels, or null where it overflows."""
    return F.try_multiply(F.try_multiply(width, height), channels)


def same_count(asked: DataFrame, got: DataFrame) -> DataFrame:
    """One row: how many were asked for, how many came, and whether that is the same."""
    return asked.agg(F.count("*").alias("expected")).crossJoin(got.agg(F.count("*").alias("actual"))).withColumn("ok", F.col("expected") == F.col("actual"))
