"""The tile store: presence, merge and replace, freshness, validation, and reading slots back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["scene", "series", "level", "z", "c", "t", "row", "col"]


def split_hits(requests: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Adds hit: whether the tile is stored."""
    known = stored.select(*keys).distinct().withColumn("hit", F.lit(True))
    return requests.join(known, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(requests: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tiles that have to be read."""
    return requests.select(*keys).distinct().join(stored, keys, "left_anti")


def merge(existing: DataFrame, new: DataFrame, slot: list[str]) -> DataFrame:
    """Existing tiles stay; of new ones for one slot the first in key order goes in. The slot has no z, c, t."""
    first = new.withColumn("rn", F.row_number().over(Window.partitionBy(*slot).orderBy(*[k for k in KEY if k in new.columns]))).filter("rn = 1").drop("rn")
    return existing.unionByName(first.join(existing.select(*slot), slot, "left_anti"))


def replace(new: DataFrame, slot: list[str]) -> DataFrame:
    return new.withColumn("rn", F.row_number().over(Window.partitionBy(*slot).orderBy(*[k for k in KEY if k in new.columns]))).filter("rn = 1").drop("rn")


def read_slots(requests: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Requests in the order of ``slot``, with data; error where the slot holds nothing."""
    out = requests.join(tiles, keys, "left")
    return out.withColumn("error", F.when(F.col("data").isNull(), "SlotNotPopulated"))


def sparse_fill(grid: DataFrame, tiles: DataFrame, keys: list[str], default: int = 0) -> DataFrame:
    """Every tile of the grid; holes take the default sample."""
    return grid.join(tiles, keys, "left").withColumn("v", F.coalesce("v", F.lit(default)))


def fresh(complete: Column, *pairs: tuple[Column, Column]) -> Column:
    """A cache is fresh if it is complete and each part of its source's fingerprint is the same, nulls included."""
    out = complete
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out


def policy(value: Column) -> Column:
    """Cache policy from an option's text."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("prefer", "on", "true", "1"), "PreferFresh").when(v.isin("required", "require"), "RequireFresh").otherwise("Off")


def candidate_paths(path: Column, folder: str) -> Column:
    """Beside the source, then under its hash in the cache folder."""
    return F.array(F.concat(path, F.lit(".svcache")), F.concat(F.lit(folder + "/"), F.sha2(path, 256), F.lit(".svcache")))


def resolve(sources: DataFrame, caches: DataFrame, folder: str) -> DataFrame:
    """sources: path, policy. caches: cache_path, fresh. The path to open: the first fresh candidate, else the source; an
    error where a fresh one is required."""
    paths = sources.select("path", "policy", F.posexplode(candidate_paths(F.col("path"), folder)).alias("i", "cache_path"))
    found = paths.join(caches.filter("fresh"), "cache_path").groupBy("path").agg(F.min_by("cache_path", "i").alias("cached"))
    out = sources.join(found, "path", "left")
    use = (F.col("policy") != "Off") & F.col("cached").isNotNull()
    return out.withColumns({"open_path": F.when(use, F.col("cached")).otherwise(F.col("path")), "error": F.when((F.col("policy") == "RequireFresh") & F.col("cached").isNull(), "NoFreshCache")}).drop("cached")


def overlapping(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Payload ranges (offset, length) that start before the one before them ends."""
    w = Window.partitionBy(*by).orderBy("offset", "length").rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumn("before", F.max(F.col("offset") + F.col("length")).over(w))
    return out.filter(F.col("offset") < F.col("before"))


def payload_offsets(tiles: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Where each payload goes when they are written one after the other."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def write(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The store as Parquet, by slide and level, rows and columns near each other; the commit is the writer's own."""
    tiles.repartition("dataset_id", "level").sortWithinPartitions("dataset_id", "level", "row", "col").write.mode(mode).partitionBy("level").parquet(path)
