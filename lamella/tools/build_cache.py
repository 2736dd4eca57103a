"""Builds tile caches of slides: whole, or the tiles under a window. For spark-submit; arguments as --help says."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import grid, reading
from lamella.sources import cache, registry


def tiles(levels: DataFrame, tags: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Tiles as cache.packed wants them; selected: path, level, col, row, or all."""
    if selected is None:
        rows = levels.select("path", "level", "tiles_across", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles_across") * F.col("tiles_down") - 1)).alias("i"))
        selected = rows.select("path", "level", F.pmod("i", "tiles_across").alias("col"), F.floor(F.col("i") / F.col("tiles_across")).alias("row"))
    got = reading.read_tiles(selected.distinct().withColumn("slot", F.lit(0)), levels, tags).filter("error is null and sample_type = 'Uint8'")
    space = F.when(F.col("channels") == 3, "Rgb").when(F.col("channels") == 4, "Rgba").otherwise("Grayscale")
    out = got.join(levels.select("path", "level", "tiles_across"), ["path", "level"])
    return out.select("path", F.lit(0).alias("scene"), F.lit(0).alias("series"), "level", (F.col("row") * F.col("tiles_across") + F.col("col")).alias("tile_index"), F.col("tile_width").cast("int").alias("width"), F.col("tile_height").cast("int").alias("height"), "channels", space.alias("color_space"), "data")


def build(spark: SparkSession, path: str, window: tuple[int, int, int] | None = None) -> DataFrame:
    """path, content of a cache for each TIFF slide under path. window: level, width and height of one around the middle."""
    opened = registry.open_slides(spark, path)["tiff"]
    levels, tags = opened["levels"], opened["tags"]
    selected = None
    if window:
        level, w, h = window
        asked = levels.filter(F.col("level") == level).withColumns({"w": F.lit(w).cast("long"), "h": F.lit(h).cast("long"), **{n: F.lit(None).cast("long") for n in ("origin_x", "origin_y", "center_x", "center_y")}})
        selected = grid.window_selections(asked, 0).select("path", "level", "col", "row")
    named = F.concat(F.regexp_extract("path", r"([^/]+)$", 1), F.lit(".svcache"))
    packed = cache.packed(tiles(levels, tags, selected)).withColumn("path", named)
    sources = levels.select("path").distinct().select(named.alias("path"), F.struct(F.col("path").alias("path"), F.lit(0).cast("long").alias("len"), F.lit(None).cast("decimal(38,0)").alias("modified_unix_nanos"), F.sha2("path", 256).alias("sample_sha256")).alias("source"), F.create_map(F.lit("vendor"), F.lit("tiff")).alias("properties"))
    of_levels = levels.select(named.alias("path"), F.lit(0).alias("scene"), F.lit(0).alias("series"), "level", "width", "height", "downsample", "tile_w", "tile_h", "tiles_across", "tiles_down")
    return cache.files_of(packed, of_levels, sources, complete=window is None)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("slides", help="folder of slides, as Spark reads it")
    parser.add_argument("target", help="folder for the caches, which all workers see")
    parser.add_argument("--window", nargs=3, type=int, metavar=("LEVEL", "WIDTH", "HEIGHT"), help="only tiles under a window around the middle of a level")
    said = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    cache.store(build(spark, said.slides, tuple(said.window) if said.window else None), said.target)


if __name__ == "__main__":
    main()
