"""Rules over DICOM instances: siblings of a file, pixel formats, spacings, associated images, raw tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.requests import first_error
from lamella.operators.vendor import TRANSFER_SYNTAX

TARGET_SIDE, MAX_FILES = 2048, 10_000
# Photometric interpretations by codec.
MONO, JPEG_COLOURS, JP2K_COLOURS = ["MONOCHROME1", "MONOCHROME2"], ["YBR_FULL_422", "RGB"], ["YBR_FULL", "YBR_FULL_422", "YBR_ICT", "YBR_RCT", "RGB"]


def siblings(files: DataFrame, selected: DataFrame) -> DataFrame:
    """files: path, folder, series_uid (null where a file is no DICOM). selected: path. The files of each selected one's
    folder that have its series, itself included. A large folder has as many rows out as the square of its files: these are
    dealt by a hash of the path, and the selected ones go to each part, so that no folder is one task's work."""
    n = 4 * files.sparkSession.sparkContext.defaultParallelism
    parts = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = files.filter("folder is not null and series_uid is not null")
    one = known.join(selected, "path").select(F.col("path").alias("selected"), "folder", "series_uid").withColumn("part", parts)
    # a number of partitions that is asked for is not made smaller by their few bytes
    keys = ["part", "folder", "series_uid"]
    dealt = known.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(n)).cast("int")).repartition(n, *keys)
    return one.repartition(n, *keys).hint("merge").join(dealt, keys).select("selected", "path", "series_uid")


def folder_series(files: DataFrame) -> DataFrame:
    """Folders as slides: exactly one series is allowed."""
    n = files.groupBy("folder").agg(F.count_distinct("series_uid").alias("n"), F.max("series_uid").alias("series_uid"))
    error = first_error((F.col("n") == 0, "NoDicom"), (F.col("n") > 1, "SeveralSeries"))
    return n.select("folder", F.when(F.col("n") == 1, F.col("series_uid")).alias("series_uid"), error.alias("error"))


def child_files(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """files: path. Each folder's direct files in order, as an array; an error where there are too many."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    out = files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
    return out.select("folder", "n", F.when(F.col("n") <= most, F.col("paths")).alias("paths"), F.when(F.col("n") > most, "TooManyFiles").alias("error"))


def pixel_format_error(c: dict[str, Column]) -> Column:
    """The first rule that an instance's pixel format breaks. c: transfer_syntax, bits_allocated, bits_stored, high_bit,
    samples, representation, planar, focal_planes, photometric; nulls break the rules of what is required."""
    kind = F.lit(None).cast("string")
    for uid, codec in TRANSFER_SYNTAX.items():
        kind = F.when(c["transfer_syntax"] == uid, codec).otherwise(kind)
    differs = lambda name, value: ~F.coalesce(c[name] == value, F.lit(False))
    colour = F.when(c["samples"] == 1, c["photometric"].isin(MONO)).when(kind == "Jpeg", c["photometric"].isin(JPEG_COLOURS)).when(kind == "Jp2k", c["photometric"].isin(JP2K_COLOURS)).otherwise(c["photometric"] == "RGB")
    return first_error(
        (kind.isNull(), "TransferSyntax"), (differs("bits_allocated", 8), "BitsAllocated"), (differs("bits_stored", 8), "BitsStored"), (differs("high_bit", 7), "HighBit"),
        (~F.coalesce(c["samples"].isin(1, 3), F.lit(False)), "SamplesPerPixel"), (differs("representation", 0), "PixelRepresentation"), ((c["samples"] == 3) & ~c["planar"].isin(0, 1), "PlanarConfiguration"),
        (c["focal_planes"] != 1, "FocalPlanes"), (~F.coalesce(colour, F.lit(False)), "Photometric"),
    )


def spacing_mpp(shared: Column, root: Column) -> Column:
    """Pixel spacing: that of the shared functional groups, else the instance's own."""
    return F.coalesce(shared, root)


def associated(images: DataFrame, by: str) -> DataFrame:
    """images: by, name, sop, place. One image of each name, the first; an error where a name stands for several instances."""
    w = Window.partitionBy(by, "name")
    first = F.row_number().over(w.orderBy("place"))
    several = F.min("sop").over(w) != F.max("sop").over(w)
    return images.withColumns({"n": first, "error": F.when(several, "UnexpectedImage")}).filter("n = 1").drop("n")


def tile_error(col: Column, row: Column, across: Column, down: Column) -> Column:
    return F.when((col < 0) | (row < 0) | (col >= across) | (row >= down), "TileOutOfRange")


def raw_photometric(samples: Column, photometric: Column) -> Column:
    """What a raw tile's payload is said to be; null where raw access is not supported."""
    return F.when((samples == 1) & photometric.isin(MONO), "Monochrome2").when((samples == 3) & (photometric == "RGB"), "Rgb").when((samples == 3) & photometric.isin(JP2K_COLOURS), "YbrFull422")


def cache_hint(tile_w: Column, tile_h: Column, samples: Column) -> Column:
    """Bytes of the decoded tiles that cover a region of 2048 pixels a side; null for tiles of no size."""
    n = lambda t: F.ceil(F.lit(TARGET_SIDE) / t) * t
    return F.when((tile_w > 0) & (tile_h > 0), F.try_multiply(F.try_multiply(n(tile_w), n(tile_h)), samples))
