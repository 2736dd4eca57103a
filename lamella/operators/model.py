"""The tile model: sample types, pixel formats, buffers, raw tiles, budgets, output preferences, C-style lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators.requests import first_error
from lamella.operators.vendor import lookup

# Bytes of a sample; channels and sample type of a pixel format; defaults of the caches.
SAMPLE_BYTES = {"Uint8": 1, "Uint16": 2, "Float32": 4}
PIXEL_FORMATS = {"Rgb8": ("Rgb", 3, "Uint8"), "Rgba8": ("Rgba", 4, "Uint8"), "Gray8": ("Grayscale", 1, "Uint8"), "Rgb16": ("Rgb", 3, "Uint16"), "Rgba16": ("Rgba", 4, "Uint16"), "Gray16": ("Grayscale", 1, "Uint16")}
SHARED_TILE_BYTES, DISPLAY_TILE_BYTES = 64 << 20, 32 << 20
# Sample types of ETS pixel type codes.
ETS_SAMPLES = {1: "Uint8", 2: "Uint8", 3: "Uint16", 4: "Uint16", 9: "Float32"}


def sample_bytes(kind: Column) -> Column:
    return lookup(kind, SAMPLE_BYTES, F.lit(None).cast("int"))


def pixel_formats(spark: SparkSession) -> DataFrame:
    """The dimension table of pixel formats: name, color_space, channels, sample_type, bytes_per_pixel."""
    return spark.createDataFrame([(k, *v, v[1] * SAMPLE_BYTES[v[2]]) for k, v in PIXEL_FORMATS.items()], "name string, color_space string, channels int, sample_type string, bytes_per_pixel int")


def buffer_error(width: Column, height: Column, channels: Column, samples: Column) -> Column:
    """Whether a buffer holds width x height x channels samples."""
    expected = F.try_multiply(F.try_multiply(width.cast("long"), height.cast("long")), channels.cast("long"))
    return first_error((expected.isNull(), "DimensionsOverflow"), (expected != samples, "SampleCount"))


def raw_tile_error(c: dict[str, Column]) -> Column:
    """The first rule that a raw tile breaks: what is missing comes first. c: width, height, bits, samples, photometric, bytes
    (its payload's length), null where not given."""
    missing = [((c["width"].isNull() | c["height"].isNull()), "MissingDimensions"), (c["bits"].isNull(), "MissingBitsAllocated"), (c["samples"].isNull(), "MissingSamplesPerPixel"), (c["photometric"].isNull(), "MissingPhotometricInterpretation"), (c["bytes"].isNull(), "MissingData")]
    invalid = [((c["width"] == 0) | (c["height"] == 0), "InvalidDimensions"), (c["bits"] == 0, "InvalidBitsAllocated"), (c["samples"] == 0, "InvalidSamplesPerPixel"), (c["bytes"] == 0, "EmptyData")]
    return first_error(*missing, *invalid)


def bounded(content: Column, most: int) -> Column:
    """A payload, or null where it is over the limit: nothing longer is read into a task."""
    return F.when(F.octet_length(content) <= most, content)


def tile_budget(configured: Column, hint: Column) -> Column:
    """Bytes of the shared tile cache: what is configured, else the source's hint, else the default."""
    return F.coalesce(configured, hint, F.lit(SHARED_TILE_BYTES).cast("long"))


def uses_display_cache(source: Column) -> Column:
    """Display tiles that are decoded from scratch are not kept."""
    return ~F.coalesce(source.isin("NdpiJpeg", "NdpiFullDecode", "SyntheticDownsample"), F.lit(False))


def output_error(preference: Column, has_device: Column) -> Column:
    """There is no device here: what asks for one gets tiles of the CPU, what requires one an error."""
    return F.when((preference == "RequireDevice") & ~has_device, "DeviceUnavailable")


def first_tile(layouts: DataFrame, tiles: DataFrame, by: str) -> DataFrame:
    """layouts: by, layout, tiles_across, tiles_down (1 and 1 for whole levels that have a size). tiles: by, col, row, for
    irregular ones. The tile whose metadata stands for the level: (0, 0), or the least row, then column; null where there is none."""
    least = tiles.groupBy(by).agg(F.min(F.struct("row", "col")).alias("m"))
    c = F.col
    out = layouts.join(least, by, "left")
    regular = c("layout") != "Irregular"
    there = (c("tiles_across") > 0) & (c("tiles_down") > 0)
    zero = F.lit(0).cast("long")
    return out.select(by, F.when(regular & there, zero).when(~regular, c("m.col")).alias("col"), F.when(regular & there, zero).when(~regular, c("m.row")).alias("row"))


def or_minus_one(asked: DataFrame, known: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Lookups as a C caller sees them: -1 for what is not there."""
    out = asked.join(known.select(*keys, *values), keys, "left")
    return out.select(*asked.columns, *(F.coalesce(v, F.lit(-1).cast(known.schema[v].dataType)).alias(v) for v in values))


def ets_key(coords: Column, pyramid: Column) -> Column:
    """(level, z, c, t, col, row) of a tile's coordinates: x, y, up to three more axes, and the level last in a pyramid; null
    where one is negative."""
    n = F.size(coords) - F.when(pyramid, 1).otherwise(0)
    axis = lambda i: F.when(F.lit(i) < n, F.get(coords, F.lit(i))).otherwise(0)
    level = F.when(pyramid, F.element_at(coords, -1)).otherwise(0)
    key = F.struct(level.alias("level"), axis(2).alias("z"), axis(3).alias("c"), axis(4).alias("t"), F.get(coords, F.lit(0)).alias("col"), F.get(coords, F.lit(1)).alias("row"))
    used = F.slice(coords, F.lit(1), F.least(F.size(coords), F.lit(5)))
    return F.when(~F.exists(used, lambda x: x < 0) & (level >= 0), key)


def background(samples: Column, colour: Column) -> Column:
    """The colour of tiles that are not stored: three samples, or one three times."""
    grey = F.coalesce(F.get(colour, F.lit(0)), F.lit(0))
    return F.when((samples >= 3) & (F.size(colour) >= 3), F.slice(colour, F.lit(1), F.lit(3))).otherwise(F.array(grey, grey, grey))


def frame_files(files: DataFrame) -> DataFrame:
    """files: path. A slide's ETS files: frame_t.ets one folder down, in order, by slide folder."""
    name = r"^(.*)/([^/]+)/frame_t\.ets$"
    found = files.filter(F.regexp_like("path", F.lit(name))).select(F.regexp_extract("path", name, 1).alias("folder"), "path")
    return found.groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def scene_indices(boxes: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """boxes: by, scene (of bounding boxes). sizes: by, n_scenes (null where unknown). The scenes that have a box, else as
    many as the metadata says, else one; with their slots."""
    have = boxes.filter("scene >= 0").groupBy(by).agg(F.array_sort(F.collect_set("scene")).alias("have"))
    numbered = F.coalesce("have", F.sequence(F.lit(0), F.coalesce("n_scenes", F.lit(1)) - 1).cast("array<bigint>"))
    return sizes.join(have, by, "left").select(by, F.posexplode(numbered).alias("slot", "scene"))


def subblock_slots(subblocks: DataFrame, scenes: DataFrame, by: str) -> DataFrame:
    """subblocks: by, id, scene (null where it has none). The slot of each one's scene; one without a scene goes to the only one."""
    n = scenes.groupBy(by).agg(F.count("*").alias("n"))
    out = subblocks.join(scenes, [by, "scene"], "left").join(n, by, "left")
    return out.select(by, "id", F.when(F.col("scene").isNull() & (F.col("n") == 1), 0).otherwise(F.col("slot")).alias("slot"))


def channels(planes: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """planes: by, place, c, name, color. sizes: by, n_c. Name and colour of each channel, from its first plane."""
    first = planes.groupBy(by, "c").agg(F.min_by(F.struct("name", "color"), "place").alias("p"))
    every = sizes.select(by, F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)).alias("c"))
    return every.join(first, [by, "c"], "left").select(by, "c", "p.name", "p.color")


def shard_of(tile: DataFrame) -> DataFrame:
    """tile: col, row, base_across, base_down (tiles of a whole shard), shards_across, n_shards, across and down of the shard
    it falls in. Adds shard, tile_index, error."""
    c = F.col
    div = lambda a, b: F.floor(c(a) / c(b))
    shard = div("row", "base_down") * c("shards_across") + div("col", "base_across")
    col, row = F.pmod(c("col"), c("base_across")), F.pmod(c("row"), c("base_down"))
    error = first_error((shard >= c("n_shards"), "MissingShard"), ((col >= c("across")) | (row >= c("down")), "OutsideShard"))
    return tile.withColumns({"shard": shard, "tile_index": row * c("across") + col, "error": error})


def row_starts(content: Column, rows: Column) -> Column:
    """Starts of rows of tiles, from blocks of 40 bytes that begin with a 64-bit number; 0 is unknown (null). Null where cut off."""
    at = lambda i: F.substr(content, (i * 40 + 1).cast("int"), F.lit(8))
    # low byte first: the digits are turned by twos
    number = lambda raw: F.conv(F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0)), lambda k: F.hex(F.substr(raw, (k + 1).cast("int"), F.lit(1)))), ""), 16, 10).cast("long")
    starts = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.nullif(number(at(i)), F.lit(0).cast("long")))
    return F.when(F.octet_length(content) >= rows * 40, starts)


def colour_transform(photometric: Column, samples: Column, hint: Column) -> Column:
    """How a TIFF's JPEG samples become RGB: what the stream says comes first, then the photometric tag."""
    said = F.when(samples == 3, F.when((hint == "Rgb") | ((hint == "Rgb012") & (photometric != 6)), "ForceRgb").when(hint == "YCbCr", "ForceYCbCr"))
    return F.coalesce(said, F.when((photometric == 2) & (samples == 3), "ForceRgb").when((photometric == 6) & (samples == 3), "ForceYCbCr"), F.lit("Auto"))
