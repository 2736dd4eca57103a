"""The tile cache as one file: magic, length of the metadata, metadata as JSON, payloads; read by position, written whole.

Payloads are Zstandard frames of interleaved 8-bit samples, each with a SHA-256 of what it decodes to, which is verified.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators import formats
from lamella.sources.ranges import Ranges
from lamella.sources.rows import exactly, parsed

# The magic, the schema, and limits on metadata and tiles.
MAGIC, SCHEMA_VERSION, MAX_METADATA, MAX_PAYLOAD, MAX_TILES = b"SVCACHE1", 3, 16 << 20, 512 << 20, 16 << 20
CHANNELS = {"Rgb": 3, "Rgba": 4, "Grayscale": 1}
_TILE = "struct<payload_offset:long,payload_len:long,decoded_len:long,width:int,height:int,channels:int,color_space:string,codec:string,sha256:string>"
_LEVEL = f"struct<dimensions:array<long>,downsample:double,tile_width:int,tile_height:int,tiles_across:long,tiles_down:long,tiles:array<{_TILE}>,sparse_tiles:array<struct<index:long,tile:{_TILE}>>>"
_SERIES = f"struct<id:string,axes:struct<z:int,c:int,t:int>,sample_type:string,channels:array<struct<name:string,color:array<int>>>,levels:array<{_LEVEL}>>"
METADATA = (
    "schema_version int, complete boolean, source struct<path:string,len:long,modified_unix_nanos:decimal(38,0),sample_sha256:string>, properties array<array<string>>, "
    f"scenes array<struct<id:string,name:string,series:array<{_SERIES}>>>, associated array<struct<name:string,dimensions:array<int>,tile:{_TILE}>>"
)


def _head(source: Ranges) -> Iterator[tuple]:
    head = source.read(0, 16)
    if head[:8] != MAGIC:
        raise ValueError("no cache file")
    n = struct.unpack("<Q", head[8:].ljust(8, b"\0"))[0]
    if n > MAX_METADATA:
        raise ValueError("metadata is too large")
    yield exactly(source, 16, n).decode(), 16 + n, source.size


def opened(files: DataFrame) -> DataFrame:
    """path, m (the metadata), payload_start, size, error: the file's own, or the first rule that its metadata break."""
    raw = parsed(files, _head, "json string, payload_start long, size long, error string")
    rows = raw.withColumn("m", F.from_json("json", METADATA))
    names = F.transform("m.properties", lambda p: F.get(p, F.lit(0)))
    ids = F.transform("m.scenes", lambda s: s["id"])
    many = lambda a: F.size(F.array_distinct(a)) != F.size(a)
    broken = F.when(F.col("m.schema_version").isNull(), "Metadata").when(F.col("m.schema_version") != SCHEMA_VERSION, "SchemaVersion").when(many(names), "DuplicateProperty").when(many(ids), "DuplicateScene")
    return rows.select("path", "m", "payload_start", "size", F.coalesce("error", broken).alias("error"))


def levels(caches: DataFrame) -> DataFrame:
    """Levels as rows, each with the first rule that it breaks."""
    good = caches.filter("error is null").withColumn("complete", F.coalesce("m.complete", F.lit(True)))
    s = good.select("path", "payload_start", "size", "complete", F.posexplode("m.scenes").alias("scene", "s"))
    r = s.select("path", "payload_start", "size", "complete", "scene", F.posexplode("s.series").alias("series", "r"))
    v = r.select("path", "payload_start", "size", "complete", "scene", "series", "r.axes", F.posexplode("r.levels").alias("level", "l"))
    c = F.col
    rows = v.select(
        "path", "payload_start", "size", "complete", "scene", "series", "level", "axes", F.get("l.dimensions", F.lit(0)).alias("width"), F.get("l.dimensions", F.lit(1)).alias("height"), "l.downsample", c("l.tile_width").alias("tile_w"), c("l.tile_height").alias("tile_h"),
        "l.tiles_across", "l.tiles_down", F.coalesce(F.size("l.tiles"), F.lit(0)).alias("n_dense"), F.coalesce(F.size("l.sparse_tiles"), F.lit(0)).alias("n_sparse"), c("l.tiles").alias("dense"), c("l.sparse_tiles").alias("sparse"),
    )
    rows = rows.withColumns({"n_dense": F.greatest("n_dense", F.lit(0)), "n_sparse": F.greatest("n_sparse", F.lit(0))})
    checked = formats.level_errors(rows)
    axes = (c("axes.z") > 0) & (c("axes.c") > 0) & (c("axes.t") > 0)
    holes = c("complete") & ((c("n_dense") == 0) & (c("n_sparse") != c("tiles_across") * c("tiles_down")) | F.coalesce(F.exists("dense", lambda t: t.isNull()), F.lit(False)))
    more = F.when(~axes, "Axes").when(~(c("downsample") > 0), "Downsample").when(c("tiles_across") * c("tiles_down") > MAX_TILES, "TooManyTiles").when(holes, "IncompleteLevel")
    return checked.withColumn("error", F.coalesce("error", more))


def entries(of_levels: DataFrame) -> DataFrame:
    """The stored tiles: path, scene, series, level, tile_index, col, row and what the metadata say; each with the first rule
    that it breaks."""
    keys = ["path", "payload_start", "size", "scene", "series", "level", "tiles_across", "tiles_down"]
    good = of_levels.filter("error is null")
    dense = good.filter("n_dense > 0").select(*keys, F.posexplode("dense").alias("i", "t")).filter("t is not null").withColumn("i", F.col("i").cast("long"))
    sparse = good.filter("n_sparse > 0").select(*keys, F.explode("sparse").alias("s")).select(*keys, F.col("s.index").alias("i"), F.col("s.tile").alias("t"))
    rows = dense.unionByName(sparse).select(*keys, F.col("i").alias("tile_index"), "t.*")
    c = F.col
    channels = F.lit(None).cast("int")
    for name, n in CHANNELS.items():
        channels = F.when(c("color_space") == name, n).otherwise(channels)
    error = (
        F.when((c("tile_index") < 0) | (c("tile_index") >= c("tiles_across") * c("tiles_down")), "TileIndex").when((c("width") <= 0) | (c("height") <= 0), "TileSize").when(~F.coalesce(channels == c("channels"), F.lit(False)), "Channels")
        .when(c("width").cast("long") * c("height") * c("channels") != c("decoded_len"), "DecodedLength").when((c("payload_len") <= 0) | (c("payload_len") > MAX_PAYLOAD), "PayloadLength")
        .when(c("payload_offset") + c("payload_len") > c("size") - c("payload_start"), "PayloadPastEnd").when(~F.regexp_like("sha256", F.lit("^[0-9a-fA-F]{64}$")), "Digest").when(c("codec") != "Zstd", "Codec")
    )
    placed = {"col": F.pmod("tile_index", "tiles_across"), "row": F.floor(c("tile_index") / c("tiles_across")).cast("long"), "offset": c("payload_start") + c("payload_offset"), "length": c("payload_len"), "error": error}
    return rows.withColumns(placed).drop("payload_start", "size", "payload_offset", "payload_len")


def verified(payload: Column, decoded_len: Column, sha256: Column) -> Column:
    """A struct of data and error: the payload decoded, if it has the length and the digest that it should."""

    @F.pandas_udf("data binary, error string")
    def of(raw: pd.Series, n: pd.Series, digest: pd.Series) -> pd.DataFrame:
        import zstandard

        out = []
        for p, size, want in zip(raw, n, digest):
            if p is None:
                out.append((None, "PayloadPastEnd"))
                continue
            try:
                data = zstandard.ZstdDecompressor().decompress(bytes(p), max_output_size=int(size))
            except zstandard.ZstdError as error:
                out.append((None, str(error)))
                continue
            ok = len(data) == size and hashlib.sha256(data).hexdigest() == want.lower()
            out.append((data, None) if ok else (None, "DigestMismatch"))
        return pd.DataFrame(out, columns=["data", "error"])

    return of(payload, decoded_len, sha256)


def read_tiles(asked: DataFrame, found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """asked: slot, path, scene, series, level, col, row. Their samples; SlotNotPopulated where the cache has none."""
    from lamella.operators.reading import fetch

    keys = ["path", "scene", "series", "level", "col", "row"]
    rows = asked.join(found, keys, "left")
    there = fetch(rows.filter("tile_index is not null and error is null"), files).withColumn("x", verified(F.col("payload"), F.col("decoded_len"), F.col("sha256")))
    good = there.select(*asked.columns, "width", "height", "channels", "x.data", "x.error")
    none = rows.filter("tile_index is null or error is not null").select(*asked.columns, "width", "height", "channels", F.lit(None).cast("binary").alias("data"), F.coalesce("error", F.lit("SlotNotPopulated")).alias("error"))
    return good.unionByName(none)


def packed(tiles: DataFrame) -> DataFrame:
    """tiles: data (interleaved samples). Adds payload, payload_len, decoded_len and sha256."""
    import zstandard

    @F.pandas_udf("binary")
    def squeeze(values: pd.Series) -> pd.Series:
        return values.map(lambda v: zstandard.ZstdCompressor(level=1).compress(bytes(v)))

    out = tiles.withColumns({"payload": squeeze("data"), "decoded_len": F.octet_length("data").cast("long"), "sha256": F.sha2("data", 256)})
    return out.withColumn("payload_len", F.octet_length("payload").cast("long")).drop("data")


def files_of(tiles: DataFrame, of_levels: DataFrame, sources: DataFrame, complete: bool = False) -> DataFrame:
    """Cache files as rows (path, content). tiles: path (of the cache), scene, series, level, tile_index, width, height,
    channels, color_space, and what ``packed`` adds. of_levels: path, scene, series, level, width, height, downsample, tile_w,
    tile_h, tiles_across, tiles_down. sources: path, source (struct of path, len, modified_unix_nanos, sample_sha256),
    properties (map). A file is one task's work, as is its commit; files are spread over all tasks. Levels are sparse."""
    order = ["scene", "series", "level", "tile_index"]
    w = Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = tiles.withColumn("payload_offset", F.coalesce(F.sum("payload_len").over(w), F.lit(0)))
    tile = F.struct("payload_offset", "payload_len", "decoded_len", "width", "height", "channels", "color_space", F.lit("Zstd").alias("codec"), "sha256")
    grouped = placed.groupBy("path", "scene", "series", "level").agg(F.array_sort(F.collect_list(F.struct(F.col("tile_index").alias("index"), tile.alias("tile")))).alias("sparse_tiles"))
    empty = F.expr("cast(array() as array<struct<index:bigint,tile:struct<payload_offset:bigint,payload_len:bigint,decoded_len:bigint,width:bigint,height:bigint,channels:int,color_space:string,codec:string,sha256:string>>>)")
    level = F.struct(F.array("width", "height").alias("dimensions"), "downsample", F.col("tile_w").alias("tile_width"), F.col("tile_h").alias("tile_height"), "tiles_across", "tiles_down", F.coalesce("sparse_tiles", empty).alias("sparse_tiles"))
    keys = ["path", "scene", "series", "level"]
    per_level = of_levels.select(*keys, "width", "height", "downsample", "tile_w", "tile_h", "tiles_across", "tiles_down").join(grouped, keys, "left").select(*keys, level.alias("l"))
    series = per_level.groupBy("path", "scene", "series").agg(F.array_sort(F.collect_list(F.struct("level", "l"))).alias("ls"))
    one = F.struct(F.concat(F.lit("ser"), "series").alias("id"), F.struct(F.lit(1).alias("z"), F.lit(1).alias("c"), F.lit(1).alias("t")).alias("axes"), F.lit("Uint8").alias("sample_type"), F.expr("array()").alias("channels"), F.col("ls.l").alias("levels"))
    scenes = series.select("path", "scene", "series", one.alias("r")).groupBy("path", "scene").agg(F.array_sort(F.collect_list(F.struct("series", F.to_json("r").alias("r")))).alias("rs"))
    text = F.concat(F.lit('{"id":"s'), F.col("scene").cast("string"), F.lit('","name":null,"series":['), F.array_join(F.col("rs.r"), ","), F.lit("]}"))
    whole = scenes.select("path", "scene", text.alias("s")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("scene", "s"))).alias("ss"))
    properties = F.transform(F.map_entries("properties"), lambda e: F.array(e["key"], e["value"]))
    head = F.concat(F.lit(f'{{"schema_version":{SCHEMA_VERSION},"complete":{json.dumps(complete)},"source":'), F.to_json("source"), F.lit(',"properties":'), F.to_json(properties), F.lit(',"scenes":['), F.array_join(F.col("ss.s"), ","), F.lit('],"associated":[]}')).alias("json")
    meta = sources.join(whole, "path").select("path", head)
    from lamella.operators.identity import little_endian

    payloads = placed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("payload_offset", "payload"))).alias("ps"))
    body = F.aggregate(F.col("ps.payload"), F.unhex(F.lit("")), lambda a, p: F.concat(a, p))
    raw = F.col("json").cast("binary")
    return meta.join(payloads, "path", "left").select("path", F.concat(F.lit(MAGIC.decode()).cast("binary"), F.unhex(little_endian(F.octet_length(raw).cast("long"))), raw, F.coalesce(body, F.unhex(F.lit("")))).alias("content"))


def store(files: DataFrame, folder: str) -> None:
    """Write cache files under a folder that all workers see; each appears whole, by a rename."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                target = os.path.join(folder, path)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, target)
            yield frame[["path"]]

    files.select("path", "content").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()
