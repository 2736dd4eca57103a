"""Reading pixels: tiles, regions, display tiles, associated images and raw payloads of TIFF slides.

A request is joined to its level, its tiles to their places in the file, and only then are bytes fetched and decoded, in
Arrow batches: a tile that several requests touch once where they come close together. Samples are 8-bit interleaved bytes (16-bit ones are two
bytes, low byte first). What cannot be decoded carries an error and no data; others of its batch are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import codecs, jpeg
from lamella.functions.geometry import edge_extent
from lamella.operators import grid, model, requests, vendor
from lamella.sources import tiff

MAX_COMPRESSED = 512 << 20
#: Bytes of tiles that a batch keeps: requests that touch the same tile come close together, and it is decoded once for them.
KEPT = 16 << 20
FACTS = ("compression", "predictor", "samples", "bits", "planar", "photometric", "big_endian", "jpeg_tables")
DECODED = "data binary, channels int, sample_type string, error string"


def facts(tags: DataFrame) -> DataFrame:
    """What decoding needs of each directory, with the defaults of absent tags; of stripped ones also rows_per_strip."""
    first = F.get("ints", F.lit(0))
    tag = lambda n, value=first: F.max(F.when(F.col("tag") == n, value))
    columns = {"compression": (259, 1), "predictor": (317, 1), "samples": (277, 1), "planar": (284, 1), "photometric": (262, 0), "rows_per_strip": (278, None)}
    out = tags.filter("tag is not null").groupBy("path", "ifd_id").agg(
        *[F.coalesce(tag(n), F.lit(d)).cast("int").alias(name) for name, (n, d) in columns.items()],
        F.coalesce(F.max(F.when(F.col("tag") == 258, F.array_max("ints"))), F.lit(1)).cast("int").alias("bits"),
        F.bool_or("big_endian").alias("big_endian"), F.max(F.when(F.col("tag") == 347, F.col("raw"))).alias("jpeg_tables"),
    )
    return out


def places(tags: DataFrame) -> DataFrame:
    """Where each tile or strip is: path, ifd_id, index, offset, length. Offsets and counts of different number are an error."""
    of = lambda *n: F.max(F.when(F.col("tag").isin(*n), F.col("ints")))
    both = tags.filter(F.col("tag").isin(273, 324, 279, 325)).groupBy("path", "ifd_id").agg(of(273, 324).alias("offsets"), of(279, 325).alias("counts"))
    fit = both.filter(F.size("offsets") == F.size("counts"))
    return fit.select("path", "ifd_id", F.posexplode(F.arrays_zip("offsets", "counts")).alias("index", "p")).select("path", "ifd_id", F.col("index").cast("long").alias("index"), F.col("p.offsets").alias("offset"), F.col("p.counts").alias("length"))


def fetch(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """rows: path, offset, length. Adds payload: from the files' content where they are given (path, content), else by
    position from the files themselves. Payloads over the limit are not read."""
    small = rows.withColumn("length", F.when(F.col("length") <= MAX_COMPRESSED, F.col("length")))
    if files is None:
        return tiff.payload_at(small)
    cut = F.substr("content", (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return small.join(files.select("path", "content"), "path", "left").withColumn("payload", F.when(F.octet_length(cut) == F.col("length"), cut)).drop("content")


def samples_of(payload: bytes, width: int, height: int, compression: int, predictor: int, samples: int, bits: int, planar: int, photometric: int, big_endian: bool, tables: bytes | None) -> np.ndarray:
    """Rows, columns, samples of one payload that holds width x height pixels."""
    if compression in (6, 7):
        said = "ForceRgb" if photometric == 2 and samples == 3 else "ForceYCbCr" if photometric == 6 and samples == 3 else "Auto"
        out = jpeg.decode(payload, tables, said)
        if out.shape[0] < height or out.shape[1] < width:
            raise ValueError("JPEG is smaller than its tile")
        return out[:height, :width]
    if compression in (1, 5, 8, 32946, 50000, 32773):
        if compression == 5:
            payload = codecs.lzw_decode_bytes(payload)
        elif compression in (8, 32946):
            payload = zlib.decompress(payload)
        elif compression == 32773:
            payload = codecs.packbits_decode_bytes(payload)
        elif compression == 50000:
            import zstandard

            payload = zstandard.ZstdDecompressor().decompress(payload)
    else:
        raise ValueError(f"compression {vendor.COMPRESSION.get(compression, compression)} is not supported")
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits a sample")
    kind = np.dtype("u1" if bits == 8 else (">u2" if big_endian else "<u2"))
    if payload is None or len(payload) != width * height * samples * kind.itemsize:
        raise ValueError("payload has another size than its tile")
    flat = np.frombuffer(payload, kind).astype(kind.newbyteorder("="))
    out = flat.reshape(samples, height, width).transpose(1, 2, 0) if planar == 2 else flat.reshape(height, width, samples)
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=out.dtype)
    if photometric == 0:
        out = np.iinfo(out.dtype).max - out
    return out


def decoded(payload: Column, width: Column, height: Column, keep_w: Column, keep_h: Column, fact: dict[str, Column]) -> Column:
    """A struct of data, channels, sample_type and error. width, height: of the payload; keep_w, keep_h: what of it is inside
    the level. An empty payload is black; a missing one is an error."""

    @F.pandas_udf(DECODED)
    def of(raw: pd.Series, w: pd.Series, h: pd.Series, kw: pd.Series, kh: pd.Series, rest: pd.DataFrame) -> pd.DataFrame:
        out, known, size = [], {}, 0
        for p, a, b, c, d, x in zip(raw, w, h, kw, kh, rest.itertuples(index=False)):
            if p is None:
                out.append((None, None, None, "PayloadOutOfBounds"))
                continue
            try:
                if len(p):
                    key = (bytes(p), int(a), int(b), *x[:-1], None if x.jpeg_tables is None else bytes(x.jpeg_tables))
                    tile = known.get(key)
                    if tile is None:
                        tile = samples_of(*key)
                        if size > KEPT:
                            known, size = {}, 0
                        known[key], size = tile, size + len(p) + tile.nbytes
                    tile = tile[: int(d), : int(c)]
                else:
                    tile = np.zeros((int(d), int(c), 3), dtype=np.uint8)
                out.append((np.ascontiguousarray(tile).astype(tile.dtype.newbyteorder("<")).tobytes(), tile.shape[2], "Uint8" if tile.itemsize == 1 else "Uint16", None))
            except Exception as error:  # of this tile only: the batch goes on
                out.append((None, None, None, str(error)))
        return pd.DataFrame(out, columns=["data", "channels", "sample_type", "error"])

    return of(payload, width, height, keep_w, keep_h, F.struct(*(fact[n].alias(n) for n in FACTS)))


def _on_levels(asked: DataFrame, levels: DataFrame) -> DataFrame:
    return asked.join(levels.select("path", "level", "ifd_id", "width", "height", "tile_w", "tile_h", "tiles_across", "tiles_down"), ["path", "level"], "left")


def _decode_rows(rows: DataFrame, tags: DataFrame, files: DataFrame | None) -> DataFrame:
    """rows: path, ifd_id, col, row, width, height, tile_w, tile_h, tiles_across. Adds tile_width, tile_height and DECODED."""
    c = F.col
    placed = rows.withColumn("index", c("row") * c("tiles_across") + c("col")).join(places(tags), ["path", "ifd_id", "index"], "left").join(facts(tags), ["path", "ifd_id"], "left")
    sized = placed.withColumns({"tile_width": edge_extent(c("col"), c("tile_w"), c("width")), "tile_height": edge_extent(c("row"), c("tile_h"), c("height"))})
    got = fetch(sized, files)
    x = decoded(c("payload"), c("tile_w"), c("tile_h"), c("tile_width"), c("tile_height"), {n: c(n) for n in FACTS})
    return got.withColumn("x", x).drop("payload", *FACTS, "rows_per_strip", "index", "offset", "length").select("*", "x.*").drop("x")


def read_tiles(asked: DataFrame, levels: DataFrame, tags: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """asked: slot, path, level, col, row. One row each, with tile_width, tile_height and DECODED; ``slot`` keeps the order. A
    level that is not there, or a tile outside it, is an error. Codecs may be mixed."""
    c = F.col
    on = _on_levels(asked, levels)
    bad = requests.first_error((c("ifd_id").isNull(), "LevelOutOfRange"), ((c("col") < 0) | (c("row") < 0) | (c("col") >= c("tiles_across")) | (c("row") >= c("tiles_down")), "TileOutOfRange"))
    marked = on.withColumn("bad", bad)
    columns = [*asked.columns, "tile_width", "tile_height", "data", "channels", "sample_type", "error"]
    good = _decode_rows(marked.filter("bad is null"), tags, files).select(columns)
    rest = marked.filter("bad is not null").select(*asked.columns, *(F.lit(None).cast(good.schema[n].dataType).alias(n) for n in columns[len(asked.columns) : -1]), c("bad").alias("error"))
    return good.unionByName(rest)


def read_raw(asked: DataFrame, levels: DataFrame, tags: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """asked as for read_tiles. Each tile's payload as it is stored, with its codec, sizes and photometric; JPEG streams get
    their file's tables, so that each stands alone."""
    c = F.col
    rows = _on_levels(asked, levels).withColumn("index", c("row") * c("tiles_across") + c("col"))
    got = fetch(rows.join(places(tags), ["path", "ifd_id", "index"]).join(facts(tags), ["path", "ifd_id"]), files)

    @F.pandas_udf("binary")
    def whole(payload: pd.Series, tables: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else jpeg.splice(bytes(p), t) for p, t in zip(payload, tables)])

    data = F.when(c("compression").isin(6, 7), whole("payload", "jpeg_tables")).otherwise(c("payload"))
    photometric = F.when(c("photometric") == 6, "YbrFull422").when(c("photometric") == 2, "Rgb").when(c("photometric").isin(0, 1), "Monochrome2")
    out = got.withColumns({"data": data, "codec": vendor.compression(c("compression")), "photometric": photometric})
    error = model.raw_tile_error({"width": c("tile_w"), "height": c("tile_h"), "bits": c("bits"), "samples": c("samples"), "photometric": c("photometric"), "bytes": F.octet_length("data")})
    return out.select(*asked.columns, "codec", c("tile_w").alias("width"), c("tile_h").alias("height"), "bits", "samples", "photometric", "data", error.alias("error"))


def gathered(rows: DataFrame, by: list[str], order: str, whole: Callable[[list], tuple], schema: str) -> DataFrame:
    """A row for each group of rows, which ``whole`` makes of them in order. Groups stream through sorted tasks, and results go
    back by the megabyte: a frame for each small group would cost more than its pixels."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out, size = None, [], [], 0
        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                now = tuple(getattr(row, b) for b in by)
                if held and now != key:
                    out.append(whole(held))
                    size += sum(200 + (len(v) if isinstance(v, bytes) else 0) for v in out[-1])
                    held = []
                    if size >= 8 << 20:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out, size = [], 0
                key = now
                held.append(row)
        if held:
            out.append(whole(held))
        yield pd.DataFrame(out, columns=names, dtype=object)

    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInPandas(run, schema)


def compose(tiles: DataFrame, by: str) -> DataFrame:
    """tiles: by, w, h, ordinal, dest_x, dest_y, tile_width, tile_height, channels, data, error. One row a region, of 8-bit
    samples: later tiles overwrite, what none covers is zero; the first error of its tiles is the region's."""

    def whole(rows: list) -> tuple:
        one, failed = rows[0], next((r.error for r in rows if r.error is not None), None)
        if failed is not None:
            return one.key, one.w, one.h, None, None, failed
        n = max((int(r.channels) for r in rows if r.data is not None), default=3)
        out = np.zeros((int(one.h), int(one.w), n), dtype=np.uint8)
        for t in rows:
            if t.data is None:
                continue
            a = np.frombuffer(t.data, np.uint8).reshape(int(t.tile_height), int(t.tile_width), int(t.channels))
            x, y = int(t.dest_x), int(t.dest_y)
            x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + a.shape[1], out.shape[1]), min(y + a.shape[0], out.shape[0])
            if x0 < x1 and y0 < y1:
                out[y0:y1, x0:x1] = a[y0 - y : y1 - y, x0 - x : x1 - x]
        return one.key, one.w, one.h, n, out.tobytes(), None

    kind = tiles.schema[by].dataType.simpleString()
    columns = ["w", "h", "ordinal", "dest_x", "dest_y", "tile_width", "tile_height", "channels", "data", "error"]
    rows = tiles.select(F.col(by).alias("key"), *columns)
    return gathered(rows, ["key"], "ordinal", whole, f"{by} {kind}, w long, h long, channels int, data binary, error string")


def read_regions(asked: DataFrame, levels: DataFrame, tags: DataFrame, files: DataFrame | None = None, max_pixels: int = requests.MAX_REGION_PIXELS) -> DataFrame:
    """asked: request_id, path, level, x, y, w, h, in the level's pixels. One row each: w, h, channels, data, error. A region
    may reach out of its level; a region above the limit, or of a level that is not there, is an error."""
    c = F.col
    on = _on_levels(asked, levels).withColumn("bad", requests.first_error((c("w") * c("h") > max_pixels, "RegionTooLarge"), (c("ifd_id").isNull(), "LevelOutOfRange")))
    hits = grid.regular_hits(on.filter("bad is null"), keep_empty=True)
    some = _decode_rows(hits.filter("col is not null and row is not null"), tags, files)
    none = hits.filter("col is null or row is null").select(*(c(f.name) if f.name in hits.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema.fields))
    composed = compose(some.unionByName(none), "request_id")
    bad = on.filter("bad is not null").select("request_id", c("w").cast("long"), c("h").cast("long"), F.lit(None).cast("int").alias("channels"), F.lit(None).cast("binary").alias("data"), c("bad").alias("error"))
    return composed.unionByName(bad)


def read_display(asked: DataFrame, levels: DataFrame, tags: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """asked: request_id, path, level, tile (its side), col, row. The square tile of the level clipped to it: a native tile of
    that size as it is, others composed. One that starts outside the level is an error."""
    c = F.col
    on = _on_levels(asked, levels)
    x, y = c("col") * c("tile"), c("row") * c("tile")
    bad = requests.first_error((c("ifd_id").isNull(), "LevelOutOfRange"), ((c("col") < 0) | (c("row") < 0) | (x >= c("width")) | (y >= c("height")), "OriginOutsideLevel"))
    marked = on.withColumns({"bad": bad, "x": x, "y": y, "w": F.least(c("tile"), c("width") - x), "h": F.least(c("tile"), c("height") - y), "native": (c("tile") == c("tile_w")) & (c("tile") == c("tile_h"))})
    native = _decode_rows(marked.filter("bad is null and native"), tags, files).select("request_id", c("w").cast("long").alias("w"), c("h").cast("long").alias("h"), "channels", "data", "error")
    others = read_regions(marked.filter("bad is null and not native").select("request_id", "path", "level", "x", "y", "w", "h"), levels, tags, files)
    wrong = marked.filter("bad is not null").select("request_id", *(F.lit(None).cast(native.schema[n].dataType).alias(n) for n in ("w", "h", "channels", "data")), c("bad").alias("error"))
    return native.unionByName(others).unionByName(wrong)


def read_synthetic(asked: DataFrame, levels: DataFrame, tags: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """asked: request_id, path, base_level, factor (a power of two), x, y, w, h, in pixels of the synthetic level. The region of
    the base that it stands for, halved as often as the factor says: only what is asked for is decoded."""
    base = asked.select("request_id", "path", F.col("base_level").alias("level"), *((F.col(n) * F.col("factor")).alias(n) for n in ("x", "y", "w", "h")))
    got = read_regions(base, levels, tags, files).join(asked.select("request_id", "factor"), "request_id")

    @F.pandas_udf("binary")
    def halve(data: pd.Series, w: pd.Series, h: pd.Series, n: pd.Series, factor: pd.Series) -> pd.Series:
        out = []
        for d, a, b, k, f in zip(data, w, h, n, factor):
            if d is None:
                out.append(None)
                continue
            x = np.frombuffer(d, np.uint8).reshape(int(b), int(a), int(k)).astype(np.uint32)
            while f > 1:
                x = (x[::2, ::2] + x[1::2, ::2] + x[::2, 1::2] + x[1::2, 1::2]) // 4
                f //= 2
            out.append(x.astype(np.uint8).tobytes())
        return pd.Series(out)

    small = lambda n: F.floor(F.col(n) / F.col("factor")).cast("long").alias(n)
    return got.select("request_id", small("w"), small("h"), "channels", halve("data", "w", "h", "channels", "factor").alias("data"), "error")


def read_images(images: DataFrame, tags: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """images: path, name, ifd_id, width, height, of stripped directories. Each whole image: its strips in order, plane after
    plane where they are apart. One row an image: channels, data, error."""
    c = F.col
    rows = images.join(facts(tags), ["path", "ifd_id"]).join(places(tags), ["path", "ifd_id"])
    step = F.coalesce("rows_per_strip", c("height"))
    per_plane = F.ceil(c("height") / step)
    apart = c("planar") == 2
    strip = F.when(apart, F.pmod(c("index"), per_plane)).otherwise(c("index"))
    rows = rows.withColumns({"plane": F.when(apart, F.floor(c("index") / per_plane)).otherwise(0).cast("long"), "dest_y": strip * step, "tile_height": edge_extent(strip, step, c("height"))})
    rows = rows.withColumns({"samples": F.when(apart, 1).otherwise(c("samples")).cast("int"), "planes": F.when(apart, c("samples")).otherwise(1)})
    x = decoded(c("payload"), c("width"), c("tile_height"), c("width"), c("tile_height"), {n: F.lit(1) if n == "planar" else c(n) for n in FACTS})
    got = fetch(rows, files).withColumn("x", x).select("path", "name", "width", "height", "index", "plane", "planes", "dest_y", "tile_height", "x.*")

    def whole(strips: list) -> tuple:
        one, failed = strips[0], next((t.error for t in strips if t.error is not None), None)
        if failed is not None:
            return one.path, one.name, one.width, one.height, None, None, failed
        n, planes = int(one.channels), int(one.planes)
        out = np.zeros((int(one.height), int(one.width), max(n, planes)), dtype=np.uint8)
        for t in strips:
            a = np.frombuffer(t.data, np.uint8).reshape(int(t.tile_height), int(one.width), n)
            at = slice(int(t.dest_y), int(t.dest_y + t.tile_height))
            if planes > 1:
                out[at, :, int(t.plane)] = a[:, :, 0]
            else:
                out[at] = a
        return one.path, one.name, one.width, one.height, out.shape[2], out.tobytes(), None

    return gathered(got, ["path", "name"], "index", whole, "path string, name string, width long, height long, channels int, data binary, error string")


def read_associated(asked: DataFrame, images: DataFrame, tags: DataFrame, files: DataFrame | None = None, optional: bool = False) -> DataFrame:
    """asked: path, name. Its image; where there is none, an error, or nothing if optional."""
    wanted = images.join(asked, ["path", "name"], "left_semi")
    out = asked.join(read_images(wanted, tags, files), ["path", "name"], "left")
    return out if optional else out.withColumn("error", F.when(F.col("data").isNull(), F.coalesce("error", F.lit("AssociatedImageNotFound"))))


def premultiplied(data: Column, channels: Column) -> Column:
    """8-bit samples as 32-bit words of alpha, red, green and blue, low byte first: grey and RGB are opaque."""

    @F.pandas_udf("binary")
    def of(values: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for d, k in zip(values, n):
            if d is None:
                out.append(None)
                continue
            a = np.frombuffer(d, np.uint8).reshape(-1, int(k)).astype(np.uint32)
            rgb, alpha = (np.repeat(a[:, :1], 3, axis=1), np.full(len(a), 255, np.uint32)) if k < 3 else (a[:, :3], a[:, 3] if k == 4 else np.full(len(a), 255, np.uint32))
            rgb = (rgb * alpha[:, None] + 127) // 255
            out.append((alpha << 24 | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]).astype("<u4").tobytes())
        return pd.Series(out)

    return of(data, channels)


def in_level_pixels(asked: DataFrame, levels: DataFrame) -> DataFrame:
    """asked: path, level, x, y in pixels of level 0. The same in the level's own, divided by its downsample and rounded down."""
    on = asked.join(levels.select("path", "level", "downsample"), ["path", "level"])
    return on.withColumns({n: F.floor(F.col(n) / F.col("downsample")).cast("long") for n in ("x", "y")}).drop("downsample")


def retiled(streams: DataFrame, width: int, height: int) -> DataFrame:
    """streams: id, data (a baseline JPEG). Its tiles of that size as JPEG streams of their own, from the same coefficients:
    id, col, row, data. Sizes are multiples of the MCU; nothing is decoded to samples, so nothing is lost."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, data in frame.itertuples(index=False):
                image = jpeg.coefficients(bytes(data))
                for y in range(0, image.height, height):
                    for x in range(0, image.width, width):
                        part = jpeg.cropped(image, x, y, min(width, image.width - x), min(height, image.height - y))
                        out.append((key, x // width, y // height, jpeg.emit(part)))
            yield pd.DataFrame(out, columns=["id", "col", "row", "data"])

    kind = streams.schema["id"].dataType.simpleString()
    return streams.select("id", "data").mapInPandas(run, f"id {kind}, col long, row long, data binary")


def to_rgba(data: Column, channels: Column, alpha: bool = True) -> Column:
    """8-bit interleaved samples as RGBA, or RGB: grey thrice, an absent alpha opaque."""

    @F.pandas_udf("binary")
    def of(values: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for d, k in zip(values, n):
            if d is None:
                out.append(None)
                continue
            a = np.frombuffer(d, np.uint8).reshape(-1, int(k))
            rgb = np.repeat(a[:, :1], 3, axis=1) if k < 3 else a[:, :3]
            last = a[:, 3:4] if k == 4 else np.full((len(a), 1), 255, np.uint8)
            out.append((np.concatenate([rgb, last], axis=1) if alpha else np.ascontiguousarray(rgb)).tobytes())
        return pd.Series(out)

    return of(data, channels)


def fitted(data: Column, width: Column, height: Column, channels: Column, to_w: Column, to_h: Column) -> Column:
    """The upper left part of a tile; null where the tile is smaller than that."""

    @F.pandas_udf("binary")
    def of(values: pd.Series, w: pd.Series, h: pd.Series, n: pd.Series, tw: pd.Series, th: pd.Series) -> pd.Series:
        cut = lambda d, a, b, k, c, e: None if d is None or c > a or e > b else np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(int(b), int(a), int(k))[: int(e), : int(c)]).tobytes()
        return pd.Series([cut(*x) for x in zip(values, w, h, n, tw, th)])

    return of(data, width, height, channels, to_w, to_h)


def zeros(width: Column, height: Column, channels: Column, sample_type: Column) -> Column:
    """What a region without tiles holds: zeros, of the channels and samples that its slide has."""
    return F.unhex(F.repeat(F.lit("00"), (width * height * channels * model.sample_bytes(sample_type)).cast("int")))


def read_placed(asked: DataFrame, placed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """asked: slot, path, level, col, row. placed: path, level, col, row, src_x, src_y, tile_w, tile_h, and where the JPEG image is
    that holds the tile (path of the data file, offset, length). The part of the image that is the tile."""
    c = F.col
    rows = asked.join(placed.withColumnRenamed("file_path", "data_path"), ["path", "level", "col", "row"], "left")
    there = rows.filter("data_path is not null").withColumnRenamed("path", "slide").withColumnRenamed("data_path", "path")

    @F.pandas_udf(DECODED)
    def of(raw: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for p, a, b, m, n in zip(raw, x, y, w, h):
            try:
                tile = jpeg.decode(bytes(p))[int(b) : int(b + n), int(a) : int(a + m)]
                out.append((np.ascontiguousarray(tile).tobytes(), tile.shape[2], "Uint8", None))
            except (ValueError, TypeError) as error:
                out.append((None, None, None, str(error)))
        return pd.DataFrame(out, columns=["data", "channels", "sample_type", "error"])

    got = fetch(there, files).withColumn("x", of("payload", "src_x", "src_y", "tile_w", "tile_h"))
    keys = [c("slide").alias(n) if n == "path" else c(n) for n in asked.columns]
    good = got.select(*keys, "tile_w", "tile_h", "x.*")
    none = rows.filter("data_path is null").select(*asked.columns, "tile_w", "tile_h", *(F.lit(None).cast(good.schema[n].dataType).alias(n) for n in ("data", "channels", "sample_type")), F.lit("TileNotStored").alias("error"))
    return good.unionByName(none)
