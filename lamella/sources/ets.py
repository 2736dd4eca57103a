"""ETS frame files as rows: one for each stored tile, with what the file says of all of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators import model
from lamella.sources.ranges import Ranges
from lamella.sources.rows import exactly, parsed

# The compression code of JPEG 2000; the room for a background colour; bytes of a pixel type.
JP2K, BACKGROUND = 3, 40
TILES = "coords array<int>, offset long, length long, tile_w long, tile_h long, samples int, pixel_type int, background array<int>, pyramid boolean, error string"


def tiles_of(source: Ranges) -> Iterator[tuple]:
    head = exactly(source, 0, 64)
    if head[:3] != b"SIS":
        raise ValueError("no SIS")
    n_dims, extra = struct.unpack_from("<IQ", head, 12)
    chunks, n_chunks = struct.unpack_from("<QI", head, 32)
    more = exactly(source, extra, 40)
    if more[:3] != b"ETS":
        raise ValueError("no ETS")
    kind, samples, _, compression, _, tile_w, tile_h, _ = struct.unpack_from("<8I", more, 8)
    size = model.SAMPLE_BYTES.get(model.ETS_SAMPLES.get(kind, ""), 0)
    if not size:
        raise ValueError(f"pixel type {kind} is not supported")
    if compression != JP2K:
        raise ValueError(f"compression {compression} is not supported")
    if n_dims < 3:
        raise ValueError("too few dimensions")
    after = extra + 40 + 68
    colour = exactly(source, after, samples * size)
    pyramid = struct.unpack("<I", exactly(source, after + max(BACKGROUND, samples * size) + 4, 4))[0] != 0
    step = 4 + 4 * n_dims + 16
    for k in range(n_chunks):
        raw = exactly(source, chunks + k * step, step)
        offset, length = struct.unpack_from("<QI", raw, 4 + 4 * n_dims)
        yield list(struct.unpack_from(f"<{n_dims}i", raw, 4)), offset, length, tile_w, tile_h, samples, kind, list(colour[::size]), pyramid


def tiles(files: DataFrame) -> DataFrame:
    """path, level, z, c, t, col, row, offset, length, tile_w, tile_h, samples, sample_type, background, error."""
    c = F.col
    rows = parsed(files, tiles_of, TILES)
    kind = model.lookup(c("pixel_type"), model.ETS_SAMPLES, F.lit(None).cast("string"))
    keyed = rows.withColumn("k", model.ets_key(c("coords"), c("pyramid")))
    error = F.coalesce("error", F.when(c("k").isNull(), "NegativeCoordinate"))
    return keyed.select("path", "k.*", "offset", "length", "tile_w", "tile_h", "samples", kind.alias("sample_type"), model.background(c("samples"), c("background")).alias("background"), error.alias("error"))


def levels(found: DataFrame) -> DataFrame:
    """Sizes of the levels: the grid reaches to the last stored tile; downsample by the base's width."""
    out = found.filter("error is null").groupBy("path", "level", "tile_w", "tile_h").agg((F.max("col") + 1).cast("long").alias("tiles_across"), (F.max("row") + 1).cast("long").alias("tiles_down"))
    out = out.withColumns({"width": F.col("tiles_across") * F.col("tile_w"), "height": F.col("tiles_down") * F.col("tile_h")})
    return out.withColumn("downsample", F.first("width").over(Window.partitionBy("path").orderBy("level")) / F.col("width"))


def scenes(of_levels: DataFrame, folder: str = "folder") -> DataFrame:
    """of_levels: folder, path, level, width, height. The files of a slide as scenes, the largest base first, then by path."""
    base = of_levels.filter("level = 0")
    w = Window.partitionBy(folder).orderBy(F.desc(F.col("width") * F.col("height")), "path")
    return base.select(folder, "path", (F.row_number().over(w) - 1).alias("scene"))


def written(tiles_: list[tuple[tuple[int, ...], bytes]], tile_w: int, tile_h: int, samples: int, kind: int, background: bytes, pyramid: bool) -> bytes:
    """A file of these tiles (coordinates, payload)."""
    n_dims = len(tiles_[0][0]) if tiles_ else 4
    extra = 64
    head = extra + 40 + 68 + max(BACKGROUND, len(background)) + 8
    places, body = [], bytearray()
    for coords, payload in tiles_:
        places.append((coords, head + len(body), len(payload)))
        body += payload
    table = b"".join(struct.pack(f"<I{n_dims}iQII", 0, *coords, at, n, 0) for coords, at, n in places)
    out = b"SIS\0" + struct.pack("<IIIQIIQII", 64, 2, n_dims, extra, 228, 0, head + len(body), len(places), 0)
    out = out.ljust(extra, b"\0")
    out += b"ETS\0" + struct.pack("<9I", 0, kind, samples, 4, JP2K, 90, tile_w, tile_h, 1) + b"\0" * 68
    out += background.ljust(BACKGROUND, b"\0") + struct.pack("<II", 1, int(pyramid))
    return bytes(out) + bytes(body) + table
