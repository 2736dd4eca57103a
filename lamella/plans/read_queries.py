"""Queries that read generated slides: tags, tiles, regions, display tiles, strips, raw payloads; the same pixels in SQL.

Slide s of the suppliers is a TIFF whose byte order, size of offsets, codec and predictor follow from s. Level 0 has
48 + s % 23 by 40 + s % 17 pixels in tiles of 16, level 1 half of that; sample k of pixel (x, y) of level l is
(s * 7 + l * 11 + x * 3 + y * 5 + k * 31) % 251. JPEG slides have tiles of one colour, which that codec keeps exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import jpeg
from lamella.operators import reading, tables, tiff_layout
from lamella.plans.fixtures import table
from lamella.sources import tiff, tiff_write

QUERIES, SQL = {}, {}
TILE = 16
CODECS = [(1, 1), (5, 1), (8, 2), (50000, 1), (7, 1), (5, 2)]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def pixels(s: int, level: int, w: int, h: int) -> np.ndarray:
    y, x, k = np.mgrid[0:h, 0:w, 0:3]
    if s % 6 == 4 and level < 9:
        x, y = x // TILE, y // TILE
    return ((s * 7 + level * 11 + x * 3 + y * 5 + k * 31) % 251).astype(np.uint8)


def slide(s: int) -> bytes:
    w, h = 48 + s % 23, 40 + s % 17
    codec, predictor = CODECS[s % 6]
    order, texts = "<>"[s % 2], {270: "Aperio Image|AppMag = 20|MPP = 0.5"}
    level = lambda n, size: tiff_write.image(pixels(s, n, *size), TILE, codec, predictor, texts=texts, order=order, empty=(1,) if s % 5 == 0 and n == 0 else ())
    label = tiff_write.image(pixels(s, 9, 21, 13), None, 1, 1, 5, 1 + s % 2, texts={270: "a label"}, order=order)
    return tiff_write.tiff([level(0, (w, h)), level(1, (w // 2, h // 2)), label], order, s % 3 == 0)


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: made once, as a table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(f"s{s}.tif", slide(s)) for s in frame["s"].tolist()], columns=["path", "content"])

    return tables.stored(tables.spread(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as s")).mapInPandas(run, "path string, content binary"))


def _opened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """files, tags, levels, directories."""
    files = slides(spark, sf_dir)
    tags = tables.stored(tiff.tags_of(files))
    ifds = tables.stored(tiff_layout.images(tags))
    return files, tags, tiff_layout.levels(ifds, tiff_layout.vendors(ifds)), ifds


_S = "s as (select s_suppkey as s, 's' || s_suppkey || '.tif' as path, 48 + s_suppkey % 23 as w0, 40 + s_suppkey % 17 as h0 from supplier)"
_L = f"{_S}, l as (select s, path, l as level, w0 >> l as w, h0 >> l as h from s, (select unnest([0, 1]) as l))"
#: A pixel's sample, black where the tile is left out.
_V = "case when s % 5 = 0 and level = 0 and x // 16 = 1 and y // 16 = 0 then 0 else (s * 7 + level * 11 + (case when s % 6 = 4 then x // 16 else x end) * 3 + (case when s % 6 = 4 then y // 16 else y end) * 5 + k * 31) % 251 end"
_SUMS = "cast(sum(v) as bigint) as total, cast(sum(v * (i % 97)) as bigint) as weighted"


def _sums(data: str = "data") -> list:
    """The sum of a buffer's samples, and the sum weighted by place."""

    @F.pandas_udf("total long, weighted long")
    def of(values: pd.Series) -> pd.DataFrame:
        out = [(None, None) if v is None else (int((a := np.frombuffer(v, np.uint8).astype(np.int64)).sum()), int((a * (np.arange(len(a)) % 97)).sum())) for v in values]
        return pd.DataFrame(out, columns=["total", "weighted"]).astype("Int64")

    return of(data)


@query(
    f"""with {_S}, d as (select s, path, cast(i as int) as ifd_index, case i when 0 then w0 when 1 then w0 // 2 else 21 end as width, case i when 0 then h0 when 1 then h0 // 2 else 13 end as height, [1, 5, 8, 50000, 7, 5][s % 6 + 1] as codec from s, (select unnest([0, 1, 2]) as i))
select path, ifd_index, cast(width as bigint) as width, cast(height as bigint) as height, cast(case when ifd_index = 2 then 1 else codec end as bigint) as compression, case when ifd_index < 2 then 'Aperio Image|AppMag = 20|MPP = 0.5' else 'a label' end as description,
 cast(case when ifd_index < 2 then ((width + 15) // 16) * ((height + 15) // 16) else 3 * (1 + 2 * (s % 2)) end as int) as n_places, s % 2 = 1 as big_endian from d"""
)
def tiff_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = tiff.tags_of(slides(spark, sf_dir))
    tag = lambda n, v: F.max(F.when(F.col("tag") == n, v))
    first = F.get("ints", F.lit(0))
    return tags.groupBy("path", "ifd_index").agg(tag(256, first).alias("width"), tag(257, first).alias("height"), tag(259, first).alias("compression"), tag(270, F.col("text")).alias("description"), F.max(F.when(F.col("tag").isin(273, 324), F.size("ints"))).alias("n_places"), F.bool_or("big_endian").alias("big_endian"))


@query(
    f"""with {_L} select path, 'aperio' as vendor, cast(level as int) as level, cast(w as bigint) as width, cast(h as bigint) as height, cast((w + 15) // 16 as bigint) as tiles_across, cast((h + 15) // 16 as bigint) as tiles_down,
 round((first_value(w) over o * 1.0::double / w + first_value(h) over o * 1.0::double / h) / 2, 9) as downsample, ['None', 'Lzw', 'Deflate', 'Zstd', 'Jpeg', 'Lzw'][s % 6 + 1] as codec from l window o as (partition by path order by level)"""
)
def opened_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, levels, _ = _opened(spark, sf_dir)
    return levels.select("path", "vendor", "level", "width", "height", "tiles_across", "tiles_down", F.round("downsample", 9).alias("downsample"), "codec")


_TILES = f"{_L}, a as (select *, unnest(range(0, 7)) as col from l), t as (select *, unnest(range(0, 5)) as row from a)"
_INSIDE = "t.col * 16 < t.w and t.row * 16 < t.h"


@query(
    f"""with {_TILES}, p as (select path, level, col, "row" as r, s, w, h, unnest(range(0, 16 * 16 * 3)) as j from t where {_INSIDE}), q as (select *, col * 16 + j // 3 % 16 as x, r * 16 + j // 48 as y, j % 3 as k, least(16, w - col * 16) as tw from p),
v as (select path, level, col, r, tw, least(16, h - r * 16) as th, {_V} as v, ((y - r * 16) * tw + (x - col * 16)) * 3 + k as i from q where x < w and y < h)
select path, cast(level as int) as level, cast(col as bigint) as col, cast(r as bigint) as "row", cast(tw as bigint) as tile_width, cast(th as bigint) as tile_height, {_SUMS}, null as error from v group by all
union all select path, cast(level as int), cast(col as bigint), cast("row" as bigint), null, null, null, null, 'TileOutOfRange' from t where not ({_INSIDE})
union all select path, 2, 0, 0, null, null, null, null, 'LevelOutOfRange' from s"""
)
def read_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile of both levels, tiles past the edge, and one of a level that is not there."""
    files, tags, levels, _ = _opened(spark, sf_dir)
    asked = files.select("path", F.explode(F.expr("transform(sequence(0, 69), i -> struct(cast(i div 35 as int) as level, cast(i % 35 % 7 as bigint) as col, cast(i % 35 div 7 as bigint) as row))")).alias("t")).select("path", "t.*")
    asked = asked.unionByName(files.selectExpr("path", "2 as level", "0L as col", "0L as row")).withColumn("slot", F.xxhash64("path", "level", "col", "row"))
    out = reading.read_tiles(asked, levels, tags, files)
    return out.withColumn("s", _sums()).select("path", "level", "col", "row", "tile_width", "tile_height", "s.*", "error")


_REGIONS = f"{_L}, g as (select path || level || i as request_id, s, path, level, w as lw, h as lh, cast(i * 9 - 5 as bigint) as x0, cast(i * 7 - 3 as bigint) as y0, 11 + i * 5 as w, 9 + i * 4 as h from l, (select unnest([0, 1, 2, 9]) as i))"


def _regions(files: DataFrame) -> DataFrame:
    asked = files.select("path", F.explode(F.expr("flatten(transform(array(0, 1), l -> transform(array(0, 1, 2, 9), i -> struct(l as level, i))))")).alias("t")).select("path", "t.*")
    return asked.selectExpr("concat(path, level, i) as request_id", "path", "level", "cast(i * 9 - 5 as bigint) as x", "cast(i * 7 - 3 as bigint) as y", "cast(11 + i * 5 as bigint) as w", "cast(9 + i * 4 as bigint) as h")


@query(
    f"""with {_REGIONS}, p as (select *, unnest(range(0, w * h * 3)) as i from g), q as (select *, x0 + i // 3 % w as x, y0 + i // 3 // w as y, i % 3 as k from p)
select request_id, cast(w as bigint) as w, cast(h as bigint) as h, cast(sum(v) as bigint) as total, cast(sum(v * (i % 97)) as bigint) as weighted from (select request_id, w, h, i, case when x >= 0 and y >= 0 and x < lw and y < lh then {_V} else 0 end as v from q) group by all"""
)
def read_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that cross tiles, start before their level, end after it, or miss it."""
    files, tags, levels, _ = _opened(spark, sf_dir)
    out = reading.read_regions(_regions(files), levels, tags, files)
    return out.withColumn("x", _sums()).select("request_id", "w", "h", "x.*")


_DISPLAY = f"{_L}, g as (select path || level || t || c || r as request_id, s, path, level, w as lw, h as lh, t, c, r, c * t as x0, r * t as y0, least(t, w - c * t) as w, least(t, h - r * t) as h from l, (select unnest([16, 24]) as t), (select unnest([0, 1, 3]) as c), (select unnest([0, 1]) as r))"


@query(
    f"""with {_DISPLAY}, ok as (select * from g where w > 0 and h > 0), p as (select *, unnest(range(0, w * h * 3)) as i from ok), q as (select *, x0 + i // 3 % w as x, y0 + i // 3 // w as y, i % 3 as k from p)
select request_id, cast(w as bigint) as w, cast(h as bigint) as h, {_SUMS}, null as error from (select *, {_V} as v from q) group by all union all select request_id, null, null, null, null, 'OriginOutsideLevel' from g where w <= 0 or h <= 0"""
)
def read_display_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, tags, levels, _ = _opened(spark, sf_dir)
    asked = files.select("path", F.explode(F.expr("flatten(flatten(flatten(transform(array(0, 1), l -> transform(array(16, 24), t -> transform(array(0, 1, 3), c -> transform(array(0, 1), r -> struct(l as level, t, c, r))))))))")).alias("t")).select("path", "t.*")
    asked = asked.selectExpr("concat(path, level, t, c, r) as request_id", "path", "level", "cast(t as bigint) as tile", "cast(c as bigint) as col", "cast(r as bigint) as row")
    return reading.read_display(asked, levels, tags, files).withColumn("x", _sums()).select("request_id", "w", "h", "x.*", "error")


@query(
    f"""with {_S}, p as (select s, path, unnest(range(0, 21 * 13 * 3)) as i from s), v as (select path, i, (s * 7 + 99 + i // 3 % 21 * 3 + i // 63 * 5 + i % 3 * 31) % 251 as v from p)
select path, 'label' as name, cast(21 as bigint) as width, {_SUMS}, null as error from v group by all union all select path, 'macro', null, null, null, 'AssociatedImageNotFound' from s"""
)
def read_associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of three planes, together and apart; and an image that no slide has."""
    files, tags, _, ifds = _opened(spark, sf_dir)
    images = tiff_layout.associated(ifds, tiff_layout.vendors(ifds))
    asked = files.select("path", F.explode(F.array(F.lit("label"), F.lit("macro"))).alias("name"))
    return reading.read_associated(asked, images, tags, files).withColumn("x", _sums()).select("path", "name", "width", "x.*", "error")


@query(
    f"""with {_S}, p as (select s, path, unnest(range(0, 21 * 13)) as i from s), v as (select path, i, s * 7 + 99 + i % 21 * 3 + i // 21 * 5 as b from p)
select path, cast(sum((i % 97 + 1) * (4278190080 + b % 251 * 65536 + (b + 31) % 251 * 256 + (b + 62) % 251)) as bigint) as checksum from v group by path"""
)
def associated_argb(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, tags, _, ifds = _opened(spark, sf_dir)
    images = tiff_layout.associated(ifds, tiff_layout.vendors(ifds)).filter("name = 'label'")
    out = reading.read_images(images, tags, files)

    @F.pandas_udf("long")
    def checksum(values: pd.Series) -> pd.Series:
        return pd.Series([int(((a := np.frombuffer(v, "<u4").astype(np.int64)) * (np.arange(len(a)) % 97 + 1)).sum()) for v in values])

    return out.select("path", checksum(reading.premultiplied(F.col("data"), F.col("channels"))).alias("checksum"))


@query(
    f"""with {_S} select path, ['None', 'Lzw', 'Deflate', 'Zstd', 'Jpeg', 'Lzw'][s % 6 + 1] as codec, cast(16 as bigint) as width, 'Rgb' as photometric, case s % 6 when 0 then 768 end as bytes, s % 6 = 4 as is_jpeg, null as error from s where s % 5 > 0
union all select path, ['None', 'Lzw', 'Deflate', 'Zstd', 'Jpeg', 'Lzw'][s % 6 + 1], 16, 'Rgb', case s % 6 when 0 then 0 end, false, 'EmptyData' from s where s % 5 = 0"""
)
def read_raw_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second tile of each slide as it is stored; every fifth slide has left it out."""
    files, tags, levels, _ = _opened(spark, sf_dir)
    asked = files.selectExpr("path", "0 as level", "1L as col", "0L as row")
    out = reading.read_raw(asked, levels, tags, files)
    start = F.startswith(F.col("data"), F.unhex(F.lit("FFD8")))
    return out.select("path", "codec", "width", "photometric", F.when(F.col("codec") == "None", F.octet_length("data")).alias("bytes"), ((F.col("codec") == "Jpeg") & start).alias("is_jpeg"), "error")


@query(
    f"""with {_S}, l as (select s, path, 0 as level, w0 // 4 as w, h0 // 4 as h from s), p as (select *, unnest(range(0, w * h * 3)) as i from l), b as (select path, w, h, i, s, level, i // 3 % w * 4 as bx, i // 3 // w * 4 as by_, i % 3 as k from p),
f as (select path, w, h, i, s, level, k, unnest(range(0, 16)) as j, bx, by_ from b), z as (select path, w, h, i, s, level, k, bx + j % 4 as x, by_ + j // 4 as y, j from f), v as (select path, w, h, i, j % 4 // 2 as hx, j // 8 as hy, {_V} as v from z),
h1 as (select path, w, h, i, hx, hy, cast(sum(v) as bigint) // 4 as v from v group by all), h2 as (select path, w, h, i, cast(sum(v) as bigint) // 4 as v from h1 group by all)
select path, cast(w as bigint) as w, cast(h as bigint) as h, {_SUMS} from h2 group by all"""
)
def read_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of a level at a quarter that no slide has stored."""
    files, tags, levels, _ = _opened(spark, sf_dir)
    asked = levels.filter("level = 0").selectExpr("path as request_id", "path", "0 as base_level", "4L as factor", "0L as x", "0L as y", "width div 4 as w", "height div 4 as h")
    return reading.read_synthetic(asked, levels, tags, files).withColumn("x", _sums()).select(F.col("request_id").alias("path"), "w", "h", "x.*")


@query(
    """with s as (select s_suppkey as s, 17 + s_suppkey % 40 as w, 9 + s_suppkey % 30 as h from supplier), t as (select *, unnest(range(0, (w + 15) // 16)) as col from s), u as (select *, unnest(range(0, (h + 7) // 8)) as row from t),
p as (select s, w, h, col, row, unnest(range(0, least(16, w - col * 16) * least(8, h - row * 8))) as i from u), v as (select s, w, h, col, row, i, (s + (col * 16 + i % least(16, w - col * 16)) // 8 * 9 + (row * 8 + i // least(16, w - col * 16)) // 8 * 5) % 256 as v from p)
select s as id, cast(col as bigint) as col, cast(row as bigint) as "row", cast(sum(v) as bigint) as total, cast(sum(v * (i % 97)) as bigint) as weighted from v group by all"""
)
def jpeg_retile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey streams of one level for each block, cut into streams of 16 x 8 and decoded."""

    @F.pandas_udf("binary")
    def made(keys: pd.Series) -> pd.Series:
        out = []
        for s in keys.tolist():
            y, x = np.mgrid[0 : 9 + s % 30, 0 : 17 + s % 40]
            out.append(jpeg.encode(((s + x // 8 * 9 + y // 8 * 5) % 256).astype(np.uint8)[:, :, None]))
        return pd.Series(out)

    @F.pandas_udf("binary")
    def samples(streams: pd.Series) -> pd.Series:
        return pd.Series([jpeg.decode(bytes(v)).tobytes() for v in streams])

    streams = tables.spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(F.col("s_suppkey").alias("id"), made(F.col("s_suppkey")).alias("data"))
    return reading.retiled(streams, 16, 8).withColumn("pixels", samples("data")).withColumn("x", _sums("pixels")).select("id", "col", "row", "x.*")


@query(
    """with s as (select s_suppkey as k, 8 * (2 + s_suppkey % 3 * 2) as w, 8 + s_suppkey % 20 as h from supplier)
select k, cast(w as int) as width, cast(h as int) as height, case when k % 2 = 0 then 16 end as tile_w, case when k % 2 = 0 then 8 end as tile_h, cast(case when k % 2 = 0 then 16 else w end as int) as lenient_w, cast(w + 1 as int) as patched from s"""
)
def jpeg_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second stream has a restart interval of two blocks; the last column is a width written over the stream's own."""

    @F.pandas_udf("width int, height int, tile_w int, tile_h int, lenient_w int, patched int")
    def of(keys: pd.Series) -> pd.DataFrame:
        out = []
        for s in keys.tolist():
            w, h = 8 * (2 + s % 3 * 2), 8 + s % 20
            data = jpeg.encode(np.full((h, w, 1), s % 256, np.uint8))
            if s % 2 == 0:
                data = data[:2] + b"\xff\xdd\x00\x04\x00\x02" + data[2:]
            try:
                _, _, tile_w, tile_h = jpeg.tile_geometry(data)
            except jpeg.JpegError:
                tile_w = tile_h = None
            other = jpeg.header(jpeg.patched(data, w + 1, h, True))[0]
            lenient = jpeg.lenient_geometry(data[:100])
            out.append((lenient[0], lenient[1], tile_w, tile_h, lenient[2], other.width))
        return pd.DataFrame(out, columns=["width", "height", "tile_w", "tile_h", "lenient_w", "patched"]).astype("Int32")

    return tables.spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(F.col("s_suppkey").alias("k"), of(F.col("s_suppkey")).alias("x")).select("k", "x.*")
