"""Queries over generated containers: DICOM instances and frames, ETS tiles, JPEG 2000 headers, cache files; the same in SQL."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import jp2k
from lamella.plans.fixtures import table
from lamella.operators import identity, properties, reading, tables, tiff_layout
from lamella.plans import read_queries
from lamella.sources import cache, czi, dicom, ets, mirax, registry, tiff, vms, zvi

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def made(spark: SparkSession, sf_dir: str, name: str, build: Callable[[int], bytes], where: str = "true") -> DataFrame:
    """A file for each supplier s of which ``where`` holds: path, content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(f"{s}.{name}", build(s)) for s in frame["s"].tolist()], columns=["path", "content"])

    return tables.spread(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as s").filter(where)).mapInPandas(run, "path string, content binary")


def dicom_file(s: int) -> bytes:
    """Every fourth file has implicit VRs and a sequence of undefined length before its pixels; every seventh no series."""
    explicit = s % 4 != 0
    e = lambda tag, vr, value, **k: dicom.element(tag, vr, value, explicit, **k)
    number = lambda n: struct.pack("<H", n)
    out = e((8, 8), "CS", b"DERIVED\\PRIMARY\\VOLUME\\RESAMPLED") + e((8, 0x18), "UI", f"1.2.{s}".encode())
    if s % 7:
        out += e((0x20, 0xE), "UI", f"9.{s % 5}".encode())
    out += e((0x28, 2), "US", number(3)) + e((0x28, 4), "CS", b"YBR_ICT") + e((0x28, 8), "IS", str(2 + s % 3).encode()) + e((0x28, 0x10), "US", number(240)) + e((0x28, 0x11), "US", number(256))
    if s % 2:
        out += e((0x28, 0x30), "DS", b"0.5\\0.25")
    out += e((0x28, 0x100), "US", number(8)) + e((0x48, 6), "UL", struct.pack("<I", 1000 + s)) + e((0x48, 7), "UL", struct.pack("<I", 70_000))
    measures = e(dicom.MEASURES, "SQ", dicom.item(e(dicom.SPACING, "DS", f"0.00{1 + s % 9}\\0.002".encode())))
    if s % 3:
        out += e(dicom.SHARED, "SQ", dicom.item(measures))
    if s % 4 == 0:
        end = struct.pack("<HHI", *dicom.SEQUENCE_END, 0)
        out += e((0x5200, 0x9230), "SQ", b"", undefined=True) + struct.pack("<HHI", *dicom.ITEM, dicom.UNDEFINED) + e((0x28, 0x30), "DS", b"9\\9") + struct.pack("<HHI", *dicom.ITEM_END, 0) + end
        return dicom.part10("1.2.840.10008.1.2", out + dicom.element(dicom.PIXELS, "OW", b"\1" * 10, False))
    # two fragments a frame with a table (s % 4 = 1), one without (2), or all of one frame (3)
    n = 2 + s % 3
    if s % 4 == 1:
        sizes = [10 + 2 * k for k in range(2 * n)]
        starts = [sum(8 + x for x in sizes[: 2 * k]) for k in range(n)]
        pixels = dicom.encapsulated([b"\2" * x for x in sizes], starts)
    else:
        pixels = dicom.encapsulated([b"\3" * (5 + k) for k in range(n)])
    return dicom.part10("1.2.840.10008.1.2.4.90", out + pixels)


@query(
    """select s_suppkey || '.dcm' as path, case when s_suppkey % 7 > 0 then '9.' || s_suppkey % 5 end as series_uid, '1.2.' || s_suppkey as sop_uid, case when s_suppkey % 4 = 0 then '1.2.840.10008.1.2' else '1.2.840.10008.1.2.4.90' end as transfer_syntax, 'DERIVED,PRIMARY,VOLUME,RESAMPLED' as image_type,
 3 as samples, cast(2 + s_suppkey % 3 as int) as frames, 240 as rows, 256 as cols, cast(1000 + s_suppkey as bigint) as total_w, cast(70000 as bigint) as total_h, case when s_suppkey % 3 > 0 then (1 + s_suppkey % 9) / 1000.0::double when s_suppkey % 2 = 1 then 0.5::double end as spacing, cast(null as varchar) as error from supplier"""
)
def dicom_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dicom.instances(made(spark, sf_dir, "dcm", dicom_file))
    return rows.select("path", "series_uid", "sop_uid", "transfer_syntax", F.array_join("image_type", ",").alias("image_type"), "samples", "frames", "rows", "cols", "total_w", "total_h", F.get("spacing", F.lit(0)).alias("spacing"), "error")


@query(
    """with s as (select s_suppkey as s, 2 + s_suppkey % 3 as n from supplier where s_suppkey % 4 > 0), f as (select s, n, unnest(range(0, case when s % 4 = 1 then 2 * n else n end)) as k from s)
select s || '.dcm' as path, cast(k as int) as fragment, cast(case when s % 4 = 1 then 10 + 2 * k else 5 + k + (5 + k) % 2 end as bigint) as length, cast(case when s % 4 = 1 then k // 2 else k end as int) as frame from f"""
)
def dicom_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(spark, sf_dir, "dcm", dicom_file)
    return dicom.frames(files, dicom.instances(files)).select("path", "fragment", "length", "frame")


def _ets_coords(s: int) -> list[tuple[int, ...]]:
    tiles = [(x, y, z, 0) for x in range(1 + s % 4) for y in range(1 + s % 3) for z in range(1 + s % 2)]
    return tiles + [(x, y, 0, 1) for x in range((2 + s % 4) // 2) for y in range((2 + s % 3) // 2)]


def ets_file(s: int) -> bytes:
    """Level 0 has 1 + s % 4 by 1 + s % 3 tiles in 1 + s % 2 planes, level 1 half; every ninth file is of a type that is not supported."""
    return ets.written([(c, bytes([k % 256]) * (4 + k)) for k, c in enumerate(_ets_coords(s))], 512, 256, 3 if s % 2 else 1, 5 if s % 9 == 0 else 2, bytes([10, 20, 30][: 3 if s % 2 else 1]), True)


_ETS = """s as (select s_suppkey as s from supplier where s_suppkey % 9 > 0), a as (select s, 0 as level, unnest(range(0, 1 + s % 4)) as col from s), b as (select *, unnest(range(0, 1 + s % 3)) as row from a), c as (select *, unnest(range(0, 1 + s % 2)) as z from b),
d as (select s, 1 as level, unnest(range(0, (2 + s % 4) // 2)) as col from s), e as (select *, unnest(range(0, (2 + s % 3) // 2)) as row, 0 as z from d), t as (select s, level, z, col, "row" from c union all select s, level, z, col, "row" from e)"""


@query(
    f"""with {_ETS}, n as (select *, row_number() over (partition by s order by level, col, "row", z) - 1 as k from t)
select s || '.ets' as path, cast(level as int) as level, cast(z as int) as z, cast(col as int) as col, cast("row" as int) as "row", cast(4 + k as bigint) as length, case when s % 2 = 1 then '10,20,30' else '10,10,10' end as background, 'Uint8' as sample_type, cast(null as varchar) as error from n
union all select s_suppkey || '.ets', null, null, null, null, null, '0,0,0', null, 'pixel type 5 is not supported' from supplier where s_suppkey % 9 = 0"""
)
def ets_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ets.tiles(made(spark, sf_dir, "ets", ets_file))
    return rows.select("path", "level", "z", "col", "row", "length", F.array_join(F.col("background").cast("array<string>"), ",").alias("background"), "sample_type", "error")


@query(f"""with {_ETS} select s || '.ets' as path, cast(level as int) as level, cast((max(col) + 1) * 512 as bigint) as width, cast((max("row") + 1) * 256 as bigint) as height, round(first_value((max(col) + 1) * 512.0::double) over (partition by s order by level) / ((max(col) + 1) * 512), 9) as downsample from t group by s, level""")
def ets_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ets.levels(ets.tiles(made(spark, sf_dir, "ets", ets_file)))
    return found.select("path", "level", "width", "height", F.round("downsample", 9).alias("downsample"))


@query(f"""with {_ETS}, base as (select s, (max(col) + 1) * 512 * (max("row") + 1) * 256 as area from t where level = 0 group by s) select 'f' || s % 10 as folder, s || '.ets' as path, cast(row_number() over (partition by s % 10 order by area desc, s || '.ets') - 1 as int) as scene from base""")
def ets_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ets.levels(ets.tiles(made(spark, sf_dir, "ets", ets_file)))
    return ets.scenes(found.withColumn("folder", F.concat(F.lit("f"), F.split("path", r"\.")[0].cast("long") % 10)))


def codestream(s: int) -> bytes:
    """Breaks one rule for each remainder by 12."""
    m = s % 12
    w, h = 100 + s % 50, 60 + s % 30
    tile_w = w // 2 if m == 1 else w
    parts = 2 if m == 2 else 1
    comps = [(7, 1, 1)] * (1 if m == 3 else 3)
    if m == 4:
        comps[1] = (11, 1, 1)
    if m == 5:
        comps[1:] = [(7, 2, 1), (7, 1, 1)]
    if m in (6, 0):
        comps[1:] = [(7, 2, 2)] * 2
    segment = lambda marker, body: struct.pack(">HH", marker, len(body) + 2) + body
    out = struct.pack(">H", jp2k.SOC) + segment(jp2k.SIZ, struct.pack(">HIIIIIIIIH", 0, w, h, 0, 0, tile_w, h, 0, 0, len(comps)) + b"".join(bytes(c) for c in comps))
    out += segment(jp2k.COD, struct.pack(">BBHBBBBBB", 0, s % 5, 0 if m == 7 else 1, 1, 5, 5 if m == 8 else 4, 4, 2 if m == 9 else 0, 3 if m == 10 else s % 2))
    out += segment(jp2k.QCD, bytes([0x42]) + b"\0\0" * (3 if m == 11 else 16))
    for p in range(parts):
        out += segment(jp2k.SOT, struct.pack(">HIBB", 0, 12 + 2 + 20, p, parts)) + struct.pack(">H", jp2k.SOD) + b"\5" * 20
    return out + struct.pack(">H", jp2k.EOC) if s % 13 else out[:60]


@query(
    """with s as (select s_suppkey as s, s_suppkey % 12 as m from supplier)
select s || '.j2k' as path, case when s % 13 > 0 then cast(100 + s % 50 as bigint) end as width, case when s % 13 > 0 then cast(60 + s % 30 as bigint) end as height, case when s % 13 > 0 then ['LRCP', 'RLCP', 'RPCL', 'PCRL', 'CPRL'][s % 5 + 1] end as progression, case when s % 13 > 0 then case m when 2 then 40 else 20 end end as bytes,
 case when s % 13 = 0 then 'Malformed' when m = 1 then 'TileGrid' when m = 2 then 'TileParts' when m = 3 then 'Components' when m = 4 then 'Precision' when m = 5 then 'ChromaSampling' when m = 7 then 'Layers' when m = 8 then 'CodeBlock' when m = 9 then 'CodeBlockStyle' when m = 10 then 'Wavelet' when m = 11 then 'QuantSteps' end as error from s"""
)
def jp2k_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, "j2k", codestream).withColumn("h", jp2k.header(F.col("content")))
    total = F.aggregate("h.tile_parts", F.lit(0), lambda a, p: a + p["length"].cast("int"))
    return rows.select("path", "h.width", "h.height", "h.progression", total.alias("bytes"), jp2k.subset_error(F.col("h")).alias("error"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Levels, tiles and sources of a cache for each supplier: two levels of tiles of 16, of which those with (col + row + s) % 3
    = 0 are stored; sample i of a tile is (s + level * 5 + tile * 3 + i) % 256."""
    s = tables.spread(table(spark, sf_dir, "supplier").select("s_suppkey")).selectExpr("s_suppkey as s", "concat(s_suppkey, '.svcache') as path")
    levels = s.selectExpr("s", "path", "explode(array(0, 1)) as level").selectExpr("s", "path", "0 as scene", "0 as series", "level", "shiftright(40 + s % 20, level) as width", "shiftright(30 + s % 10, level) as height", "cast(shiftleft(1, level) as double) as downsample", "16 as tile_w", "16 as tile_h")
    levels = levels.selectExpr("*", "cast(ceil(width / 16) as bigint) as tiles_across", "cast(ceil(height / 16) as bigint) as tiles_down")
    tiles = levels.selectExpr("s", "path", "scene", "series", "level", "width as w", "height as h", "tiles_across", "explode(sequence(0L, tiles_across * tiles_down - 1)) as tile_index").filter("(tile_index % tiles_across + tile_index div tiles_across + s) % 3 = 0")
    tiles = tiles.selectExpr("*", "cast(least(16, w - tile_index % tiles_across * 16) as int) as width", "cast(least(16, h - tile_index div tiles_across * 16) as int) as height")
    data = F.expr("unhex(concat_ws('', transform(sequence(0, width * height * 3 - 1), i -> lpad(hex((s + level * 5 + tile_index * 3 + i) % 256), 2, '0'))))")
    tiles = tiles.select("path", "scene", "series", "level", "tile_index", "width", "height", F.lit(3).alias("channels"), F.lit("Rgb").alias("color_space"), data.alias("data"))
    sources = s.selectExpr("path", "named_struct('path', concat(s, '.tif'), 'len', s * 100, 'modified_unix_nanos', null, 'sample_sha256', sha2(path, 256)) as source", "map('vendor', 'aperio', 'k', cast(s as string)) as properties")
    return levels, tiles, sources


_STORED = """l as (select s_suppkey as s, unnest([0, 1]) as level from supplier), g as (select *, (40 + s % 20) >> level as w, (30 + s % 10) >> level as h from l), n as (select *, (w + 15) // 16 as across, (h + 15) // 16 as down from g),
t as (select *, unnest(range(0, across * down)) as tile from n), k as (select *, tile % across as col, tile // across as row, (tile % across + tile // across + s) % 3 = 0 as stored, least(16, w - tile % across * 16) as tw, least(16, h - tile // across * 16) as th from t)"""


@query(f"with {_STORED} select s || '.svcache' as path, cast(level as int) as level, cast(w as bigint) as width, cast(across as bigint) as tiles_across, cast(count(*) filter (stored) as bigint) as n_sparse, cast(null as varchar) as error from k group by s, level, w, across")
def cache_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, tiles, sources = _stored(spark, sf_dir)
    found = cache.levels(cache.opened(cache.files_of(cache.packed(tiles), levels, sources)))
    return found.select("path", "level", "width", "tiles_across", F.col("n_sparse").cast("long").alias("n_sparse"), "error")


@query(
    f"""with {_STORED}, p as (select s, level, col, "row" as r, tile, unnest(range(0, tw * th * 3)) as i from k where stored)
select s || '.svcache' as path, cast(level as int) as level, cast(col as bigint) as col, cast(r as bigint) as "row", cast(sum((s + level * 5 + tile * 3 + i) % 256 * (i % 97)) as bigint) as weighted, cast(null as varchar) as error from p group by all
union all select s || '.svcache', cast(level as int), cast(col as bigint), cast("row" as bigint), null, 'SlotNotPopulated' from k where not stored"""
)
def cache_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caches written as files and read back, digests verified."""
    levels, tiles, sources = _stored(spark, sf_dir)
    files = cache.files_of(cache.packed(tiles), levels, sources)
    found = cache.entries(cache.levels(cache.opened(files)))
    asked = levels.selectExpr("path", "scene", "series", "level", "explode(sequence(0L, tiles_across * tiles_down - 1)) as i", "tiles_across").selectExpr("i as slot", "path", "scene", "series", "level", "i % tiles_across as col", "i div tiles_across as row")
    out = cache.read_tiles(asked, found, files)

    @F.pandas_udf("long")
    def weighted(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else int(np.frombuffer(v, np.uint8) @ (np.arange(len(v)) % 97)) for v in values], dtype="Int64")

    return out.select("path", "level", "col", "row", weighted("data").alias("weighted"), "error")


@query("select s_suppkey || '.svcache' as path, 'aperio' as vendor, cast(s_suppkey * 100 as bigint) as source_len, false as complete, cast(null as varchar) as error from supplier")
def cache_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, tiles, sources = _stored(spark, sf_dir)
    found = cache.opened(cache.files_of(cache.packed(tiles), levels, sources))
    vendor = F.get(F.filter("m.properties", lambda p: F.get(p, F.lit(0)) == "vendor"), F.lit(0))
    return found.select("path", F.get(vendor, F.lit(1)).alias("vendor"), F.col("m.source.len").alias("source_len"), "m.complete", "error")


def mirax_index(s: int) -> bytes:
    """4 by 4 images, two to a position; three levels, each of half the images a side; the second record of the second level of
    every fifth slide is left out; and three other records."""
    levels = [[(y * 4 + x, 1000 * k + y * 4 + x, 7 + s % 5, k) for y in range(0, 4, 1 << k) for x in range(0, 4, 1 << k) if not (s % 5 == 0 and k == 1 and y * 4 + x == 2)] for k in range(3)]
    return mirax.written(f"ID{s % 10}", levels, [(100 + s, 20, 0), (200, 21, 1), (300, 22, 0)])


_MIRAX = "r as (select s_suppkey as s, l as level, x, y, l as file from supplier, (select unnest([0, 1, 2]) as l), (select unnest([0, 1, 2, 3]) as x), (select unnest([0, 1, 2, 3]) as y) where x % (1 << l) = 0 and y % (1 << l) = 0 and not (s_suppkey % 5 = 0 and l = 1 and y * 4 + x = 2))"


@query(f"""with {_MIRAX} select s || '.dat' as path, cast(level as int) as level, cast(y * 4 + x as int) as image_index, cast(1000 * level + y * 4 + x as bigint) as "offset", cast(7 + s % 5 as bigint) as length, cast(file as int) as file, cast(null as varchar) as error from r""")
def mirax_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirax.records(made(spark, sf_dir, "dat", mirax_index), 3, 3)


@query("""select s_suppkey || '.dat' as path, n as name, cast(case n when 'macro' then 100 + s_suppkey else 300 end as bigint) as "offset", cast(case n when 'macro' then 20 else 22 end as bigint) as length, cast(0 as int) as file, cast(null as varchar) as error from supplier, (select unnest(['macro', 'label']) as n)""")
def mirax_associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirax.associated(made(spark, sf_dir, "dat", mirax_index), 3, {"macro": 0, "label": 2})


@query(
    f"""with {_MIRAX}, t as (select *, unnest(range(0, case when level = 2 then 2 else 1 end)) as xi from r), u as (select *, unnest(range(0, case when level = 2 then 2 else 1 end)) as yi from t),
v as (select *, x + xi * 2 as xx, y + yi * 2 as yy from u), w as (select *, xx // 2 as xp, yy // 2 as yp from v), p as (select *, s % 3 = 0 and xp = 1 and yp = 1 as unused, xp * 900 + s % 7 as px, yp * 800 + s % 5 as py from w),
c as (select s, level, x // (case when level > 0 then 2 else 1 end) + xi as col, y // (case when level > 0 then 2 else 1 end) + yi as "row", (px + 500 * (xx - xp * 2)) / (1 << level)::double as pos_x, (py + 450 * (yy - yp * 2)) / (1 << level)::double as pos_y,
  case level when 0 then 500 - 20 / 2.0 when 1 then 500 - 20 / 1.0 else 250 - 20 / 1.0 end::double as ax, case level when 0 then 450 - 10 / 2.0 when 1 then 450 - 10 / 1.0 else 225 - 10 / 1.0 end::double as ay, xi * 250 as src_x, 1000 * level + y * 4 + x as o from p where not unused)
select s || '.dat' as path, cast(level as int) as level, cast(col as bigint) as col, cast("row" as bigint) as "row", round(pos_x - col * ax, 6) as off_x, round(pos_y - "row" * ay, 6) as off_y, cast(src_x as bigint) as src_x, cast(o as bigint) as "offset" from c"""
)
def mirax_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third slide does not use its last position."""
    found = mirax.records(made(spark, sf_dir, "dat", mirax_index), 3, 3).drop("error")
    paths = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as s", "concat(s_suppkey, '.dat') as path")
    levels = paths.selectExpr("path", "explode(array(0, 1, 2)) as level").selectExpr("path", "level", "shiftleft(1, level) as concat", "500 as image_w", "450 as image_h", "20D as overlap_x", "10D as overlap_y")
    levels = mirax.level_parameters(levels, F.lit(2), F.lit(True))
    slides = paths.selectExpr("path", "4 as images_x", "4 as images_y", "2 as divisions", "500 as image0_w", "450 as image0_h")
    positions = paths.selectExpr("s", "path", "explode(array(0, 1, 2, 3)) as position").selectExpr("path", "position", "if(s % 3 = 0 and position = 3, 0, position % 2 * 900 + s % 7) as px", "if(s % 3 = 0 and position = 3, 0, position div 2 * 800 + s % 5) as py")
    out = mirax.tiles(found, levels, slides, positions)
    return out.select("path", "level", "col", "row", F.round("off_x", 6).alias("off_x"), F.round("off_y", 6).alias("off_y"), "src_x", "offset")


def _vms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "supplier").selectExpr(
        "concat(s_suppkey, '.vms') as path",
        "posexplode(array('[Virtual Microscope Specimen]', 'NoJpegColumns=2', 'NoJpegRows = 1', concat('ImageFile=a', s_suppkey, '.jpg'), if(s_suppkey % 4 = 0, 'ImageFile(x)=bad', 'ImageFile(1,0)=b.jpg'), 'ImageFile(1, 0, 0)=layer.jpg', 'SourceLens=40', concat('PhysicalWidth=', s_suppkey * 1000), '; comment', '[Other]', 'ImageFile=no')) as (n, line)",
    )
    return properties.parse_ini(lines, "path")


@query(
    """select s_suppkey || '.vms' as path, cast(c as bigint) as shard, cast(c as int) as col, cast(0 as int) as "row", case when c = 0 then 'a' || s_suppkey || '.jpg' else 'b.jpg' end as file, case when s_suppkey % 4 = 0 then 'MissingShard' end as error
from supplier, (select unnest([0, 1]) as c) where c = 0 or s_suppkey % 4 > 0"""
)
def vms_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _vms(spark, sf_dir)
    return vms.shards(vms.images(pairs), pairs).withColumn("shard", F.col("shard").cast("long"))


@query("select s_suppkey || '.vms' as path, 'hamamatsu' as vendor, '40' as lens, case when s_suppkey > 0 then round(s_suppkey * 1000 / 5000.0::double, 9) end as mpp, 'a' || s_suppkey || '.jpg' as image from supplier")
def vms_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _vms(spark, sf_dir)
    found = vms.properties(pairs, pairs.select("path").distinct().selectExpr("path", "5 as width", "5 as height"))
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return found.groupBy("path").agg(value("vendor").alias("vendor"), value("objective-power").alias("lens"), F.round(value("mpp-x").cast("double"), 9).alias("mpp"), value("hamamatsu.ImageFile").alias("image"))


@query(
    """select p as path, case when p like '%.tif' then 'tiff' when p like '%.dcm' then 'dicom' when p like '%.svcache' then 'svcache' when p like '%.own' then 'own' end as vendor, case when p like '%.txt' then 'UnsupportedFormat' end as error
from (select s_suppkey || e as p from supplier, (select unnest(['.tif', '.dcm', '.svcache', '.own', '.txt']) as e) where s_suppkey % 3 = 0 or e in ('.own', '.txt'))"""
)
def registry_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated files of three formats, one of a user's own backend, and one of none."""
    own = registry.Registry.builtin().register(registry.Backend("own", lambda path, head: F.startswith(head, F.lit("OWN").cast("binary"))))
    return own.detect(_mixed(spark, sf_dir)).select("path", "vendor", "error")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(spark, sf_dir, "tif", read_queries.slide, "s % 3 = 0").unionByName(made(spark, sf_dir, "dcm", dicom_file, "s % 3 = 0"))
    levels, tiles, sources = _stored(spark, sf_dir)
    some = F.split("path", r"\.")[0].cast("long") % 3 == 0
    files = files.unionByName(cache.files_of(cache.packed(tiles.filter(some)), levels.filter(some), sources.filter(some)))
    files = files.unionByName(made(spark, sf_dir, "own", lambda s: b"OWN%d" % s)).unionByName(made(spark, sf_dir, "txt", lambda s: b"text"))
    return tables.stored(files)


@query(
    """with s as (select s_suppkey as s from supplier where s_suppkey % 3 = 0) select 'tiff' as vendor, s || '.tif' as path, cast(count(*) * 2 as bigint) as n from s group by s union all select 'dicom', s || '.dcm', 1 from s union all select 'svcache', s || '.svcache', 2 from s"""
)
def registry_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each backend's reader makes of its files: levels, instances, levels."""
    found = registry.Registry.builtin().open(_mixed(spark, sf_dir))
    count = lambda vendor, name: found[vendor][name].groupBy("path").agg(F.count("*").alias("n")).select(F.lit(vendor).alias("vendor"), "path", "n")
    return count("tiff", "levels").unionByName(count("dicom", "instances")).unionByName(count("svcache", "levels"))


@query(
    """with s as (select s_suppkey as s, (48 + s_suppkey % 23) // 2 as w, (40 + s_suppkey % 17) // 2 as h from supplier where s_suppkey % 6 = 0), t as (select *, unnest(range(0, (w + 15) // 16 * ((h + 15) // 16) * 768)) as i from s),
p as (select *, i // 768 % ((w + 15) // 16) * 16 + i % 768 // 3 % 16 as x, i // 768 // ((w + 15) // 16) * 16 + i % 768 // 48 as y, i % 3 as k from t),
b as (select s, i, lpad(lower(hex(case when x < w and y < h then (s * 7 + 11 + x * 3 + y * 5 + k * 31) % 251 else 0 end)), 2, '0') as v from p), d as (select s, string_agg(v, '' order by i) as v from b group by s),
n as (select string_agg('tiff.' || n || chr(0) || case when n = 'ImageDescription' then 'Aperio Image|AppMag = 20|MPP = 0.5' else '' end || chr(0), '' order by o) as t from (select unnest(['ImageDescription', 'Make', 'Model', 'Software', 'DateTime', 'Artist', 'HostComputer', 'Copyright', 'DocumentName']) as n, unnest(range(0, 9)) as o))
select s || '.tif' as path, sha256(unhex(d.v) || encode(n.t)) as quickhash, substr(sha256(unhex(d.v) || encode(n.t)), 1, 32) as dataset_id from d, n"""
)
def tiff_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncompressed slides, by the bytes of their lower level and their texts."""
    files = tables.stored(made(spark, sf_dir, "tif", read_queries.slide, "s % 6 = 0"))
    tags = tables.stored(tiff.tags_of(files))
    ifds = tables.stored(tiff_layout.images(tags))
    levels = tiff_layout.levels(ifds, tiff_layout.vendors(ifds))
    lowest = levels.groupBy("path").agg(F.max_by("ifd_id", "level").alias("ifd_id"), F.min_by("ifd_id", "level").alias("top"))
    ranges = reading.fetch(reading.places(tags).join(lowest.select("path", "ifd_id"), ["path", "ifd_id"]), files)
    facts = ifds.groupBy("path").agg(F.count("*").alias("ifds"), F.count_if(F.col("parent_id").isNull()).alias("top_ifds")).join(tags.groupBy("path").agg(F.bool_or("big_endian").alias("big_endian")), "path").join(lowest.select("path", "ifd_id"), "path").withColumn("big", F.lit(False))
    return identity.tiff_identity(ranges, identity.text_properties(tags, lowest.select("path", F.col("top").alias("ifd_id"))), facts)


def czi_file(s: int) -> bytes:
    """Subblocks of 20 by 12 pixels a step of 18 by 10 apart, 2 + s % 2 by 2, in scene s % 3, and their half; a thumbnail."""
    blocks = []
    for m, (i, j) in enumerate((i, j) for j in range(2) for i in range(2 + s % 2)):
        value = bytes([(s * 3 + m * 40 + k) % 256 for k in range(3)])
        dims = {"X": (i * 18 - 5, 20, 20), "Y": (j * 10 + 7, 12, 12), "M": (m, 1, 1), "S": (s % 3, 1, 1)}
        blocks.append({"kind": 3, "compression": 0, "dims": dims, "data": value * 240})
    blocks.append({"kind": 3, "compression": 0, "dims": {"X": (-5, 40, 20), "Y": (7, 24, 12)}, "data": bytes([s % 256] * 3) * 240})
    return czi.written(blocks, [("Thumbnail", "JPG", b"t" * (5 + s % 4))])


_CZI = "a as (select s_suppkey as s, unnest(range(0, 2 + s_suppkey % 2)) as i from supplier), b as (select *, unnest([0, 1]) as j from a), c as (select s, i, j, j * (2 + s % 2) + i as m from b)"


@query(
    f"""with {_CZI} select s || '.czi' as path, cast(m as int) as idx, 'Bgr24' as pixel_type, cast(s % 3 as bigint) as scene, cast(m as int) as m, cast(i * 18 - 5 as bigint) as x, cast(20 as bigint) as stored_w, cast(1 as bigint) as ratio, cast(720 as bigint) as length, cast(null as varchar) as error from c
union all select s_suppkey || '.czi', cast(2 * (2 + s_suppkey % 2) as int), 'Bgr24', null, null, -5, 20, 2, 720, null from supplier"""
)
def czi_subblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return czi.subblocks(made(spark, sf_dir, "czi", czi_file)).select("path", "idx", "pixel_type", "scene", "m", "x", "stored_w", "ratio", "length", "error")


@query("select s_suppkey || '.czi' as path, 'Thumbnail' as name, 'JPG' as kind, cast(5 + s_suppkey % 4 as bigint) as length, repeat('t', cast(5 + s_suppkey % 4 as int)) as text from supplier")
def czi_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(spark, sf_dir, "czi", czi_file)
    return reading.fetch(czi.attachments(files), files).select("path", "name", "kind", "length", F.col("payload").cast("string").alias("text"))


@query(
    f"""with {_CZI}, t as (select s_suppkey as s, unnest([0, 1, 2]) as col, p.row from supplier, (select unnest([0, 1]) as row) p), p as (select s, col, row, unnest(range(0, 256)) as k from t),
x as (select s, col, row, k, col * 16 + k % 16 as px, row * 16 + k // 16 as py from p), v as (select x.s, x.col, x.row, x.k, max(c.m) as m from x join c on c.s = x.s and x.px >= c.i * 18 and x.px < c.i * 18 + 20 and x.py >= c.j * 10 and x.py < c.j * 10 + 12 group by all)
select s || '.czi' as path, cast(col as bigint) as col, cast("row" as bigint) as "row", cast(sum((k % 89 + 1) * ((s * 3 + m * 40 + 2) % 256 * 3 + (s * 3 + m * 40 + 1) % 256 * 5 + (s * 3 + m * 40) % 256 * 7)) as bigint) as checksum from v group by all"""
)
def czi_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 16 drawn from subblocks that overlap, later ones over earlier ones."""
    files = made(spark, sf_dir, "czi", czi_file)
    asked = files.select("path").withColumn("t", F.explode(F.expr("flatten(transform(array(0L, 1L, 2L), c -> transform(array(0L, 1L), r -> struct(c as col, r as row))))"))).select("path", "t.*").withColumns({"ratio": F.lit(1).cast("long"), "slot": F.concat("path", F.lit("/"), "col", F.lit("/"), "row")})
    out = czi.read_tiles(asked, czi.subblocks(files), 16, files).filter("data is not null")

    @F.pandas_udf("long")
    def checksum(values: pd.Series) -> pd.Series:
        return pd.Series([int(((i := np.arange(len(v))) // 3 % 89 + 1) @ (np.frombuffer(v, np.uint8) * np.array([3, 5, 7])[i % 3])) for v in values])

    return out.select("path", "col", "row", checksum("data").alias("checksum"))


def zvi_stream(s: int) -> bytes:
    text = f" tag {s} \0".encode("utf-16-le")
    values = [(515, struct.pack("<Hi", 3, 100 + s)), (516, struct.pack("<Hi", 22, s)), (769, struct.pack("<Hd", 5, s + 0.25)), (1047, struct.pack("<Hi", 3, 1)), (2, struct.pack("<HI", 8, len(text)) + text), (3, struct.pack("<Hh", 11, s % 2)), (4, struct.pack("<HH", 66, 2) + b"ab"), (5, struct.pack("<H", 1))]
    body = b"".join(v + struct.pack("<Hi", 3, t) + struct.pack("<Hi", 3, 0) for t, v in values)
    return struct.pack("<HIHi", 3, 1, 3, len(values)) + body[: len(body) - (20 if s % 5 == 0 else 0)]


@query("select s_suppkey as k, cast(case when s_suppkey % 5 = 0 then 5 else 7 end as int) as n, (100 + s_suppkey)::varchar as width, (s_suppkey + 0.25::double)::varchar as stage, 'tag ' || s_suppkey as text, case when s_suppkey % 2 = 1 then 'true' else 'false' end as flag from supplier")
def zvi_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth stream is cut off after its sixth value."""
    rows = made(spark, sf_dir, "zvi", zvi_stream).withColumn("t", zvi.tags(F.col("content")))
    tag = lambda n: F.element_at("t", F.lit(n))
    return rows.select(F.split("path", r"\.")[0].cast("long").alias("k"), F.size("t").alias("n"), tag(515).alias("width"), tag(769).alias("stage"), tag(2).alias("text"), tag(3).alias("flag"))
