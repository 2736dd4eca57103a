"""Queries over vendors' metadata, DICOM rules, the tile model and routing, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import dicom, model, routing, vendor_meta
from lamella.plans.fixtures import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _part(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as k", *columns)


def _columns(*names: str) -> dict:
    return {n: F.col(n) for n in names}


# A collection of four images: a macro by type (every 3rd slide) or by its view, and scenes with p_size % 3 + 1 levels and p_size % 2 + 1 channels.
_XML = """concat('<scn><collection sizeX="', 1000 + p_size, '" sizeY="', 2000 + p_size, '">',
 '<image name="macro"><pixels><dimension ifd="0" sizeX="100" sizeY="200" r="0"/></pixels><view ', if(p_partkey % 3 = 0, concat('type="Macro" sizeX="7" sizeY="8" offsetX="5"'), concat('sizeX="', 1000 + p_size, '" sizeY="', 2000 + p_size, '" offsetX="0" offsetY="0"')), '/></image>',
 '<image name="s"><pixels>', array_join(flatten(transform(sequence(0, p_size % 3), r -> transform(sequence(0, p_size % 2), c -> concat('<dimension ifd="', 1 + r * 2 + c, '" sizeX="', 4096 div (cast(pow(4, r) as int)), '" sizeY="', 2048 div (cast(pow(4, r) as int)), '" r="', r, '" c="', c, '"/>')))), ''),
 '<dimension sizeX="9" sizeY="9"/><dimension ifd="9" sizeX="0" sizeY="9"/></pixels><view sizeX="300" sizeY="400" offsetX="', p_size, '" offsetY="3"/><scanSettings><illuminationSettings><illuminationSource>', if(p_partkey % 2 = 0, 'brightfield', 'fluorescence'), '</illuminationSource></illuminationSettings>',
 if(p_partkey % 5 = 0, '<channelSettings><channel index="0" name="DAPI"/><channel index="7" name="no"/></channelSettings>', ''), '</scanSettings></image>',
 '<image name="no view"><pixels><dimension ifd="5" sizeX="1" sizeY="1"/></pixels></image><image name="no pixels"><view sizeX="1" sizeY="1"/></image></collection></scn>')"""


@query(
    """with s as (select p_partkey as k, 1 + p_size % 2 as n_c, p_partkey % 5 = 0 as named, p_partkey % 2 = 0 as bright, p_size from part)
select k, cast(0 as int) as place, true as is_macro, cast(1 as int) as n_dims, cast(1 as int) as n_z, cast(1 as int) as n_c, 'macro' as channels from s
union all select k, 1, false, cast((p_size % 3 + 1) * n_c as int), 1, cast(n_c as int),
  case when n_c = 1 and not named and bright then '' when n_c = 1 and not named then 's' when n_c = 1 then 'DAPI' else (case when named then 'DAPI' else 'Channel 0' end) || ',Channel 1' end from s"""
)
def collection_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vendor_meta.collection_images(_part(spark, sf_dir, f"{_XML} as xml"), "k", "xml")
    return rows.select("k", "place", "is_macro", F.size("dimensions").alias("n_dims"), "n_z", "n_c", F.array_join("channels", ",").alias("channels"))


@query(
    """select p_partkey as k, cast(0 as int) as scene, cast(r as int) as level, cast(c as int) as c, cast(1 + r * 2 + c as int) as ifd, cast(4096 // cast(pow(4, r) as int) as bigint) as width, cast(pow(4, r) as double) as downsample
from (select *, unnest(range(0, p_size % 3 + 1)) as r from part), (select unnest([0, 1]) as c) where c <= p_size % 2"""
)
def collection_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = vendor_meta.collection_images(_part(spark, sf_dir, f"{_XML} as xml"), "k", "xml")
    return vendor_meta.collection_levels(images, "k").select("k", "scene", "level", "c", "ifd", "width", "downsample")


@query(
    """select p_partkey as k, round(case p_partkey % 4 when 0 then p_size / 1000.0::double when 1 then 0.5 / p_size else 0.25 end * 1000, 9) as x, round(case p_partkey % 4 when 0 then 0.002::double when 1 then 0.5 / p_size else 0.25 end * 1000, 9) as y from part where p_partkey % 4 < 3"""
)
def spacing_mpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spacings in quotes, one alone, none (the base's), and none at all."""
    raw = "case p_partkey % 4 when 0 then concat('\"0.002\", ''', p_size / 1000D, '''') when 1 then concat(' x -1 ', 0.5D / p_size) when 2 then 'none' end as raw"
    rows = _part(spark, sf_dir, raw, "if(p_partkey % 4 = 2, 0.25D, null) as base")
    return rows.withColumn("m", vendor_meta.mpp_pair(F.col("raw"), F.col("base"))).filter("m is not null").select("k", F.round("m.x", 9).alias("x"), F.round("m.y", 9).alias("y"))


@query("select p_partkey as k, 3 as n, cast(p_size as varchar) as mag, 'b' || p_partkey % 7 as last from part")
def description_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat(' Objective Magnification = ', p_size, ';OverlapsXY=1 2; =x;empty=;noequals;Background = a ;Background=b', p_partkey % 7) as text"
    rows = _part(spark, sf_dir, text).withColumn("m", vendor_meta.key_values(F.col("text")))
    return rows.select("k", F.size("m").alias("n"), F.element_at("m", "Objective Magnification").alias("mag"), F.element_at("m", "Background").alias("last"))


_GRID = "g as (select s_suppkey as area, cast(c as bigint) as col, cast(r as bigint) as row, c * 100 - (c * s_suppkey) % 7 as x, r * 80 + (r * s_suppkey) % 5 - (case when s_suppkey % 4 = 0 and r = 2 then 90 else 0 end) as y from supplier, (select unnest(range(0, 4)) as c), (select unnest(range(0, 3)) as r) where (s_suppkey + c * 3 + r * 5) % 11 > 0)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as area", "explode(sequence(0L, 3L)) as col").selectExpr("area", "col", "explode(sequence(0L, 2L)) as row")
    return rows.filter("(area + col * 3 + row * 5) % 11 > 0").selectExpr("area", "col", "row", "col * 100 - (col * area) % 7 as x", "row * 80 + (row * area) % 5 - if(area % 4 = 0 and row = 2, 90, 0) as y")


@query(
    f"""with {_GRID}, n as (select g.*, e.x - g.x as ex, g.x - w.x as wx, s.y - g.y as sy, g.y - u.y as ny from g left join g e on e.area = g.area and e.row = g.row and e.col = g.col + 1 left join g w on w.area = g.area and w.row = g.row and w.col = g.col - 1
 left join g s on s.area = g.area and s.col = g.col and s.row = g.row + 1 left join g u on u.area = g.area and u.col = g.col and u.row = g.row - 1)
select area, col, "row", cast(greatest(1, round(case when col < 3 and ex > 0.5 then ex when col = 3 or col < 3 then case when 390 - x > 0.5 then 390 - x when wx > 0.5 then wx else 100 end end)) as bigint) as width,
 cast(greatest(1, round(case when "row" < 2 and sy > 0.5 then sy else case when 235 - y > 0.5 then 235 - y when ny > 0.5 then ny else 80 end end)) as bigint) as height from n"""
)
def exact_tile_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {"num_cols": 4, "num_rows": 3, "area_w": 390, "area_h": 235, "tile_w": 100, "tile_h": 80}
    return vendor_meta.exact_tile_extents(_grid(spark, sf_dir).withColumns({k: F.lit(v) for k, v in extra.items()}), ["area"]).select("area", "col", "row", "width", "height")


@query(
    """with a as (select s_nationkey as k, s_suppkey % 50 * 10 as x, s_suppkey % 30 * 7 as y, s_suppkey % 4 as nx, s_suppkey % 3 as ny from supplier),
r as (select k, min(x) as x0, min(y) as y0, max(case when nx > 0 and ny > 0 then x + (nx - 1) * 90.5::double + 100 end) as x1, max(case when nx > 0 and ny > 0 then y + (ny - 1) * 70.25::double + 80 end) as y1 from a group by k)
select k, cast(ceil(x1 - x0) as bigint) as width, cast(ceil(y1 - y0) as bigint) as height from r where x1 is not null"""
)
def stitched_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_nationkey as k", "s_suppkey % 50 * 10 as x", "s_suppkey % 30 * 7 as y", "s_suppkey % 4 as tiles_across", "s_suppkey % 3 as tiles_down", "90.5D as advance_x", "70.25D as advance_y", "100 as tile_w", "80 as tile_h")
    return vendor_meta.stitched_dimensions(rows, "k").filter("width is not null")


@query(
    f"""with {_GRID}, t as (select area, "row" * 4 + col as id, x, y, 100 as w, 80 as h from g), p as (select a.area, a.id as a, b.id as b, least(a.x + 100, b.x + 100) - greatest(a.x, b.x) as sx, least(a.y + 80, b.y + 80) - greatest(a.y, b.y) as sy from t a join t b on a.area = b.area and a.id < b.id)
select area, a, b, cast(sx * sy as bigint) as overlap from p where sx > 0 and sy > 0"""
)
def overlapping_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _grid(spark, sf_dir).selectExpr("area", "row * 4 + col as id", "x", "y", "100 as w", "80 as h")
    found = vendor_meta.overlapping_tiles(tiles.withColumnRenamed("area", "slide"), "slide", 128)
    return found.select(F.col("slide").alias("area"), "a", "b", F.col("area").alias("overlap"))


@query(
    """with r as (select p_partkey as k, 10 + p_size as w, 8 + p_size % 9 as h, case when p_partkey % 7 = 0 then 5 end as compression, case when p_partkey % 11 = 0 then 6 else 2 end as photometric, p_partkey % 3 as p, p_partkey % 13 > 0 as whole, p_partkey % 17 > 0 as eight from part)
select k, compression is null and photometric = 2 and whole and eight as readable from r"""
)
def readable_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "cast(10 + p_size as bigint) as width", "cast(8 + p_size % 9 as bigint) as height", "if(p_partkey % 7 = 0, 5, null) as compression", "if(p_partkey % 11 = 0, 6, 2) as photometric", "3 as samples", "cast(null as int) as orientation", "if(p_partkey % 2 = 0, 1, null) as predictor", "array(null, 1, 2)[p_partkey % 3] as planar", "4L as rows_per_strip", "array(8L, 8L, if(p_partkey % 17 = 0, 16L, 8L)) as bits", "if(p_partkey % 5 = 0, array(1L, 1L, 1L), null) as formats")
    rows = rows.selectExpr("*", "cast(ceil(height / 4D) as int) as per_plane").selectExpr("*", "if(planar = 2, 3, 1) as planes").selectExpr("*", "flatten(array_repeat(transform(sequence(0, per_plane - 1), i -> least(4L, height - i * 4) * width * if(planes = 3, 1, 3)), planes)) as full")
    rows = rows.selectExpr("*", "transform(full, (n, i) -> n + if(k % 13 = 0 and i = 0, 1, 0)) as counts", "transform(full, (n, i) -> 100L + i) as offsets")
    names = ["width", "height", "compression", "photometric", "samples", "orientation", "predictor", "planar", "rows_per_strip", "bits", "formats", "offsets", "counts"]
    return rows.select("k", vendor_meta.readable_strips(_columns(*names)).alias("readable"))


_FILES = "f as (select 'd' || p_partkey % 40 as folder, 'd' || p_partkey % 40 || '/f' || p_partkey as path, case when p_partkey % 6 = 0 then null else 'u' || p_partkey % 40 // 10 || case when p_partkey % 40 > 30 then p_partkey % 2 else 0 end end as uid from part)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = "if(p_partkey % 6 = 0, null, concat('u', p_partkey % 40 div 10, if(p_partkey % 40 > 30, p_partkey % 2, 0))) as series_uid"
    return table(spark, sf_dir, "part").selectExpr("concat('d', p_partkey % 40) as folder", "concat('d', p_partkey % 40, '/f', p_partkey) as path", uid)


@query(f"with {_FILES} select s.path as selected, f.path, f.uid as series_uid from f s join f on f.folder = s.folder and f.uid = s.uid where s.path like '%7'")
def dicom_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return dicom.siblings(files, files.filter("path like '%7'").select("path"))


@query(f"with {_FILES}, n as (select folder, count(distinct uid) as n, max(uid) as uid from f group by folder) select folder, case when n = 1 then uid end as series_uid, case n when 0 then 'NoDicom' when 1 then null else 'SeveralSeries' end as error from n")
def dicom_folder_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dicom.folder_series(_files(spark, sf_dir))


@query(f"with {_FILES} select folder, count(*) as n, case when count(*) <= 50 then string_agg(path, ',' order by path) end as paths, case when count(*) > 50 then 'TooManyFiles' end as error from f group by folder")
def child_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dicom.child_files(_files(spark, sf_dir), 50).withColumn("paths", F.array_join("paths", ","))


_UID = "case l_partkey % 5 when 0 then '1.2.840.10008.1.2.1' when 1 then '1.2.840.10008.1.2.4.50' when 2 then '1.2.840.10008.1.2.4.90' when 3 then '1.2.840.10008.1.2.5' else '9.9' end"
_COLOUR = "case l_suppkey % 5 when 0 then 'RGB' when 1 then 'YBR_FULL_422' when 2 then 'YBR_ICT' when 3 then 'MONOCHROME2' else 'PALETTE' end"


@query(
    f"""with i as (select distinct l_orderkey as k, l_linenumber as n, {_UID} as uid, {_COLOUR} as colour, case when l_quantity > 45 then 16 else 8 end as bits, 1 + l_suppkey % 3 as samples, l_partkey % 4 as planar, case when l_orderkey % 9 = 0 then 2 when l_orderkey % 2 = 0 then 1 end as focal from lineitem)
select k, n, samples, case when uid = '9.9' then 'TransferSyntax' when bits <> 8 then 'BitsAllocated' when samples = 2 then 'SamplesPerPixel' when samples = 3 and planar > 1 then 'PlanarConfiguration' when focal <> 1 then 'FocalPlanes'
 when samples = 1 and colour <> 'MONOCHROME2' then 'Photometric' when samples = 3 and (case when uid like '%4.50' then colour not in ('RGB', 'YBR_FULL_422') when uid like '%4.90' then colour not in ('RGB', 'YBR_FULL_422', 'YBR_ICT') else colour <> 'RGB' end) then 'Photometric' end as error, count(*) as times
from i group by all"""
)
def pixel_format_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as k", "l_linenumber as n", f"{_UID} as transfer_syntax", f"{_COLOUR} as photometric", "if(l_quantity > 45, 16, 8) as bits_allocated", "8 as bits_stored", "7 as high_bit", "1 + l_suppkey % 3 as samples",
        "0 as representation", "l_partkey % 4 as planar", "case when l_orderkey % 9 = 0 then 2 when l_orderkey % 2 = 0 then 1 end as focal_planes",
    ).distinct()
    names = ["transfer_syntax", "bits_allocated", "bits_stored", "high_bit", "samples", "representation", "planar", "focal_planes", "photometric"]
    return rows.select("k", "n", "samples", dicom.pixel_format_error(_columns(*names)).alias("error")).groupBy("k", "n", "samples", "error").agg(F.count("*").alias("times"))


@query("select p_partkey as k, case when p_partkey % 3 = 0 then p_size / 1000.0::double when p_partkey % 3 = 1 then 0.5::double end as mpp from part")
def dicom_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "if(p_partkey % 3 = 0, p_size / 1000D, null) as shared", "if(p_partkey % 3 < 2, 0.5D, null) as root")
    return rows.select("k", dicom.spacing_mpp(F.col("shared"), F.col("root")).alias("mpp"))


@query(
    """with i as (select l_orderkey as slide, case l_linenumber % 2 when 0 then 'label' else 'macro' end as name, case when l_orderkey % 4 = 0 then 's' || l_linenumber else 's' || l_linenumber % 2 end as sop, min(l_linenumber) as place from lineitem group by all)
select slide, name, min_by(sop, place) as sop, case when count(distinct sop) > 1 then 'UnexpectedImage' end as error from i group by slide, name"""
)
def dicom_associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as slide", "if(l_linenumber % 2 = 0, 'label', 'macro') as name", "if(l_orderkey % 4 = 0, concat('s', l_linenumber), concat('s', l_linenumber % 2)) as sop", "l_linenumber as place")
    return dicom.associated(rows.groupBy("slide", "name", "sop").agg(F.min("place").alias("place")), "slide").select("slide", "name", "sop", "error")


@query(
    """with t as (select p_partkey as k, p_partkey % 13 - 2 as c, p_size % 7 - 1 as r, p_partkey % 3 * 128 as tile, case when p_partkey % 2 = 0 then 3 else 1 end as s, case p_size % 4 when 0 then 'RGB' when 1 then 'YBR_RCT' when 2 then 'MONOCHROME1' else 'PALETTE' end as colour from part)
select k, case when c < 0 or r < 0 or c >= 8 or r >= 4 then 'TileOutOfRange' end as error, case when s = 1 and colour = 'MONOCHROME1' then 'Monochrome2' when s = 3 and colour = 'RGB' then 'Rgb' when s = 3 and colour = 'YBR_RCT' then 'YbrFull422' end as photometric,
 case when tile > 0 then cast((2048 + tile - 1) // tile * tile * ((2048 + 239) // 240 * 240) * s as bigint) end as hint from t"""
)
def dicom_tile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "p_partkey % 13 - 2 as c", "p_size % 7 - 1 as r", "cast(p_partkey % 3 * 128 as bigint) as tile", "if(p_partkey % 2 = 0, 3, 1) as s", "case p_size % 4 when 0 then 'RGB' when 1 then 'YBR_RCT' when 2 then 'MONOCHROME1' else 'PALETTE' end as colour")
    return rows.select("k", dicom.tile_error(F.col("c"), F.col("r"), F.lit(8), F.lit(4)).alias("error"), dicom.raw_photometric(F.col("s"), F.col("colour")).alias("photometric"), dicom.cache_hint(F.col("tile"), F.lit(240).cast("long"), F.col("s")).alias("hint"))


@query("select * from (values ('Rgb8', 'Rgb', 3, 'Uint8', 3), ('Rgba8', 'Rgba', 4, 'Uint8', 4), ('Gray8', 'Grayscale', 1, 'Uint8', 1), ('Rgb16', 'Rgb', 3, 'Uint16', 6), ('Rgba16', 'Rgba', 4, 'Uint16', 8), ('Gray16', 'Grayscale', 1, 'Uint16', 2)) t(name, color_space, channels, sample_type, bytes_per_pixel)")
def pixel_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.pixel_formats(spark)


@query("select p_partkey as k, case p_partkey % 4 when 0 then 1 when 1 then 2 when 2 then 4 end as bytes, case when p_partkey % 5 = 0 then 'SampleCount' when p_partkey % 97 = 1 then 'DimensionsOverflow' end as error from part")
def buffer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "array('Uint8', 'Uint16', 'Float32', 'Other')[p_partkey % 4] as kind", "if(p_partkey % 97 = 1 and p_partkey % 5 > 0, 5000000000, 10 + p_size) as w", "if(p_partkey % 97 = 1 and p_partkey % 5 > 0, 5000000000, 7) as h", "(10 + p_size) * 21L + if(p_partkey % 5 = 0, 1, 0) as n")
    return rows.select("k", model.sample_bytes(F.col("kind")).alias("bytes"), model.buffer_error(F.col("w"), F.col("h"), F.lit(3), F.col("n")).alias("error"))


@query(
    """select p_partkey as k, case p_partkey % 10 when 0 then 'MissingDimensions' when 1 then 'MissingBitsAllocated' when 2 then 'MissingSamplesPerPixel' when 3 then 'MissingPhotometricInterpretation' when 4 then 'MissingData'
 when 5 then 'InvalidDimensions' when 6 then 'InvalidBitsAllocated' when 7 then 'InvalidSamplesPerPixel' when 8 then 'EmptyData' end as error from part"""
)
def raw_tile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key breaks one rule, and those after a missing one too."""
    m = "p_partkey % 10"
    rows = _part(spark, sf_dir, f"case {m} when 0 then null when 5 then 0 else 64 end as width", "64 as height", f"case {m} when 1 then null when 0 then null when 6 then 0 else 8 end as bits", f"case {m} when 2 then null when 7 then 0 else 3 end as samples", f"if({m} = 3, null, 'Rgb') as photometric", f"case {m} when 4 then null when 8 then 0 when 5 then 0 else 99 end as bytes")
    return rows.select("k", model.raw_tile_error(_columns("width", "height", "bits", "samples", "photometric", "bytes")).alias("error"))


@query("select doc_id as k, case when octet_length(encode(text)) <= 2000 then text end as text from documents")
def bounded_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), model.bounded(F.col("text").cast("binary"), 2000).cast("string").alias("text"))


@query(
    """select p_partkey as k, cast(case when p_partkey % 3 = 0 then p_size when p_partkey % 3 = 1 then p_size * 1000 else 67108864 end as bigint) as budget, p_partkey % 4 > 2 or p_partkey % 4 = 0 as kept,
 case when p_partkey % 3 = 2 and p_size % 2 = 0 then 'DeviceUnavailable' end as error from part"""
)
def cache_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "cast(if(p_partkey % 3 = 0, p_size, null) as bigint) as set", "cast(if(p_partkey % 3 = 1, p_size * 1000, null) as bigint) as hint", "array('TiledIfd', 'NdpiJpeg', 'SyntheticDownsample', null)[p_partkey % 4] as source", "array('Cpu', 'PreferDevice', 'RequireDevice')[p_partkey % 3] as pref", "p_size % 2 = 1 as device")
    return rows.select("k", model.tile_budget(F.col("set"), F.col("hint")).alias("budget"), model.uses_display_cache(F.col("source")).alias("kept"), model.output_error(F.col("pref"), F.col("device")).alias("error"))


@query(
    f"""with {_GRID}, l as (select s_suppkey as area, case s_suppkey % 3 when 0 then 'Regular' when 1 then 'Irregular' else 'WholeLevel' end as layout, s_suppkey % 5 as across from supplier),
m as (select area, min_by(col, "row" * 100 + col) as col, min("row") as row from g group by area)
select l.area, cast(case when layout = 'Irregular' then m.col when across > 0 then 0 end as bigint) as col, cast(case when layout = 'Irregular' then m.row when across > 0 then 0 end as bigint) as "row" from l left join m on m.area = l.area"""
)
def probe_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as area", "array('Regular', 'Irregular', 'WholeLevel')[s_suppkey % 3] as layout", "s_suppkey % 5 as tiles_across", "1 as tiles_down")
    return model.first_tile(layouts, _grid(spark, sf_dir), "area")


@query(
    """with a as (select p_partkey as k, cast(unnest([-1, 0, 3, 4]) as int) as level, p_size from part)
select k, level, cast(case when level between 0 and 3 then (1024 + 64 * p_size) >> level else -1 end as bigint) as width, cast(case when level between 0 and 3 then (768 + 48 * p_size) >> level else -1 end as bigint) as height, cast(case when level between 0 and 3 then 1 << level else -1 end as double) as downsample from a"""
)
def level_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.plans.fixtures import levels

    asked = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "explode(array(-1, 0, 3, 4)) as level")
    return model.or_minus_one(asked, levels(spark, sf_dir).withColumnRenamed("dataset_id", "k"), ["k", "level"], ["width", "height", "downsample"])


@query("select s_suppkey as k, n as name, cast(case when n = 'label' or s_suppkey % 2 = 0 then 100 + s_suppkey else -1 end as bigint) as width, cast(case when n = 'label' or s_suppkey % 2 = 0 then length(s_name) else -1 end as bigint) as icc from supplier, (select unnest(['label', 'macro']) as n)")
def associated_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    asked = rows.selectExpr("s_suppkey as k", "explode(array('label', 'macro')) as name")
    known = rows.selectExpr("s_suppkey as k", "explode(if(s_suppkey % 2 = 0, array('label', 'macro'), array('label'))) as name", "100 + s_suppkey as width", "cast(octet_length(cast(s_name as binary)) as bigint) as icc")
    return model.or_minus_one(asked, known, ["k", "name"], ["width", "icc"])


@query(
    """with r as (select p_partkey as k, p_partkey % 2 = 0 as pyramid, p_size % 4 as extra, p_size as x, p_partkey % 60 - 1 as y from part)
select k, case when y >= 0 then cast(case when pyramid then 2 else 0 end as int) end as level, case when y >= 0 then cast(case when extra > 0 then 11 else 0 end as int) end as z, case when y >= 0 then cast(case when extra > 1 then 12 else 0 end as int) end as c, case when y >= 0 then cast(case when extra > 2 then 13 else 0 end as int) end as t,
 case when y >= 0 then cast(x as int) end as col, case when y >= 0 then cast(y as int) end as "row" from r"""
)
def ets_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = "concat(array(p_size, cast(p_partkey % 60 - 1 as int)), slice(array(11, 12, 13), 1, p_size % 4), if(p_partkey % 2 = 0, array(2), cast(array() as array<int>))) as coords"
    rows = _part(spark, sf_dir, coords, "p_partkey % 2 = 0 as pyramid")
    return rows.select("k", model.ets_key(F.col("coords"), F.col("pyramid")).alias("x")).select("k", "x.*")


@query(
    """select s_suppkey as k, case s_suppkey % 11 when 1 then 'Uint8' when 2 then 'Uint8' when 3 then 'Uint16' when 4 then 'Uint16' when 9 then 'Float32' end as kind,
 case when s_suppkey % 4 = 3 and s_suppkey % 5 >= 3 then '10,20,30' when s_suppkey % 5 = 0 then '0,0,0' else '10,10,10' end as colour from supplier"""
)
def ets_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "cast(s_suppkey % 11 as int) as code", "s_suppkey % 4 as samples", "slice(array(10, 20, 30, 40), 1, cast(s_suppkey % 5 as int)) as colour")
    kind = model.lookup(F.col("code"), model.ETS_SAMPLES, F.lit(None).cast("string"))
    return rows.select("k", kind.alias("kind"), F.array_join(model.background(F.col("samples"), F.col("colour")).cast("array<string>"), ",").alias("colour"))


@query("with f as (select 's' || s_nationkey as folder, 's' || s_nationkey || '/stack' || s_suppkey || case when s_suppkey % 3 = 0 then '/other.ets' when s_suppkey % 3 = 1 then '/frame_t.ets' else '/a/frame_t.ets' end as path, s_suppkey from supplier) select case when s_suppkey % 3 = 1 then folder else folder || '/stack' || s_suppkey end as folder, string_agg(path, ',' order by path) as paths from f where s_suppkey % 3 > 0 group by all")
def ets_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_nationkey, '/stack', s_suppkey, array('/other.ets', '/frame_t.ets', '/a/frame_t.ets')[s_suppkey % 3]) as path")
    return model.frame_files(files).withColumn("paths", F.array_join("paths", ","))


_BLOCKS = "b as (select l_orderkey as k, l_linenumber as id, max(case when l_orderkey % 5 = 0 then null else cast(l_linenumber % 3 as bigint) - 1 end) as scene from lineitem group by all), h as (select distinct k, scene from b where scene >= 0 and k % 2 = 0), n as (select distinct k, case when k % 3 > 0 then cast(1 + k % 2 as int) end as n from b)"


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id")).agg(F.max(F.expr("if(l_orderkey % 5 = 0, null, cast(l_linenumber % 3 as bigint) - 1)")).alias("scene"))
    return b, b.filter("k % 2 = 0").select("k", "scene"), b.selectExpr("k", "if(k % 3 > 0, cast(1 + k % 2 as int), null) as n_scenes").distinct()


_SLOTS = f"{_BLOCKS}, have as (select distinct k from h), s as (select k, scene, row_number() over (partition by k order by scene) - 1 as slot from h union all select k, i, i from (select n.k, unnest(range(0, coalesce(n, 1))) as i from n where k not in (select k from have)))"


@query(f"with {_SLOTS} select k, cast(slot as int) as slot, scene from s")
def scene_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, boxes, sizes = _blocks(spark, sf_dir)
    return model.scene_indices(boxes, sizes, "k")


@query(f"with {_SLOTS}, c as (select k, count(*) as c from s group by k) select b.k, b.id, cast(case when b.scene is null then case when c.c = 1 then 0 end else s.slot end as int) as slot from b left join s on s.k = b.k and s.scene = b.scene left join c on c.k = b.k")
def subblock_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, boxes, sizes = _blocks(spark, sf_dir)
    return model.subblock_slots(blocks, model.scene_indices(boxes, sizes, "k"), "k")


@query("with p as (select l_orderkey as k, l_linenumber as place, cast(l_linenumber % 4 as int) as c, 'n' || min(l_partkey) as name from lineitem group by all), s as (select distinct k from p), e as (select k, cast(unnest([0, 1, 2]) as int) as c from s) select e.k, e.c, min_by(name, place) as name, min_by(cast(place * 7 as int), place) as color from e left join p on p.k = e.k and p.c = e.c group by all")
def plane_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("place")).agg(F.min("l_partkey").alias("p"))
    planes = rows.selectExpr("k", "place", "cast(place % 4 as int) as c", "concat('n', p) as name", "cast(place * 7 as int) as color")
    return model.channels(planes, planes.selectExpr("k", "3 as n_c").distinct(), "k")


@query(
    """with t as (select p_partkey as k, p_partkey % 20 as col, p_size % 12 as row from part), s as (select *, row // 4 * 3 + col // 8 as shard, col % 8 as lc, row % 4 as lr from t)
select k, cast(shard as bigint) as shard, cast(lr * 7 + lc as bigint) as tile_index, case when shard >= 8 then 'MissingShard' when lc >= 7 or lr >= 4 then 'OutsideShard' end as error from s"""
)
def shard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "p_partkey % 20 as col", "p_size % 12 as row", "8 as base_across", "4 as base_down", "3 as shards_across", "8 as n_shards", "7 as across", "4 as down")
    return model.shard_of(rows).select("k", F.col("shard").cast("long").alias("shard"), F.col("tile_index").cast("long").alias("tile_index"), "error")


@query("select p_partkey as k, case when p_partkey % 6 = 0 then null else coalesce((p_partkey * 300)::varchar, '') || ',-,' || p_size end as starts from part")
def row_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blocks of 40 bytes, the second one unknown; every sixth file is cut off."""
    number = lambda e: f"unhex(concat_ws('', transform(sequence(0, 7), i -> lpad(hex(shiftright({e}, 8 * i) & 255), 2, '0'))))"
    pad = "unhex(repeat('00', 32))"
    rows = _part(spark, sf_dir, f"concat({number('p_partkey * 300')}, {pad}, {number('0L')}, {pad}, {number('cast(p_size as bigint)')}, if(p_partkey % 6 = 0, unhex(''), {pad})) as content")
    starts = model.row_starts(F.col("content"), F.lit(3))
    return rows.select("k", F.array_join(F.transform(starts, lambda s: F.coalesce(s.cast("string"), F.lit("-"))), ",").alias("starts"))


@query(
    """select p_partkey as k, case when p_partkey % 2 = 0 and (p_size % 4 = 0 or (p_size % 4 = 1 and p_partkey % 3 * 4 <> 4 and [2, 6, 1][p_partkey % 3 + 1] <> 6)) then 'ForceRgb' when p_partkey % 2 = 0 and p_size % 4 = 2 then 'ForceYCbCr'
 when p_partkey % 2 = 0 and p_partkey % 3 = 0 then 'ForceRgb' when p_partkey % 2 = 0 and p_partkey % 3 = 1 then 'ForceYCbCr' else 'Auto' end as transform from part"""
)
def colour_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, "array(2, 6, 1)[p_partkey % 3] as photometric", "if(p_partkey % 2 = 0, 3, 1) as samples", "array('Rgb', 'Rgb012', 'YCbCr', 'Unknown')[p_size % 4] as hint")
    return rows.select("k", model.colour_transform(F.col("photometric"), F.col("samples"), F.col("hint")).alias("transform"))


@query(
    """with b as (select l_orderkey as k, count(*) as n, count(distinct l_suppkey % 2) as kinds, min(l_suppkey % 2) as codec, min(l_partkey) as p from lineitem group by all)
select k, n, kinds = 1 and codec = 1 as keyed, case when p % 3 = 0 or not (kinds = 1 and codec = 1) or n >= 4 then 'asked' when p % 5 = 0 then 'device' when p % 7 > 0 and 10 * (p % 40) <= 200 * 0.85::double then 'device' else 'cpu' end as route,
 not (p % 3 = 0 or not (kinds = 1 and codec = 1) or n >= 4) and p % 5 > 0 as measures from b"""
)
def batch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as batch", "1 as dataset_id", "0 as scene", "0 as series", "0 as level", "if(l_suppkey % 2 = 1, 'Jp2k', 'Jpeg') as codec", "256 as tile_w", "256 as tile_h", "l_partkey")
    p = rows.groupBy("batch").agg(F.min("l_partkey").alias("p"))
    facts = routing.batch_keys(rows, "batch").join(p, "batch").selectExpr("batch", "n", "key", "p % 3 > 0 as adaptive", "if(p % 5 = 0, 'device', null) as remembered", "200 as cpu_us", "10 * (p % 40) as device_us", "p % 7 as device_tiles")
    return routing.routes(routing.measured(facts), 4).select(F.col("batch").alias("k"), "n", F.col("key").isNotNull().alias("keyed"), "route", "measures")


@query(
    """with recursive e as (select user_id % 8 as runtime, event_id as seq, 'k' || cast(floor(value) as bigint) % 40 as key, row_number() over (partition by user_id % 8 order by event_id) as i from events),
f as (select runtime, i, seq, key, false as known, [key] as held from e where i = 1
 union all select e.runtime, e.i, e.seq, e.key, list_contains(f.held, e.key), case when list_contains(f.held, e.key) then f.held when len(f.held) >= 10 then f.held[2:] || [e.key] else f.held || [e.key] end from f join e on e.runtime = f.runtime and e.i = f.i + 1)
select runtime, seq, key, known, cast(len(held) as bigint) as held from f"""
)
def remembered_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id % 8 as runtime", "event_id as seq", "concat('k', cast(floor(value) as bigint) % 40) as key", "'cpu' as winner")
    return routing.remembered(rows, "runtime", 10)
