"""Queries over the rules of single formats, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import decode, formats, requests
from lamella.operators import tables
from lamella.plans.fixtures import LEVELS, levels, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


INST = "i as (select distinct l_orderkey as series, l_partkey as sop, 100 * (1 + l_partkey % 4) as width, 80 * (1 + l_partkey % 3) as height from lineitem)"


@query(
    f"""with {INST}, g as (select series, width, height, count(*) as parts from i group by all)
select series, width, height, parts, cast(row_number() over w - 1 as int) as level, round(first_value(width) over w / width, 9) as downsample from g window w as (partition by series order by width * height desc, width desc, height desc)"""
)
def dicom_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as series", "l_partkey as sop", "100 * (1 + l_partkey % 4) as width", "80 * (1 + l_partkey % 3) as height")
    return formats.dicom_levels(rows, "series").withColumn("downsample", F.round("downsample", 9))


@query("select p_partkey as dataset_id, cast((1024 + 64 * p_size) * 16 as bigint) as w, cast((768 + 48 * p_size) * 16 as bigint) as h from part where p_partkey % 3 > 0 and ((1024 + 64 * p_size) * 16 >= 32768 or ((1024 + 64 * p_size) * 16 + 255) // 256 * (((768 + 48 * p_size) * 16 + 255) // 256) >= 4096)")
def huge_base_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third slide has a second level, and so is shown."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as dataset_id", "(1024 + 64 * p_size) * 16 as width", "(768 + 48 * p_size) * 16 as height", "explode(sequence(0, if(p_partkey % 3 = 0, 1, 0))) as level")
    sized = rows.selectExpr("dataset_id", "cast(width as bigint) as width", "cast(height as bigint) as height", "ceil(width / 256) as tiles_across", "ceil(height / 256) as tiles_down")
    return formats.huge_base_only(sized, "dataset_id").select("dataset_id", "w", "h")


FRAMES = "f as (select l_orderkey as series, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate) as frame, 1 + (l_partkey * 37) % 1000 as x, 1 + (l_suppkey * 53) % 1000 as y from lineitem)"


@query(f'with {FRAMES} select series, cast((x - 1) // 256 as bigint) as col, cast((y - 1) // 240 as bigint) as "row", cast(max(frame) as bigint) as frame from f group by all')
def sparse_tile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("frame", F.row_number().over(w).cast("long"))
    return formats.sparse_tile_map(rows.selectExpr("l_orderkey as series", "frame", "1 + (l_partkey * 37) % 1000 as x", "1 + (l_suppkey * 53) % 1000 as y", "256 as tile_w", "240 as tile_h"), "series")


@query(
    """with fr as (select s_suppkey % 10 as file, s_suppkey as frame, s_suppkey * 100 as start from supplier), fg as (select event_id, event_id % 10 as file, (event_id * 37) % 12000 as o from events)
select fg.event_id % 10 as file, fg.o as "offset", fr.frame from fg asof left join fr on fr.file = fg.file and fr.start <= fg.o"""
)
def fragment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 10 as file", "s_suppkey as frame", "s_suppkey * 100 as start")
    fragments = table(spark, sf_dir, "events").selectExpr("event_id % 10 as file", "(event_id * 37) % 12000 as offset")
    return formats.frame_of_fragments(fragments, frames, "file").select("file", "offset", F.coalesce("frame", F.lit(-1)).alias("frame"))


SQL["fragment_frames"] = SQL["fragment_frames"].replace("fr.frame from", "coalesce(fr.frame, -1) as frame from")


@query(
    """with im as (select p_partkey as k, cast(unnest([0, 1]) as int) as place, unnest([cast(1024 + 64 * p_size as bigint), cast(256 + 16 * p_size as bigint)]) as w, unnest([cast(768 + 48 * p_size as bigint), cast(192 + 12 * p_size as bigint)]) as h from part),
g as (select k, place, cast(s as bigint) as scale, w // s as width, h // s as height from (select *, unnest([1, 2, 4, 8]) as s from im) where w % s = 0 and h % s = 0),
r as (select *, row_number() over (partition by k, width order by place desc, scale desc) as n from g)
select k, width, place, scale, height, cast(row_number() over (partition by k order by width desc) - 1 as int) as level from r where n = 1"""
)
def scaled_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "posexplode(array(named_struct('w', 1024 + 64 * p_size, 'h', 768 + 48 * p_size), named_struct('w', 256 + 16 * p_size, 'h', 192 + 12 * p_size))) as (place, d)")
    return formats.scaled_levels(rows.selectExpr("k", "place", "cast(d.w as bigint) as width", "cast(d.h as bigint) as height"), "k")


BLOCKS = "b as (select l_orderkey as k, l_linenumber as n, max(l_partkey * 17 % 5000) as x, max(l_suppkey * 31 % 4000) as y, max(256 * (1 + l_partkey % 4)) as w, max(256 * (1 + l_suppkey % 3)) as h, max(cast([1, 2, 4][1 + l_linenumber % 3] as bigint)) as ratio from lineitem group by all)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(
        F.max(F.expr("l_partkey * 17 % 5000")).alias("x"), F.max(F.expr("l_suppkey * 31 % 4000")).alias("y"), F.max(F.expr("256 * (1 + l_partkey % 4)")).alias("w"),
        F.max(F.expr("256 * (1 + l_suppkey % 3)")).alias("h"), F.max(F.expr("cast(array(1, 2, 4)[l_linenumber % 3] as bigint)")).alias("ratio"),
    )


@query(f"with {BLOCKS} select k, min(x) as x0, min(y) as y0, max(x + w) - min(x) as width, max(y + h) - min(y) as height from b group by k")
def subblock_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.canvas(_blocks(spark, sf_dir), "k").select("k", "x0", "y0", "width", "height")


@query(
    f"""with {BLOCKS}, s as (select *, x // ratio // 256 as c0, ((x + w + ratio - 1) // ratio + 255) // 256 as c1, y // ratio // 256 as r0, ((y + h + ratio - 1) // ratio + 255) // 256 as r1 from b),
c as (select *, unnest(range(c0, c1)) as col from s) select k, n, col, unnest(range(r0, r1)) as "row" from c"""
)
def subblock_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.subblock_tiles(_blocks(spark, sf_dir), 256).select("k", "n", "col", "row")


@query(
    """with r as (select p_partkey as k, cast(p_size * 100 as bigint) as w, cast(p_size * 60 as bigint) as h, cast(p_size * 25 + p_partkey % 3 as bigint) as sw, cast(p_size * 15 + p_partkey % 2 as bigint) as sh from part)
select k, coalesce(case when round(w / sw) = round(h / sh) then cast(round(w / sw) as bigint) end, -1) as ratio from r"""
)
def subblock_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_size * 100 as w", "p_size * 60 as h", "p_size * 25 + p_partkey % 3 as sw", "p_size * 15 + p_partkey % 2 as sh")
    return rows.select("k", F.coalesce(formats.subblock_ratio(F.col("w"), F.col("h"), F.col("sw"), F.col("sh")), F.lit(-1)).alias("ratio"))


@query("select s_nationkey as scene, s_suppkey % 4 as series, count(distinct s_suppkey % 8) > 1 as conflict, case when count(distinct s_suppkey % 8) <= 1 then cast(min(s_suppkey % 8) as varchar) end as bytes from supplier group by all")
def profile_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_nationkey as scene", "s_suppkey % 4 as series", "s_suppkey as ifd", "cast(s_suppkey % 8 as string) as bytes")
    return formats.profile_conflicts(rows, ["scene", "series"])


@query("select s_suppkey as k, case when s_suppkey % 2 = 0 then 'label,macro,thumbnail' else 'a' || s_nationkey || ',macro' end as names from supplier")
def associated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.expr("if(s_suppkey % 2 = 0, cast(array() as array<string>), array('macro', concat('a', s_nationkey), 'macro'))")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.array_join(formats.associated_names(declared), ",").alias("names"))


@query(f"with {LEVELS}, t as (select *, (dataset_id * 7) % (tiles_across + 2) - 1 as col, (dataset_id * 11) % (tiles_down + 2) - 1 as r from levels) select dataset_id, level, case when col >= 0 and r >= 0 and col < tiles_across and r < tiles_down then r * tiles_across + col else -1 end as slot from t")
def tile_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    col, row = (c("dataset_id") * 7) % (c("tiles_across") + 2) - 1, (c("dataset_id") * 11) % (c("tiles_down") + 2) - 1
    return levels(spark, sf_dir).select("dataset_id", "level", F.coalesce(formats.slot(col, row, c("tiles_across"), c("tiles_down")), F.lit(-1)).alias("slot"))


@query(
    f"""with {LEVELS}, v as (select *, tiles_across + case when dataset_id % 5 = 0 then 1 else 0 end as a, case when dataset_id % 7 = 0 then 1 else 0 end as n_sparse,
  tiles_across * tiles_down - case when dataset_id % 11 = 0 then 1 else 0 end as n_dense from levels)
select dataset_id, level, case when a <> tiles_across then 'GridMismatch' when n_dense > 0 and n_sparse > 0 then 'DenseAndSparse' when n_dense > 0 and n_dense <> tiles_across * tiles_down then 'DenseCount' end as error from v"""
)
def level_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("dataset_id"), F.col
    rows = levels(spark, sf_dir).withColumns(
        {"n_sparse": (k % 7 == 0).cast("int"), "n_dense": c("tiles_across") * c("tiles_down") - (k % 11 == 0).cast("int"), "tiles_across": c("tiles_across") + (k % 5 == 0).cast("int")}
    )
    return formats.level_errors(rows).select("dataset_id", "level", "error")


@query("select s_suppkey as k, ['Regular', 'Irregular', 'WholeLevel'][1 + s_suppkey % 3] as layout, case s_suppkey % 3 when 1 then greatest(cast(round(s_acctbal / 100) as bigint), 1) else 256 end as size from supplier")
def layout_tile_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "array('Regular', 'Irregular', 'WholeLevel')[cast(s_suppkey % 3 as int)] as layout", "s_acctbal / 100 as adv")
    return rows.select("k", "layout", F.coalesce(formats.tile_size(F.col("layout"), F.lit(256).cast("long"), F.col("adv")), F.lit(-1)).alias("size"))


@query("select p_partkey as k, cast(c & 255 as int) as r, cast((c >> 8) & 255 as int) as g, cast((c >> 16) & 255 as int) as b from (select p_partkey, (p_partkey * 104729) % 16777216 as c from part)")
def tag_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), formats.tag_rgb((F.col("p_partkey") * 104729) % 16777216).alias("c"))
    return rows.select("k", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("rgb")])


@query("select (select count(*) from orders) as expected, (select count(*) from orders where o_orderkey % 2 = 0) as actual, (select count(*) from orders) = (select count(*) from orders where o_orderkey % 2 = 0) as ok")
def batch_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return requests.same_count(orders, orders.filter("o_orderkey % 2 = 0"))


@query("select doc_id as k, cast(octet_length(encode(coalesce(text, ''))) // 3 as bigint) as pixels, true as same from documents where octet_length(encode(coalesce(text, ''))) >= 3")
def rle_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as RGB frames, run-length coded in three planes and back."""
    rows = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), 5000).select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("t")).filter(F.octet_length("t") >= 3)
    rows = rows.withColumn("pixels", F.floor(F.octet_length("t") / 3)).withColumn("raw", F.substr("t", F.lit(1), (F.col("pixels") * 3).cast("int")))
    return rows.select("k", "pixels", (decode.rle_decode(decode.rle_encode(F.col("raw"), 3), F.col("pixels"), 3) == F.col("raw")).alias("same"))


def _packets(progression: str, order: str):
    sql = f"""with p as (select p_partkey as k, l as layer, r as res, c as comp, q as prec from part, range(0, 2) a(l), range(0, 3) b(r), range(0, 3) d(c), range(0, 4) e(q) where l < 1 + p_partkey % 2 and r < 1 + p_size % 3 and q < 1 + p_size % 4)
select k, cast(layer as int) as layer, cast(res as int) as res, cast(comp as int) as comp, cast(prec as int) as prec, cast(row_number() over (partition by k order by {order}) - 1 as int) as place from p"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        images = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "cast(1 + p_partkey % 2 as int) as layers", "1 + p_size % 3 as resolutions", "3 as components", "1 + p_size % 4 as precincts")
        return decode.packet_order(images, "k", progression)

    run.__name__ = f"packet_order_{progression.lower()}"
    query(sql)(run)


for _name, _loops in decode.PROGRESSIONS.items():
    _packets(_name, ", ".join(_loops))


@query(
    """with r as (select s_suppkey as k, 1000 + s_suppkey * 10 as o, 500 as n, case when s_suppkey % 2 = 0 then [1000 + s_suppkey * 10, 1200 + s_suppkey * 10] else [0, 200] end as st from supplier), a as (select *, k % 2 = 0 as absolute from r)
select k, absolute, case when absolute then st[2] - o else st[2] end as second from a"""
)
def mcu_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "1000 + s_suppkey * 10 as o", "if(s_suppkey % 2 = 0, array(1000 + s_suppkey * 10, 1200 + s_suppkey * 10), array(0L, 200L)) as st")
    rows = rows.withColumn("absolute", decode.mcu_starts_are_absolute(F.col("st"), F.col("o"), F.lit(500)))
    return rows.select("k", "absolute", decode.normalized_mcu_start(F.get("st", F.lit(1)), F.col("absolute"), F.col("o")).alias("second"))


@query("select p_partkey as k, ['None', 'Rle', 'Jpeg', 'JpegLs', 'Jp2k', 'Unsupported'][1 + p_partkey % 6] as codec from part")
def transfer_syntaxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.expr("array('1.2.840.10008.1.2.1', '1.2.840.10008.1.2.5', '1.2.840.10008.1.2.4.50', '1.2.840.10008.1.2.4.80', '1.2.840.10008.1.2.4.91', '1.2.3')[cast(p_partkey % 6 as int)]")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), decode.transfer_syntax(uid).alias("codec"))
