"""Queries over grids, levels and requests, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.geometry import edge_extent
from lamella.operators import grid, pyramid, requests
from lamella.plans.fixtures import LEVELS, REGIONS, levels, regions, slides, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


HITS = (
    REGIONS
    + """, span as (
  select *, greatest(0, least(tiles_across, cast(floor(x / 256.0) as bigint))) as c0, greatest(0, least(tiles_across, cast(ceil((x + w) / 256.0) as bigint))) as c1,
    greatest(0, least(tiles_down, cast(floor(y / 256.0) as bigint))) as r0, greatest(0, least(tiles_down, cast(ceil((y + h) / 256.0) as bigint))) as r1 from regions
), rws as (select *, unnest(range(r0, r1)) as "row" from span), hits as (select *, unnest(range(c0, c1)) as col from rws)"""
)


@query(f'with {HITS} select request_id, dataset_id, level, col, "row", col * 256 - x as dest_x, "row" * 256 - y as dest_y from hits')
def region_tile_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular_hits(regions(spark, sf_dir)).select("request_id", "dataset_id", "level", "col", "row", "dest_x", "dest_y")


@query(f'with {HITS} select request_id, count(*) as n_hits, cast(min("row" * 1000000 + col) as bigint) as first_hit from hits group by request_id')
def region_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular_hits(regions(spark, sf_dir)).groupBy("request_id").agg(F.count("*").alias("n_hits"), F.min(F.col("row") * 1_000_000 + F.col("col")).alias("first_hit"))


@query(f"with {LEVELS} select dataset_id, level, width, height, downsample, cast(tiles_across as bigint) as tiles_across, cast(tiles_down as bigint) as tiles_down from levels")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pyramid.regular_levels(levels(spark, sf_dir).drop("tiles_across", "tiles_down"))
    return out.select("dataset_id", "level", "width", "height", "downsample", "tiles_across", "tiles_down")


@query(
    """with r as (
  select o_orderkey as request_id, case when o_orderkey % 5 = 0 then 1 else 0 end as scene, case when o_orderkey % 7 = 0 then 2 else 0 end as series, o_orderkey % 6 as level,
    o_orderkey % 3 - 1 as z, case when o_orderkey % 11 = 0 then 3 else 2 end as c, case when o_orderkey % 13 = 0 then 1 else 0 end as t,
    cast(1 + o_orderkey % 30000 as bigint) as w, cast(10000 as bigint) as h from orders)
select request_id, case when w * h > 268435456 then 'RegionTooLarge' when scene >= 1 then 'SceneOutOfRange' when series >= 1 then 'SeriesOutOfRange' when level >= 4 then 'LevelOutOfRange'
  when z < 0 or z >= 1 then 'ZOutOfRange' when c >= 3 then 'COutOfRange' when t >= 1 then 'TOutOfRange' end as error from r"""
)
def region_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(
        k.alias("request_id"), F.when(k % 5 == 0, 1).otherwise(0).alias("scene"), F.when(k % 7 == 0, 2).otherwise(0).alias("series"), (k % 6).alias("level"), (k % 3 - 1).alias("z"),
        F.when(k % 11 == 0, 3).otherwise(2).alias("c"), F.when(k % 13 == 0, 1).otherwise(0).alias("t"), (k % 30000 + 1).alias("w"), F.lit(10000).cast("long").alias("h"),
    )
    extents = {"n_scenes": F.lit(1), "n_series": F.lit(1), "n_levels": F.lit(4), "n_z": F.lit(1), "n_c": F.lit(3), "n_t": F.lit(1)}
    return requests.validate_region(asked.withColumns(extents)).select("request_id", "error")


@query(
    """with r as (select o_orderkey as k, case when o_orderkey % 4 = 0 then null else o_orderkey end as scene, case when o_orderkey % 3 = 0 then null else 1 end as level,
  case when o_orderkey % 5 = 0 then null else 2 end as w from orders)
select k as request_id, case when scene is null then 'missing scene' when level is null then 'missing level' when w is null then 'missing w' end as error from r"""
)
def request_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("request_id"), F.when(k % 4 != 0, k).alias("scene"), F.when(k % 3 != 0, 1).alias("level"), F.when(k % 5 != 0, 2).alias("w"))
    return rows.select("request_id", requests.missing_field(["scene", "level", "w"]).alias("error"))


@query("select o_orderkey as request_id, case when o_orderkey % 2 = 0 then -1 else (o_orderkey + 1) * 1024 * 3 end as samples from orders")
def checked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("request_id"), F.when(k % 2 == 0, F.try_multiply(k + 1, F.lit(1 << 40))).otherwise(k + 1).alias("w"), F.when(k % 2 == 0, 1 << 40).otherwise(1024).alias("h"))
    return rows.select("request_id", F.coalesce(requests.checked_samples(F.col("w"), F.col("h"), F.lit(3)), F.lit(-1)).alias("samples"))


@query(
    f"""with {LEVELS}, g as (select *, (width + 511) // 512 as a, (height + 511) // 512 as d from levels), r as (select *, unnest(range(0, d)) as "row" from g), t as (select *, unnest(range(0, a + 1)) as col from r)
select dataset_id, level, col, "row", cast(least(512, greatest(width - col * 512, 0)) as bigint) as w, cast(least(512, greatest(height - "row" * 512, 0)) as bigint) as h,
  case when col * 512 >= width or "row" * 512 >= height then 'OriginOutsideLevel' end as error from t"""
)
def display_tile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.display_tiles(levels(spark, sf_dir), 512).select("dataset_id", "level", "col", "row", "w", "h", "error")


@query(
    f"""with {LEVELS} select dataset_id, level, cast(least(256, greatest(width - (tiles_across - 1) * 256, 0)) as bigint) as last_w, cast(least(256, greatest(height - (tiles_down - 1) * 256, 0)) as bigint) as last_h,
  cast(least(256, greatest(width - tiles_across * 256, 0)) as bigint) as beyond_w from levels"""
)
def edge_tile_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return levels(spark, sf_dir).select(
        "dataset_id", "level", edge_extent(c("tiles_across") - 1, c("tile_w"), c("width")).alias("last_w"), edge_extent(c("tiles_down") - 1, c("tile_h"), c("height")).alias("last_h"),
        edge_extent(c("tiles_across"), c("tile_w"), c("width")).alias("beyond_w"),
    )


@query(
    f"""with {LEVELS}, a as (select p_partkey as dataset_id, unnest([cast(0.5 as double), 1.4, 1.5, 3.0, 5.9, 6.0, 100.0, 'nan'::double]) as wanted from part)
select a.dataset_id, a.wanted, case when isnan(a.wanted) then -1 else arg_min(level, abs(downsample - a.wanted) * 10 + level) end as best_level from a join levels l on a.dataset_id = l.dataset_id group by all"""
)
def best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.explode(F.array(*map(F.lit, (0.5, 1.4, 1.5, 3.0, 5.9, 6.0, 100.0, float("nan")))))
    return pyramid.best_level(slides(spark, sf_dir).select("dataset_id", wanted.alias("wanted")), levels(spark, sf_dir))


SQL["best_level"] = f"""with {LEVELS}, a as (select p_partkey as dataset_id, unnest([cast(0.5 as double), 1.4, 1.5, 3.0, 5.9, 6.0, 100.0, 'nan'::double]) as wanted from part),
r as (select a.dataset_id, a.wanted, level, row_number() over (partition by a.dataset_id, a.wanted order by abs(downsample - a.wanted), level) as k from a join levels l on a.dataset_id = l.dataset_id)
select dataset_id, wanted, case when isnan(wanted) then -1 else level end as best_level from r where k = 1"""


@query(f"with {REGIONS} select request_id, cast(floor((x * 4 - 3) / downsample) as bigint) as level_x, cast(floor((y * 4 - 3) / downsample) as bigint) as level_y from regions")
def level0_to_level_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    to = lambda v: F.floor((c(v) * 4 - 3) / c("downsample"))
    return regions(spark, sf_dir).select("request_id", to("x").alias("level_x"), to("y").alias("level_y"))


@query(
    f"""with {LEVELS}, r as (select *, case when dataset_id % 3 = 0 then (dataset_id * 37) % width end as ox, case when dataset_id % 3 = 0 then (dataset_id * 53) % height end as oy,
    case when dataset_id % 3 = 1 then (dataset_id * 71) % width end as cx, case when dataset_id % 3 = 1 then (dataset_id * 97) % height end as cy, 300 as w, 200 as h from levels),
s as (select *, coalesce(ox, case when cx is not null then greatest(cx - 150, 0) end, greatest(width - 300, 0) // 2) as sx, coalesce(oy, case when cy is not null then greatest(cy - 100, 0) end, greatest(height - 200, 0) // 2) as sy from r),
b as (select *, greatest(sx // 256 - 1, 0) as c0, least(least(sx + 299, width - 1) // 256 + 1, tiles_across - 1) as c1, greatest(sy // 256 - 1, 0) as r0, least(least(sy + 199, height - 1) // 256 + 1, tiles_down - 1) as r1 from s),
x as (select *, unnest(range(c0, c1 + 1)) as col from b)
select dataset_id, level, col, unnest(range(r0, r1 + 1)) as "row" from x"""
)
def window_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("dataset_id"), F.col
    asked = levels(spark, sf_dir).withColumns(
        {
            "origin_x": F.when(k % 3 == 0, (k * 37) % c("width")), "origin_y": F.when(k % 3 == 0, (k * 53) % c("height")),
            "center_x": F.when(k % 3 == 1, (k * 71) % c("width")), "center_y": F.when(k % 3 == 1, (k * 97) % c("height")), "w": F.lit(300), "h": F.lit(200),
        }
    )
    return grid.window_selections(asked, 1).select("dataset_id", "level", "col", "row")


@query(
    f"""with {LEVELS}, g as (select *, greatest(tiles_across - 4, 0) // 2 as c0, greatest(tiles_down - 4, 0) // 2 as r0 from levels), t as (select *, unnest(range(0, tiles_across)) as col from g), u as (select *, unnest(range(0, tiles_down)) as "row" from t),
o as (select *, row_number() over (partition by dataset_id, level order by case when col >= c0 and col < c0 + 4 and "row" >= r0 and "row" < r0 + 4 then 0 else 1 end, "row", col) as n from u)
select dataset_id, level, col, "row" from o where n <= 12"""
)
def centered_tile_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.centered_coords(levels(spark, sf_dir), 12, ["dataset_id", "level"]).select("dataset_id", "level", "col", "row")


@query(
    f"""with {LEVELS}, p as (select *, greatest(1, least(128, least(width, height))) as side from levels)
select dataset_id, level, n as name, case n when 'top_left' then 0 when 'center' then (width - side) // 2 else width - side end as x,
  case n when 'top_left' then 0 when 'center' then (height - side) // 2 else height - side end as y, cast(side as bigint) as side from (select *, unnest(['top_left', 'center', 'bottom_right']) as n from p)"""
)
def representative_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = levels(spark, sf_dir).withColumns({"side": F.greatest(F.lit(1), F.least(F.lit(128), "width", "height")).cast("long"), "name": F.explode(F.array(*map(F.lit, ("top_left", "center", "bottom_right"))))})
    at = lambda size: F.when(c("name") == "top_left", 0).when(c("name") == "center", F.floor((c(size) - c("side")) / 2)).otherwise(c(size) - c("side")).cast("long")
    return out.select("dataset_id", "level", "name", at("width").alias("x"), at("height").alias("y"), "side")


@query(f"with {LEVELS} select dataset_id, level, i as step, i % tiles_across as col, i % tiles_down as \"row\" from (select *, unnest(range(0, 16)) as i from levels where level = 2)")
def pan_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = levels(spark, sf_dir).filter("level = 2").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return out.selectExpr("dataset_id", "level", "step", "step % tiles_across as col", "step % tiles_down as row")


IRREGULAR = """tiles as (select cast(s_suppkey % 10 as bigint) as col, cast(s_suppkey // 10 as bigint) as "row", s_acctbal % 20 as off_x, s_acctbal % 13 as off_y, 200 as tile_w, 150 as tile_h from supplier),
req as (select cast(c_custkey as bigint) as request_id, cast((c_custkey * 7919) % 2100 - 60 as bigint) as x, cast((c_custkey * 104729) % 1600 - 60 as bigint) as y, cast(40 + c_custkey % 300 as bigint) as w, cast(30 + c_custkey % 200 as bigint) as h from customer),
sp as (select *, cast(trunc(x / 200.5) as bigint) - 1 as c0, cast(ceil((x + w) / 200.5) as bigint) + 1 as c1, cast(trunc(y / 150.25) as bigint) - 1 as r0, cast(ceil((y + h) / 150.25) as bigint) + 1 as r1 from req)"""


@query(
    f"""with {IRREGULAR}, m as (select *, t.col * 200.5::double + off_x - x as dx, t."row" * 150.25::double + off_y - y as dy from sp join tiles t on t.col >= c0 and t.col < c1 and t."row" >= r0 and t."row" < r1)
select request_id, col, "row", round(dx, 6) as dest_xf, round(dy, 6) as dest_yf from m where dx < w and dx + tile_w > 0 and dy < h and dy + tile_h > 0"""
)
def irregular_tile_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = table(spark, sf_dir, "supplier").selectExpr("1 as level", "s_suppkey % 10 as col", "s_suppkey div 10 as row", "s_acctbal % 20 as off_x", "s_acctbal % 13 as off_y", "200 as tile_w", "150 as tile_h")
    asked = table(spark, sf_dir, "customer").selectExpr(
        "1 as level", "c_custkey as request_id", "(c_custkey * 7919) % 2100 - 60 as x", "(c_custkey * 104729) % 1600 - 60 as y", "40 + c_custkey % 300 as w", "30 + c_custkey % 200 as h",
        "200.5D as adv_x", "150.25D as adv_y", "1 as extra_left", "1 as extra_right", "1 as extra_top", "1 as extra_bottom",
    )
    return grid.irregular_hits(asked, tiles, ["level"]).select("request_id", "col", "row", F.round("dest_xf", 6).alias("dest_xf"), F.round("dest_yf", 6).alias("dest_yf"))


@query(
    """select p_partkey as dataset_id, l as level, case when (1024 + 64 * p_size) % (1 << l) = 0 and (768 + 48 * p_size) % (1 << l) = 0 then cast(1 << l as bigint) else -1 end as factor
from (select *, unnest(range(0, 7)) as l from part)"""
)
def power_of_two_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slides(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    w, h = F.expr("shiftright(width0, cast(level as int))"), F.expr("shiftright(height0, cast(level as int))")
    return out.select("dataset_id", "level", F.coalesce(pyramid.power_of_two_factor(F.col("width0"), F.col("height0"), w, h), F.lit(-1)).alias("factor"))


@query(
    """with s as (select p_partkey as dataset_id, cast(1024 + 64 * p_size as bigint) as w0, cast(768 + 48 * p_size as bigint) as h0, unnest(range(0, 5)) as e from part)
select dataset_id, cast(1 << e as bigint) as factor, case when e in (0, 2, 4) then 'Physical' else 'SyntheticDownsample' end as source_kind, cast(1 << (e - e % 2) as bigint) as base_factor
from s where w0 % (1 << e) = 0 and h0 % (1 << e) = 0"""
)
def synthetic_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    physical = slides(spark, sf_dir).select("dataset_id", "width0", "height0", F.explode(F.array(*[F.lit(f).cast("long") for f in (1, 4, 16)])).alias("factor"))
    return pyramid.synthesized(physical).select("dataset_id", "factor", "source_kind", "base_factor")


@query(
    f"""with {LEVELS}, r as (select *, row_number() over w - 1 as rank, round((first_value(width) over w / width + first_value(height) over w / height) / 2, 9) as mean_downsample
  from levels window w as (partition by dataset_id order by width * height desc, level))
select dataset_id, level, cast(rank as int) as rank, mean_downsample from r"""
)
def mean_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.mean_downsample(levels(spark, sf_dir)).select("dataset_id", "level", "rank", F.round("mean_downsample", 9).alias("mean_downsample"))


@query("select p_partkey as dataset_id, cast(l as int) as level, cast(greatest((1024 + 64 * p_size) >> (l * 3), 1) as bigint) as width from (select *, unnest(range(0, 6)) as l from part)")
def public_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slides(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return out.select("dataset_id", "level", F.greatest(F.expr("shiftright(width0, level * 3)"), F.lit(1)).cast("long").alias("width"))


INSTANCES = "inst as (select l_orderkey as series, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as pos, cast(l_partkey % 1000 as bigint) as width, cast(l_suppkey % 1000 as bigint) as height from lineitem)"


@query(
    f"""with {INSTANCES}, p as (select *, lag(width) over w as pw, lag(height) over w as ph from inst window w as (partition by series order by pos))
select series, cast(pos as int) as pos, width, height from p where width > pw or height > ph"""
)
def monotonic_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.row_number().over(w).alias("pos"), (F.col("l_partkey") % 1000).alias("width"), (F.col("l_suppkey") % 1000).alias("height"))
    return pyramid.monotonic(rows, "series", "pos").select("series", "pos", "width", "height")
