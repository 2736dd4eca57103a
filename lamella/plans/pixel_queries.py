"""Queries over pixels, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import pixels as px
from lamella.operators import tables
from lamella.plans.fixtures import PIXELS, U8, pixels, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("vec_id", "x", "y", px.windowed(F.col("s"), -0.5, 0.5).alias("v"))


@query(f"with {U8} select vec_id, cast(x as int) as x, cast(y as int) as y, v from u8")
def window_to_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u8(spark, sf_dir).select("vec_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "v")


HALF = "select vec_id, cast(x // 2 as int) as x, cast(y // 2 as int) as y, cast(sum(v) // count(*) as int) as v from {} group by vec_id, x // 2, y // 2"


@query(f"with {U8} {HALF.format('u8')}")
def box_downsample_2x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.box_downsample(u8(spark, sf_dir), ["vec_id"])


@query(f"with {U8}, h as ({HALF.format('u8')}) {HALF.format('h')}")
def box_downsample_4x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.box_downsample_pow2(u8(spark, sf_dir), ["vec_id"], 4)


@query(
    f"""with {U8}, placed as (select vec_id, vec_id % 20 as col, vec_id // 20 as "row", x, y, v from u8),
req as (select cast(s_suppkey as bigint) as request_id, cast((s_suppkey * 7) % 100 - 4 as bigint) as x0, cast((s_suppkey * 11) % 80 - 4 as bigint) as y0 from supplier),
hits as (select request_id, p."row" * 20 + p.col as ordinal, p.col * 6 + p.x - x0 as px, p."row" * 6 + p.y - y0 as py, v from req join placed p on p.col * 6 + p.x >= x0 and p.col * 6 + p.x < x0 + 12 and p."row" * 6 + p.y >= y0 and p."row" * 6 + p.y < y0 + 12),
top as (select request_id, px, py, arg_max(v, ordinal) as v from hits group by all),
grid as (select request_id, px, unnest(range(0, 12)) as py from (select request_id, unnest(range(0, 12)) as px from req))
select g.request_id, g.px, g.py, cast(coalesce(t.v, 0) as int) as v from grid g left join top t on t.request_id = g.request_id and t.px = g.px and t.py = g.py"""
)
def compose_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 x 12 regions over tiles of 8 x 8 that advance by 6, so that later tiles overwrite; the level has 20 columns."""
    c = F.col
    tiles = table(spark, sf_dir, "embeddings").select((c("vec_id") % 20).alias("col"), F.floor(c("vec_id") / 20).alias("row"), "embedding")
    asked = tables.spread(table(spark, sf_dir, "supplier").select("s_suppkey"), 2000).selectExpr("s_suppkey as request_id", "(s_suppkey * 7) % 100 - 4 as x0", "(s_suppkey * 11) % 80 - 4 as y0", "cast(12 as bigint) as w", "cast(12 as bigint) as h")
    reach = lambda start: F.explode(F.sequence(F.greatest(F.floor((start - 7) / 6), F.lit(0)), F.floor((start + 11) / 6)))
    wanted = asked.withColumn("col", reach(c("x0"))).withColumn("row", reach(c("y0"))).filter("col < 20")
    # a tile is one row until it has met its regions
    joined = wanted.join(tiles, ["col", "row"]).select("request_id", "x0", "y0", "col", "row", F.posexplode("embedding").alias("i", "s")).withColumn("v", px.windowed(c("s"), -0.5, 0.5))
    hits = joined.selectExpr("request_id", "row * 20 + col as ordinal", "col * 6 + i % 8 - x0 as px", "row * 6 + i div 8 - y0 as py", "v")
    return px.compose(asked, hits, ["request_id"]).select("request_id", "px", "py", "v")


@query(f"with {U8} select vec_id, cast(y as int) as y, cast(x as int) as x, cast(sum(v) over (partition by vec_id, y order by x) % 256 as int) as v from u8")
def predictor_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.undo_predictor(u8(spark, sf_dir), ["vec_id", "y"], "x", 8).select("vec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")


@query(f"with {U8} select vec_id, cast(y as int) as y, cast(x as int) as x, cast(sum(v * 257) over (partition by vec_id, y, x % 2 order by x) % 65536 as int) as v from u8")
def predictor_undo_16bit_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = u8(spark, sf_dir).withColumn("lane", F.col("x") % 2).withColumn("v", F.col("v") * 257)
    return px.undo_predictor(rows, ["vec_id", "y", "lane"], "x", 16).select("vec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")


LATTICE = "lat as (select distinct cast(l_partkey % 256 as int) as y, cast(l_suppkey % 256 as int) as cb, cast(l_orderkey % 256 as int) as cr from lineitem)"


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey % 256 as int) as y", "cast(l_suppkey % 256 as int) as cb", "cast(l_orderkey % 256 as int) as cr").distinct()


def _clamp(e: str) -> str:
    return f"cast(greatest(0, least(255, {e})) as int)"


@query(
    f"""with {LATTICE} select y, cb, cr, {_clamp("round(y + cast(1.402 as double) * (cr - 128))")} as r, {_clamp("round(y - cast(0.344136 as double) * (cb - 128) - cast(0.714136 as double) * (cr - 128))")} as g,
  {_clamp("round(y + cast(1.772 as double) * (cb - 128))")} as b from lat"""
)
def ycbcr_to_rgb_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = px.ycbcr_float(F.col("y"), F.col("cb"), F.col("cr"))
    return lattice(spark, sf_dir).select("y", "cb", "cr", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"with {LATTICE} select y, cb, cr, {_clamp('y + (1402 * (cr - 128)) // 1000')} as r, {_clamp('y - (344 * (cb - 128) + 714 * (cr - 128)) // 1000')} as g, {_clamp('y + (1772 * (cb - 128)) // 1000')} as b from lat")
def ycbcr_to_rgb_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = px.ycbcr_int("y", "cb", "cr")
    return lattice(spark, sf_dir).select("y", "cb", "cr", r.alias("r"), g.alias("g"), b.alias("b"))


@query(
    f"""with {LATTICE} select y, cb, cr, cast(cr as bigint) * 16777216 + ((y * cr + 127) // 255) * 65536 + ((cb * cr + 127) // 255) * 256 + ((y * cr + 127) // 255) as argb from lat"""
)
def premultiply_argb(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, cb, cr = F.col("y"), F.col("cb"), F.col("cr")
    return lattice(spark, sf_dir).select("y", "cb", "cr", px.premultiplied_argb(y, cb, y, cr).alias("argb"))


@query("select l_partkey as k, cast(((bgr & 255) << 16) | (bgr & 65280) | ((bgr >> 16) & 255) as int) as rgb from (select distinct l_partkey, cast((l_partkey * 7919) % 16777216 as int) as bgr from lineitem)")
def bgr_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as k", "cast((l_partkey * 7919) % 16777216 as int) as bgr").distinct()
    return rows.select("k", px.bgr_to_rgb(F.col("bgr")).alias("rgb"))


@query(f"with {U8} select vec_id, cast(x as int) as x, cast(y as int) as y, case when v % 5 = 4 then 0 else 10 * (v % 5) end as r, case when v % 5 = 4 then 0 else 20 * (v % 5) + 1 end as g, case when v % 5 = 4 then 0 else 255 - v % 5 end as b from u8")
def palette_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = px.palette_rgb(F.col("v") % 5, [(10 * i, 20 * i + 1, 255 - i) for i in range(4)])
    return u8(spark, sf_dir).withColumn("c", rgb).select("vec_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.get("c", F.lit(0)).alias("r"), F.get("c", F.lit(1)).alias("g"), F.get("c", F.lit(2)).alias("b"))


@query(f"with {U8} select vec_id, cast(x as int) as x, cast(y as int) as y, 255 - v as v8, 65535 - v * 257 as v16 from u8")
def min_is_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u8(spark, sf_dir).select("vec_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), px.inverted(F.col("v"), 8).alias("v8"), px.inverted(F.col("v") * 257, 16).alias("v16"))


@query(f"with {U8}, f as (select vec_id, list(v order by y, x) as d from u8 group by vec_id) select vec_id, i, k, d[1 + (case when vec_id % 2 = 0 then k * 21 + i else i * 3 + k end)] as v from (select *, unnest(range(0, 21)) as i from f), range(0, 3) t(k)")
def planar_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 pixels of 3 channels in 63 samples; even tiles are planar."""
    data = u8(spark, sf_dir).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("d"))
    seq = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    at = px.planar_index(F.col("i"), F.col("k"), 3, F.lit(21), F.col("vec_id") % 2 == 0)
    return data.withColumn("i", seq(20)).withColumn("k", seq(2)).select("vec_id", "i", "k", F.get("d", at.cast("int")).alias("v"))


@query(f"with {U8} select vec_id, cast(x - 2 as int) as x, cast(y - 3 as int) as y, v from u8 where x between 2 and 6 and y between 3 and 7")
def crop_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u8(spark, sf_dir).filter("x between 2 and 6 and y between 3 and 7").select("vec_id", (F.col("x") - 2).cast("int").alias("x"), (F.col("y") - 3).cast("int").alias("y"), "v")


@query(f"with {U8}, g as (select x as dx, unnest(range(0, 5)) as dy from range(0, 11) r(x)) select vec_id, cast(dx as int) as x, cast(dy as int) as y, v from g join u8 on u8.x = dx * 8 // 11 and u8.y = dy * 8 // 5")
def nearest_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 to 11 x 5: each pixel takes the one at its place scaled and truncated; the mapping is a small table."""
    to = spark.range(11).selectExpr("id as dx", "explode(sequence(0L, 4L)) as dy").selectExpr("dx", "dy", "cast(dx * 8 div 11 as int) as x", "dy * 8 div 5 as y")
    return u8(spark, sf_dir).join(F.broadcast(to), ["x", "y"]).select("vec_id", F.col("dx").cast("int").alias("x"), F.col("dy").cast("int").alias("y"), "v")


@query(
    f"""with {U8}, d as (select a.vec_id, abs(a.v - e.v) as d from u8 a join u8 e on e.vec_id = a.vec_id + 1 and e.x = a.x and e.y = a.y),
g as (select vec_id, max(d) as max_abs, avg(d) as mean_abs, avg(case when d = 0 then 1.0 else 0.0 end) as equal_rate, avg(d * d) as mse from d group by vec_id)
select vec_id, max_abs, round(mean_abs, 6) as mean_abs, round(cast(equal_rate as double), 6) as equal_rate, round(mse, 6) as mse, round(case when mse > 0 then 10 * log10(65025 / mse) end, 6) as psnr from g"""
)
def image_compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile against the one after it."""
    a = u8(spark, sf_dir)
    out = px.compare(a, a.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id", "x", "y"], ["vec_id"])
    return out.select("vec_id", "max_abs", *[F.round(c, 6).alias(c) for c in ("mean_abs", "equal_rate", "mse", "psnr")])


@query(
    f"""with {U8}, c as (select vec_id, v as r, (v * 3 + vec_id) % 256 as g, 255 - v as b from u8),
t as (select *, (r + g + b) / 3 < 235 and greatest(r, g, b) - least(r, g, b) > 12 as tissue from c)
select vec_id, count(*) as n, cast(count(*) filter (tissue) as bigint) as tissue, round(avg(r) filter (tissue), 6) as mean_r, round(avg(g) filter (tissue), 6) as mean_g, round(avg(b) filter (tissue), 6) as mean_b from t group by vec_id"""
)
def tissue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = u8(spark, sf_dir).selectExpr("vec_id", "v as r", "(v * 3 + vec_id) % 256 as g", "255 - v as b")
    return px.tissue_stats(rows, ["vec_id"]).select("vec_id", "n", "tissue", *[F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in "rgb"])
