"""Queries over codecs, caches, timings, stitching and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import codecs
from lamella.operators import cache_replay, stitching, timing
from lamella.operators import tables
from lamella.plans.fixtures import table
from lamella.streaming import pan

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


TIMES = """runs as (select l_suppkey % 20 as slide, ['p50_us', 'p95_us', 'p99_us', 'peak_rss_bytes', 'mean_us'][l_linenumber % 5 + 1] as metric, l_orderkey as repeat, max(l_partkey % 150) as samples, max(cast(l_quantity * 1000 as bigint) * (l_partkey % 9 > 0)::int) as b, max(cast(floor(l_extendedprice) as bigint)) as a from lineitem group by all),
pairs as (select slide, metric, b, a, b > 0 and a::double / b > 1.05::double and (metric = 'peak_rss_bytes' or a - b >= 500) as worse from runs where samples >= case metric when 'p95_us' then 20 when 'p99_us' then 100 else 0 end),
s as (select slide, metric, count(*) as pairs, list_sort(list(b))[count(*) // 2 + 1] as before, list_sort(list(a))[count(*) // 2 + 1] as after, cast(count(*) filter (worse) as bigint) as slower from pairs group by slide, metric)"""


def _runs(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 20 as slide", "array('p50_us', 'p95_us', 'p99_us', 'peak_rss_bytes', 'mean_us')[l_linenumber % 5] as metric", "l_orderkey as repeat", "l_partkey % 150 as samples", f"cast({value} as bigint) as value")
    return rows.groupBy("slide", "metric", "repeat").agg(F.max("samples").alias("samples"), F.max("value").alias("value"))


@query(f"with {TIMES} select *, slower >= 2 and before > 0 and after::double / before > 1.05::double and (metric = 'peak_rss_bytes' or after - before >= 500) as regressed from s where pairs >= 3")
def perf_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth part makes a run of zero before."""
    sides = (_runs(spark, sf_dir, e) for e in ("cast(l_quantity * 1000 as bigint) * if(l_partkey % 9 > 0, 1, 0)", "floor(l_extendedprice)"))
    return timing.summaries(*sides, ["slide"])


@query(
    """with r as (select p_partkey as k, cast(p_size as double) as o50, cast(p_size * (1 + p_partkey % 9) as double) as o99, case when p_partkey % 10 = 0 then null else cast(25 as double) end as t50, cast(40 as double) as t99 from part)
select k, case when o50 is null or t50 is null then 'n/a' when o50 / t50 > 2.0 then 'HOTSPOT' when o99 / o50 > 5 and o99 / o50 > 2 * (t99 / t50) then 'JITTER' when o50 / t50 > 1.3 then 'slower' when o50 / t50 < 0.8 then 'FASTER' else 'ok' end as verdict from r"""
)
def bench_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "cast(p_size as double) as o50", "cast(p_size * (1 + p_partkey % 9) as double) as o99", "case when p_partkey % 10 <> 0 then 25D end as t50", "40D as t99")
    return rows.select("k", timing.verdict(F.col("o50"), F.col("o99"), F.col("t50"), F.col("t99")).alias("verdict"))


@query("select p_partkey as k, case when p_partkey % 5 > 0 and p_size * 10 <= 300 * 0.85::double then 'device' else 'cpu' end as route from part")
def route_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), timing.route(F.lit(300), F.col("p_size") * 10, F.col("p_partkey") % 5).alias("route"))


@query(
    """with recursive e as (select user_id % 32 as reader, event_id as seq, user_id % 16 || ':' || cast(floor(value) as bigint) % 16 as key, cast(length(event_type) * 1000 as bigint) as n, row_number() over (partition by user_id % 32 order by ts, event_id) as i from events),
f as (select e.reader, e.i, e.seq, e.key, false as hit, cast(0 as bigint) as evicted, case when n <= 30000 then [{'k': e.key, 'n': n}] else [] end as held from e where i = 1
 union all select reader, i, seq, key, hit, case when hit or n > 30000 then 0 else len(held) - len(kept) end, case when hit then list_filter(held, lambda x: x.k <> key) || list_filter(held, lambda x: x.k = key) when n > 30000 then held else kept || [{'k': key, 'n': n}] end
  from (select e.reader, e.i, e.seq, e.key, e.n, f.held, list_contains(list_transform(f.held, lambda x: x.k), e.key) as hit,
   list_filter(f.held, lambda x, j: list_sum(list_transform(f.held[j:], lambda y: y.n)) + e.n <= 30000) as kept from f join e on e.reader = f.reader and e.i = f.i + 1))
select reader, seq, key, hit, evicted, cast(coalesce(list_sum(list_transform(held, lambda x: x.n)), 0) as bigint) as held from f"""
)
def lru_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id % 32 as reader", "ts", "event_id as seq", "concat(user_id % 16, ':', cast(floor(value) as bigint) % 16) as key", "cast(length(event_type) * 1000 as bigint) as bytes")
    return cache_replay.replay(rows, 30_000)


@query("select doc_id as k, cast(octet_length(encode(coalesce(text, ''))) as int) as n, true as packbits, true as lzw, true as deflate, true as zstd from documents")
def payload_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through each codec and back; whether the bytes are the same."""
    raw = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), 5000).select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    pairs = {"packbits": (codecs.packbits_encode, codecs.packbits_decode), "lzw": (codecs.lzw_encode, codecs.lzw_decode), "deflate": (codecs.deflate, codecs.inflate), "zstd": (codecs.zstd, codecs.unzstd)}
    return raw.select("k", F.octet_length("raw").alias("n"), *[(back(there(F.col("raw"))) == F.col("raw")).alias(n) for n, (there, back) in pairs.items()])


@query("select p_partkey as k, 'FFD8' || hex(p_name) || 'FFD9' as repaired, 'FFD8' || hex(p_name) || 'FFD9' as trimmed from part")
def jpeg_frame_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even keys come with their end marker, odd ones without; trimmed ones come with a byte of padding."""
    body = F.concat(F.unhex(F.lit("FFD8")), F.col("p_name").cast("binary"))
    with_end = F.concat(body, F.unhex(F.lit("FFD9")))
    raw = F.when(F.col("p_partkey") % 2 == 0, with_end).otherwise(body)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.hex(codecs.with_end_marker(raw)).alias("repaired"), F.hex(codecs.trimmed_padding(F.concat(with_end, F.unhex(F.lit("00"))))).alias("trimmed"))


@query(
    """with h as (select p_partkey as k, upper(substr(sha256(p_name || p_partkey), 1, 32)) as d from part)
select k, substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2) || substr(d, 11, 2) || substr(d, 9, 2) || substr(d, 15, 2) || substr(d, 13, 2) || substr(d, 17, 16) as guid from h"""
)
def guid_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.expr("sha2(concat(p_name, p_partkey), 256)")
    dashed = F.concat(F.lit("{"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 4), F.lit("-"), F.substring(d, 17, 4), F.lit("-"), F.substring(d, 21, 12), F.lit("}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.hex(codecs.guid_bytes(dashed)).alias("guid"))


@query(
    """with recursive j as (select s_suppkey // 10 as area, s_suppkey as a, s_suppkey + 1 as b, case s_suppkey % 4 when 0 then 256 - s_suppkey % 7 when 1 then s_suppkey % 7 - 256 else 0 end as dx,
  case s_suppkey % 4 when 2 then s_suppkey % 7 - 256 when 3 then 256 - s_suppkey % 7 else 0 end as dy from supplier where s_suppkey % 10 < 9),
w as (select area, min(a) as tile, 0.0::double as x, 0.0::double as y from j group by area union all select j.area, j.b, w.x + j.dx, w.y + j.dy from w join j on j.area = w.area and j.a = w.tile)
select area, tile, x, y from w"""
)
def joint_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 < 9").selectExpr("s_suppkey div 10 as area", "s_suppkey as a", "s_suppkey + 1 as b", "array('RIGHT', 'LEFT', 'UP', 'DOWN')[cast(s_suppkey % 4 as int)] as direction", "cast(s_suppkey % 7 as double) as o")
    dx, dy = stitching.joint_delta(F.col("direction"), F.lit(256.0), F.lit(256.0), F.col("o"), F.col("o"))
    return stitching.places(rows.select("area", "a", "b", dx.alias("dx"), dy.alias("dy")))


@query(
    """with j as (select l_suppkey as area, case when l_linenumber % 2 = 0 then 'UP' else 'RIGHT' end as d, cast(l_quantity as bigint) as c, -(l_partkey % 50) as o from lineitem)
select area, round(cast(sum(c * -o) filter (d = 'UP') as double) / sum(c) filter (d = 'UP'), 6) as vertical, round(cast(sum(c * -o) filter (d <> 'UP') as double) / sum(c) filter (d <> 'UP'), 6) as horizontal from j group by area"""
)
def weighted_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as area", "case when l_linenumber % 2 = 0 then 'UP' else 'RIGHT' end as direction", "cast(l_quantity as bigint) as confidence", "-(l_partkey % 50) as overlap")
    return stitching.weighted_overlap(rows, "area").select("area", F.round("vertical", 6).alias("vertical"), F.round("horizontal", 6).alias("horizontal"))


@query(
    """select cast(floor(epoch(ts) / 3600) as bigint) * 3600 as window_start, user_id % 16 as reader, count(*) as tiles, cast(sum(length(event_type) * 1000) as bigint) as bytes from events group by all"""
)
def pan_trace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly tile traffic of each reader: the batch form of the stream in lamella.streaming.pan."""
    return pan.hourly(pan.requests(table(spark, sf_dir, "events")))
