"""Queries over the store, properties, vendor rules, identities and timings, with the same results in SQL where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import identity, properties, store, vendor
from lamella.plans.fixtures import LEVELS, levels, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


TRACE = "trace as (select event_id, ts, user_id % 16 as col, cast(floor(value) as bigint) % 16 as \"row\", event_type, length(event_type) * 1000 as bytes from events)"


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id % 16 as col", "cast(floor(value) as bigint) % 16 as row", "event_type", "cast(length(event_type) * 1000 as bigint) as bytes")


STORED = "stored as (select distinct col, \"row\" from trace where event_id % 7 = 0)"


@query(f'with {TRACE}, {STORED} select event_id, t.col, t."row", s.col is not null as hit from trace t left join stored s on s.col = t.col and s."row" = t."row"')
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return store.split_hits(t, t.filter("event_id % 7 = 0"), ["col", "row"]).select("event_id", "col", "row", "hit")


@query(f'with {TRACE}, {STORED} select distinct t.col, t."row" from trace t where not exists (select 1 from stored s where s.col = t.col and s."row" = t."row")')
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return store.misses(t, t.filter("event_id % 7 = 0").select("col", "row").distinct(), ["col", "row"])


@query(f"with {TRACE} select event_type, cast(count(*) filter (event_id % 3 = 0) as bigint) as hits, cast(count(*) filter (event_id % 3 <> 0) as bigint) as misses, cast(sum(bytes) as bigint) as bytes from trace group by event_type")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("event_id") % 3 == 0
    return trace(spark, sf_dir).groupBy("event_type").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.sum("bytes").alias("bytes"))


NEW = """old as (select col, "row", min(event_id) as src from trace where event_id % 5 = 0 group by col, "row"),
fresh as (select col, "row", z, src from (select col, "row", event_id % 2 as z, event_id as src, row_number() over (partition by col, "row" order by event_id % 2, event_id) as k from trace where event_id % 5 = 1) where k = 1)"""


def _store_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = trace(spark, sf_dir)
    old = t.filter("event_id % 5 = 0").groupBy("col", "row").agg(F.min("event_id").alias("src"))
    new = t.filter("event_id % 5 = 1").groupBy("col", "row", (F.col("event_id") % 2).alias("z")).agg(F.min("event_id").alias("src"))
    return old, new


@query(f'with {TRACE}, {NEW} select col, "row", src from old union all select col, "row", src from fresh f where not exists (select 1 from old o where o.col = f.col and o."row" = f."row")')
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _store_sides(spark, sf_dir)
    return store.merge(old.withColumn("z", F.lit(0).cast("long")), new, ["col", "row"]).select("col", "row", "src")


@query(f'with {TRACE}, {NEW} select col, "row", z, src from fresh')
def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, new = _store_sides(spark, sf_dir)
    return store.replace(new, ["col", "row"]).select("col", "row", "z", "src")


@query(f"""with {TRACE} select event_type, event_id, cast(coalesce(sum(bytes) over (partition by event_type order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from trace""")
def payload_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.payload_offsets(trace(spark, sf_dir).withColumnRenamed("bytes", "length"), ["event_type"], ["event_id"]).select("event_type", "event_id", "offset")


@query(
    """with r as (select l_suppkey as file, l_partkey * 100 as o, cast(l_quantity as bigint) * 3 as n from lineitem),
b as (select *, max(o + n) over (partition by file order by o, n rows between unbounded preceding and 1 preceding) as before from r) select file, o as "offset", n as length from b where o < before"""
)
def overlapping_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as file", "l_partkey * 100 as offset", "cast(l_quantity as bigint) * 3 as length")
    return store.overlapping(rows, ["file"]).select("file", "offset", "length")


@query(
    """with t as (select l_orderkey as series, l_linenumber as pos, cast(max(l_partkey) % 256 as int) as v from lineitem group by all), g as (select o_orderkey as series, cast(p as int) as pos from orders, range(1, 8) r(p))
select g.series, g.pos, coalesce(t.v, 0) as v from g left join t on t.series = g.series and t.pos = g.pos"""
)
def sparse_tile_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("pos")).agg((F.max("l_partkey") % 256).cast("int").alias("v"))
    frames = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("series"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("pos"))
    return store.sparse_fill(frames, tiles, ["series", "pos"])


@query(
    """with r as (select p_partkey as k, case p_partkey % 6 when 0 then ' Prefer ' when 1 then 'ON' when 2 then 'required' when 3 then 'require' when 4 then 'off' else null end as v from part)
select k, case when lower(trim(v)) in ('prefer', 'on', 'true', '1') then 'PreferFresh' when lower(trim(v)) in ('required', 'require') then 'RequireFresh' else 'Off' end as policy from r"""
)
def cache_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("case p_partkey % 6 when 0 then ' Prefer ' when 1 then 'ON' when 2 then 'required' when 3 then 'require' when 4 then 'off' end")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), store.policy(v).alias("policy"))


@query(
    """with s as (select p_partkey as k, '/s/' || p_name || p_partkey || '.svs' as path, case p_partkey % 3 when 0 then 'Off' when 1 then 'PreferFresh' else 'RequireFresh' end as policy from part),
p as (select *, path || '.svcache' as c0, '/c/' || sha256(path) || '.svcache' as c1 from s), f as (select *, case when k % 5 = 0 then c0 when k % 5 = 1 then c1 end as hit from p)
select path, policy, case when policy <> 'Off' and hit is not null then hit else path end as open_path, case when policy = 'RequireFresh' and hit is null then 'NoFreshCache' end as error from f"""
)
def cache_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat('/s/', p_name, p_partkey, '.svs') as path", "case p_partkey % 3 when 0 then 'Off' when 1 then 'PreferFresh' else 'RequireFresh' end as policy")
    both = rows.withColumn("cs", store.candidate_paths(F.col("path"), "/c"))
    caches = both.filter("k % 5 < 2").select(F.get("cs", (F.col("k") % 5).cast("int")).alias("cache_path"), F.lit(True).alias("fresh"))
    return store.resolve(rows.drop("k"), caches, "/c").select("path", "policy", "open_path", "error")


@query(
    """select p_partkey as k, p_partkey % 4 <> 0 and (case when p_partkey % 3 = 0 then null else p_size end) is not distinct from (case when p_partkey % 6 = 0 then null else p_size end) and p_name = p_name as fresh from part"""
)
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), store.fresh(k % 4 != 0, (F.when(k % 3 != 0, F.col("p_size")), F.when(k % 6 != 0, F.col("p_size"))), (F.col("p_name"), F.col("p_name"))).alias("fresh"))


PROPS = "props as (select p_partkey as k, 'Aperio Image Library|AppMag = ' || p_size || '|MPP = 0.' || (2000 + p_size * 7) || '|Brand = ' || p_brand || '|junk' as t, p_size, p_brand from part)"


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('Aperio Image Library|AppMag = ', p_size, '|MPP = 0.', 2000 + p_size * 7, '|Brand = ', p_brand, '|junk') as t"
    return table(spark, sf_dir, "part").selectExpr("p_partkey as k", text).withColumn("m", properties.pipe_properties(F.col("t"), "aperio."))


@query(f"with {PROPS} select k, 'aperio.' || trim(split_part(x, '=', 1)) as key, trim(substr(x, instr(x, '=') + 1)) as value from (select k, unnest(string_split(t, '|')) as x from props) where contains(x, '=')")
def property_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _props(spark, sf_dir).select("k", F.explode("m").alias("key", "value"))


@query(f"with {PROPS} select k, cast('0.' || (2000 + p_size * 7) as double) as mpp, cast(p_size as double) as objective from props")
def property_mpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    mpp, _ = properties.both(properties.number(F.col("m"), "aperio.MPP"), properties.number(F.col("m"), "aperio.MPP"))
    return _props(spark, sf_dir).select("k", mpp.alias("mpp"), properties.number(F.col("m"), "aperio.AppMag").alias("objective"))


@query(f"with {PROPS} select k, ['aperio.AppMag', 'aperio.Brand', 'aperio.MPP'][i] as name, cast(i as int) as i from props, range(1, 4) r(i)")
def property_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _props(spark, sf_dir).select("k", F.posexplode(F.array_sort(F.map_keys("m"))).alias("i", "name")).select("k", "name", (F.col("i") + 1).alias("i"))


@query(
    """with r as (select p_partkey as k, case when p_partkey % 4 = 0 then 'nothex' else substr(sha256(p_name), 1, 6) end as t from part)
select k, case when k % 4 = 0 then 255 else ('0x' || substr(t, 1, 2))::int end as r, case when k % 4 = 0 then 255 else ('0x' || substr(t, 3, 2))::int end as g, case when k % 4 = 0 then 255 else ('0x' || substr(t, 5, 2))::int end as b from r"""
)
def background_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "case when p_partkey % 4 = 0 then 'nothex' else concat('#', substr(sha2(p_name, 256), 1, 6)) end as t").withColumn("c", properties.hex_rgb(F.col("t")))
    return rows.select("k", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("rgb")])


@query(
    """with r as (select p_partkey as k, cast(p_size * 1000 as double) as res, case p_partkey % 3 when 0 then 2 when 1 then 3 end as unit from part)
select k, round(case coalesce(unit, 2) when 2 then 25400 / res else 10000 / res end, 9) as generic_mpp, round(case coalesce(unit, 3) when 2 then 25400 / res else 10000 / res end, 9) as ndpi_mpp from r"""
)
def mpp_from_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "cast(p_size * 1000 as double) as res", "case p_partkey % 3 when 0 then 2 when 1 then 3 end as unit")
    mpp = lambda unit: F.round(properties.mpp_from_resolution(F.col("res"), F.col("unit"), unit), 9)
    return rows.select("k", mpp(2).alias("generic_mpp"), mpp(3).alias("ndpi_mpp"))


@query(
    f"""with {LEVELS} select dataset_id, 'level[' || level || '].width' as key, width::varchar as value from levels union all select dataset_id, 'level[' || level || '].height', height::varchar from levels
union all select dataset_id, 'level[' || level || '].downsample', printf('%.1f', downsample) from levels union all select dataset_id, 'level-count', count(*)::varchar from levels group by dataset_id"""
)
def capi_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.capi_properties(levels(spark, sf_dir), "dataset_id")


@query("select p_partkey as k, unnest([64 + p_size, 48]) as x, unnest([62, 46]) as y, unnest([1, 2]) as i from part")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(64 + p_size, ' 62  48 46 x 7')")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.posexplode(properties.overlap_pairs(text)).alias("i", "p")).select("k", "p.x", "p.y", (F.col("i") + 1).alias("i"))


@query(
    r"""select page_id, cast(generate_subscripts(v, 1) as int) as i, unnest(v) as href from (select page_id, regexp_extract_all(html, '\shref="([^"]*)"', 1) as v from pages)"""
)
def xml_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(properties.attributes(F.col("html"), "href")).alias("i", "href"))
    return found.select("page_id", (F.col("i") + 1).alias("i"), "href")


@query(
    """select s_suppkey as k, section, name, value from (select s_suppkey, unnest([{'section': 'GENERAL', 'name': 'SLIDE_ID', 'value': s_name}, {'section': 'LEVEL0', 'name': 'W', 'value': (s_suppkey + 1)::varchar}, {'section': 'LEVEL0', 'name': 'H', 'value': 'a=b'}], recursive := true) from supplier)"""
)
def ini_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('; note\n[GENERAL]\nSLIDE_ID = ', s_name, '\n# more\n\n[LEVEL0]\nW=', s_suppkey, '\n H = a=b\nW = ', s_suppkey + 1, '\nnothing')")
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return properties.parse_ini(lines, "k")


@query(
    """with v as (select * from (values (0, 'svcache'), (1, 'dicom'), (2, 'mirax'), (3, 'vms'), (4, 'vsi'), (5, 'raw_jp2k'), (6, 'zvi'), (7, 'czi'), (8, 'tiff')) t(priority, vendor)),
p as (select doc_id as path, priority, vendor, (doc_id + priority * 3) % 7 = 0 as detected, case when (doc_id + priority) % 2 = 0 then 'Definite' else 'Likely' end as confidence,
  case when (doc_id * 5 + priority) % 11 = 0 then 'E' || priority end as error from documents, v),
m as (select path, vendor, confidence, row_number() over (partition by path order by case confidence when 'Definite' then 0 else 1 end, priority) as k from p where detected and error is null),
e as (select path, arg_min(error, priority) as error from p where error is not null group by path)
select d.doc_id as path, m.vendor, m.confidence, case when m.path is null then e.error end as error from documents d left join m on m.path = d.doc_id and m.k = 1 left join e on e.path = d.doc_id"""
)
def vendor_probe_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, vendor.REGISTRY))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(names).alias("priority", "vendor"))
    probes = rows.selectExpr(
        "path", "priority", "vendor", "(path + priority * 3) % 7 = 0 as detected", "case when (path + priority) % 2 = 0 then 'Definite' else 'Likely' end as confidence",
        "case when (path * 5 + priority) % 11 = 0 then concat('E', priority) end as error",
    )
    return vendor.best_probe(probes)


CODES = "codes as (select l_orderkey as k, l_linenumber as n, max([1, 5, 8, 32946, 6, 7, 50000, 33003, 33005, 33004, 99][1 + (l_partkey + l_linenumber) % 11]) as tag from lineitem group by all)"


@query(
    f"""with {CODES}, c as (select *, case tag when 1 then 'None' when 5 then 'Lzw' when 8 then 'Deflate' when 32946 then 'Deflate' when 6 then 'Jpeg' when 7 then 'Jpeg' when 50000 then 'Zstd' when 33003 then 'Jp2kYcbcr' when 33005 then 'Jp2kYcbcr' when 33004 then 'Jp2kRgb' else 'Other(' || tag || ')' end as compression from codes)
select k, n, tag, compression, case when compression = 'Jpeg' then 'Jpeg' when compression like 'Jp2k%' then 'Jp2k' else 'Other' end as codec from c"""
)
def compression_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.expr("array(1, 5, 8, 32946, 6, 7, 50000, 33003, 33005, 33004, 99)[cast((l_partkey + l_linenumber) % 11 as int)]")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max(tag).alias("tag"))
    return rows.withColumn("compression", vendor.compression(F.col("tag"))).withColumn("codec", vendor.codec_kind(F.col("compression")))


@query("select l_orderkey as series, count(distinct l_returnflag) > 1 as conflict, case when count(distinct l_returnflag) <= 1 then max(l_returnflag) end as value from lineitem group by l_orderkey")
def series_group_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.common_value(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "series"), "series", "l_returnflag")


@query("select o_orderkey as k, case o_orderkey % 5 when 0 then 'Level' when 1 then 'label' when 2 then 'macro' when 3 then 'Ignore' else 'thumbnail' end as role from orders")
def dicom_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("array('ORIGINAL', 'PRIMARY', array('VOLUME', 'LABEL', 'OVERVIEW', 'THUMBNAIL', 'THUMBNAIL')[cast(o_orderkey % 5 as int)], if(o_orderkey % 5 = 4, 'RESAMPLED', 'NONE'))")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), vendor.dicom_role(kind).alias("role"))


SPANS = "spans as (select l_suppkey as file, l_partkey * 1000 as o, 100 + cast(l_quantity as bigint) * 20 as n from lineitem)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as file", "l_partkey * 1000 as offset", "100 + cast(l_quantity as bigint) * 20 as length")


@query(
    f"""with {SPANS}, m as (select *, case when o <= max(o + n) over (partition by file order by o, n rows between unbounded preceding and 1 preceding) + 500 then 0 else 1 end as new from spans),
g as (select *, sum(new) over (partition by file order by o, n rows unbounded preceding) as g from m)
select file, cast(g as bigint) as group_id, min(o) as start, max(o + n) as "end", count(*) as n_spans from g group by file, g"""
)
def read_span_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.read_groups(_spans(spark, sf_dir), ["file"], 500)


@query(
    f"""with recursive {SPANS}, e as (select *, row_number() over (partition by file order by o, n) as i from spans),
f as (select file, i, o as a, o + n as z, 1 as g from e where i = 1
 union all select e.file, e.i, case when e.o <= f.z + 500 and greatest(f.z, e.o + e.n) - f.a <= 20000 then f.a else e.o end, case when e.o <= f.z + 500 and greatest(f.z, e.o + e.n) - f.a <= 20000 then greatest(f.z, e.o + e.n) else e.o + e.n end,
  f.g + case when e.o <= f.z + 500 and greatest(f.z, e.o + e.n) - f.a <= 20000 then 0 else 1 end from f join e on e.file = f.file and e.i = f.i + 1)
select file, cast(g as bigint) as group_id, min(a) as start, max(z) as "end", count(*) as n_spans from f group by file, g"""
)
def read_span_groups_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.read_groups_capped(_spans(spark, sf_dir), ["file"], 500, 20_000)


@query(
    """with r as (select distinct l_orderkey % 200 as k, l_linenumber as scene, l_suppkey % 6 as ratio from lineitem), s as (select k, count(distinct scene) as n from r group by k),
x as (select r.k, ratio from r join s on s.k = r.k group by r.k, ratio, n having count(distinct scene) = n) select k, ratio from x union select k, 1 from s"""
)
def common_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 200 as k", "l_linenumber as scene", "l_suppkey % 6 as ratio")
    return vendor.common_ratios(rows, "k", "scene", "ratio")


@query("select s_suppkey as k, cast(round((s_acctbal - min(s_acctbal) over (partition by s_nationkey)) / 0.25) as bigint) as px, cast(round((s_suppkey * 1.5::double - min(s_suppkey * 1.5::double) over (partition by s_nationkey)) / 0.25) as bigint) as py from supplier")
def mosaic_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_nationkey", "s_acctbal as sx", "s_suppkey * 1.5D as sy")
    return vendor.mosaic_offsets(planes, ["s_nationkey"], 0.25).select("k", "px", "py")


STEPS = "pos as (select c_nationkey as k, cast(floor(c_acctbal) as bigint) as p from customer)"


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_list(F.floor("c_acctbal")).alias("ps"))


@query(
    f"""with {STEPS}, d as (select k, p - lag(p) over (partition by k order by p) as d from pos), s as (select k, d, row_number() over (partition by k order by d) - 1 as i, count(*) over (partition by k) as n from d where d > 20)
select k, d as step from s where i = n // 2"""
)
def median_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("k", vendor.median_step(F.col("ps"), 20).alias("step")).filter("step is not null")


@query(
    f"""with recursive {STEPS}, walk as (select k, min(p) as p from pos group by k union all select w.k, (select min(x.p) from pos x where x.k = w.k and x.p > w.p + 200) as p from walk w where w.p is not null)
select k, p as position from walk where p is not null"""
)
def dedup_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("k", F.explode(vendor.dedup_positions(F.col("ps"), 200)).alias("position"))


@query(f"with {STEPS}, s as (select k, p, row_number() over (partition by k order by p) - 1 as i from pos) select k, cast(arg_min(i, abs(p - 2500) * 100000 + i) as int) as nearest from s group by k")
def nearest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("k", vendor.nearest_index(F.array_sort("ps"), F.lit(2500)).alias("nearest"))


@query("select s_suppkey as k, case when s_suppkey // 10 % 2 = 0 then s_suppkey % 10 else 9 - s_suppkey % 10 end as col, cast(s_suppkey // 10 as bigint) as \"row\" from supplier")
def serpentine_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, row = vendor.serpentine(F.col("s_suppkey") + 1, F.lit(10))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), col.alias("col"), row.alias("row"))


@query(
    """with n as (select s_suppkey as k, case when s_nationkey % 3 = 0 then 'macro' when s_nationkey % 3 = 1 then 'label' else 'thumb' end as name from supplier),
r as (select *, row_number() over (partition by k % 10, name order by k) - 1 as i from n) select k, case when i = 0 then name else name || '-' || i end as unique_name from r"""
)
def unique_associated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_suppkey % 10 as slide", "case s_nationkey % 3 when 0 then 'macro' when 1 then 'label' else 'thumb' end as name")
    return vendor.unique_names(rows, "slide", "name", "k").select("k", "unique_name")


@query(
    """select conv_id as k, sum(octet_length(encode(coalesce(text, '')))) as bytes, case when sum(octet_length(encode(coalesce(text, '')))) <= 5242880 then sha256(string_agg(coalesce(text, ''), '' order by turn, text)) end as quickhash,
  case when sum(octet_length(encode(coalesce(text, '')))) <= 5242880 then substr(sha256(string_agg(coalesce(text, ''), '' order by turn, text)), 1, 32) end as dataset_id from conversations group by conv_id"""
)
def quickhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identity.quickhash(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), ["conv_id"], "turn", "text")
    return out.select(F.col("conv_id").alias("k"), "bytes", "quickhash", identity.dataset_id(F.col("quickhash")).alias("dataset_id"))


SQL["quickhash"] = SQL["quickhash"].replace("select conv_id as k, sum(octet_length(encode(coalesce(text, ''))))", "select conv_id as k, cast(sum(octet_length(encode(coalesce(text, '')))) as bigint)")


def _le(n: str) -> str:
    return " || ".join(f"printf('%02X', (({n}) >> {8 * i}) & 255)" for i in range(8))


@query(
    f"""with d as (select doc_id as k, hex(encode(coalesce(text, ''))) as t, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
o as (select distinct k, t, n, unnest([0, n // 4, n // 2, n // 4 * 3, greatest(n - 65536, 0)]) as o from d)
select k, sha256(unhex(any_value({_le("n")}) || string_agg({_le("o")} || substr(t, 2 * o + 1, 131072), '' order by o))) as fingerprint from o group by k"""
)
def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), identity.fingerprint(F.coalesce("text", F.lit("")).cast("binary")).alias("fingerprint"))
