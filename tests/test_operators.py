"""Operators on small hand-made rows: degenerate grids, negative regions, ties, codecs, caches, streams."""

import random

import pytest
from pyspark.sql import functions as F

from lamella.functions import codecs
from lamella.operators import cache_replay, grid, identity, pixels, pyramid, requests, store, vendor
from lamella.streaming import pan

LEVEL = "x long, y long, w long, h long, tile_w long, tile_h long, tiles_across long, tiles_down long"


def hits(spark, *region, grid_=(256, 256, 2, 2)):
    df = spark.createDataFrame([(*region, *grid_)], LEVEL)
    return [(r["col"], r["row"], r["dest_x"], r["dest_y"]) for r in grid.regular_hits(df).orderBy("ordinal").collect()]


def test_regular_hits(spark):
    assert hits(spark, 100, 100, 300, 300) == [(0, 0, -100, -100), (1, 0, 156, -100), (0, 1, -100, 156), (1, 1, 156, 156)]
    assert hits(spark, -50, -50, 100, 100) == [(0, 0, 50, 50)]
    assert hits(spark, 300, 0, 1000, 10) == [(1, 0, -44, 0)]
    assert hits(spark, 512, 0, 10, 10) == [] and hits(spark, -100, 0, 100, 10) == []
    assert hits(spark, 0, 0, 10, 10, grid_=(256, 256, 0, 0)) == []


def test_hit_count_is_the_area_formula(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-600, 900), rng.randrange(-600, 900), rng.randrange(1, 700), rng.randrange(1, 700), 64, 32, 9, 11) for _ in range(200)]
    df = spark.createDataFrame(rows, LEVEL).withColumn("k", F.monotonically_increasing_id())
    got = {r["k"]: r["count"] for r in grid.regular_hits(df).groupBy("k").count().collect()}
    for r in df.collect():
        across = max(0, min(9, -(-(r["x"] + r["w"]) // 64)) - max(0, min(9, r["x"] // 64)))
        down = max(0, min(11, -(-(r["y"] + r["h"]) // 32)) - max(0, min(11, r["y"] // 32)))
        assert got.get(r["k"], 0) == across * down


def test_irregular_hits(spark):
    ask = spark.createDataFrame([(0, 10, 10, 100, 100, 100.0, 100.0, 1, 1, 1, 1)], "level int, x long, y long, w long, h long, adv_x double, adv_y double, extra_left int, extra_right int, extra_top int, extra_bottom int")
    tiles = spark.createDataFrame([(0, c, r, 5.0 if c == 2 else 0.0, -95.0 if r == 2 else 0.0, 100, 100) for c in range(3) for r in range(3)], "level int, col long, row long, off_x double, off_y double, tile_w long, tile_h long")
    got = {(r["col"], r["row"]) for r in grid.irregular_hits(ask, tiles, ["level"]).collect()}
    assert got == {(0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (1, 2)}


def test_validation_order(spark):
    row = (5, 9, 9, 9, 9, 9, 1 << 20, 1 << 20, 1, 1, 1, 1, 1, 1)
    names = "scene long, series long, level long, z long, c long, t long, w long, h long, n_scenes int, n_series int, n_levels int, n_z int, n_c int, n_t int"
    one = lambda r: requests.validate_region(spark.createDataFrame([r], names)).first()["error"]
    assert one(row) == "RegionTooLarge"
    small = (5, 9, 9, 9, 9, 9, 10, 10, 1, 1, 1, 1, 1, 1)
    for i, code in enumerate(("SceneOutOfRange", "SeriesOutOfRange", "LevelOutOfRange", "ZOutOfRange", "COutOfRange", "TOutOfRange")):
        assert one((*[0] * i, *small[i:])) == code
    assert one((*[0] * 6, *small[6:])) is None


def test_two_pass_downsample_is_not_one_average(spark):
    df = spark.createDataFrame([(1, x, y, v) for (x, y), v in {(0, 0): 1, (1, 0): 0, (0, 1): 0, (1, 1): 2, (2, 0): 3, (2, 1): 0}.items()], "k int, x int, y int, v int")
    assert {(r["x"], r["y"]): r["v"] for r in pixels.box_downsample(df, ["k"]).collect()} == {(0, 0): 0, (1, 0): 1}
    assert pixels.box_downsample_pow2(df, ["k"], 4).first()["v"] == 0


def test_best_level_ties_and_infinities(spark):
    levels = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 4.0)], "dataset_id int, level int, downsample double")
    asked = spark.createDataFrame([(1, 1.5), (1, 3.0), (1, 99.0), (1, float("inf")), (1, -5.0)], "dataset_id int, wanted double")
    got = {r["wanted"]: r["best_level"] for r in pyramid.best_level(asked, levels).collect()}
    assert got == {1.5: 0, 3.0: 1, 99.0: 2, float("inf"): -1, -5.0: 0}


def test_windows_need_sense():
    for low, high in ((1, 1), (2, 1), (0, float("inf")), (float("nan"), 1)):
        with pytest.raises(ValueError):
            pixels.windowed(F.lit(1), low, high)


def test_store(spark):
    old = spark.createDataFrame([(0, 0, 0, "a")], "col int, row int, z int, src string")
    new = spark.createDataFrame([(0, 0, 0, "b"), (1, 0, 1, "d"), (1, 0, 0, "c")], old.schema)
    assert {(r["col"], r["src"]) for r in store.merge(old, new, ["col", "row"]).collect()} == {(0, "a"), (1, "c")}
    assert {(r["col"], r["src"]) for r in store.replace(new, ["col", "row"]).collect()} == {(0, "b"), (1, "c")}
    read = store.read_slots(old.withColumn("slot", F.lit(1)).drop("src"), spark.createDataFrame([(0, 0, "x")], "col int, row int, data string"), ["col", "row"]).first()
    assert read["data"] == "x" and read["error"] is None


def test_store_files(spark, tmp_path):
    tiles = spark.createDataFrame([(1, l, r, c, "d") for l in range(2) for r in range(3) for c in range(3)], "dataset_id int, level int, row int, col int, data string")
    store.write(tiles, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, back.select(tiles.columns).collect())) == sorted(map(tuple, tiles.collect()))


def test_codecs_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 127, 128, 129, 130, 1000, 20_000):
        for alphabet in (b"a", b"ab", bytes(range(256))):
            raw = bytes(rng.choices(alphabet, k=n))
            assert codecs.packbits_decode_bytes(codecs.packbits_encode_bytes(raw), n) == raw
            assert codecs.lzw_decode_bytes(codecs.lzw_encode_bytes(raw)) == raw
    assert codecs.packbits_decode_bytes(b"\x05ab") is None and codecs.packbits_decode_bytes(b"\x80\x00x") == b"x"
    assert codecs.lzw_decode_bytes(b"\xff\xff") is None
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x0c\x00\x10\x01\x01\x11\x00\xff\xd9"
    assert codecs.jpeg_dimensions_of(jpeg) == (16, 12) and codecs.jpeg_dimensions_of(b"\xff\xd8\xff\xd9") is None


def test_lru(spark):
    cache = cache_replay.ByteLru(10)
    assert cache.put("a", 4) == 0 and cache.put("b", 4) == 0 and cache.get("a")
    assert cache.put("c", 4) == 1 and not cache.get("b") and cache.get("a") and cache.put("huge", 11) == 0 and cache.held == 8
    rows = [(1, 1, 1, "a", 4), (1, 2, 2, "b", 4), (1, 3, 3, "a", 4), (1, 4, 4, "c", 4), (1, 5, 5, "b", 4), (2, 1, 6, "b", 4)]
    out = cache_replay.replay(spark.createDataFrame(rows, "reader long, ts long, seq long, key string, bytes long"), 10).orderBy("seq").collect()
    assert [r["hit"] for r in out] == [False, False, True, False, False, False] and [r["evicted"] for r in out] == [0, 0, 0, 1, 1, 0]


def test_span_groups(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 12, 5), (1, 40, 5), (1, 41, 1), (1, 60, 5)], "file int, offset long, length long")
    assert sorted((r["start"], r["end"], r["n_spans"]) for r in vendor.read_groups(df, ["file"], 3).collect()) == [(0, 17, 2), (40, 45, 2), (60, 65, 1)]
    assert sorted((r["start"], r["end"], r["n_spans"]) for r in vendor.read_groups_capped(df, ["file"], 50, 46).collect()) == [(0, 45, 4), (60, 65, 1)]


def test_quickhash_limit(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (2, 0, None)], "k int, n int, d string")
    import hashlib

    got = {r["k"]: r["quickhash"] for r in identity.quickhash(df, ["k"], "n", "d").collect()}
    assert got[1] == hashlib.sha256(b"ba").hexdigest()


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", i % 4, float(i % 5), "view") for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = pan.requests(pan.read(spark, str(tmp_path / "in"), events.schema))
    for name, df, mode in (("hours", pan.hourly(stream), "complete"), ("caches", pan.cached(stream, 3000 * 16), "update")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    batch = pan.hourly(pan.requests(events))
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch.collect()))
    last = {r["reader"]: r for r in spark.table("caches").collect()}
    assert sum(r["hits"] + r["misses"] for r in last.values()) == 60
