"""What only larger tables show: large keys, joins that must not gather on the driver, work that must spread."""

import numpy as np
from pyspark.sql import functions as F

from lamella.functions import codecs
from lamella.operators import dicom, pixels, pyramid, reading
from lamella.plans import container_queries, format_queries, geometry_queries, read_queries, tool_queries
from lamella.sources import tiff


def test_samples_of_keys_past_2_to_23(spark, tmp_path):
    spark.createDataFrame([(8_388_610,), (35_999_998,), (36_000_001,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = geometry_queries.checked_samples(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(8_388_610, -1), (35_999_998, -1), (36_000_001, 36_000_002 * 3072)]


def test_best_level_gathers_neither_side_on_the_driver(spark):
    levels = spark.range(40).selectExpr("id div 4 as dataset_id", "cast(id % 4 as int) as level", "cast(shiftleft(1, cast(id % 4 as int)) as double) as downsample")
    asked = spark.range(10).selectExpr("id as dataset_id", "explode(array(1.4D, 3.1D)) as wanted")
    out = pyramid.best_level(asked, levels)
    assert sorted(map(tuple, out.filter("dataset_id = 3").collect())) == [(3, 1.4, 0), (3, 3.1, 2)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_files_of_keys_spread_over_tasks(spark, tmp_path):
    spark.range(3000).selectExpr("id as s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    files = container_queries.made(spark, str(tmp_path), "x", lambda s: b"%d" % s)
    counts = [r[0] for r in files.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(counts) == 3000 and max(counts) <= 1000
    assert container_queries.made(spark, str(tmp_path), "x", lambda s: b"", "s % 3 = 0").count() == 1000


def test_slides_are_made_once_for_all_branches(spark, tmp_path):
    spark.range(3).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    for df in read_queries._opened(spark, str(tmp_path)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and "MapInArrow" not in plan


def test_small_files_come_back_together(spark):
    from lamella.sources.rows import parsed

    files = spark.range(0, 3000, 1, 1).selectExpr("cast(id as string) as path", "cast(lpad(cast(id as string), 8, '0') as binary) as content")
    rows = parsed(files, lambda source: iter([(source.size,)]), "size long, error string")
    assert rows.count() == 3000 and rows.agg(F.count_if(F.col("error").isNull()), F.max("size")).first()[:] == (3000, 8)
    tags = list(tiff._batches(iter([("p", 1, None, 0, 256, "SHORT", 1, [5], None, None, b"55", False, None)] * 9000)))
    assert [b.num_rows for b in tags] == [4000, 4000, 1000]


def test_a_tile_that_requests_share_is_decoded_once(monkeypatch):
    import pandas as pd

    calls = []
    monkeypatch.setattr(reading, "samples_of", lambda *a: calls.append(a) or np.full((2, 2, 1), a[0][0], np.uint8))
    facts = {n: F.col(n) for n in reading.FACTS}
    seen = {}
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda f: seen.setdefault("f", f) and (lambda *a: None))
    monkeypatch.setattr(F, "struct", lambda *a: None)
    reading.decoded(*[None] * 5, {n: type("C", (), {"alias": lambda self, n: None})() for n in facts})
    rest = pd.DataFrame([(1, 1, 1, 8, 1, 1, False, None)] * 4, columns=list(reading.FACTS))
    two = pd.Series([2] * 4)
    out = seen["f"](pd.Series([b"\x07", b"\x09", b"\x07", None]), two, two, pd.Series([2, 2, 1, 2]), two, rest)
    assert len(calls) == 2 and out["data"].tolist()[:3] == [b"\x07" * 4, b"\x09" * 4, b"\x07" * 2] and out["error"].tolist()[3] == "PayloadOutOfBounds"


def test_regions_of_many_tiles_stream_through_a_task(spark):
    rows = [(k, 4, 2, i, i * 2, 0, 2, 2, 1, bytes([k * 10 + i]) * 4, "bad" if k == 3 and i == 1 else None) for k in range(5) for i in (1, 0)]
    tiles = spark.createDataFrame(rows, "id long, w long, h long, ordinal long, dest_x long, dest_y long, tile_width long, tile_height long, channels int, data binary, error string")
    out = reading.compose(tiles, "id")
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.channels, r.data and bytes(r.data), r.error) for r in out.collect()}
    assert got[3] == (None, None, "bad") and got[2] == (1, bytes([20, 20, 21, 21] * 2), None) and len(got) == 5


def test_a_large_folder_is_several_tasks_work(spark):
    files = spark.range(0, 300, 1, 1).selectExpr("concat('d/f', id) as path", "concat('d', id div 1000) as folder", "if(id % 3 = 0, null, 'u') as series_uid")
    out = dicom.siblings(files, files.filter("path like '%7'").select("path"))
    parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 20 * 200 and len(parts) > 4 and max(parts) < 2000
    assert out.distinct().count() == 4000


def test_pixels_are_composed_without_a_join_of_pixels(spark):
    canvas = spark.createDataFrame([(1, 2, 2), (2, 1, 1)], "id long, w long, h long")
    hits = spark.createDataFrame([(1, 5, 0, 0, 7), (1, 6, 0, 0, 8), (1, 5, 1, 1, 9), (1, 9, 2, 0, 1)], "id long, ordinal long, px long, py long, v int")
    out = pixels.compose(canvas, hits, ["id"])
    assert sorted(map(tuple, out.select("id", "px", "py", "v").collect())) == [(1, 0, 0, 8), (1, 0, 1, 0), (1, 1, 0, 0), (1, 1, 1, 9), (2, 0, 0, 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_texts_spread_over_tasks(spark, tmp_path):
    spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "concat('aaaa', id) as text").write.parquet(f"{tmp_path}/documents.parquet")
    for query, same in ((tool_queries.payload_round_trips, "packbits and lzw and deflate and zstd"), (format_queries.rle_frames, "same")):
        out = query(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() > 1 and out.filter(same).count() == 40
    assert codecs.packbits_encode_bytes(b"ab" + b"c" * 130 + b"dd") == bytes([1, 97, 98, 129, 99, 3]) + b"ccdd"
