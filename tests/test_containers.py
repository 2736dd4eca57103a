"""Malformed containers, tools, registries, and reads that no query covers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import jp2k, jpeg
from lamella.operators import reading
from lamella.plans import container_queries as made
from lamella.sources import cache, czi, dicom, ets, mirax, registry, tiff_write, zvi
from lamella.tools import build_cache


def files(spark, **contents):
    return spark.createDataFrame([(k, v) for k, v in contents.items()], "path string, content binary")


def test_malformed_containers_are_errors_of_their_own(spark):
    whole = {"d": made.dicom_file(5), "e": made.ets_file(5), "c": made.czi_file(5), "m": made.mirax_index(5)}
    readers = {"d": dicom.instances, "e": ets.tiles, "c": czi.subblocks, "m": lambda f: mirax.records(f, 3, 3)}
    for name, read in readers.items():
        raw = whole[name]
        rows = read(files(spark, good=raw, none=b"", cut=raw[: len(raw) // 3], other=b"x" * 500)).collect()
        errors = {r["path"] for r in rows if r["error"]}
        assert errors >= {"none", "other"} and "good" not in errors and any(r["path"] == "good" for r in rows), name
    rows = cache.opened(files(spark, a=b"SVCACHE1" + struct.pack("<Q", 1 << 40), b=b"SVCACHE1" + struct.pack("<Q", 2) + b"{}", c=b"SVC", d=b"SVCACHE1" + struct.pack("<Q", 5) + b"{")).collect()
    assert {r["path"]: r["error"] for r in rows} == {"a": "metadata is too large", "b": "Metadata", "c": "no cache file", "d": "cut off at 16"}


def test_pages_that_link_back_are_an_error(spark):
    raw = bytearray(mirax.written("ID0", [[(0, 0, 1, 0)]], []))
    page = len(mirax.VERSION) + 3 + 8
    struct.pack_into("<i", raw, page + 4, page)
    rows = mirax.records(files(spark, a=bytes(raw)), 3, 1).collect()
    assert [r["error"] is None for r in rows] == [True, False] and "twice" in rows[1]["error"]


def test_mirax_positions():
    raw = struct.pack("<Bii", 1, 10, -3) + struct.pack("<Bii", 0, 7, 8)
    assert mirax.positions_of(raw, 2) == [(20, -6), (14, 16)]
    for bad in (raw[:-1], b"\x02" + raw[1:]):
        with pytest.raises(ValueError):
            mirax.positions_of(bad, 1)
    assert mirax.nominal_positions(2, 2, 100, 50, 10, 5, 2) == [(0, 0), (190, 0), (0, 95), (190, 95)]


def test_tiles_inside_placed_images(spark):
    y, x = np.mgrid[0:32, 0:48]
    image = np.stack([x // 8 * 20, y // 8 * 30, x * 0 + 9], axis=2).astype(np.uint8)
    stream = jpeg.encode(image)
    placed = spark.createDataFrame([("s", 0, 0, 0, 0, 0, 24, 32, "f", 3, len(stream)), ("s", 0, 1, 0, 24, 0, 24, 32, "f", 3, len(stream)), ("s", 0, 2, 0, 0, 0, 8, 8, "f", 3, 4)], "path string, level int, col long, row long, src_x long, src_y long, tile_w long, tile_h long, file_path string, offset long, length long")
    asked = spark.createDataFrame([(i, "s", 0, i, 0) for i in range(4)], "slot int, path string, level int, col long, row long")
    out = {r["slot"]: r for r in reading.read_placed(asked, placed, files(spark, f=b"abc" + stream)).collect()}
    assert (np.frombuffer(out[1]["data"], np.uint8).reshape(32, 24, 3).astype(int) - image[:, 24:]).max() <= 1
    assert out[2]["error"] and out[3]["error"] == "TileNotStored" and out[0]["error"] is None


def test_buffers(spark):
    rows = spark.createDataFrame([(bytes([7, 200]), 2, 1, 1), (bytes([1, 2, 3, 4, 5, 6]), 2, 1, 3), (bytes([1, 2, 3, 4]), 1, 1, 4), (None, 1, 1, 3)], "data binary, w int, h int, n int")
    out = rows.select(reading.to_rgba("data", "n").alias("a"), reading.to_rgba(F.col("data"), F.col("n"), False).alias("b"), reading.fitted(F.col("data"), F.col("w"), F.col("h"), F.col("n"), F.lit(1), F.lit(1)).alias("c"), reading.fitted(F.col("data"), F.col("w"), F.col("h"), F.col("n"), F.lit(2), F.lit(2)).alias("d"), reading.zeros(F.col("w"), F.col("h"), F.col("n"), F.lit("Uint16")).alias("z")).collect()
    assert [r["a"] and list(r["a"]) for r in out] == [[7, 7, 7, 255, 200, 200, 200, 255], [1, 2, 3, 255, 4, 5, 6, 255], [1, 2, 3, 4], None]
    assert list(out[1]["b"]) == [1, 2, 3, 4, 5, 6] and list(out[0]["c"]) == [7] and all(r["d"] is None for r in out) and len(out[1]["z"]) == 12


def test_registry_order_options_and_a_reader_of_ones_own(spark):
    said = lambda word: (lambda path, head: F.contains(head, F.lit(word).cast("binary")))
    mine = registry.Registry.native().register(registry.Backend("likely", said(b"x"), None, "Likely")).register(registry.Backend("mine", said(b"x"), lambda f, o: {"rows": f.withColumn("cache", F.lit(o.cache))}))
    found = mine.open(files(spark, a=b"a x", b=b"SVCACHE1", c=b"ZISRAWFILE x"), registry.Options(cache="PreferFresh"))
    got = {r["path"]: (r["vendor"], r["error"]) for r in found[""]["detected"].collect()}
    assert got == {"a": ("mine", None), "b": (None, "UnsupportedFormat"), "c": ("czi", None)}
    assert [(r["path"], r["cache"]) for r in found["mine"]["rows"].collect()] == [("a", "PreferFresh")]
    plain = registry.Options()
    assert (plain.cache, plain.output, plain.tile_budget(), plain.tile_budget(5), registry.Options(shared_tile_bytes=0).tile_budget(5), plain.display_budget()) == ("Off", "Cpu", 64 << 20, 5, 0, 32 << 20)


def test_caches_are_built_stored_and_read(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, size=(50, 70, 3)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in/a.svs").write_bytes(tiff_write.tiff([tiff_write.image(image, 16, 8, 2, texts={270: "Aperio"}), tiff_write.image(image[:25, :35], 16, texts={270: "Aperio"})]))
    build_cache.main([f"{tmp_path}/in", f"{tmp_path}/out"])
    opened = registry.open_slides(spark, f"{tmp_path}/out")["svcache"]
    assert {(r["level"], r["width"], r["error"]) for r in opened["levels"].collect()} == {(0, 70, None), (1, 35, None)}
    assert opened["metadata"].first()["m"]["complete"] and opened["tiles"].count() == 20 + 6
    asked = opened["tiles"].select("path", "scene", "series", "level", "col", "row").withColumn("slot", F.lit(1))
    for r in cache.read_tiles(asked, opened["tiles"]).collect():
        whole = image if r["level"] == 0 else image[:25, :35]
        part = whole[r["row"] * 16 : r["row"] * 16 + 16, r["col"] * 16 : r["col"] * 16 + 16]
        assert r["error"] is None and r["data"] == part.tobytes()
    some = {r["path"]: r["content"] for r in build_cache.build(spark, f"{tmp_path}/in", (0, 20, 20)).collect()}
    raw = bytearray(some["a.svs.svcache"])
    found = cache.entries(cache.levels(cache.opened(files(spark, **{"a.svs.svcache": bytes(raw)}))))
    assert {(r["col"], r["row"]) for r in found.collect()} == {(c, r) for c in (1, 2) for r in (0, 1, 2)}
    raw[-3] ^= 1  # the last payload
    broken = files(spark, **{"a.svs.svcache": bytes(raw)})
    got = cache.read_tiles(found.select("path", "scene", "series", "level", "col", "row").withColumn("slot", F.lit(1)), found, broken).collect()
    assert sum(r["error"] is not None for r in got) == 1


def test_variants_and_streams():
    assert zvi.variant(struct.pack("<Hh", 2, -5), 0) == ("-5", 4) and zvi.variant(struct.pack("<HQ", 21, 0), 0)[1] == 10
    assert zvi.variant(struct.pack("<H", 77) + b"ab" + struct.pack("<H", 3), 0) == ("", 4)
    with pytest.raises(ValueError):
        zvi.variant(struct.pack("<HI", 8, 100), 0)
    for bad in (b"", b"\xff\x4f", made.codestream(5)[:30]):
        with pytest.raises((ValueError, struct.error)):
            jp2k.header_of(bad)
