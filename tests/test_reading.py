"""Range reads, JPEG against the JVM's own codec, wrapped offsets, batches with broken tiles, folds."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import fold, jpeg
from lamella.operators import pyramid, reading, tiff_layout
from lamella.sources import ranges, tiff, tiff_write


def levels_of(tags):
    ifds = tiff_layout.images(tags)
    return tiff_layout.levels(ifds, tiff_layout.vendors(ifds))


def picture(h, w, n=3):
    y, x, k = np.mgrid[0:h, 0:w, 0:n]
    return ((x * 3 + y * 2 + k * 40) % 256).astype(np.uint8)


def test_ranges(tmp_path):
    data = bytes(range(256)) * 1000
    path = tmp_path / "f"
    path.write_bytes(data)
    for source in (ranges.Held(data), ranges.opened(str(path)), ranges.opened(f"file://{path}"), ranges.Stored(f"file://{path}")):
        assert source.size == len(data)
        for at, n in ((0, 10), (70_000, 5), (3, 100_000), (len(data) - 3, 10), (len(data) + 5, 4)):
            assert source.read(at, n) == data[at : at + n]


def test_files_are_read_by_position(spark, tmp_path):
    image = picture(50, 70)
    for i, (codec, predictor) in enumerate([(1, 1), (5, 2), (8, 2), (50000, 1)]):
        (tmp_path / f"{i}.svs").write_bytes(tiff_write.tiff([tiff_write.image(image, 32, codec, predictor, texts={270: "Aperio"}, order="<>"[i % 2])], "<>"[i % 2], i > 1))
    tags = tiff.read_tags(spark, str(tmp_path))
    levels = levels_of(tags)
    asked = levels.select("path", "level").withColumn("t", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(r).alias("row")) for c in range(3) for r in range(2)]))).select("path", "level", "t.*")
    out = reading.read_tiles(asked.withColumn("slot", F.monotonically_increasing_id()), levels, tags).collect()
    assert len(out) == 24 and all(r["error"] is None for r in out)
    for r in out:
        part = image[r["row"] * 32 : r["row"] * 32 + 32, r["col"] * 32 : r["col"] * 32 + 32]
        assert (np.frombuffer(r["data"], np.uint8).reshape(r["tile_height"], r["tile_width"], 3) == part).all()


def test_offsets_that_wrapped_are_led_back(spark, tmp_path):
    """A sparse file of more than 4 GiB whose directory, strip offsets and values lie beyond what 32 bits say."""
    path, far = tmp_path / "big.ndpi", (1 << 32) + 1000
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, far % (1 << 32)))
        f.truncate(far + 400)
        f.seek(far - 500)
        f.write(b"Hamamatsu model \0".ljust(100, b"\0"))
        entries = [(256, 4, 1, 8), (257, 4, 1, 4), (271, 2, 17, (far - 500) % (1 << 32)), (273, 4, 1, (far - 300) % (1 << 32)), (279, 4, 1, 96)]
        f.seek(far)
        f.write(struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<Q", 0))
    rows = {r["tag"]: r for r in tiff.read_tags(spark, str(path)).collect()}
    assert rows[273]["ints"] == [far - 300] and rows[256]["ints"] == [8] and rows[271]["text"] == "Hamamatsu model " and rows[256]["ifd_id"] == far
    (tmp_path / "cut.ndpi").write_bytes(struct.pack("<2sHI", b"II", 42, 1 << 20))
    assert "outside" in tiff.read_tags(spark, str(tmp_path / "cut.ndpi")).first()["error"]


def test_a_broken_tile_fails_alone(spark):
    image = picture(40, 40)
    parts = tiff_write.image(image, 16, 8, texts={270: "Aperio"})
    parts["payloads"][4] = b"not deflate"
    jp2k = tiff_write.image(image, 16, 1, texts={270: "Aperio"})
    jp2k["tags"][259] = (3, [33005])
    files = spark.createDataFrame([("a", tiff_write.tiff([parts])), ("j", tiff_write.tiff([jp2k])), ("t", tiff_write.tiff([tiff_write.image(image, 16, 1, texts={270: "Aperio"})])[:1500])], "path string, content binary")
    tags = tiff.tags_of(files.filter("path <> 't'"))
    levels = levels_of(tags)
    asked = spark.createDataFrame([(c + 3 * r, p, 0, c, r) for p in "aj" for c in range(3) for r in range(3)], "slot int, path string, level int, col long, row long")
    out = {(r["path"], r["slot"]): r for r in reading.read_tiles(asked, levels, tags, files).collect()}
    assert {s for (p, s), r in out.items() if p == "a" and r["error"]} == {4} and all("Jp2kYcbcr" in r["error"] for (p, _), r in out.items() if p == "j")
    region = spark.createDataFrame([(1, "a", 0, 0, 0, 15, 15), (2, "a", 0, 0, 0, 20, 20), (3, "a", 7, 0, 0, 5, 5), (4, "a", 0, 0, 0, 1 << 20, 1 << 20)], "request_id int, path string, level int, x long, y long, w long, h long")
    got = {r["request_id"]: r for r in reading.read_regions(region, levels, tags, files).collect()}
    assert got[1]["error"] is None and got[2]["error"] and got[3]["error"] == "LevelOutOfRange" and got[4]["error"] == "RegionTooLarge"
    assert (np.frombuffer(got[1]["data"], np.uint8).reshape(15, 15, 3) == image[:15, :15]).all()


def test_sixteen_bits_and_white_is_zero(spark):
    wide = (np.arange(30 * 20).reshape(20, 30, 1) * 97 % 65536).astype(np.uint16)
    files = spark.createDataFrame([(o, tiff_write.tiff([tiff_write.image(wide, 16, 5, 2, photometric=p, order=o, texts={270: "Aperio"})], o)) for o, p in (("<", 1), (">", 0))], "path string, content binary")
    tags = tiff.tags_of(files)
    asked = files.selectExpr("1 as slot", "path", "0 as level", "0L as col", "0L as row")
    for r in reading.read_tiles(asked, levels_of(tags), tags, files).collect():
        got = np.frombuffer(r["data"], "<u2").reshape(16, 16)
        assert r["sample_type"] == "Uint16" and (got == (wide[:16, :16, 0] if r["path"] == "<" else 65535 - wide[:16, :16, 0])).all()


def _jvm_decode(spark, data):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    rgb = np.array([[image.getRGB(x, y) for x in range(image.getWidth())] for y in range(image.getHeight())])
    return np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=2)


def _jvm_encode(spark, data):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(data.shape[1], data.shape[0], 1)
    for y in range(data.shape[0]):
        for x in range(data.shape[1]):
            r, g, b = map(int, data[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_jpeg_against_the_jvm(spark):
    y, x = np.mgrid[0:26, 0:37]
    smooth = np.stack([x * 5, y * 7, x + y * 3], axis=2).astype(np.uint8)
    ours = jpeg.encode(smooth)
    assert np.abs(_jvm_decode(spark, ours) - smooth).max() <= 2 and np.abs(jpeg.decode(ours).astype(int) - smooth).max() <= 1
    theirs = _jvm_encode(spark, smooth)
    assert np.abs(jpeg.decode(theirs) - _jvm_decode(spark, theirs)).mean() <= 2  # chroma is upsampled in another way
    assert np.abs(_jvm_decode(spark, jpeg.emit(jpeg.coefficients(theirs))) - _jvm_decode(spark, theirs)).max() <= 1


def test_jpeg_streams():
    image = picture(40, 56)
    data = jpeg.encode(image, 2)
    whole = jpeg.coefficients(data)
    assert (jpeg.decode(jpeg.emit(whole)) == jpeg.decode(data)).all()
    assert (jpeg.decode(jpeg.emit(jpeg.cropped(whole, 16, 8, 24, 20))) == jpeg.decode(data)[8:28, 16:40]).all()
    with pytest.raises(jpeg.JpegError):
        jpeg.cropped(whole, 3, 0, 8, 8)
    for scale in (2, 4, 8):
        mean = image[: 40 // scale * scale, : 56 // scale * scale].astype(float).reshape(40 // scale, scale, 56 // scale, scale, 3).mean(axis=(1, 3))
        small = jpeg.decode(data, scale=scale)
        assert small.shape == mean.shape and np.abs(small - mean).mean() < 12
    # tables apart from the stream, as in a TIFF
    parts = list(jpeg.segments(data))
    tables = data[:2] + b"".join(data[at - 4 : at + n] for m, at, n in parts if m in (0xDB, 0xC4)) + b"\xff\xd9"
    bare = data[:2] + b"".join(data[at - 4 : at + n] for m, at, n in parts if m not in (0xDB, 0xC4)) + data[parts[-1][1] + parts[-1][2] :]
    assert (jpeg.decode(bare, tables) == jpeg.decode(data)).all() and (jpeg.decode(jpeg.splice(bare, tables)) == jpeg.decode(data)).all()
    zero = data.replace(struct.pack(">HH", 40, 56), struct.pack(">HH", 0, 0), 1)
    assert jpeg.patched(zero, 56, 40) == data and jpeg.patched(data, 9, 9) == data
    for bad in (b"", b"\xff\xd8", data[:30], b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00"):
        with pytest.raises((jpeg.JpegError, struct.error)):
            jpeg.decode(bad)


def test_equal_requests_are_answered_each(spark):
    asked = spark.createDataFrame([(1, 2.2), (1, 2.2), (1, float("nan"))], "dataset_id int, wanted double")
    levels = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 4.0)], "dataset_id int, level int, downsample double")
    assert sorted(r["best_level"] for r in pyramid.best_level(asked, levels).collect()) == [-1, 1, 1]


def test_folds_stream_through_batches(spark):
    rows = spark.range(25_000).selectExpr("id % 3 as k", "id as o")
    out = fold.folded(rows, ["k"], ["o"], lambda: [0], lambda s, r: s.__setitem__(0, s[0] + r.o) or [], lambda s, k: [(k, s[0])], "k long, total long")
    assert {r["k"]: r["total"] for r in out.collect()} == {k: sum(range(k, 25_000, 3)) for k in range(3)}
    assert fold.folded(rows.limit(0), ["k"], ["o"], list, lambda s, r: [], None, "k long").count() == 0
