import struct

import pytest

from lamella.operators import tiff_layout
from lamella.sources import probe, tiff


def make_tiff(ifds, order="<", big=False):
    """ifds: lists of (tag, type, values or bytes)."""
    sizes = {2: 1, 3: 2, 4: 4, 5: 8, 12: 8, 16: 8}
    codes = {3: "H", 4: "I", 12: "d", 16: "Q"}
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for entries in ifds:
        tail, rows = bytearray(), []
        at = len(out)
        head = (8 if big else 2) + len(entries) * (20 if big else 12) + (8 if big else 4)
        for tag, kind, values in entries:
            if kind == 2:
                raw, count = values.encode() + b"\0", len(values) + 1
            elif kind == 5:
                raw, count = b"".join(struct.pack(order + "II", *v) for v in values), len(values)
            else:
                raw, count = struct.pack(order + codes[kind] * len(values), *values), len(values)
            assert len(raw) == sizes[kind] * count
            inline = 8 if big else 4
            if len(raw) <= inline:
                field = raw.ljust(inline, b"\0")
            else:
                field = struct.pack(order + ("Q" if big else "I"), at + head + len(tail))
                tail += raw
            rows.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, count) + field)
        struct.pack_into(order + ("Q" if big else "I"), out, link, at)
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(rows)
        link = len(out)
        out += struct.pack(order + ("Q" if big else "I"), 0) + tail
    return bytes(out)


def image(w, h, tile=None, text=None, software=None, more=()):
    out = [(256, 4, [w]), (257, 4, [h]), (259, 3, [7])]
    if text:
        out.append((270, 2, text))
    out += [(282, 5, [(40000, 1)]), (296, 3, [3])]
    if software:
        out.append((305, 2, software))
    if tile:
        out += [(322, 3, [tile]), (323, 3, [tile])]
    return out + list(more)


APERIO = [image(5000, 3000, 256, "Aperio Image|AppMag = 40|MPP = 0.25"), image(300, 200, None, "thumb"), image(1250, 750, 256, "Aperio Image"), image(100, 80, None, "a label"), image(90, 80, None, "a macro")]


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("/s/a.svs", make_tiff(APERIO)), ("/s/b.tif", make_tiff([image(1000, 700, 128), image(500, 350, 128)], ">", True)), ("/s/p.tiff", make_tiff([image(4096, 4096, 512, "<DataObject>", "Philips DP"), image(2560, 2560, 512, "x", "Philips DP")])),
        ("/s/broken.tif", b"II*\0\xff\xff\0\0"), ("/s/bad.ndpi", b"nothing"), ("/s/x.czi", b"ZISRAWFILE" + b"\0" * 20), ("/s/d.dcm", b"\0" * 128 + b"DICM"), ("/s/none.txt", b"hello"), ("/s/c.svcache", b"SVCACHE1..."), ("/s/j.j2k", b"\xff\x4f\xff\x51"),
    ]
    return spark.createDataFrame(rows, "path string, content binary").cache()


def test_tags(files):
    got = {(r["path"], r["ifd_index"], r["tag"]): r for r in tiff.tags_of(files).filter("error is null").collect()}
    assert got["/s/a.svs", 0, 256]["ints"] == [5000] and got["/s/a.svs", 0, 270]["text"].startswith("Aperio") and got["/s/a.svs", 0, 282]["floats"] == [40000.0]
    assert got["/s/b.tif", 1, 257]["ints"] == [350] and ("/s/a.svs", 4, 256) in got
    errors = {r["path"]: r["error"] for r in tiff.tags_of(files).filter("error is not null").collect()}
    assert "/s/broken.tif" in errors and errors["/s/none.txt"] == "no byte order" and "/s/a.svs" not in errors


def test_loops_are_errors(spark):
    data = bytearray(make_tiff([image(10, 10, 16)]))
    n = struct.unpack_from("<H", data, 8)[0]
    struct.pack_into("<I", data, 10 + 12 * n, 8)
    row = tiff.tags_of(spark.createDataFrame([("/l.tif", bytes(data))], "path string, content binary")).collect()
    assert [r["error"] for r in row[:-1]] == [None] * 7 and "twice" in row[-1]["error"]  # what came before the loop is kept


def test_layout(files):
    ifds = tiff_layout.images(tiff.tags_of(files))
    vendors = tiff_layout.vendors(ifds)
    assert {r["path"]: r["vendor"] for r in vendors.collect()} == {"/s/a.svs": "aperio", "/s/b.tif": "generic-tiff", "/s/p.tiff": "philips"}
    levels = {(r["path"], r["level"]): r for r in tiff_layout.levels(ifds, vendors).collect()}
    a1 = levels["/s/a.svs", 1]
    assert (a1["width"], a1["tiles_across"], a1["tiles_down"], a1["downsample"], a1["codec"]) == (1250, 5, 3, 4.0, "Jpeg")
    p1 = levels["/s/p.tiff", 1]
    assert (p1["width"], p1["tiles_across"], p1["downsample"]) == (2048, 5, 2.0)  # the grid is that of the padded image
    names = {(r["path"], r["name"]) for r in tiff_layout.associated(ifds, vendors).collect()}
    assert names == {("/s/a.svs", "thumbnail"), ("/s/a.svs", "label"), ("/s/a.svs", "macro")}
    props = {(r["path"], r["key"]): r["value"] for r in tiff_layout.slide_properties(ifds, vendors).collect()}
    assert props["/s/a.svs", "aperio.AppMag"] == "40" and props["/s/a.svs", "mpp-x"] == "0.25" and props["/s/b.tif", "mpp-x"] == "0.250000"


def test_collections_of_scenes(spark):
    xml = """<scn xmlns="http://x"><collection sizeX="100" sizeY="100"><image name="m"><pixels><dimension ifd="0" sizeX="40" sizeY="40"/></pixels><view sizeX="100" sizeY="100" offsetX="0" offsetY="0"/></image>
<image name="a"><pixels><dimension ifd="1" sizeX="64" sizeY="32" r="0"/><dimension ifd="2" sizeX="32" sizeY="16" r="1"/></pixels><view sizeX="30" sizeY="30" offsetX="5"/></image>
<image name="b"><pixels><dimension ifd="3" sizeX="48" sizeY="48" r="0" c="0"/><dimension ifd="4" sizeX="48" sizeY="48" r="0" c="1"/></pixels><view sizeX="20" sizeY="20" offsetX="50"/></image></collection></scn>"""
    data = make_tiff([image(40, 40, 16, xml), image(64, 32, 16), image(32, 16, 16), image(48, 48, 16), image(48, 48, 16)])
    ifds = tiff_layout.images(tiff.tags_of(spark.createDataFrame([("l", data)], "path string, content binary")))
    vendors = tiff_layout.vendors(ifds)
    scenes = {(r["scene"], r["level"], r["c"]): (r["width"], r["tiles_across"], r["downsample"]) for r in tiff_layout.scene_levels(ifds, vendors).collect()}
    assert scenes == {(0, 0, 0): (64, 4, 1.0), (0, 1, 0): (32, 2, 2.0), (1, 0, 0): (48, 3, 1.0), (1, 0, 1): (48, 3, 1.0)}
    assert [(r["level"], r["width"]) for r in tiff_layout.levels(ifds, vendors).orderBy("level").collect()] == [(0, 64), (1, 32)]


def test_probe(files):
    got = {r["path"]: (r["vendor"], r["error"]) for r in probe.detect(files).collect()}
    assert got["/s/a.svs"] == ("tiff", None) and got["/s/x.czi"][0] == "czi" and got["/s/d.dcm"][0] == "dicom" and got["/s/c.svcache"][0] == "svcache" and got["/s/j.j2k"][0] == "raw_jp2k"
    assert got["/s/none.txt"] == (None, None) and got["/s/bad.ndpi"] == (None, "malformed .ndpi")


def test_open_slides(spark, tmp_path):
    (tmp_path / "a.svs").write_bytes(make_tiff(APERIO))
    (tmp_path / "b.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["vendor"], r["error"]) for r in probe.open_slides(spark, str(tmp_path)).collect()}
    assert got == {"a.svs": ("tiff", None), "b.txt": (None, "UnsupportedFormat")}


def test_companions(spark):
    rows = spark.createDataFrame([("a/b.dat", True), ("/etc/x", False), ("../x", False), ("a/../../x", False), ("C:\\x", False), ("a..b", True), ("", False)], "n string, ok boolean")
    assert rows.filter(probe.confined(rows["n"]) != rows["ok"]).count() == 0
