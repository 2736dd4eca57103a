"""CZI files as rows: the subblock directory, where pixels lie, attachments; and tiles composed from subblocks.

Segments are found by the positions that the file header gives; of the file's other parts nothing is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import jpeg
from lamella.operators import formats
from lamella.sources.ranges import Ranges
from lamella.sources.rows import exactly, parsed

# Pixel types (name, samples, bytes of a sample), compressions, least room before a subblock's metadata.
PIXELS = {0: ("Gray8", 1, 1), 1: ("Gray16", 1, 2), 3: ("Bgr24", 3, 1), 4: ("Bgr48", 3, 2)}
COMPRESSION = {0: "None", 1: "Jpeg", 2: "Lzw", 4: "JpegXr", 5: "Zstd0", 6: "Zstd1"}
ROOM, SEGMENT = 256, 32
SUBBLOCKS = "idx int, pixel_type string, samples int, compression string, scene long, m int, x long, y long, w long, h long, stored_w long, stored_h long, z int, c int, t int, position long, offset long, length long, error string"
ATTACHMENTS = "name string, kind string, offset long, length long, error string"


def _segment(source: Ranges, at: int, name: bytes) -> int:
    """Where a segment's contents begin."""
    found = exactly(source, at, SEGMENT)[:16].rstrip(b"\0")
    if found != name:
        raise ValueError(f"no {name.decode()} at {at}")
    return at + SEGMENT


def _entry(source: Ranges, at: int) -> tuple[dict, int]:
    """A directory entry and where the next one begins."""
    head = exactly(source, at, 32)
    if head[:2] != b"DV":
        raise ValueError(f"unknown entry at {at}")
    kind, position, _, compression = struct.unpack_from("<iqii", head, 2)
    n = struct.unpack_from("<i", head, 28)[0]
    if not 0 <= n <= 64:
        raise ValueError("dimensions of an unknown number")
    raw = exactly(source, at + 32, 20 * n)
    dims = {}
    for k in range(n):
        name, start, size, _, stored = struct.unpack_from("<4siifi", raw, 20 * k)
        dims[name.rstrip(b"\0").decode()] = (start, size, stored or size)
    return {"kind": kind, "position": position, "compression": compression, "dims": dims}, at + 32 + 20 * n


def _subblocks(source: Ranges) -> Iterator[tuple]:
    start = _segment(source, 0, b"ZISRAWFILE")
    directory = struct.unpack("<q", exactly(source, start + 52, 8))[0]
    at = _segment(source, directory, b"ZISRAWDIRECTORY")
    n = struct.unpack("<i", exactly(source, at, 4))[0]
    at += 128
    for k in range(n):
        e, at = _entry(source, at)
        block = _segment(source, e["position"], b"ZISRAWSUBBLOCK")
        metadata, _, size = struct.unpack("<iiq", exactly(source, block, 16))
        _, end = _entry(source, block + 16)
        d, (name, samples, _) = e["dims"], PIXELS.get(e["kind"], (f"type {e['kind']}", None, None))
        (x, w, sw), (y, h, sh) = d["X"], d["Y"]
        first = lambda c: d[c][0] if c in d else None
        yield k, name, samples, COMPRESSION.get(e["compression"], str(e["compression"])), first("S"), first("M"), x, y, w, h, sw, sh, first("Z") or 0, first("C") or 0, first("T") or 0, e["position"], block + max(ROOM, end - block) + metadata, size


def _attachments(source: Ranges) -> Iterator[tuple]:
    start = _segment(source, 0, b"ZISRAWFILE")
    directory = struct.unpack("<q", exactly(source, start + 72, 8))[0]
    if not directory:
        return
    at = _segment(source, directory, b"ZISRAWATTDIR")
    n = struct.unpack("<i", exactly(source, at, 4))[0]
    for k in range(n):
        raw = exactly(source, at + 256 + 128 * k, 128)
        position = struct.unpack_from("<q", raw, 12)[0]
        body = _segment(source, position, b"ZISRAWATTACH")
        text = lambda a, z: raw[a:z].split(b"\0")[0].decode("utf-8", "replace")
        yield text(48, 128), text(40, 48), body + ROOM, struct.unpack("<i", exactly(source, body, 4))[0]


def subblocks(files: DataFrame) -> DataFrame:
    """A row for each subblock, with its ratio (how much smaller it is stored, if the same on both axes)."""
    rows = parsed(files, _subblocks, SUBBLOCKS)
    return rows.withColumn("ratio", formats.subblock_ratio(F.col("w"), F.col("h"), F.col("stored_w"), F.col("stored_h")))


def attachments(files: DataFrame) -> DataFrame:
    return parsed(files, _attachments, ATTACHMENTS)


def samples_of(payload: bytes, kind: str, compression: str, w: int, h: int) -> np.ndarray:
    """Rows, columns, samples: grey, or RGB."""
    _, n, size = next(v for v in PIXELS.values() if v[0] == kind)
    if compression == "Jpeg":
        return jpeg.decode(payload)[:h, :w]
    if compression == "Zstd0":
        import zstandard

        payload = zstandard.ZstdDecompressor().decompress(payload)
    elif compression != "None":
        raise ValueError(f"compression {compression} is not supported")
    out = np.frombuffer(payload, "<u1" if size == 1 else "<u2")[: w * h * n].reshape(h, w, n)
    return out[:, :, ::-1] if n == 3 else out


def read_tiles(asked: DataFrame, found: DataFrame, tile: int, files: DataFrame | None = None) -> DataFrame:
    """asked: slot, path, ratio, col, row, in tiles of that side of the level whose subblocks have that ratio, counted from the
    slide's corner. Subblocks are drawn in the order of their mosaic index, then of the file; what none covers is zero."""
    from lamella.operators.reading import fetch, gathered

    c = F.col
    corner = found.filter("error is null").groupBy("path").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    own = found.filter("error is null and ratio is not null").join(corner, "path").withColumns({"x": c("x") - c("x0"), "y": c("y") - c("y0")}).drop("error")
    covered = formats.subblock_tiles(own, tile)
    drawn = asked.join(covered, ["path", "ratio", "col", "row"]).withColumn("ordinal", F.row_number().over(_order()))
    got = fetch(drawn, files)

    def whole(blocks: list) -> tuple:
        out = None
        for r in blocks:
            try:
                a = samples_of(bytes(r.payload), r.pixel_type, r.compression, int(r.stored_w), int(r.stored_h))
            except (ValueError, TypeError, StopIteration) as e:
                return r.slot, None, None, str(e) or "unknown pixel type"
            if out is None:
                out = np.zeros((tile, tile, a.shape[2]), dtype=np.uint8)
            x, y = int(r.x // r.ratio - r.col * tile), int(r.y // r.ratio - r.row * tile)
            x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + a.shape[1], tile), min(y + a.shape[0], tile)
            if x0 < x1 and y0 < y1:
                out[y0:y1, x0:x1] = a[y0 - y : y1 - y, x0 - x : x1 - x]
        return blocks[0].slot, out.shape[2], out.tobytes(), None

    kind = asked.schema["slot"].dataType.simpleString()
    rows = got.select("slot", "ordinal", "payload", "pixel_type", "compression", "stored_w", "stored_h", "x", "y", "ratio", "col", "row")
    tiles = gathered(rows, ["slot"], "ordinal", whole, f"slot {kind}, channels int, data binary, error string")
    return asked.join(tiles, "slot", "left")


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("slot").orderBy(F.col("m").asc_nulls_first(), "position")


def written(blocks: list[dict], attached: list[tuple[str, str, bytes]] = ()) -> bytes:
    """A file of these subblocks (kind, compression, dims: name to (start, size, stored), data) and attachments (name, kind, data)."""
    segment = lambda name, body: name.ljust(16, b"\0") + struct.pack("<qq", len(body), len(body)) + body

    def entry(b: dict, position: int) -> bytes:
        dims = b"".join(struct.pack("<4siifi", k.encode(), s, n, float(s), stored) for k, (s, n, stored) in b["dims"].items())
        return b"DV" + struct.pack("<iqii", b["kind"], position, 0, b["compression"]) + b"\0" * 6 + struct.pack("<i", len(b["dims"])) + dims

    out = bytearray(SEGMENT + 512)
    entries = []
    for b in blocks:
        entries.append(entry(b, len(out)))
        head = struct.pack("<iiq", 4, 0, len(b["data"])) + entries[-1]
        out += segment(b"ZISRAWSUBBLOCK", head.ljust(ROOM, b"\0") + b"meta" + b["data"])
    directory = len(out)
    out += segment(b"ZISRAWDIRECTORY", struct.pack("<i", len(entries)).ljust(128, b"\0") + b"".join(entries))
    places = []
    for _, _, data in attached:
        places.append(len(out))
        out += segment(b"ZISRAWATTACH", struct.pack("<i", len(data)).ljust(ROOM, b"\0") + data)
    at = len(out) if attached else 0
    if attached:
        rows = b"".join(b"A1" + b"\0" * 10 + struct.pack("<qi", p, 0) + b"\0" * 16 + kind.encode().ljust(8, b"\0") + name.encode().ljust(80, b"\0") for p, (name, kind, _) in zip(places, attached))
        out += segment(b"ZISRAWATTDIR", struct.pack("<i", len(attached)).ljust(256, b"\0") + rows)
    body = struct.pack("<iiii", 1, 0, 0, 0) + b"\0" * 32 + struct.pack("<iqqi", 0, directory, 0, 0) + struct.pack("<q", at)
    out[: SEGMENT + 512] = segment(b"ZISRAWFILE", body.ljust(512, b"\0"))
    return bytes(out)
