"""TIFF files out of images: tiled or stripped, classic or Big, either byte order, with the codecs that can be written here."""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

from lamella.functions import codecs, jpeg

SHORT, LONG, RATIONAL, ASCII, UNDEFINED, LONG8 = 3, 4, 5, 2, 7, 16
_CODES = {SHORT: "H", LONG: "I", LONG8: "Q"}


@functools.lru_cache(1024)
def _jpeg(raw: bytes, shape: tuple[int, ...]) -> bytes:
    """Tiles of one colour come again and again, and a JPEG stream costs a millisecond."""
    return jpeg.encode(np.frombuffer(raw, np.uint8).reshape(shape))


def packed(data: np.ndarray, compression: int, predictor: int = 1, order: str = "<") -> bytes:
    """data: rows, columns, samples, of 8 or 16 bits."""
    if compression == 7:
        return _jpeg(data.tobytes(), data.shape)
    if predictor == 2:
        data = np.concatenate([data[:, :1], data[:, 1:] - data[:, :-1]], axis=1)
    raw = data.astype(data.dtype.newbyteorder(order)).tobytes()
    if compression == 5:
        return codecs.lzw_encode_bytes(raw)
    if compression == 8:
        return zlib.compress(raw)
    if compression == 50000:
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(raw)
    return raw


def image(data: np.ndarray, tile: int | None = None, compression: int = 1, predictor: int = 1, rows_per_strip: int | None = None, planar: int = 1, photometric: int | None = None, texts: dict[int, str] | None = None, order: str = "<", empty: tuple[int, ...] = ()) -> dict:
    """One directory: its tags and its payloads. empty: tiles that are left out."""
    h, w, n = data.shape
    tags = {256: (LONG, [w]), 257: (LONG, [h]), 258: (SHORT, [8 * data.itemsize] * n), 259: (SHORT, [compression]), 262: (SHORT, [photometric if photometric is not None else 2 if n >= 3 else 1]), 277: (SHORT, [n]), 284: (SHORT, [planar])}
    if predictor != 1:
        tags[317] = (SHORT, [predictor])
    for tag, text in (texts or {}).items():
        tags[tag] = (ASCII, text)
    payloads = []
    if tile:
        tags |= {322: (SHORT, [tile]), 323: (SHORT, [tile])}
        whole = np.pad(data, ((0, -h % tile), (0, -w % tile), (0, 0)), mode="edge" if compression == 7 else "constant")
        for y in range(0, len(whole), tile):
            for x in range(0, whole.shape[1], tile):
                payloads.append(b"" if len(payloads) in empty else packed(whole[y : y + tile, x : x + tile], compression, predictor, order))
    else:
        step = rows_per_strip or h
        tags[278] = (LONG, [step])
        planes = [data[:, :, k : k + 1] for k in range(n)] if planar == 2 else [data]
        payloads = [packed(p[y : y + step], compression, predictor, order) for p in planes for y in range(0, h, step)]
    return {"tags": tags, "payloads": payloads, "places": (324, 325) if tile else (273, 279)}


def tiff(images: list[dict], order: str = "<", big: bool = False) -> bytes:
    """A file of these directories, payloads first."""
    word, inline = ("Q", 8) if big else ("I", 4)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for im in images:
        offsets = []
        for p in im["payloads"]:
            offsets.append(len(out))
            out += p + b"\0" * (len(p) % 2)
        kind = LONG8 if big else LONG
        tags = im["tags"] | {im["places"][0]: (kind, offsets), im["places"][1]: (kind, [len(p) for p in im["payloads"]])}
        rows = []
        for tag in sorted(tags):
            kind, values = tags[tag]
            if kind == ASCII:
                raw, count = values.encode() + b"\0", len(values.encode()) + 1
            elif kind == UNDEFINED:
                raw, count = values, len(values)
            elif kind == RATIONAL:
                raw, count = b"".join(struct.pack(order + "II", *v) for v in values), len(values)
            else:
                raw, count = struct.pack(order + _CODES[kind] * len(values), *values), len(values)
            if len(raw) > inline:
                out += b"\0" * (len(out) % 2)
                place, raw = len(out), raw
                out += raw
                raw = struct.pack(order + word, place)
            rows.append(struct.pack(order + "HH" + word, tag, kind, count) + raw.ljust(inline, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(rows)) + b"".join(rows)
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)
