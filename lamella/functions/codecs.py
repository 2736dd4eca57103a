"""Codecs over binary columns: PackBits, LZW, Deflate, Zstandard, frame repair, marker scans. Arrow batches in, bytes out."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: A run that is worth two bytes, as far as one can say it.
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode_bytes(raw: bytes) -> bytes:
    """Runs of three or more as (257 - n, byte), the rest as literals of up to 128."""
    out, last = bytearray(), 0
    for run in [*_RUN.finditer(raw), None]:
        at = run.start() if run else len(raw)
        for s in range(last, at, 128):
            part = raw[s : min(s + 128, at)]
            out.append(len(part) - 1)
            out += part
        if run:
            last = run.end()
            out += bytes((257 - (last - at), raw[at]))
    return bytes(out)


def packbits_decode_bytes(packed: bytes, expected: int | None = None) -> bytes | None:
    """The plain bytes; null where a run is cut off, or their number is not the expected one. 128 does nothing."""
    out, i = bytearray(), 0
    while i < len(packed) and (expected is None or len(out) < expected):
        n = packed[i]
        if n < 128:
            if i + 1 + n >= len(packed):
                return None
            out += packed[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            if i + 1 >= len(packed):
                return None
            out += packed[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out) if expected is None or len(out) == expected else None


def lzw_decode_bytes(packed: bytes) -> bytes | None:
    """TIFF LZW: codes from the high bit, 256 clears, 257 ends, widths grow one code early; null where a code is unknown."""
    out, table, width, at, last = [], [], 9, 0, None
    total, padded = 8 * len(packed), packed + b"\0\0\0"
    while at + width <= total:
        byte = at >> 3
        code = ((padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]) >> (24 - (at & 7) - width)) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, None
            continue
        if code < 256:
            entry = bytes((code,))
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif code - 258 == len(table) and last is not None:
            entry = last + last[:1]
        else:
            return None
        out.append(entry)
        if last is not None and len(table) < 4096 - 258:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (258 + len(table) + 1).bit_length()))
    return b"".join(out)


def lzw_encode_bytes(raw: bytes) -> bytes:
    """The inverse of lzw_decode_bytes; clears the table before it is full."""
    out, number, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal number, bits
        number, bits = number << width | code, bits + width
        if bits >= 512:
            out.extend((number >> bits % 8).to_bytes(bits // 8, "big"))
            number, bits = number & ((1 << bits % 8) - 1), bits % 8

    # a string is known by the code of all but its last byte, and that byte
    table: dict[int, int] = {}
    added, width, now = 0, 9, -1
    put(256, 9)
    emitted = False
    for byte in raw:
        if now < 0:
            now = byte
            continue
        grown = now << 8 | byte
        known = table.get(grown)
        if known is not None:
            now = known
            continue
        number, bits = number << width | now, bits + width
        if bits >= 512:
            out += (number >> bits % 8).to_bytes(bits // 8, "big")
            number, bits = number & ((1 << bits % 8) - 1), bits % 8
        table[grown] = 258 + len(table)
        added += emitted
        emitted = True
        if 258 + added + 1 >= 1 << width and width < 12:
            width += 1
        if len(table) >= 4096 - 260:
            put(256, width)
            table, added, width, emitted = {}, 0, 9, False
        now = byte
    if now >= 0:
        put(now, width)
        added += emitted
        width = min(12, max(9, (258 + added + 1).bit_length()))
    put(257, width)
    pad = -bits % 8
    return bytes(out) + (number << pad).to_bytes((bits + pad) // 8, "big")


def _column(f):
    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return of


def packbits_encode(c: Column) -> Column:
    return _column(packbits_encode_bytes)(c)


def packbits_decode(c: Column) -> Column:
    return _column(packbits_decode_bytes)(c)


def lzw_encode(c: Column) -> Column:
    return _column(lzw_encode_bytes)(c)


def lzw_decode(c: Column) -> Column:
    return _column(lzw_decode_bytes)(c)


def deflate(c: Column) -> Column:
    return _column(zlib.compress)(c)


def inflate(c: Column) -> Column:
    return _column(zlib.decompress)(c)


def zstd(c: Column) -> Column:
    import zstandard

    return _column(lambda v: zstandard.ZstdCompressor(level=1).compress(v))(c)


def unzstd(c: Column) -> Column:
    import zstandard

    return _column(lambda v: zstandard.ZstdDecompressor().decompress(v))(c)


def with_end_marker(jpeg: Column) -> Column:
    """A JPEG stream that ends in FF D9."""
    end = F.unhex(F.lit("FFD9"))
    return F.when(F.endswith(jpeg, end), jpeg).otherwise(F.concat(jpeg, end))


def trimmed_padding(frame: Column) -> Column:
    """A frame without the zero byte that pads FF D9 to an even length."""
    return F.when(F.endswith(frame, F.unhex(F.lit("FFD900"))), F.substr(frame, F.lit(1), F.octet_length(frame) - 1)).otherwise(frame)


def utf16le(raw: Column) -> Column:
    return F.decode(raw, "UTF-16LE")


def guid_bytes(text: Column) -> Column:
    """The 16 bytes of a GUID: its first three groups are little-endian."""
    d = F.regexp_replace(text, "[{}-]", "")
    flip = lambda a, n: [F.substring(d, i, 2) for i in range(a + n - 2, a - 1, -2)]
    return F.unhex(F.concat(*flip(1, 8), *flip(9, 4), *flip(13, 4), F.substring(d, 17, 16)))


def jpeg_dimensions_of(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header; null where there is none."""
    i = 2
    while data[:2] == b"\xff\xd8" and i + 4 <= len(data):
        if data[i] != 0xFF:
            return None
        marker = data[i + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 1:
            i += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[i + 2 : i + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return (int.from_bytes(data[i + 7 : i + 9], "big"), int.from_bytes(data[i + 5 : i + 7], "big")) if i + 9 <= len(data) else None
        if marker in (0xD9, 0xDA):
            return None
        i += 2 + size
    return None


def jpeg_dimensions(c: Column) -> Column:
    @F.pandas_udf("struct<width:int,height:int>")
    def of(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jpeg_dimensions_of(v or b"") or (None, None) for v in values], columns=["width", "height"])

    return of(c)
