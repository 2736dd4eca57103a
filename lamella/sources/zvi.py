"""Tag streams of ZVI files: variants, and the tags that they hold."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Variant types with a fixed form (struct code); those that are texts or blobs by 32-bit length; the tag that is skipped.
NUMBERS = {2: "<h", 3: "<i", 22: "<i", 19: "<I", 23: "<I", 4: "<f", 5: "<d", 7: "<d", 20: "<q", 21: ">Q"}
TEXTS, BLOBS, EMPTY, REFERENCES, BOOLEAN, SHORT_TEXT, SKIPPED = (8, 69), (63, 65), (0, 1), (9, 13), 11, 66, 1047


def variant(data: bytes, at: int) -> tuple[str, int]:
    """A value as text, and the place after it. Types that are not known end where the next 32-bit number begins."""
    kind = struct.unpack_from("<H", data, at)[0]
    at += 2
    if kind in EMPTY:
        return "", at
    if kind in NUMBERS:
        n = struct.unpack_from(NUMBERS[kind], data, at)[0]
        return (str(n) if isinstance(n, int) else f"{n:g}" if kind == 4 else repr(n).removesuffix(".0")), at + struct.calcsize(NUMBERS[kind])
    if kind == BOOLEAN:
        return ("true" if struct.unpack_from("<h", data, at)[0] else "false"), at + 2
    if kind in REFERENCES:
        return "", at + 16
    if kind in TEXTS or kind in BLOBS or kind == SHORT_TEXT:
        code = "<H" if kind == SHORT_TEXT else "<I"
        n, start = struct.unpack_from(code, data, at)[0], at + struct.calcsize(code)
        if start + n > len(data):
            raise ValueError("a value is cut off")
        raw = data[start : start + n]
        return ("" if kind in BLOBS else raw.decode("utf-8" if kind == SHORT_TEXT else "utf-16-le", "replace")), start + n
    while at + 2 <= len(data) and struct.unpack_from("<H", data, at)[0] != 3:
        at += 2
    return "", at


def tags_of(data: bytes) -> Iterator[tuple[int, str]]:
    """(tag, value) in order: a version, a count, then value, number of the tag and attributes of each."""
    count, at = max(struct.unpack_from("<i", data, 8)[0], 0), 12
    for _ in range(count):
        if at + 2 > len(data):
            return
        value, at = variant(data, at)
        if at + 12 > len(data):
            return
        tag = struct.unpack_from("<i", data, at + 2)[0]
        at += 12
        if tag != SKIPPED:
            yield tag, value.strip("\0").strip()


def tags(stream: Column) -> Column:
    """A map of the tags of a stream, the last of equal ones; null where it is malformed."""

    @F.pandas_udf("map<int,string>")
    def of(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                out.append(dict(tags_of(bytes(v or b""))))
            except (struct.error, ValueError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return of(stream)
