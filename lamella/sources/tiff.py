"""TIFF and BigTIFF headers as rows: one for each tag of each directory.

Directories are walked by position, where the files are: what is read of a file is its directories and the values of their
tags, never its pixels. Files may also come as rows with their bytes. What is found before a file turns out to be malformed
is kept, and one row with the error follows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators.vendor import TIFF_TYPES
from lamella.sources.ranges import Held, Ranges, opened

# Limits on directories, their entries, and the bytes of one tag's values and of all.
MAX_DIRECTORIES, MAX_ENTRIES, MAX_ALL_ENTRIES, MAX_PAYLOAD, MAX_ALL_PAYLOAD = 10_000, 100_000, 2_000_000, 64 << 20, 512 << 20
MAX_DEPTH, SUB_DIRECTORIES, DATA_OFFSETS, WRAP = 4, 330, (273, 324), 1 << 32
TAGS = "path string, ifd_id long, parent_id long, ifd_index int, tag int, type string, count long, ints array<long>, floats array<double>, text string, raw binary, big_endian boolean, error string"
_SIZE = {i: n for i, _, n in TIFF_TYPES}
_NAME = {i: name for i, name, _ in TIFF_TYPES}
_KIND = {1: "u1", 3: "u2", 4: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}


class TiffError(ValueError):
    pass


class Walker:
    """One file's directories. ndpi: 32-bit offsets may have wrapped, and are led back below what points to them."""

    def __init__(self, source: Ranges, ndpi: bool = False):
        self.source, self.ndpi = source, ndpi
        head = source.read(0, 2)
        if head not in (b"II", b"MM"):
            raise TiffError("no byte order")
        self.order = "<" if head == b"II" else ">"
        self.rows: list[tuple] = []
        self.seen: set[int] = set()
        self.entries = self.payload = 0
        magic = self.take("H", 2)
        if magic == 43:
            if self.take("H", 4) != 8:
                raise TiffError("offsets of an unknown size")
            self.big, self.first = True, self.take("Q", 8)
        elif magic == 42:
            self.big, self.first = False, self.take("I", 4)
            if ndpi:
                self.first = self.start(self.first)
        else:
            raise TiffError(f"unknown version {magic}")

    def take(self, code: str, at: int) -> int:
        n = struct.calcsize(code)
        raw = self.source.read(at, n)
        if len(raw) < n:
            raise TiffError(f"cut off at {at}")
        return struct.unpack(self.order + code, raw)[0]

    def start(self, at: int) -> int:
        """The first place, of those that have these 32 bits, where a directory can be."""
        size = self.source.size
        if at >= size:
            raise TiffError(f"the first directory at {at} is outside the file")
        for place in range(at, size - 1, WRAP):
            n = self.take("H", place)
            if 0 < n <= 4096 and place + 2 + 12 * n + 8 <= size:
                return place
        return at

    def unwrapped(self, of: int, offset: int) -> int:
        """The largest offset with these 32 bits that lies below ``of``, not below zero."""
        whole = of - of % WRAP + offset % WRAP
        return whole if whole < of else max(whole - WRAP, 0)

    def directory(self, at: int, parent: int | None, index: int, depth: int) -> int:
        """Appends the tags of the directory at this offset; gives the next one's offset."""
        if at in self.seen:
            raise TiffError(f"directory {at} comes twice")
        self.seen.add(at)
        if len(self.seen) > MAX_DIRECTORIES:
            raise TiffError("too many directories")
        n, head, size, inline = (self.take("Q", at), 8, 20, 8) if self.big else (self.take("H", at), 2, 12, 4)
        self.entries += n
        if n > MAX_ENTRIES or self.entries > MAX_ALL_ENTRIES:
            raise TiffError("too many entries")
        children: list[int] = []
        for i in range(n):
            e = at + head + i * size
            tag, kind = self.take("H", e), self.take("H", e + 2)
            count = self.take("Q" if self.big else "I", e + 4)
            field = e + (12 if self.big else 8)
            if kind not in _SIZE:
                continue
            length = _SIZE[kind] * count
            start = field
            if length > inline:
                start = self.take("Q" if self.big else "I", field)
                if self.ndpi and not self.big:
                    start = self.unwrapped(at, start)
            self.payload += length
            if length > MAX_PAYLOAD or self.payload > MAX_ALL_PAYLOAD:
                raise TiffError(f"tag {tag} is too long")
            raw = self.source.read(start, length)
            if len(raw) < length:
                raise TiffError(f"tag {tag} is out of bounds")
            ints, floats, text = self.values(kind, raw)
            if self.ndpi and tag in DATA_OFFSETS and ints is not None:
                ints = [self.unwrapped(at, x) for x in ints]
            self.rows.append((at, parent, index, tag, _NAME[kind], count, ints, floats, text, raw, self.order == ">", None))
            if tag == SUB_DIRECTORIES:
                children = list(ints if ints is not None else ())
        if depth < MAX_DEPTH:
            for k, sub in enumerate(children):
                while sub:
                    sub = self.directory(sub, at, k, depth + 1)
        link = at + head + n * size
        if self.ndpi and not self.big:
            return self.take("Q", link) if self.source.size >= link + 8 and self.source.size > WRAP else self.take("I", link)
        return self.take("Q" if self.big else "I", link)

    def values(self, kind: int, raw: bytes):
        if kind == 2:
            return None, None, raw.split(b"\0")[0].decode("utf-8", "replace")
        if kind in (5, 10):
            pairs = np.frombuffer(raw, self.order + ("u4" if kind == 5 else "i4")).astype(float)
            with np.errstate(all="ignore"):
                return None, np.where(pairs[1::2] != 0, pairs[::2] / pairs[1::2], np.nan).tolist(), None
        if kind == 7:
            return None, None, None
        found = np.frombuffer(raw, self.order + _KIND[kind])
        return (None, found.astype(float).tolist(), None) if kind in (11, 12) else (found.astype(np.int64).tolist(), None, None)

    def walk(self) -> Iterator[tuple]:
        at, index = self.first, 0
        while at:
            at, index = self.directory(at, None, index, 0), index + 1
            yield from self.rows
            self.rows.clear()


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string(), pa.binary(), pa.bool_(), pa.string()]


def _rows(path: str, source: Ranges) -> Iterator[tuple]:
    walker = None
    try:
        walker = Walker(source, path.lower().endswith(".ndpi"))
        for row in walker.walk():
            yield (path, *row)
    except TiffError as error:
        for row in walker.rows if walker else ():
            yield (path, *row)
        yield (path, *[None] * 11, str(error))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=[f.split()[0] for f in TAGS.split(", ")])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of many small files together, those of large tags in batches of about 8 MB: a batch for each file would cost more
    than its parsing."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 200 + 8 * len(row[10] or b"")
        if len(out) >= 4000 or size >= 8 << 20:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _parse_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(row for batch in batches for path, content in zip(batch.column(0).to_pylist(), batch.column(1)) for row in _rows(path, Held(content.as_py() or b"")))


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source = opened(path)
                try:
                    yield from _rows(path, source)
                finally:
                    source.close()

    yield from _batches(rows())


def tags_of(files: DataFrame) -> DataFrame:
    """files: path, content."""
    return files.select("path", "content").mapInArrow(_parse_held, TAGS)


def tags_at(files: DataFrame) -> DataFrame:
    """files: path. Their headers, read by position; files of any size."""
    return files.select("path").mapInArrow(_parse_files, TAGS)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Of all files under path; the listing does not read them."""
    return tags_at(spark.read.format("binaryFile").load(path).select("path").repartition(F.col("path")))


def payload_at(files: DataFrame) -> DataFrame:
    """files: path, offset, length and other columns. Adds payload, read by position; null where the file ends before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Ranges] = {}
        for batch in batches:
            out = []
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if path not in held:
                    if len(held) >= 16:
                        held.pop(next(iter(held))).close()
                    held[path] = opened(path)
                raw = held[path].read(at, n)
                out.append(raw if len(raw) == n else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "payload"])
        for source in held.values():
            source.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{kinds}, payload binary")
