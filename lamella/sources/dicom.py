"""DICOM files as rows: the attributes that slides need, and the frames of encapsulated pixel data.

Elements are walked by position, little-endian with explicit or implicit VRs; the values of other elements, pixels among
them, are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.sources.ranges import Ranges
from lamella.sources.rows import exactly, parsed

# VRs with 32-bit lengths; tags by name and kind; item and delimiter tags.
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
TAGS = {
    (0x0002, 0x0010): ("transfer_syntax", "text"), (0x0008, 0x0008): ("image_type", "texts"), (0x0008, 0x0018): ("sop_uid", "text"), (0x0020, 0x000E): ("series_uid", "text"), (0x0028, 0x0002): ("samples", "u2"),
    (0x0028, 0x0004): ("photometric", "text"), (0x0028, 0x0006): ("planar", "u2"), (0x0028, 0x0008): ("frames", "number"), (0x0028, 0x0010): ("rows", "u2"), (0x0028, 0x0011): ("cols", "u2"), (0x0028, 0x0100): ("bits", "u2"),
    (0x0048, 0x0006): ("total_w", "u4"), (0x0048, 0x0007): ("total_h", "u4"),
}
SPACING, SHARED, MEASURES, PIXELS = (0x0028, 0x0030), (0x5200, 0x9229), (0x0028, 0x9110), (0x7FE0, 0x0010)
ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), 0xFFFFFFFF
INSTANCE = "transfer_syntax string, image_type array<string>, sop_uid string, series_uid string, samples int, photometric string, planar int, frames int, rows int, cols int, bits int, total_w long, total_h long, spacing array<double>, pixel_offset long, error string"
FRAGMENT = "fragment int, item_offset long, payload_offset long, length long, table_size int, frame_start long, error string"
MAX_DEPTH = 16


class Elements:
    """Elements in order: tag, place of the value, its length. Sequences and items are entered by calling again."""

    def __init__(self, source: Ranges, explicit: bool):
        self.source, self.explicit = source, explicit

    def at(self, place: int, explicit: bool | None = None) -> tuple[tuple[int, int], int, int, bytes]:
        head = exactly(self.source, place, 8)
        tag = struct.unpack_from("<HH", head)
        if tag[0] == 0xFFFE:
            return tag, place + 8, struct.unpack_from("<I", head, 4)[0], b""
        if explicit if explicit is not None else self.explicit:
            vr = head[4:6]
            if vr in LONG:
                return tag, place + 12, struct.unpack("<I", exactly(self.source, place + 8, 4))[0], vr
            return tag, place + 8, struct.unpack_from("<H", head, 6)[0], vr
        return tag, place + 8, struct.unpack_from("<I", head, 4)[0], b""

    def passed(self, place: int, length: int, depth: int = 0) -> int:
        """The place after a value; one of undefined length ends with its delimiter."""
        if length != UNDEFINED:
            return place + length
        if depth > MAX_DEPTH:
            raise ValueError("nested too deep")
        while True:
            tag, value, n, _ = self.at(place)
            if tag in (SEQUENCE_END, ITEM_END):
                return value
            place = self.passed(value, n, depth + 1)

    def items(self, place: int, length: int) -> Iterator[tuple[int, int]]:
        """Where the items of a sequence begin and end."""
        end = place + length if length != UNDEFINED else None
        while end is None or place < end:
            tag, value, n, _ = self.at(place)
            if tag == SEQUENCE_END:
                return
            if tag != ITEM:
                raise ValueError(f"no item at {place}")
            place = self.passed(value, n)
            yield value, place if n != UNDEFINED else place - 8

    def inside(self, place: int, end: int) -> Iterator[tuple[tuple[int, int], int, int, bytes]]:
        while place < end:
            found = self.at(place)
            yield found
            place = self.passed(found[1], found[2])


def _start(source: Ranges) -> tuple[dict, Elements, int]:
    """What the file meta says, the elements' reader, and where the data set begins."""
    if source.read(128, 4) != b"DICM":
        raise ValueError("no DICM")
    meta, place, reader = {}, 132, Elements(source, True)
    while place + 8 <= source.size and struct.unpack("<H", exactly(source, place, 2))[0] == 2:
        tag, value, n, _ = reader.at(place, True)
        if tag in TAGS:
            meta[TAGS[tag][0]] = exactly(source, value, n).rstrip(b"\0 ").decode("ascii", "replace")
        place = value + n
    syntax = meta.get("transfer_syntax", "")
    if syntax == "1.2.840.10008.1.2.2":
        raise ValueError("big-endian data sets are not supported")
    return meta, Elements(source, syntax != "1.2.840.10008.1.2"), place


def _pair(raw: bytes) -> list[float] | None:
    parts = raw.decode("ascii", "replace").replace("\0", " ").split("\\")
    return [float(x) for x in parts[:2]] if len(parts) >= 2 else None


def instance(source: Ranges) -> Iterator[tuple]:
    """One row: the attributes, spacing (row, column; that of the shared groups first), and where the pixel data begin."""
    facts, reader, place = _start(source)
    shared = own = pixels = None
    while place + 8 <= source.size:
        tag, value, n, _ = reader.at(place)
        if tag == PIXELS:
            pixels = place
            break
        if tag in TAGS and n != UNDEFINED:
            name, kind = TAGS[tag]
            raw = exactly(source, value, n)
            if kind in ("u2", "u4"):
                facts[name] = int.from_bytes(raw[: int(kind[1])], "little")
            else:
                text = raw.rstrip(b"\0 ").decode("utf-8", "replace")
                facts[name] = [x.strip() for x in text.split("\\")] if kind == "texts" else int(text) if kind == "number" else text
        elif tag == SPACING and n != UNDEFINED:
            own = _pair(exactly(source, value, n))
        elif tag == SHARED:
            for a, z in reader.items(value, n):
                for t, v, m, _ in reader.inside(a, z):
                    if t == MEASURES:
                        for b, y in reader.items(v, m):
                            for u, w, k, _ in reader.inside(b, y):
                                if u == SPACING and shared is None:
                                    shared = _pair(exactly(source, w, k))
        place = reader.passed(value, n)
    names = [f.split()[0] for f in INSTANCE.split(", ")][:-3]
    yield (*(facts.get(n) for n in names), shared or own, pixels)


def fragments(source: Ranges) -> Iterator[tuple]:
    """A row for each fragment of encapsulated pixel data, with the size of the offset table and the start that it gives for the
    frame of that number; native pixel data give none."""
    _, reader, place = _start(source)
    while place + 8 <= source.size:
        tag, value, n, _ = reader.at(place)
        if tag == PIXELS:
            break
        place = reader.passed(value, n)
    else:
        return
    if n != UNDEFINED:
        return
    table: tuple[int, ...] | None = None
    place, first, k = value, None, 0
    while True:
        tag, value, n, _ = reader.at(place)
        if tag == SEQUENCE_END:
            return
        if tag != ITEM:
            raise ValueError(f"no item at {place}")
        if table is None:
            raw = exactly(source, value, n)
            table = struct.unpack(f"<{n // 4}I", raw[: n // 4 * 4])
            first = value + n
        else:
            if not n:
                raise ValueError("a fragment of no length")
            if value + n > source.size:
                raise ValueError(f"cut off at {value}")
            yield k, place, value, n, len(table), first + table[k] if k < len(table) else None
            k += 1
        place = value + n


def instances(files: DataFrame) -> DataFrame:
    return parsed(files, instance, INSTANCE)


def frames(files: DataFrame, of: DataFrame) -> DataFrame:
    """of: path, frames (their number). A row for each fragment with the frame it belongs to, from 0: by the offset table where
    there is one, else one fragment a frame, else all of one frame; frame is null where none of these holds."""
    rows = parsed(files, fragments, FRAGMENT).filter("fragment is not null")
    n = F.count("*").over(Window.partitionBy("path"))
    starts = F.collect_list("frame_start").over(Window.partitionBy("path"))
    by_table = F.size(F.filter(starts, lambda s: s <= F.col("item_offset"))) - 1
    joined = rows.withColumns({"n": n, "by_table": by_table}).join(of.select("path", F.col("frames").alias("n_frames")), "path")
    frame = F.when((F.col("table_size") > 0) & (F.col("table_size") <= F.col("n")), F.col("by_table")).when(F.col("n") == F.col("n_frames"), F.col("fragment")).when(F.col("n_frames") == 1, 0)
    return joined.select("path", "fragment", "payload_offset", "length", frame.cast("int").alias("frame"))


def element(tag: tuple[int, int], vr: str, value: bytes, explicit: bool = True, undefined: bool = False) -> bytes:
    """One element's bytes, for writing."""
    value += (b"\0" if vr in ("UI", "OB", "UN") else b" ") * (len(value) % 2)
    n = UNDEFINED if undefined else len(value)
    head = struct.pack("<HH", *tag)
    if not explicit:
        return head + struct.pack("<I", n) + value
    return head + vr.encode() + (b"\0\0" + struct.pack("<I", n) if vr.encode() in LONG else struct.pack("<H", n)) + value


def item(value: bytes) -> bytes:
    return struct.pack("<HHI", *ITEM, len(value)) + value


def part10(meta: str, elements: bytes) -> bytes:
    """A file: preamble, meta with this transfer syntax, data set."""
    return b"\0" * 128 + b"DICM" + element((2, 0x10), "UI", meta.encode()) + elements


def encapsulated(payloads: list[bytes], table: list[int] | None = None) -> bytes:
    """Pixel data as a sequence of fragments."""
    body = item(struct.pack(f"<{len(table or [])}I", *(table or []))) + b"".join(item(p + b"\0" * (len(p) % 2)) for p in payloads)
    return element(PIXELS, "OB", b"", undefined=True) + body + struct.pack("<HHI", *SEQUENCE_END, 0)
