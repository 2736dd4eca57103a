"""MIRAX slides: the pages of the index file as rows, positions, and tiles placed by them.

The index is walked by position where the file is. Everything after that is relational: records meet their level's
parameters and their positions by equi-joins, and tiles of upper levels are kept by a semi-join with the positions that
the base level uses.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators import grid
from lamella.sources.ranges import Ranges
from lamella.sources.rows import exactly, parsed

# The index's version, bytes of a record and of a position.
VERSION, RECORD, POSITION, MAX_PAGES = b"01.02", 16, 9, 1 << 20
RECORDS = "level int, image_index int, offset long, length long, file int, error string"


def _u32(source: Ranges, at: int) -> int:
    return struct.unpack("<I", exactly(source, at, 4))[0]


def _root(source: Ranges, id_length: int) -> int:
    if source.read(0, len(VERSION)) != VERSION:
        raise ValueError("unknown index version")
    return len(VERSION) + id_length


def pages(source: Ranges, head: int) -> Iterator[tuple[int, ...]]:
    """Records of the pages that a list's head links."""
    if _u32(source, head):
        raise ValueError(f"no list at {head}")
    at, seen = _u32(source, head + 4), set()
    while at:
        if at in seen or len(seen) >= MAX_PAGES:
            raise ValueError(f"page {at} comes twice")
        seen.add(at)
        n, after = struct.unpack("<ii", exactly(source, at, 8))
        if n < 0 or after < 0:
            raise ValueError("a negative page")
        raw = exactly(source, at + 8, n * RECORD)
        for k in range(n):
            record = struct.unpack_from("<iiii", raw, k * RECORD)
            if min(record) < 0:
                raise ValueError("a negative record")
            yield record
        at = after


def hierarchy(id_length: int, levels: int):
    """A parser of the records of all zoom levels."""

    def parse(source: Ranges) -> Iterator[tuple]:
        place = _u32(source, _root(source, id_length))
        for level in range(levels):
            for image, offset, length, file in pages(source, _u32(source, place + 4 * level)):
                yield level, image, offset, length, file

    return parse


def other_record(source: Ranges, id_length: int, number: int) -> tuple[int, int, int]:
    """(offset, length, file) of a record outside the zoom levels: positions, macro, label, thumbnail."""
    if number < 0:
        raise ValueError("a negative record")
    place = _u32(source, _root(source, id_length) + 4)
    head = _u32(source, place + 4 * number)
    if _u32(source, head):
        raise ValueError(f"no list at {head}")
    n, _, a, b, offset, length, file = struct.unpack("<iiiiiii", exactly(source, _u32(source, head + 4), 28))
    if n < 1 or a or b or min(offset, length, file) < 0:
        raise ValueError("a malformed record")
    return offset, length, file


def positions_of(raw: bytes, concat: int) -> list[tuple[int, int]]:
    """(x, y) of each position, in pixels of the base level; flags other than 0 and 1 are malformed."""
    if len(raw) % POSITION:
        raise ValueError("positions of another size")
    found = np.frombuffer(raw, np.dtype([("flag", "u1"), ("x", "<i4"), ("y", "<i4")]))
    if (found["flag"] > 1).any():
        raise ValueError("an unknown position flag")
    return [(int(x) * concat, int(y) * concat) for x, y in zip(found["x"], found["y"])]


def nominal_positions(across: int, down: int, width: float, height: float, overlap_x: float, overlap_y: float, divisions: int) -> list[tuple[int, int]]:
    """Where positions are if the slide does not say: a grid of cameras' pictures that overlap."""
    return [(int(i % across * (width * divisions - overlap_x)), int(i // across * (height * divisions - overlap_y))) for i in range(across * down)]


def records(files: DataFrame, id_length: int, levels: int) -> DataFrame:
    """files: path (of the index), and content or not."""
    return parsed(files, hierarchy(id_length, levels), RECORDS)


def associated(files: DataFrame, id_length: int, numbers: dict[str, int]) -> DataFrame:
    """path, name, offset, length, file: where the macro, label and thumbnail are."""

    def parse(source: Ranges) -> Iterator[tuple]:
        for name, number in numbers.items():
            yield (name, *other_record(source, id_length, number))

    return parsed(files, parse, "name string, offset long, length long, file int, error string")


def level_parameters(levels: DataFrame, divisions: Column, overlapping: Column) -> DataFrame:
    """levels: concat (image concatenation, a power of two), image_w, image_h, overlap_x, overlap_y. Adds how many tiles an
    image has a side, what divides image coordinates to tiles, positions under a tile, tile sizes and advances."""
    c = F.col
    per_image = F.greatest(F.floor(c("concat") / divisions), F.lit(1))
    out = levels.withColumns({
        "tiles_per_image": F.when(overlapping, per_image).otherwise(1).cast("int"), "positions_per_tile": F.when(overlapping, 1).otherwise(per_image).cast("int"),
        "divisor": F.when(overlapping, F.least(c("concat"), divisions)).otherwise(c("concat")).cast("int"), "images_per_position": F.greatest(F.floor(divisions / c("concat")), F.lit(1)),
    })
    size = lambda n: c(n).cast("double") / c("tiles_per_image")
    return out.withColumns({"tile_w": size("image_w"), "tile_h": size("image_h")}).withColumns({"adv_x": c("tile_w") - c("overlap_x") / c("images_per_position"), "adv_y": c("tile_h") - c("overlap_y") / c("images_per_position")})


def tiles(found: DataFrame, levels: DataFrame, slides: DataFrame, positions: DataFrame) -> DataFrame:
    """found: path, level, image_index, offset, length, file. levels: path, level and what ``level_parameters`` adds. slides:
    path, images_x, images_y, divisions, image0_w, image0_h. positions: path, position, px, py.

    A row for each tile: path, level, col, row, off_x, off_y (from the nominal grid), src_x, src_y (in its image), where the
    image is, and tiles beyond the nominal ones that it reaches. Positions at zero other than the first are unused; a tile of
    an upper level is kept if the base uses a position under it."""
    c = F.col
    rows = found.join(levels, ["path", "level"]).join(slides, "path").withColumns({"x": F.pmod("image_index", "images_x"), "y": F.floor(c("image_index") / c("images_x")).cast("int")})
    steps = F.sequence(F.lit(0), c("tiles_per_image") - 1)
    rows = rows.withColumn("xi", F.explode(steps)).withColumn("yi", F.explode(steps)).withColumns({"xx": c("x") + c("xi") * c("divisions"), "yy": c("y") + c("yi") * c("divisions")})
    rows = rows.filter((c("xx") < c("images_x")) & (c("yy") < c("images_y"))).withColumns({"xp": F.floor(c("xx") / c("divisions")).cast("int"), "yp": F.floor(c("yy") / c("divisions")).cast("int"), "across": F.floor(c("images_x") / c("divisions")).cast("int")})
    placed = rows.withColumn("position", c("yp") * c("across") + c("xp")).join(positions, ["path", "position"])
    base = placed.filter((c("level") == 0) & ~((c("px") == 0) & (c("py") == 0) & ((c("xp") != 0) | (c("yp") != 0))))
    active = base.select("path", "position").distinct()
    upper = placed.filter("level > 0").withColumn("id", F.struct("level", "image_index", "xi", "yi"))
    cells = F.flatten(F.transform(F.sequence(F.lit(0), c("positions_per_tile") - 1), lambda j: F.transform(F.sequence(F.lit(0), c("positions_per_tile") - 1), lambda i: (c("yp") + j) * c("across") + c("xp") + i)))
    used = upper.select("path", "id", F.explode(cells).alias("position")).join(active, ["path", "position"], "left_semi").select("path", "id").distinct()
    kept = base.unionByName(upper.join(used, ["path", "id"], "left_semi").drop("id"))
    at = lambda p, n, q, s: (c(p) + c(n) * (c(q) - c(s) * c("divisions"))) / c("concat")
    col, row = F.floor(c("x") / c("divisor")) + c("xi"), F.floor(c("y") / c("divisor")) + c("yi")
    out = kept.withColumns({"col": col.cast("long"), "row": row.cast("long"), "pos_x": at("px", "image0_w", "xx", "xp"), "pos_y": at("py", "image0_h", "yy", "yp")})
    out = out.withColumns({"off_x": c("pos_x") - c("col") * c("adv_x"), "off_y": c("pos_y") - c("row") * c("adv_y"), "src_x": F.round(c("tile_w") * c("xi")).cast("long"), "src_y": F.round(c("tile_h") * c("yi")).cast("long")})
    left, right = grid.extra_tiles(c("off_x"), c("adv_x"), c("tile_w"))
    top, bottom = grid.extra_tiles(c("off_y"), c("adv_y"), c("tile_h"))
    return out.withColumns({"extra_left": left, "extra_right": right, "extra_top": top, "extra_bottom": bottom}).select("path", "level", "col", "row", "off_x", "off_y", "src_x", "src_y", "file", "offset", "length", "extra_left", "extra_right", "extra_top", "extra_bottom")


def written(slide_id: str, levels: list[list[tuple[int, int, int, int]]], others: list[tuple[int, int, int]], page: int = 3) -> bytes:
    """An index file of these records (image, offset, length, file) by level, in pages of so many, and others (offset, length, file)."""
    root = len(VERSION) + len(slide_id)
    out = bytearray(VERSION + slide_id.encode() + b"\0" * 8)

    def head(records_: list[bytes]) -> int:
        starts = [records_[i : i + page] for i in range(0, len(records_), page)] or [[]]
        at = []
        for part in starts:
            at.append(len(out))
            out.extend(struct.pack("<ii", len(part), 0) + b"".join(part))
        for a, b in zip(at, at[1:]):
            struct.pack_into("<i", out, a + 4, b)
        out.extend(struct.pack("<II", 0, at[0]))
        return len(out) - 8

    heads = [head([struct.pack("<iiii", *r) for r in rows]) for rows in levels]
    struct.pack_into("<I", out, root, len(out))
    out.extend(struct.pack(f"<{len(heads)}I", *heads))
    heads = [head([struct.pack("<iiiii", 0, 0, *r)]) for r in others]
    struct.pack_into("<I", out, root + 4, len(out))
    out.extend(struct.pack(f"<{len(heads)}I", *heads))
    return bytes(out)
