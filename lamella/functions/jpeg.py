"""Baseline JPEG in numpy: headers, coefficients, samples, and writing coefficients or samples back.

Entropy coding is a loop over symbols, by tables of 16-bit prefixes; transforms, upsampling and colour are whole-array. For
byte columns in Arrow batches; streams that are progressive, arithmetic or of 12 bits are refused with a message.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from dataclasses import dataclass, field

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_BASIS = {n: np.array([[np.sqrt((1 if u == 0 else 2) / n) * np.cos((2 * x + 1) * u * np.pi / (2 * n)) for x in range(n)] for u in range(n)]) for n in (1, 2, 4, 8)}


class JpegError(ValueError):
    pass


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    blocks: np.ndarray | None = None  # rows, columns, 64: quantised coefficients in natural order


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    restart: int = 0
    adobe: int | None = None
    jfif: bool = False

    @property
    def mcu(self) -> tuple[int, int]:
        return 8 * max(c.h for c in self.components), 8 * max(c.v for c in self.components)


def segments(data: bytes):
    """(marker, place of its payload, length) up to the scan, whose place is where entropy-coded bytes begin."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 1 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        if marker == 0xD9:
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        yield marker, at + 4, size - 2
        at += 2 + size
        if marker == 0xDA:
            return


@functools.lru_cache(32)  # the tiles of a slide often have the same tables, and a table of 65,536 costs more than a tile
def _prefixes(bits: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """Of each 16-bit prefix: the length of the code it starts with, and its symbol; (0, 0) where there is none."""
    out: list[tuple[int, int]] = []
    k = 0
    for n, count in enumerate(bits, 1):
        for s in symbols[k : k + count]:
            out += [(n, s)] * (1 << (16 - n))
        k += count
    return out + [(0, 0)] * (65536 - len(out))


def header(data: bytes, image: Image | None = None) -> tuple[Image, int | None, list[tuple[int, int, int]]]:
    """Tables and frame; where the scan's bytes begin; and the scan's (component, DC table, AC table)."""
    image = image or Image()
    for marker, at, size in segments(data):
        body = data[at : at + size]
        if len(body) < size:
            raise JpegError("cut off")
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                values = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else "u1").astype(np.int64)
                image.quant[body[0] & 15] = values
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0]] = _prefixes(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise JpegError(f"{bits} bits a sample")
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise JpegError(f"frame type {marker:X} is not supported")
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xE0 and body[:4] == b"JFIF":
            image.jfif = True
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            image.adobe = body[11]
        elif marker == 0xDA:
            return image, at + size, [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
    return image, None, []


def tile_geometry(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, tile width, tile height) of a stream whose restart intervals are tiles: rows of MCUs are whole multiples of them."""
    image, _, _ = header(data)
    if not image.components or not image.restart:
        raise JpegError("no restart interval")
    w, h = image.mcu
    across = -(-image.width // w)
    if image.restart > across or across % image.restart:
        raise JpegError("restart interval does not divide a row")
    return image.width, image.height, w * image.restart, h


def lenient_geometry(data: bytes) -> tuple[int, int, int, int] | None:
    """The same of a header that may be cut off or lack a restart interval: then a tile is a whole row of MCUs."""
    image = Image()
    try:
        header(data, image)
    except (JpegError, struct.error):
        pass
    if not image.components or not image.width:
        return None
    w, h = image.mcu
    across = -(-image.width // w)
    n = image.restart if image.restart and across % image.restart == 0 else across
    return image.width, image.height, w * n, h


def splice(data: bytes, tables: bytes | None) -> bytes:
    """A whole stream: the tables' segments come after the start of image, unless the stream has such segments itself."""
    if not tables or data[:2] != b"\xff\xd8":
        return data
    own = {m for m, _, _ in segments(data)}
    extra = b"".join(tables[at - 4 : at + size] for m, at, size in segments(tables) if m in (0xDB, 0xC4, 0xDD) and m not in own)
    return data[:2] + extra + data[2:]


def patched(data: bytes, width: int, height: int, force: bool = False) -> bytes:
    """The frame header with these sizes, where its own are zero, or always if forced."""
    if not 0 < width <= 65535 or not 0 < height <= 65535:
        return data
    for marker, at, size in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and size >= 5:
            h, w = struct.unpack_from(">HH", data, at + 1)
            if force:
                h, w = height, width
            return data[: at + 1] + struct.pack(">HH", h or height, w or width) + data[at + 5 :]
    return data


def coefficients(data: bytes, tables: bytes | None = None) -> Image:
    """The quantised coefficients of every block."""
    image = Image()
    if tables:
        header(tables, image)
    image, at, scan = header(data, image)
    if at is None or not image.components:
        raise JpegError("no scan")
    if len(scan) != len(image.components):
        raise JpegError("several scans are not supported")
    mw, mh = image.mcu
    across, down = -(-image.width // mw), -(-image.height // mh)
    if len(scan) == 1:  # one component: blocks in raster order, whatever its sampling
        image.components[0].h = image.components[0].v = 1
        mw = mh = 8
        across, down = -(-image.width // 8), -(-image.height // 8)
    by_id = {c.id: c for c in image.components}
    for c in image.components:
        c.blocks = np.zeros((down * c.v, across * c.h, 64), dtype=np.int32)
    end = re.compile(rb"\xff[\xd9\xc0-\xc7\xda-\xdf\xe0-\xfe]").search(data, at)
    body = data[at : end.start() if end else len(data)]
    parts = re.split(rb"\xff[\xd0-\xd7]", body)
    step = image.restart or across * down
    plan = []
    for cid, dc, ac in scan:
        if dc not in image.huffman or 16 + ac not in image.huffman:
            raise JpegError("a Huffman table is missing")
        plan.append((by_id[cid], image.huffman[dc], image.huffman[16 + ac]))
    zig = ZIGZAG.tolist()
    for k, part in enumerate(parts):
        if k * step >= across * down:
            break
        raw = np.frombuffer(part.replace(b"\xff\x00", b"\xff") + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
        window = (raw[:-3] << np.uint64(24) | raw[1:-2] << np.uint64(16) | raw[2:-1] << np.uint64(8) | raw[3:]).tolist()
        limit, pos = 8 * (len(window) - 5), 0
        last = [0] * len(plan)
        for m in range(k * step, min((k + 1) * step, across * down)):
            for which, (c, dc, ac) in enumerate(plan):
                for b in range(c.h * c.v):
                    values = [0] * 64
                    i = 0
                    while i < 64:
                        n, s = (ac if i else dc)[window[pos >> 3] >> (16 - (pos & 7)) & 0xFFFF]
                        if not n or pos > limit:
                            raise JpegError("bad entropy-coded data")
                        pos += n
                        run, s = s >> 4, s & 15
                        if i:
                            if not s:
                                if run != 15:
                                    break
                                i += 16
                                continue
                            i += run
                            if i > 63:
                                raise JpegError("bad run")
                        if s:
                            v = window[pos >> 3] >> (32 - (pos & 7) - s) & ((1 << s) - 1)
                            pos += s
                            values[zig[i]] = v if v >> (s - 1) else v - (1 << s) + 1
                        i += 1
                    last[which] += values[0]
                    values[0] = last[which]
                    c.blocks[m // across * c.v + b // c.h, m % across * c.h + b % c.h] = values
    return image


def _natural(table: np.ndarray) -> np.ndarray:
    out = np.empty(64, dtype=np.int64)
    out[ZIGZAG] = table
    return out


def planes(image: Image, scale: int = 1) -> list[np.ndarray]:
    """Samples of each component at 1/scale (1, 2, 4 or 8), by a transform of that many fewer points."""
    n = 8 // scale
    out = []
    for c in image.components:
        x = (c.blocks * _natural(image.quant[c.table])).reshape(*c.blocks.shape[:2], 8, 8)[:, :, :n, :n] * (n / 8)
        y = np.einsum("ua,ijuv,vb->ijab", _BASIS[n], x, _BASIS[n])
        y = np.clip(np.floor(y + 128.5), 0, 255).astype(np.uint8)
        out.append(y.transpose(0, 2, 1, 3).reshape(c.blocks.shape[0] * n, c.blocks.shape[1] * n))
    return out


def is_ycc(image: Image, said: str = "Auto") -> bool:
    """Whether three components are luma and chroma. said: what the container knows, ForceRgb, ForceYCbCr or Auto."""
    if len(image.components) != 3 or said == "ForceRgb":
        return False
    if said == "ForceYCbCr":
        return True
    return image.adobe == 1 if image.adobe is not None else image.jfif or [c.id for c in image.components] not in ([82, 71, 66], [0, 1, 2])


def decode(data: bytes, tables: bytes | None = None, said: str = "Auto", scale: int = 1) -> np.ndarray:
    """Rows, columns, samples: grey, or RGB."""
    image = coefficients(data, tables)
    w, h = -(-image.width // scale), -(-image.height // scale)
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    found = []
    for c, p in zip(image.components, planes(image, scale)):
        if most_h % c.h or most_v % c.v:
            raise JpegError("odd sampling factors")
        found.append(np.repeat(np.repeat(p, most_v // c.v, axis=0), most_h // c.h, axis=1)[:h, :w])
    out = np.stack(found, axis=2)
    if is_ycc(image, said):
        y, b, r = (out[:, :, k].astype(float) for k in range(3))
        rgb = (y + 1.402 * (r - 128), y - 0.344136 * (b - 128) - 0.714136 * (r - 128), y + 1.772 * (b - 128))
        out = np.clip(np.floor(np.stack(rgb, axis=2) + 0.5), 0, 255).astype(np.uint8)
    return out


def _symbols(image: Image, order: list[tuple[Component, int, int]]) -> list[tuple[int, int, int, int]]:
    """What a scan says: (table, symbol, extra bits, their value). AC tables are numbered from 16."""
    out = []
    last = dict.fromkeys((c.id for c in image.components), 0)
    for c, row, col in order:
        z = c.blocks[row, col][ZIGZAG].tolist()
        kind = 0 if c is image.components[0] else 1
        d, last[c.id] = z[0] - last[c.id], z[0]
        n = abs(d).bit_length()
        out.append((kind, n, n, d if d >= 0 else d + (1 << n) - 1))
        run = 0
        for v in z[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                out.append((16 + kind, 0xF0, 0, 0))
                run -= 16
            n = abs(v).bit_length()
            out.append((16 + kind, run << 4 | n, n, v if v >= 0 else v + (1 << n) - 1))
            run = 0
        if run:
            out.append((16 + kind, 0, 0, 0))
    return out


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of at most 16 bits by Huffman's rule, with one code left over; all equal where that would be too long."""
    heap = [(n, s, (s,)) for s, n in counts.items()] + [(0, -1, (-1,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, -1], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    longest = max(depth.values())
    if longest > 16:
        return dict.fromkeys(counts, len(counts).bit_length())
    # the code of all ones must stay free: it is the extra symbol's, among the longest
    if depth[-1] < longest:
        s = next(x for x, d in depth.items() if d == longest)
        depth[s], depth[-1] = depth[-1], longest
    return {s: max(d, 1) for s, d in depth.items() if s >= 0}


def emit(image: Image) -> bytes:
    """A baseline stream of these coefficients, with Huffman tables of its own; nothing is lost."""
    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    mw, mh = image.mcu
    across, down = -(-image.width // mw), -(-image.height // mh)
    order = [(c, m // across * c.v + b // c.h, m % across * c.h + b % c.h) for m in range(across * down) for c in image.components for b in range(c.h * c.v)]
    said = _symbols(image, order)
    counts: dict[int, dict[int, int]] = {}
    for t, s, _, _ in said:
        counts.setdefault(t, {})[s] = counts.get(t, {}).get(s, 0) + 1
    out, codes = [b"\xff\xd8"], {}
    if len(image.components) == 3 and image.adobe is not None:
        out.append(segment(0xEE, b"Adobe" + struct.pack(">HHHB", 100, 0, 0, image.adobe)))
    for i, q in sorted(image.quant.items()):
        out.append(segment(0xDB, bytes([i]) + q.astype(np.uint8).tobytes()))
    frame = b"".join(bytes([c.id, c.h << 4 | c.v, c.table]) for c in image.components)
    out.append(segment(0xC0, struct.pack(">BHHB", 8, image.height, image.width, len(image.components)) + frame))
    for t in sorted(counts):
        by = _lengths(counts[t])
        ranked = sorted(by, key=lambda s: (by[s], s))
        code = before = 0
        for s in ranked:
            code <<= by[s] - before
            codes[t, s], before = (code, by[s]), by[s]
            code += 1
        out.append(segment(0xC4, bytes([t]) + bytes(sum(by[s] == n for s in ranked) for n in range(1, 17)) + bytes(ranked)))
    out.append(segment(0xDA, bytes([len(image.components)]) + b"".join(bytes([c.id, 0 if k == 0 else 0x11]) for k, c in enumerate(image.components)) + b"\0\x3f\0"))
    word, size, body = 0, 0, bytearray()
    for t, s, n, v in said:
        code, length = codes[t, s]
        word, size = (word << length | code) << n | v, size + length + n
        if size >= 512:
            body += (word >> size % 8).to_bytes(size // 8, "big")
            word, size = word & ((1 << size % 8) - 1), size % 8
    pad = -size % 8
    body += (word << pad | (1 << pad) - 1).to_bytes((size + pad) // 8, "big")
    return b"".join(out) + bytes(body).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def encode(data: np.ndarray, quant: int = 1) -> bytes:
    """Grey or RGB samples, stored as they are (no change of colours, no subsampling), with one quantiser for all."""
    h, w, n = data.shape
    image = Image(w, h, quant={0: np.full(64, quant)}, adobe=0)
    for k in range(n):
        plane = np.pad(data[:, :, k].astype(float) - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
        blocks = plane.reshape(len(plane) // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        x = np.einsum("ua,ijab,vb->ijuv", _BASIS[8], blocks, _BASIS[8])
        image.components.append(Component(k + 1, 1, 1, 0, np.floor(x / quant + 0.5).astype(np.int32).reshape(*blocks.shape[:2], 64)))
    return emit(image)


def cropped(image: Image, x: int, y: int, width: int, height: int) -> Image:
    """The blocks from (x, y), which lies on an MCU, as an image of that size: a crop without decoding."""
    mw, mh = image.mcu
    if x % mw or y % mh:
        raise JpegError("the corner is not on an MCU")
    parts = []
    for c in image.components:
        bx, by = x // mw * c.h, y // mh * c.v
        nx, ny = -(-width // mw) * c.h, -(-height // mh) * c.v
        blocks = np.zeros((ny, nx, 64), dtype=np.int32)
        some = c.blocks[by : by + ny, bx : bx + nx]
        blocks[: some.shape[0], : some.shape[1]] = some
        parts.append(Component(c.id, c.h, c.v, c.table, blocks))
    return Image(width, height, parts, image.quant, image.huffman, 0, image.adobe, image.jfif)
