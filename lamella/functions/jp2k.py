"""JPEG 2000 codestream headers: sizes, coding style, quantisation, tile parts; and whether a stream is of the supported kind."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, progressions, wavelets.
SOC, SIZ, COD, QCD, SOT, SOD, EOC, EPH = 0xFF4F, 0xFF51, 0xFF52, 0xFF5C, 0xFF90, 0xFF93, 0xFFD9, 0xFF92
PROGRESSIONS, WAVELETS, QUANTISATIONS = ["LRCP", "RLCP", "RPCL", "PCRL", "CPRL"], ["9/7", "5/3"], ["none", "derived", "expounded"]
HEADER = (
    "width long, height long, tile_w long, tile_h long, tiles_x int, tiles_y int, components array<struct<bits:int,signed:boolean,dx:int,dy:int>>, progression string, layers int, "
    "transform boolean, levels int, block_w int, block_h int, block_style int, wavelet string, quantisation string, steps int, tile_parts array<struct<tile:int,part:int,parts:int,offset:long,length:long>>, error string"
)


def header_of(data: bytes) -> dict:
    if data[:2] != b"\xff\x4f":
        raise ValueError("no start of codestream")
    out: dict = {"tile_parts": []}
    at = 2
    while at + 2 <= len(data):
        marker = struct.unpack_from(">H", data, at)[0]
        if marker in (SOD, EOC):
            break
        if marker == EPH:
            at += 2
            continue
        if at + 4 > len(data):
            raise ValueError("cut off")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) < size - 2 or size < 2:
            raise ValueError("cut off")
        if marker == SIZ:
            _, x, y, x0, y0, tw, th, tx, ty, n = struct.unpack_from(">HIIIIIIIIH", body)
            if x < x0 or y < y0 or x < tx or y < ty or not tw or not th:
                raise ValueError("sizes do not fit")
            parts = [struct.unpack_from(">BBB", body, 36 + 3 * k) for k in range(n)]
            out |= {"width": x - x0, "height": y - y0, "tile_w": tw, "tile_h": th, "tiles_x": -(-(x - tx) // tw), "tiles_y": -(-(y - ty) // th), "components": [{"bits": (s & 127) + 1, "signed": s > 127, "dx": a, "dy": b} for s, a, b in parts]}
        elif marker == COD:
            _, order, layers, mct, levels, bw, bh, style, wavelet = struct.unpack_from(">BBHBBBBBB", body)
            out |= {"progression": PROGRESSIONS[order] if order < 5 else f"unknown {order}", "layers": layers, "transform": mct != 0, "levels": levels, "block_w": 1 << bw + 2, "block_h": 1 << bh + 2, "block_style": style, "wavelet": WAVELETS[wavelet] if wavelet < 2 else f"unknown {wavelet}"}
        elif marker == QCD:
            kind = body[0] & 31
            if kind > 2 or (kind and (len(body) - 1) % 2):
                raise ValueError("quantisation is malformed")
            out |= {"quantisation": QUANTISATIONS[kind], "steps": len(body) - 1 if not kind else (len(body) - 1) // 2}
        elif marker == SOT:
            tile, length, part, parts = struct.unpack_from(">HIBB", body)
            inner = at + 2 + size
            while True:
                if inner + 2 > len(data):
                    raise ValueError("a tile part ends before its data")
                m = struct.unpack_from(">H", data, inner)[0]
                inner += 2
                if m == SOD:
                    break
                if m == EOC:
                    raise ValueError("a tile part ends before its data")
                if m != EPH:
                    inner += struct.unpack_from(">H", data, inner)[0]
            end = at + length if length else len(data)
            if not inner <= end <= len(data):
                raise ValueError("a tile part is out of bounds")
            out["tile_parts"].append({"tile": tile, "part": part, "parts": parts, "offset": inner, "length": end - inner})
            at = end
            continue
        at += 2 + size
    for name, key in (("SIZ", "width"), ("COD", "layers"), ("QCD", "steps")):
        if key not in out:
            raise ValueError(f"no {name}")
    return out


def header(c: Column) -> Column:
    """A struct of HEADER; error where the stream is malformed."""

    @F.pandas_udf(HEADER)
    def of(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append(header_of(bytes(v or b"")))
            except (ValueError, struct.error, IndexError) as error:
                rows.append({"error": str(error) or "cut off"})
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in _NAMES})

    return of(c)


_NAMES = ["width", "height", "tile_w", "tile_h", "tiles_x", "tiles_y", "components", "progression", "layers", "transform", "levels", "block_w", "block_h", "block_style", "wavelet", "quantisation", "steps", "tile_parts", "error"]


def subset_error(h: Column) -> Column:
    """The first thing about a header that the narrow decoder does not take: one tile in one part, three unsigned components of 8
    bits with luma whole and chroma alike at 1 or 2, a known wavelet, blocks of 64 by 64 or 4096 samples at most, plain or
    high-throughput coding, at least one layer, and as many quantiser steps as the style has."""
    p, c = h["tile_parts"], h["components"]
    plain = F.forall(c, lambda x: (x["bits"] == 8) & ~x["signed"])
    y, b, r = (F.get(c, F.lit(i)) for i in range(3))
    part = F.get(p, F.lit(0))
    out = F
    for bad, code in (
        (h["error"].isNotNull(), "Malformed"), ((h["tiles_x"] != 1) | (h["tiles_y"] != 1), "TileGrid"), (F.size(p) != 1, "TileParts"), ((part["part"] != 0) | (part["parts"] > 1), "TilePartIndex"), (F.size(c) != 3, "Components"),
        (~plain, "Precision"), ((y["dx"] != 1) | (y["dy"] != 1), "LumaSampling"), ((b["dx"] != r["dx"]) | (b["dy"] != r["dy"]), "ChromaSampling"), (~b["dx"].isin(1, 2) | ~b["dy"].isin(1, 2), "ChromaSampling"),
        (~h["wavelet"].isin(*WAVELETS), "Wavelet"), ((h["block_w"] > 64) | (h["block_h"] > 64) | (h["block_w"] * h["block_h"] > 4096), "CodeBlock"), (~h["block_style"].isin(0, 0x40), "CodeBlockStyle"), (h["layers"] == 0, "Layers"),
        ((h["quantisation"] == "derived") & (h["steps"] != 1), "QuantSteps"), ((h["quantisation"] == "expounded") & (h["steps"] != 3 * h["levels"] + 1), "QuantSteps"),
    ):
        out = out.when(bad, code)
    return out
