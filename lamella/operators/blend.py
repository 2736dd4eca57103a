"""Regions from tiles at fractional places: bilinear weights and alpha-over in draw order, in 32-bit floats.

A tile has one offset, so its four bilinear weights are the same at all of its pixels: the tile in a border of nothing is
added to itself shifted by one, with those weights, once for its samples and once for its cover. A tile within 1e-6 of whole
pixels is copied and opaque; samples of 16 bits or floats are always placed at the rounded pixel.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR = 1e-6
KIND = "request_id long, w long, h long, channels int, data array<int>"


def _overlap(at: int, n: int, size: int) -> tuple[slice, slice]:
    """Of a run of n placed at ``at``: what of it, and where in a canvas of this size."""
    a, z = max(0, at), max(0, min(size, at + n))
    z = max(a, z)
    return slice(a - at, z - at), slice(a, z)


def blend(width: int, height: int, channels: int, tiles: Iterable[tuple[float, float, np.ndarray]], fractional: bool = True) -> np.ndarray:
    """tiles: x, y and samples (rows, columns, channels), in draw order. What no tile covers is zero."""
    out, alpha = np.zeros((height, width, channels), dtype=np.float32), np.zeros((height, width, 1), dtype=np.float32)
    for x, y, tile in tiles:
        whole_x, whole_y = int(np.floor(x + 0.5)) if x >= 0 else -int(np.floor(-x + 0.5)), int(np.floor(y + 0.5)) if y >= 0 else -int(np.floor(-y + 0.5))
        if not fractional or (abs(x - whole_x) <= NEAR and abs(y - whole_y) <= NEAR):
            (sx, dx), (sy, dy) = _overlap(whole_x, tile.shape[1], width), _overlap(whole_y, tile.shape[0], height)
            out[dy, dx], alpha[dy, dx] = tile[sy, sx], 1
            continue
        left, top = int(np.floor(x)), int(np.floor(y))
        # pixel `left` shows source place left - x, which lies between -1 and 0
        wx, wy = left - x - np.floor(left - x), top - y - np.floor(top - y)
        cover = np.pad(np.ones((*tile.shape[:2], 1), dtype=np.float32), ((1, 1), (1, 1), (0, 0)))
        color = np.pad(tile.astype(np.float32) / np.float32(255), ((1, 1), (1, 1), (0, 0)))
        weights = [(np.float32(a) * np.float32(b), j, i) for j, b in ((0, 1 - wy), (1, wy)) for i, a in ((0, 1 - wx), (1, wx))]
        mixed = lambda m: sum(k * m[j : m.shape[0] - 1 + j, i : m.shape[1] - 1 + i] for k, j, i in weights)
        src_a, src = mixed(cover), mixed(color)
        # on an axis in whole pixels the first place is the border's, and lies a pixel before
        (sx, dx), (sy, dy) = _overlap(left - (wx == 0), src.shape[1], width), _overlap(top - (wy == 0), src.shape[0], height)
        src_a, src = src_a[sy, sx], src[sy, sx]
        dst_a = alpha[dy, dx]
        new_a = src_a + dst_a * (1 - src_a)
        new = (src + out[dy, dx] / np.float32(255) * dst_a * (1 - src_a)) / np.where(new_a > 0, new_a, np.float32(1))
        shown = src_a > 0
        out[dy, dx] = np.where(shown, np.clip(np.floor(new * 255 + np.float32(0.5)), 0, 255), out[dy, dx])
        alpha[dy, dx] = np.where(shown, new_a, dst_a)
    return out


def compose(hits: DataFrame, fractional: bool = True) -> DataFrame:
    """hits: request_id, w, h, ordinal, dest_xf, dest_yf, tile_w, tile_h, channels, data (array of samples, interleaved).
    A region is one request's answer and fits in a task; requests are spread over all of them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        one = frame.iloc[0]
        tiles = ((r.dest_xf, r.dest_yf, np.asarray(r.data).reshape(r.tile_h, r.tile_w, one.channels)) for r in frame.itertuples())
        out = blend(int(one.w), int(one.h), int(one.channels), tiles, fractional)
        return pd.DataFrame([(one.request_id, one.w, one.h, one.channels, out.ravel().astype(np.int32))], columns=["request_id", "w", "h", "channels", "data"])

    return hits.select("request_id", "w", "h", "ordinal", "dest_xf", "dest_yf", F.col("tile_w").cast("int"), F.col("tile_h").cast("int"), "channels", "data").groupBy("request_id").applyInPandas(run, KIND)
