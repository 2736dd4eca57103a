import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import blend, control


def by_pixel(width, height, tiles):
    """Alpha-over pixel by pixel; each tile's four neighbours weigh by nearness."""
    out, alpha = np.zeros((height, width)), np.zeros((height, width))
    for x, y, t in tiles:
        for oy in range(height):
            for ox in range(width):
                if abs(x - round(x)) <= 1e-6 and abs(y - round(y)) <= 1e-6:
                    sx, sy = ox - round(x), oy - round(y)
                    if 0 <= sx < t.shape[1] and 0 <= sy < t.shape[0]:
                        out[oy, ox], alpha[oy, ox] = t[sy, sx, 0], 1
                    continue
                a = v = 0.0
                for j in (0, 1):
                    for i in (0, 1):
                        sx, sy = math.floor(ox - x) + i, math.floor(oy - y) + j
                        k = (1 - abs(ox - x - sx)) * (1 - abs(oy - y - sy))
                        if 0 <= sx < t.shape[1] and 0 <= sy < t.shape[0]:
                            a, v = a + k, v + k * t[sy, sx, 0] / 255
                if a > 0:
                    new = a + alpha[oy, ox] * (1 - a)
                    out[oy, ox] = min(255, max(0, math.floor(255 * (v + out[oy, ox] / 255 * alpha[oy, ox] * (1 - a)) / new + 0.5)))
                    alpha[oy, ox] = new
    return out


@pytest.mark.parametrize("seed", range(8))
def test_blend(seed):
    rng = random.Random(seed)
    values = np.random.default_rng(seed)
    tiles = [(rng.choice([-1.5, 0.25, 2.0, 3.75, 6.5]), rng.choice([-2.25, 0.0, 1.5, 4.0]), values.integers(0, 256, size=(4, 5, 1))) for _ in range(4)]
    got, expected = blend.blend(10, 8, 1, tiles)[:, :, 0], by_pixel(10, 8, tiles)
    assert np.abs(got - expected).max() <= 1


def test_whole_pixels_overwrite_and_holes_are_zero(spark):
    tile = [int(v) for v in range(1, 5)]
    rows = [(1, 4, 3, 0, 0.0, 0.0, 2, 2, 1, tile), (1, 4, 3, 1, 1.0, 1.0, 2, 2, 1, tile), (2, 2, 2, 0, 50.0, 0.0, 2, 2, 1, tile)]
    hits = spark.createDataFrame(rows, "request_id long, w long, h long, ordinal long, dest_xf double, dest_yf double, tile_w long, tile_h long, channels int, data array<int>")
    got = {r["request_id"]: r["data"] for r in blend.compose(hits).collect()}
    assert got == {1: [1, 2, 0, 0, 3, 1, 2, 0, 0, 3, 4, 0], 2: [0] * 4}


def test_cancel(spark):
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    failed = []

    def work():
        with control.cancellable(spark, "pan"):
            try:
                spark.range(400).select(slow("id").alias("x")).agg(F.sum("x")).collect()
            except Exception as error:
                failed.append(error)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(75):
        thread.join(0.2)
        if not thread.is_alive():
            break
        control.cancel(spark, "pan")
    thread.join(60)
    assert failed and not thread.is_alive()
