"""Tile places from stitching joints: a walk from a seed tile along the joints of each area."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "area long, tile long, x double, y double"


def joint_delta(direction: Column, tile_w: Column, tile_h: Column, overlap_x: Column, overlap_y: Column) -> tuple[Column, Column]:
    """How far the joint's second tile is from its first; null for an unknown direction."""
    dx = F.when(direction == "RIGHT", tile_w - overlap_x).when(direction == "LEFT", overlap_x - tile_w).when(direction.isin("UP", "DOWN"), F.lit(0.0))
    dy = F.when(direction == "UP", overlap_y - tile_h).when(direction == "DOWN", tile_h - overlap_y).when(direction.isin("LEFT", "RIGHT"), F.lit(0.0))
    return dx, dy


def places(joints: DataFrame) -> DataFrame:
    """joints: area, a, b, dx, dy. Breadth first from the least tile of each area, a joint both ways, the lower tile first;
    tiles that no joint reaches from there are absent. An area is one scan's tiles, so its joints fit in a task."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float, float]]] = {}
        for r in frame.itertuples(index=False):
            near.setdefault(r.a, []).append((r.b, r.dx, r.dy))
            near.setdefault(r.b, []).append((r.a, -r.dx, -r.dy))
        seed = min(near)
        at, queue = {seed: (0.0, 0.0)}, deque([seed])
        while queue:
            t = queue.popleft()
            for n, dx, dy in sorted(near[t]):
                if n not in at:
                    at[n] = (at[t][0] + dx, at[t][1] + dy)
                    queue.append(n)
        return pd.DataFrame([(frame.area.iloc[0], t, x, y) for t, (x, y) in sorted(at.items())], columns=["area", "tile", "x", "y"])

    return joints.groupBy("area").applyInPandas(walk, KIND)


def weighted_overlap(joints: DataFrame, by: str) -> DataFrame:
    """Mean overlaps of vertical and horizontal joints, weighted by confidence."""
    up = F.col("direction") == "UP"
    mean = lambda on: F.sum(F.when(on, F.col("confidence") * -F.col("overlap"))) / F.sum(F.when(on, F.col("confidence")))
    return joints.groupBy(by).agg(mean(up).alias("vertical"), mean(~up).alias("horizontal"))
