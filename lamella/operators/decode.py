"""Frames and codestreams: DICOM run lengths, raw frames to RGB, photometric rules, packet orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.codecs import packbits_decode_bytes, packbits_encode_bytes
from lamella.operators.vendor import TRANSFER_SYNTAX, lookup

#: The five progressions: the order of the loops, outermost first (layer, resolution, component, precinct).
PROGRESSIONS = {"LRCP": ("layer", "res", "comp", "prec"), "RLCP": ("res", "layer", "comp", "prec"), "RPCL": ("res", "prec", "comp", "layer"), "PCRL": ("prec", "comp", "res", "layer"), "CPRL": ("comp", "prec", "res", "layer")}


def rle_encode_frame(planes: list[bytes]) -> bytes:
    """A DICOM run-length frame: 16 numbers (how many segments, where each starts), then a segment for each plane."""
    segments = [packbits_encode_bytes(p) for p in planes]
    segments = [s + b"\0" * (len(s) % 2) for s in segments]
    starts = 64 + np.cumsum([0, *map(len, segments)])[:-1]
    return np.array([len(segments), *starts, *[0] * (15 - len(segments))], dtype="<u4").tobytes() + b"".join(segments)


def rle_decode_frame(frame: bytes, pixels: int, samples: int) -> bytes | None:
    """Interleaved samples; null where the header or a segment does not fit."""
    if len(frame) < 64:
        return None
    head = np.frombuffer(frame[:64], dtype="<u4").tolist()
    n, starts = head[0], head[1 : 1 + head[0]]
    if n != samples or any(a >= z for a, z in zip(starts, [*starts[1:], len(frame) + 1])) or (starts and starts[0] < 64):
        return None
    planes = [packbits_decode_bytes(frame[a:z], pixels) for a, z in zip(starts, [*starts[1:], len(frame)])]
    if any(p is None for p in planes):
        return None
    return np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1).tobytes()


def rle_decode(frame: Column, pixels: Column, samples: int) -> Column:
    @F.pandas_udf("binary")
    def of(frames: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else rle_decode_frame(f, int(k), samples) for f, k in zip(frames, n)])

    return of(frame, pixels)


def rle_encode(raw: Column, samples: int) -> Column:
    """raw: interleaved samples."""

    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else rle_encode_frame([bytes(v[k::samples]) for k in range(samples)]))

    return of(raw)


def transfer_syntax(uid: Column) -> Column:
    return lookup(uid, TRANSFER_SYNTAX, F.lit("Unsupported"))


def packet_order(images: DataFrame, key: str, progression: str) -> DataFrame:
    """images: key, layers, resolutions, components, precincts. Every packet with its place in the progression."""
    n = {"layer": "layers", "res": "resolutions", "comp": "components", "prec": "precincts"}
    out = images
    for name, count in n.items():
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*PROGRESSIONS[progression])) - 1
    return out.withColumn("place", place).select(key, "layer", "res", "comp", "prec", "place")


def mcu_starts_are_absolute(starts: Column, strip_offset: Column, strip_bytes: Column) -> Column:
    """Whether restart places count from the file's start: all lie within the strip's range in the file, and not all within its length."""
    inside = F.forall(starts, lambda s: (s >= strip_offset) & (s < strip_offset + strip_bytes))
    return inside & F.exists(starts, lambda s: s >= strip_bytes)


def normalized_mcu_start(start: Column, absolute: Column, strip_offset: Column) -> Column:
    return F.when(absolute, F.greatest(start - strip_offset, F.lit(0))).otherwise(start)
