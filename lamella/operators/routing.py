"""How batches of tiles are routed between CPU and device, and the bounded memory of such decisions."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.fold import folded
from lamella.operators import timing

# Tiles of a sample, batch size that goes straight to the device, decisions that are remembered.
SAMPLE, DIRECT, REMEMBERED = 32, 8, 1024


def batch_keys(requests: DataFrame, by: str, sample: int = SAMPLE) -> DataFrame:
    """requests: by (the batch), dataset_id, scene, series, level, codec, tile_w, tile_h. A row for each batch: n, and its key,
    or null where the batch is mixed or its codec is not measured."""
    one = ["dataset_id", "scene", "series", "level", "codec", "tile_w", "tile_h"]
    out = requests.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*one)).alias("kinds"), F.first(F.struct(*one)).alias("k"))
    alike = (F.col("kinds") == 1) & F.col("k.codec").isin("Jp2k", "Htj2k")
    return out.select(by, "n", F.when(alike, F.struct("k.*", F.least("n", F.lit(sample)).alias("sampled"))).alias("key"))


def measured(batches: DataFrame) -> DataFrame:
    """batches: cpu_us, device_us, device_tiles, sampled. The winner; where the device made no tile, its sample is what is returned."""
    return batches.withColumn("winner", timing.route(F.col("cpu_us"), F.col("device_us"), F.col("device_tiles")))


def routes(batches: DataFrame, direct: int = DIRECT) -> DataFrame:
    """batches: n, key, adaptive, remembered (a winner, or null), winner (as measured). Adds route and whether it was measured."""
    c = F.col
    asked = ~c("adaptive") | c("key").isNull() | (c("n") >= direct)
    return batches.withColumns({"route": F.when(asked, "asked").otherwise(F.coalesce("remembered", "winner")), "measures": ~asked & c("remembered").isNull()})


def remembered(decisions: DataFrame, by: str, most: int = REMEMBERED) -> DataFrame:
    """decisions: by, seq, key, winner, in order of seq. Whether each one's key was remembered before it, and how many keys
    are after it: a memory of ``most`` keys, first in, first out; a key that is there takes its new winner and keeps its place."""

    def step(memory: OrderedDict, row) -> list[tuple]:
        known = row.key in memory
        if not known:
            while len(memory) >= most:
                memory.popitem(last=False)
        memory[row.key] = row.winner
        return [(getattr(row, by), row.seq, row.key, known, len(memory))]

    rows = decisions.select(by, "seq", "key", "winner")
    kind = rows.schema[by].dataType.simpleString()
    return folded(rows, [by], ["seq"], OrderedDict, step, None, f"{by} {kind}, seq long, key string, known boolean, held long")
