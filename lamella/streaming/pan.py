"""Pan traces as streams: tumbling windows of tile traffic, and a byte-budget cache kept for each reader."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamella.operators.cache_replay import ByteLru


def requests(events: DataFrame) -> DataFrame:
    """events, batch or stream, as tile requests."""
    return events.selectExpr("event_id as seq", "ts", "user_id % 16 as reader", "concat(user_id % 16, ':', cast(floor(value) as bigint) % 16) as key", "cast(length(event_type) * 1000 as bigint) as bytes")


def hourly(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tiles and bytes of each reader in windows of an hour; a stream drops what is later than the watermark."""
    source = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = source.groupBy(F.window("ts", "1 hour").alias("w"), "reader").agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes"))
    return out.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("window_start"), "reader", "tiles", "bytes")


def cached(rows: DataFrame, budget: int) -> DataFrame:
    """Hits and misses of each reader's cache so far; the state is the cache's entries, at most the budget's worth."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache, hits, misses = ByteLru(budget), 0, 0
        if state.exists:
            keys, sizes, hits, misses = state.get
            for k, n in zip(keys, sizes):
                cache.put(k, n)
        for frame in frames:
            for k, n in frame.sort_values(["ts", "seq"])[["key", "bytes"]].itertuples(index=False):
                if cache.get(k):
                    hits += 1
                else:
                    misses += 1
                    cache.put(k, int(n))
        state.update((list(cache.entries), list(cache.entries.values()), hits, misses))
        yield pd.DataFrame([(key[0], hits, misses, cache.held)], columns=["reader", "hits", "misses", "held"])

    return rows.groupBy("reader").applyInPandasWithState(
        step, "reader long, hits long, misses long, held long", "keys array<string>, sizes array<long>, hits long, misses long", "update", GroupStateTimeout.NoTimeout
    )


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
