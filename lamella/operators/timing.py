"""Rules over benchmark timings. 1.05, 500 us, 2 runs, 3 pairs, 20 and 100 samples; 2.0, 5, 2, 1.3, 0.8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATENCIES = ["p50_us", "p95_us", "p99_us", "mean_us"]
LEAST_SAMPLES = {"p95_us": 20, "p99_us": 100}


def comparable(metrics: DataFrame) -> DataFrame:
    """metrics: metric, samples. Tail latencies count only where enough samples stand behind them."""
    least = F.lit(0)
    for name, n in LEAST_SAMPLES.items():
        least = F.when(F.col("metric") == name, n).otherwise(least)
    return metrics.filter(F.col("samples") >= least)


def worse(metric: Column, before: Column, after: Column) -> Column:
    """Above the ratio; a latency by the floor as well. What was zero cannot get worse."""
    return (before > 0) & (after.cast("double") / before > 1.05) & (~metric.isin(LATENCIES) | (after - before >= 500))


def summaries(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """before, after: by, metric, repeat, samples, value. Of each metric with three pairs or more: the (upper) medians, and how
    many pairs are worse; it has regressed if two are, and the medians too."""
    keys = [*by, "metric"]
    pairs = comparable(before).withColumnRenamed("value", "b").drop("samples").join(comparable(after).withColumnRenamed("value", "a").drop("samples"), [*keys, "repeat"])
    upper = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c} desc)").cast("long")
    out = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), upper("b").alias("before"), upper("a").alias("after"), F.count_if(worse(F.col("metric"), F.col("b"), F.col("a"))).alias("slower"))
    out = out.filter("pairs >= 3")
    return out.withColumn("regressed", (F.col("slower") >= 2) & worse(F.col("metric"), F.col("before"), F.col("after")))


def verdict(our_p50: Column, our_p99: Column, their_p50: Column, their_p99: Column) -> Column:
    """HOTSPOT, JITTER, slower, FASTER or ok; n/a where a median is missing."""
    ratio = our_p50 / their_p50
    jitter = our_p99 / our_p50
    return (
        F.when(our_p50.isNull() | their_p50.isNull(), "n/a").when(ratio > 2.0, "HOTSPOT").when((jitter > 5) & (jitter > 2 * (their_p99 / their_p50)), "JITTER")
        .when(ratio > 1.3, "slower").when(ratio < 0.8, "FASTER").otherwise("ok")
    )


def route(cpu_us: Column, device_us: Column, device_tiles: Column) -> Column:
    """The device wins if it made tiles in at most 0.85 of the time."""
    return F.when((device_tiles > 0) & (device_us <= cpu_us * 0.85), "device").otherwise("cpu")
