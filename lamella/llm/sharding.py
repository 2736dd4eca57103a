"""Sharding by Karmarkar-Karp differencing, for near equal bytes.

Equal texts are one indivisible group and stay together, however many they are: a group that outweighs a shard's share
makes its shard the largest, and the others share the rest. Groups above half a task's share of a shard (at most 48 for
each partition, the bound of what reaches the driver) are differenced first; the rest are differenced in their partitions,
in runs of at most ``run`` groups, against a partial partition that holds the large groups' loads in proportion, so that
small groups fill what large ones leave. Differencing: while two partial partitions are left, combine the two of largest
spread, oppositely ordered. A group's rows are never in one task: the join that places them can be split, and slots are
counted by hash buckets of rows.

Defined results: null text has no bytes; repeated rows get slots of their own; slots follow (bucket of a hash, id, scan
order); an empty table gives an empty result; a null id sorts first; shards may be empty where groups are few.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import materialize, shuffle_partitions, table, text_or_empty

SHARDS, OVERHEAD, RUN = 24, 8, 1 << 15


def differencing(sizes: np.ndarray, k: int, loaded: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item. loaded: what shards 0 to k-1 hold already."""
    n = len(sizes)
    sums: dict[int, np.ndarray] = {}
    own = np.arange(k)
    for i, s in enumerate(sizes.tolist()):
        sums[i] = np.zeros(k)
        sums[i][0] = s
    first = n
    if loaded is not None:
        own = np.argsort(-loaded, kind="stable")
        sums[n] = loaded[own].astype(float)
        first += 1
    heap = [(-float(v[0] - v[-1]), i) for i, v in sums.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        v = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        new = first + len(made)
        made.append((a, b, order))
        sums[new] = v
        heapq.heappush(heap, (-float(v[0] - v[-1]), new))
    if not heap:
        return np.zeros(0, dtype=np.int32)
    names = {heap[0][1]: np.arange(k)}  # of each partial partition's slots: the slot of the whole that they end in
    for new in range(len(made) - 1, -1, -1):
        a, b, order = made[new]
        raw = np.empty(k, dtype=np.int64)
        raw[order] = names.pop(first + new)
        names[a], names[b] = raw, raw[::-1]
    shard = np.arange(k)
    if loaded is not None:
        shard[names[n]] = own
    return np.array([shard[names[i][0]] for i in range(n)], dtype=np.int32)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, run: int = RUN) -> DataFrame:
    """All rows: doc_id, size, text_crc32, text_md5, shard, slot."""
    spark = docs.sparkSession
    t = text_or_empty(text_col)
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(t.cast("binary")).alias("text_md5"), F.monotonically_increasing_id().alias("u")))
    groups = rows.groupBy("text_md5").agg(F.sum("size").alias("size"))
    total, n_groups = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(1, min(4096, shuffle_partitions(spark), n_groups // (100 * shards)))  # enough groups in each to level it
    large = total / shards / parts / 2
    big = sorted(groups.filter(F.col("size") > large).collect(), key=lambda x: (-x["size"], x["text_md5"]))  # at most 2 x shards x parts
    placed = differencing(np.array([x["size"] for x in big], dtype=np.float64), shards)
    loads = np.bincount(placed, weights=[x["size"] for x in big], minlength=shards).astype(float) if big else np.zeros(shards)
    small_total = max(1.0, total - loads.sum())

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([*frames, pd.DataFrame({"text_md5": [], "size": []})]).sort_values("text_md5")
        for at in range(0, len(held), run):
            x = held.iloc[at : at + run]
            sizes = x["size"].to_numpy(dtype=np.float64)
            yield x[["text_md5"]].assign(shard=differencing(sizes, shards, loads * (sizes.sum() / small_total)))

    kind = "text_md5 string, shard int"
    small = groups.filter(F.col("size") <= large).repartition(parts, "text_md5").mapInPandas(local, kind)
    of_big = spark.createDataFrame([(x["text_md5"], int(s)) for x, s in zip(big, placed)], kind)
    where = materialize(small.unionByName(of_big))
    out = rows.join(where, "text_md5").withColumn("sub", F.pmod(F.xxhash64("doc_id", "u"), F.lit(parts)))
    out = materialize(out.select("doc_id", "size", "text_crc32", "text_md5", "shard", "sub", "u"))
    counts = out.groupBy("shard", "sub").count()
    starts = counts.select("shard", "sub", (F.sum("count").over(Window.partitionBy("shard").orderBy("sub")) - F.col("count")).alias("start"))  # parts rows a shard
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "u")) - 1
    return out.join(F.broadcast(starts), ["shard", "sub"]).select("doc_id", "size", "text_crc32", "text_md5", "shard", (F.col("start") + rank).cast("long").alias("slot"))


def op7_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
