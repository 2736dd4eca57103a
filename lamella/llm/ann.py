"""Approximate nearest neighbours by an inverted multi-index, for the inner product.

The two halves of a vector are quantised separately, by centroids that k-means finds on a bounded sample (``fit_rows``
rows, by a hash of the id). The lists are the centroid pairs. A query walks the pairs by summed distance (minus the
inner product of each half with its centroid) with a heap, until the pairs passed hold ``visit`` of all vectors; their
entries are reranked by exact inner products. ``visit`` is the least share of the grid below that reaches ``recall`` on
the sample, by brute force, with a margin; so data with structure visit little, and data without it visit much.

Entries are stored in blocks sorted by pair, queries in blocks of their own; a query block meets the entry blocks that
hold a pair it walks, each such meeting gives one row with the best of each query, and two merges by query block
(the first one salted) keep the best. A pair with a third of all vectors is many blocks. No task holds more than two blocks.

Defined results: vectors that are null or zero, hold null or non-finite components or have a null id take no part;
vectors meet those of their own length only, each length with an index of its own; a product that overflows counts as the
infinity it gives, one that is not a number as the least; a query's own row is no candidate, other rows that repeat its id
are; a repeated query is answered for each of its rows; ties go to the smaller id; with fewer candidates than ``k`` all
are given; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import materialize, table

K, CENTROIDS, FIT_ROWS, FIT_QUERIES, RECALL = 20, 32, 20_000, 200, 0.96
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
QUERY_BLOCK, ENTRY_BLOCK, SALTS = 512, 4096, 16
NONE = np.iinfo(np.int64).max  # in place of an id: nothing found


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds from seeded rows; an empty centroid stays where it was."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=col, minlength=len(c)) for col in x.T], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)


class MultiIndex:
    """Centroids of both halves, and how many vectors each pair holds. Vectors are scaled by a power of two, so that no
    sum of squares overflows; what lies far beyond the sample's largest is brought nearer. Both touch no score."""

    def __init__(self, left: np.ndarray, right: np.ndarray, scale: float = 1.0):
        self.left, self.right, self.half, self.scale = left, right, left.shape[1], scale
        self.counts = np.zeros(len(left) * len(right), dtype=np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(x * self.scale, -1e100, 1e100)

    def pairs(self, x: np.ndarray) -> np.ndarray:
        x = self.scaled(x)
        return nearest(x[:, : self.half], self.left) * len(self.right) + nearest(x[:, self.half :], self.right)

    def walk(self, query: np.ndarray, entries: float) -> np.ndarray:
        """Pairs by rising summed distance, until they hold so many entries. Returns a mask over all pairs."""
        query = self.scaled(query)
        a, b = -(self.left @ query[: self.half]), -(self.right @ query[self.half :])
        ai, bi = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, ai, bi = a[ai].tolist(), b[bi].tolist(), ai.tolist(), bi.tolist()
        counts, width = self.counts, len(b)
        passed = np.zeros(len(counts), dtype=bool)
        heap, held = [(a[0] + b[0], 0, 0)], 0
        while heap and held < entries:
            _, i, j = heapq.heappop(heap)
            pair = ai[i] * width + bi[j]
            passed[pair] = True
            held += int(counts[pair])
            if j + 1 < width:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return passed


def ranked(scores: np.ndarray) -> np.ndarray:
    """What to sort by: the largest first, what is not a number last."""
    return np.where(np.isnan(scores), np.inf, -scores)


def best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one query: ids and exact scores of its k best among x, ties to the smaller id. scores: exact up to slack."""
    at = np.flatnonzero(allowed)
    if len(at) > k and np.isfinite(slack):
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - 2 * slack]
    with np.errstate(over="ignore", invalid="ignore"):
        exact = (x[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], ranked(exact)))[:k]
    return ids[at][order], exact[order]


def fit(sample: np.ndarray, k: int = K, centroids: int = CENTROIDS, recall: float = RECALL) -> tuple[MultiIndex, float]:
    """The index without counts, and the share of all entries to visit."""
    half = (sample.shape[1] + 1) // 2
    scale = 2.0 ** -int(np.ceil(np.log2(np.abs(sample).max())))
    index = MultiIndex(np.zeros((1, half)), np.zeros((1, sample.shape[1] - half)), scale)
    sample = index.scaled(sample)
    index = MultiIndex(kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids))
    pair = index.pairs(sample)
    index.counts = np.bincount(pair, minlength=len(index.counts))
    n = len(sample)
    hits = {v: 0 for v in GRID}
    asked = range(0, n, max(1, n // FIT_QUERIES))
    true = 0
    for i in asked:
        scores = sample @ sample[i]
        scores[i] = -np.inf
        top = np.argsort(-scores, kind="stable")[: min(k, n - 1)]
        true += len(top)
        for v in GRID:
            hits[v] += int(index.walk(sample[i], v * n)[pair[top]].sum())
    visit = next((v for v in GRID if hits[v] >= recall * true), 1.0)
    index.scale = scale
    return index, visit


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


ENTRIES = "block long, ids binary, rows binary, vectors binary, pairs binary, holds array<int>"
QUERIES = "qb long, ids binary, rows binary, vectors binary, passed binary, walks array<int>"
FOUND = "qb long, ids binary, found_ids binary, found_scores binary"


def _blocks(index: MultiIndex, size: int, entries: float | None):
    """Blocks of entries (entries None), or of queries that walk until they hold so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block(ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            if entries is None:
                pair = index.pairs(x)
                extra, cells = pair.astype("<i4"), np.unique(pair)
            else:
                passed = np.stack([index.walk(q, entries) for q in x])
                extra, cells = np.packbits(passed, axis=1), np.flatnonzero(passed.any(axis=0))
            names = ENTRIES if entries is None else QUERIES
            columns = [[number - 1], [ids.astype("<i8").tobytes()], [rows.astype("<i8").tobytes()], [x.astype("<f8").tobytes()], [extra.tobytes()], [cells.astype(np.int32)]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[p.split()[0] for p in names.split(", ")])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _vectors(batch.column(2))))
            while sum(len(x[0]) for x in held) >= size:
                all_ = [np.concatenate(c) for c in zip(*held)]
                yield block(*(c[:size] for c in all_))
                held = [tuple(c[size:] for c in all_)] if len(all_[0]) > size else []
        if held:
            yield block(*(np.concatenate(c) for c in zip(*held)))

    return run


def _meet(k: int, dim: int, pairs: int):
    """A query block and an entry block in each row; gives ids and scores of each query's best, -1 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qb, q_ids, q_rows, q, passed, ids, rows, x, pair = (batch.column(c)[r].as_py() for c in range(9))
                q_ids, q_rows, ids, rows, pair = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), np.frombuffer(pair, "<i4")
                q, x = np.frombuffer(q, "<f8").reshape(-1, dim), np.frombuffer(x, "<f8").reshape(-1, dim)
                open_ = np.unpackbits(np.frombuffer(passed, np.uint8).reshape(len(q), -1), axis=1)[:, :pairs].astype(bool)
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = q @ x.T
                    # how far rounding can move a sum of dim products; not finite where one may overflow
                    slack = 2 * dim * np.finfo(float).eps * np.sqrt((q**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max())
                found, values = np.full((len(q), k), NONE, dtype="<i8"), np.full((len(q), k), -np.inf)
                for i in range(len(q)):
                    a, s = best(scores[i], q[i], x, ids, open_[i][pair] & (rows != q_rows[i]), k, slack[i])
                    found[i, : len(a)], values[i, : len(a)] = a, s
                yield pa.RecordBatch.from_arrays([pa.array([qb]), pa.array([q_ids.tobytes()]), pa.array([found.tobytes()]), pa.array([values.tobytes()])], names=["qb", "ids", "found_ids", "found_scores"])

    return run


def _merge(k: int):
    """Rows sorted by query block: one row for each, with the best of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state[0]]), pa.array([state[1].tobytes()]), pa.array([state[2].tobytes()])], names=["qb", "ids", "found_ids", "found_scores"])

        for batch in batches:
            for r in range(batch.num_rows):
                qb, ids, found, values = (batch.column(c)[r].as_py() for c in range(4))
                found, values = np.frombuffer(found, "<i8").reshape(-1, k), np.frombuffer(values, "<f8").reshape(-1, k)
                if qb != now:
                    if state:
                        yield out()
                    now, state = qb, (ids, found, values)
                    continue
                found, values = np.concatenate([state[1], found], axis=1), np.concatenate([state[2], values], axis=1)
                order = np.lexsort((found, ranked(values)), axis=1)[:, :k]
                state = (ids, np.take_along_axis(found, order, 1), np.take_along_axis(values, order, 1))
        if state:
            yield out()

    return run


def _rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                _, ids, found, values = (batch.column(c)[r].as_py() for c in range(4))
                ids, found, values = np.frombuffer(ids, "<i8"), np.frombuffer(found, "<i8"), np.frombuffer(values, "<f8")
                query, rank, real = np.repeat(ids, k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids)), found != NONE
                yield pa.RecordBatch.from_arrays([pa.array(c[real]) for c in (query, rank, found, values)], names=["query_id", "rank", "vec_id", "score"])

    return run


def _searched(entries: DataFrame, asked: DataFrame, dim: int, n: int, k: int, fit_rows: int, centroids: int, recall: float) -> DataFrame:
    """entries, asked: id, u (number of the row), v, all of one length."""
    sample = np.array([x["v"] for x in entries.orderBy(F.xxhash64("id", "u"), "id", "u").limit(fit_rows).select("v").collect()])
    index, visit = fit(sample, k, min(centroids, len(sample)), recall)

    @F.pandas_udf("int")
    def assign(vectors: pd.Series) -> pd.Series:
        return pd.Series(index.pairs(np.array(vectors.tolist(), dtype=float).reshape(-1, dim)).astype(np.int32))

    paired = entries.withColumn("pair", assign("v"))
    counted = paired.groupBy("pair").count().collect()  # at most centroids ** 2 rows
    index.counts = np.zeros(len(index.left) * len(index.right), dtype=np.int64)
    for x in counted:
        index.counts[x["pair"]] = x["count"]
    parts = max(1, -(-n // (4 * ENTRY_BLOCK)))
    e_blocks = materialize(paired.repartitionByRange(parts, "pair", "id").sortWithinPartitions("pair", "id").select("id", "u", "v").mapInArrow(_blocks(index, ENTRY_BLOCK, None), ENTRIES))
    q_parts = max(1, -(-n // (80 * QUERY_BLOCK)))
    q_sorted = asked.withColumn("pair", assign("v")).repartitionByRange(q_parts, "pair", "id").sortWithinPartitions("pair", "id").select("id", "u", "v")
    q_blocks = materialize(q_sorted.mapInArrow(_blocks(index, QUERY_BLOCK, max(visit * n, k + 1)), QUERIES))
    pairs = (
        q_blocks.select("qb", F.explode("walks").alias("pair"))
        .join(e_blocks.select("block", F.explode("holds").alias("pair")), "pair").select("qb", "block").distinct()
    )
    left = q_blocks.select("qb", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q"), "passed")
    met = pairs.join(left, "qb").join(e_blocks.drop("holds"), "block").select("qb", "q_ids", "q_rows", "q", "passed", "ids", "rows", "vectors", "pairs")
    found = met.mapInArrow(_meet(k, dim, len(index.counts)), FOUND)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("found_ids"), F.lit(SALTS))).repartition("qb", "salt").sortWithinPartitions("qb").select("qb", "ids", "found_ids", "found_scores").mapInArrow(_merge(k), FOUND)
    merged = salted.repartition("qb").sortWithinPartitions("qb").mapInArrow(_merge(k), FOUND)
    return merged.mapInArrow(_rows(k), FOUND_ROWS)


FOUND_ROWS = "query_id long, rank int, vec_id long, score double"


def search(
    vectors: DataFrame, queries: DataFrame | Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS, recall: float = RECALL,
) -> DataFrame:
    """queries: which of the vectors ask, as a condition on their rows; or rows of the same form, whose own row is then
    any of their id. Rows query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    inside = isinstance(queries, Column)
    plain = lambda df, *more: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *more)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    usable = lambda df: df.filter(F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda e: e != 0))
    number = F.monotonically_increasing_id() if inside else F.col("id")
    asks = F.coalesce(queries, F.lit(False)) if inside else F.lit(False)
    entries = materialize(usable(plain(vectors, asks.alias("asks"))).select("id", "asks", "v", number.alias("u")))
    asked = entries.filter("asks") if inside else usable(plain(queries)).select("id", "v", F.col("id").alias("u"))
    out = spark.createDataFrame([], FOUND_ROWS)
    for x in entries.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        own = F.size("v") == x["dim"]
        out = out.unionByName(_searched(entries.filter(own), asked.filter(own), x["dim"], x["count"], k, fit_rows, centroids, recall))
    return out


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
