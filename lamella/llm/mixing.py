"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are exact word counts. The targets come from the sources' totals: each share of the whole mix stops at ``cap``
times the source, and the excess is shared again by weight. A source takes all its documents ``floor(target / size)``
times. For the budget that remains its documents stand in ``BUCKETS`` buckets by a seeded hash: the first buckets go in
whole as far as the budget reaches, so that every size gives its share, and a region about the edge (one bucket, or as many
as hold ``SPARE`` documents) is fitted. Its documents are counted by exact size; every size gives its proportional share
(rounded so that no run of sizes is a whole document off), and a bounded-knapsack dynamic program (binary splitting over
bit sets) over the counts that are left closes the gap of about ``RESERVE`` mean documents, to the word where some subset
does. The program's table is ``REACH`` words wide; a wider gap (the mean document then has over 260,000 words) first goes to
the longest documents. A size's documents are taken in the order of the hash. Only rows of the region shuffle and are ranked.

Defined results: null text has size 0; a document of size 0 takes 0 words and stays once in the repeated form; a null
source is a source of its own, the last; repeated rows are documents of their own; ties in the hash fall to the id,
then to any (such rows are alike); an empty table gives an empty result. The driver sees one total for each source, at most
``max_sources`` of them, beyond which an error is raised; a task of the fit sees the distinct sizes in one source's region.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import materialize, table, word_count

WEIGHTS, SHARE, CAP, SEED, BUCKETS, MAX_SOURCES, REACH, RESERVE = (5, 2, 1), 1.5, 2, 20, 256, 100_000, 1 << 20, 4
SPARE = 64  # documents of a source that its region has, and half as many that are left to the program, at least


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words for each source; those above cap x size stop there and the rest is shared again until none is above."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > cap * sizes[i]]
        for i in over or open_:
            out[i] = float(cap * sizes[i]) if over else left * weights[i] / whole
        if not over:
            break
        open_ -= set(over)
        left -= sum(out[i] for i in over)
    return out


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """How many documents of each size to take so that the words come as near to budget as can be from below."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    take = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    rest = budget - int((take * sizes).sum())
    rising = np.argsort(sizes, kind="stable").tolist()
    sums, over = total // 2, []  # of the shares' remainders: where they pass a whole one, that size gives one more
    for i in rising:
        left = int(counts[i]) * budget % total
        if (sums + left) // total > sums // total:
            over.append(i)
        sums += left
    keep, spare = RESERVE * total // int(counts.sum()), int((counts - take).sum())
    for i in np.random.default_rng(SEED).permutation(np.array(over, dtype=np.int64)).tolist():
        if rest - int(sizes[i]) >= keep and spare > SPARE // 2:
            take[i] += 1
            spare -= 1
            rest -= int(sizes[i])
    free = counts - take
    order = [int(i) for i in np.argsort(-sizes, kind="stable") if sizes[i] > 0]
    for i in order:  # what no table of this width holds goes to the longest documents first
        if rest <= reach:
            break
        n = min(int(free[i]), (rest - reach) // int(sizes[i]))
        take[i] += n
        free[i] -= n
        rest -= n * int(sizes[i])
    can, mask, layers = 1, (1 << (rest + 1)) - 1, []
    for i in order:
        s, n, q = int(sizes[i]), min(int(free[i]), rest // int(sizes[i])), 1
        while n > 0 and not can >> rest & 1:
            q = min(q, n)
            layers.append((i, q, can))
            can |= can << q * s & mask
            n, q = n - q, q * 2
        if can >> rest & 1:
            break
    at = can.bit_length() - 1
    for i, q, before in reversed(layers):
        if not before >> at & 1:
            at -= q * int(sizes[i])
            take[i] += q
    return take


def region(words: np.ndarray, docs: np.ndarray, budget: float, spare: int = SPARE) -> tuple[int, int]:
    """words, docs: of each bucket. The buckets [lo, hi) about the one where their words pass the budget."""
    past = np.cumsum(words)
    lo = min(int(np.searchsorted(past, budget, side="right")), len(words) - 1)
    hi = lo + 1
    while docs[lo:hi].sum() < spare and (lo > 0 or hi < len(words)):
        lo, hi = max(0, lo - 1), min(len(words), hi + 1)
    return lo, hi


def annotate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights: tuple = WEIGHTS,
    share: float = SHARE, cap: float = CAP, seed: int = SEED, max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """All rows, as struct ``row``, with size, source_size, target and taken."""
    spark = docs.sparkSession
    base = docs.select(
        F.struct("*").alias("row"), (word_count(F.col(text_col)) if size is None else size).alias("size"), F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("source"), F.xxhash64(F.lit(seed), id_col, text_col).alias("r"),
    ).withColumn("bucket", F.pmod("r", F.lit(BUCKETS)).cast("int"))
    counted = materialize(base.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    by_bucket = counted.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    totals = by_bucket.groupBy("source").agg(F.sum("words").alias("words")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals = sorted(totals, key=lambda x: (x["source"] == "n", x["source"]))
    words = [x["words"] for x in totals]
    aims = targets(words, [weights[i % len(weights)] for i in range(len(words))], share, cap)
    rest = [round(t - w * (t // w)) if w else 0 for w, t in zip(words, aims)]
    aim = spark.createDataFrame([(x["source"], w, t, int(t // w) if w else 0, r) for x, w, t, r in zip(totals, words, aims, rest)], "source string, source_size long, target double, whole int, rest long")

    def edge(part: pd.DataFrame) -> pd.DataFrame:
        at = part["bucket"].to_numpy()
        w, n = (np.bincount(at, weights=part[c], minlength=BUCKETS) for c in ("words", "docs"))
        lo, hi = region(w, n, part["rest"].iloc[0])
        return part[["source"]].head(1).assign(lo=lo, hi=hi, before=int(w[:lo].sum()))

    edges = by_bucket.join(F.broadcast(aim), "source").groupBy("source").applyInPandas(edge, "source string, lo int, hi int, before long")
    plan = materialize(aim.join(edges, "source"))  # one row a source

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        budget = int(part["rest"].iloc[0] - part["before"].iloc[0])
        return part[["source", "size"]].assign(quota=fit_counts(part["size"].to_numpy(), part["n"].to_numpy(), budget))

    inside = (F.col("bucket") >= F.col("lo")) & (F.col("bucket") < F.col("hi"))
    sizes = counted.join(F.broadcast(plan), "source").filter(inside).groupBy("source", "size", "rest", "before").agg(F.sum("n").alias("n"))
    quotas = materialize(sizes.groupBy("source").applyInPandas(fit, "source string, size long, quota long"))
    planned = base.join(F.broadcast(plan), "source")
    ranked = planned.filter(inside).join(quotas, ["source", "size"]).withColumn("rn", F.row_number().over(Window.partitionBy("source", "size").orderBy("r", "id")))
    taken = lambda rows, more: rows.select("row", "size", "source_size", "target", (F.col("size") * (F.col("whole") + more.cast("int"))).alias("taken"))
    return taken(planned.filter(~inside), F.col("bucket") < F.col("lo")).unionByName(taken(ranked, F.col("rn") <= F.col("quota")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of docs."""
    times = F.when(F.col("size") == 0, 1).otherwise((F.col("taken") / F.col("size")).cast("int"))
    return annotate(docs, **options).filter(times > 0).select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return annotate(docs).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")
