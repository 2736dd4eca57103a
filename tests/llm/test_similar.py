"""The near-dedup stage against brute-force Jaccard similarity of distinct shingles of five words."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from lamella.llm import common, simhash

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    found = (text or "").split()
    return frozenset(" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def similar(a, b):
    return a == b or len(a & b) / max(1, len(a | b)) >= 0.8


def kept(sets):
    """sets: by id. The smallest id of each component, all pairs compared."""
    ids = sorted(sets)
    root = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if root[i] != root[j] and (small >= 0.8 * large - 1e-9) and similar(sets[i], sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return sorted(set(root.values()))


def changed(rng, base, n):
    out = list(base)
    for at in rng.sample(range(len(base)), n):
        out[at] = f"x{rng.randrange(1 << 40)}"
    return out


def test_links_are_exact(spark):
    """Pairs that fingerprints call near but whose similarity is below 0.8 both stay."""
    rng = random.Random(5)
    texts = {}
    for i in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[i], texts[100 + i] = " ".join(base), " ".join(changed(rng, base, 8 + i % 2))
    expected = kept({i: shingles(t) for i, t in texts.items()})
    assert 40 < len(expected) <= 80
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame([(i, t, "s") for i, t in texts.items()], SCHEMA), "")
    assert sorted(r["doc_id"] for r in out.collect()) == expected


def test_link_sets_against_brute_force():
    rng = random.Random(6)
    sets = []
    for _ in range(12):
        base = [rng.randrange(1 << 60) for _ in range(rng.choice([4, 5, 9, 40]))]
        for _ in range(8):
            sets.append({*base} ^ {*rng.sample(base, rng.randrange(1 + len(base) // 8 + 1))} | {rng.randrange(1 << 60) for _ in range(rng.randrange(3))})
    root = simhash.link_sets([np.array(sorted(x), dtype=np.uint64) for x in sets], 0.8)
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and similar(a, b):
                label = [label[i] if x == label[j] else x for x in label]
    assert [[root[i] == root[j] for j in range(len(sets))] for i in range(len(sets))] == [[x == y for y in label] for x in label]


def test_blocks_lose_no_pair(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, " ".join(changed(rng, base, 3)), "s") for i in range(60)]
    expected = kept({i: shingles(t) for i, t, _ in rows})
    df = spark.createDataFrame(rows, SCHEMA)
    sets = {i: simhash.distinct_shingles(t, 5) for i, t, _ in rows}
    values = spark.createDataFrame([(i, (i, 0), len(s)) for i, s in sets.items()], "node long, first struct<id:long,th:long>, n long")
    one = spark.createDataFrame([(i, 0) for i in range(1, 60)], "node long, root long")
    texts = df.selectExpr("doc_id as id", "0L as th", "text as t")
    of = {r["node"]: r["root"] for r in simhash.components(simhash.verified_links(texts, one, values, 5, 0.8, block=1000)).collect()}
    assert sorted({of.get(i, i) for i in range(60)}) == expected


def test_no_similar_pair_is_missed(spark):
    """Long texts just above 0.8, short ones, and texts that repeat a passage another has once: all are linked."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        n, k = ((1000, 20), (200, 4), (8, 0))[i % 3]
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(changed(rng, base, k) if k else [*base, "end"]))]
    for i in range(60, 65):
        passage, rest = ([f"w{rng.randrange(5000)}" for _ in range(n)] for n in (50, 200))
        rows += [(2 * i, " ".join(passage + rest)), (2 * i + 1, " ".join(passage * 12 + rest))]
    expected = kept({i: shingles(t) for i, t in rows})
    assert 65 <= len(expected) < 90
    out = simhash.deduplicate(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA))
    assert sorted(r["doc_id"] for r in out.collect()) == expected


def test_recall_at_the_threshold():
    """Of pairs at 0.80 to 0.83, the share that meets in some bucket with near fingerprints: at least 0.99."""
    rng = random.Random(12)
    first, whole = simhash.radii(0.8)
    met = pairs = 0
    while pairs < 600:
        n = rng.choice((60, 150, 300, 800))
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        a, b = (simhash.distinct_shingles(" ".join(x), 5) for x in (base, changed(rng, base, max(1, round(n * 0.02)))))
        both = len(np.intersect1d(a, b))
        if not 0.8 <= both / (len(a) + len(b) - both) < 0.83:
            continue
        pairs += 1
        keys = simhash.minima([a, b])
        x, y = (np.frombuffer(simhash.wide_of(s), dtype="<u8") for s in (a, b))
        d = np.bitwise_count(x ^ y)
        met += (keys[0] == keys[1]).any() and d[0] <= first and d.sum() <= whole
    assert met / pairs >= 0.99


def test_split_buckets_lose_no_pair(spark):
    rng = random.Random(13)
    rows = []
    for i in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(100 * i + k, " ".join(changed(rng, base, 1)), "s") for k in range(12)]
    sets = [simhash.distinct_shingles(t, 5) for _, t, _ in rows]
    wide = [np.frombuffer(simhash.wide_of(s), dtype="<i8").tolist() for s in sets]
    values = spark.createDataFrame([(i, *w, b) for (i, _, _), w, b in zip(rows, wide, simhash.minima(sets).tolist())], "node long, w0 long, w1 long, w2 long, w3 long, bands array<long>")
    for split_at in (20_000, 5):
        of = {r["node"]: r["root"] for r in simhash.components(simhash.similar_links(values, 0.8, split_at)).collect()}
        assert all(of.get(i, i) == i // 100 * 100 for i, _, _ in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_stage_against_brute_force(spark):
    docs = common.materialize(corpus_pipeline.exact_dedup_stage(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ""))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = kept({r["doc_id"]: shingles((r["text"] or "").translate(lower)) for r in docs.collect()})
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in out.collect()) == expected
