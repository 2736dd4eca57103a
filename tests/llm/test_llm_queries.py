"""The registered queries over whole tables at sf0.001: SQL where there is SQL, else brute force, round trips, held-out accuracy."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm import common, packing, registry, simhash, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def run(spark, name):
    return registry.QUERIES[name](spark, DATA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{t}')")
    cursor = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    df = run(spark, name)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_op2(spark, docs):
    out = run(spark, "op2_crf_toxicity").toPandas().sort_values("doc_id")
    assert out.doc_id.tolist() == docs.doc_id.tolist() and out.score.between(0, 1).all()
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id]
    assert (out.predicted == (out.score >= 0.5)).all()


def test_op2_held_out_accuracy(spark):
    data = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas()
    held = registry.QUERIES["op2_crf_toxicity"](spark, data).filter("held_out").toPandas().merge(labels, on="doc_id")
    assert len(held) >= 50 and (held.predicted == held.toxic).mean() >= 0.95


def test_op2_uses_no_label_of_the_held_out(spark, tmp_path):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{DATA}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    pick = lambda df: {r["doc_id"]: round(r["score"], 9) for r in df.collect()}
    assert pick(registry.QUERIES["op2_crf_toxicity"](spark, str(tmp_path))) == pick(run(spark, "op2_crf_toxicity"))


def test_op3(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x, ids = np.array(e.embedding.tolist(), dtype=float), e.vec_id.to_numpy()
    out = run(spark, "op3_inverted_multi_index").toPandas()
    assert set(out.query_id) == set(ids[ids % 20 == 0])
    hits = 0
    for q, g in out.groupby("query_id"):
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(top) & set(g.vec_id))
        assert sorted(g["rank"]) == list(range(1, 21))
    assert hits / len(out) >= 0.9


def test_op4(spark, docs):
    def fingerprint(text):
        words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))

    fps = np.array([fingerprint(t) for t in docs.text], dtype=np.uint64)
    near, label = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    out = run(spark, "op4_simhash_near_dedup").toPandas().sort_values("doc_id")
    assert out.fingerprint.tolist() == [f"{int(x):016x}" for x in fps]
    assert out.component_id.tolist() == docs.doc_id.to_numpy()[label].tolist()


def test_op5(spark, docs):
    seen, expected = set(), []
    for text in docs.text:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        expected.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    out = run(spark, "op5_run_length_dedup").toPandas().sort_values("doc_id")
    assert list(zip(out.n_bytes, out.n_removed, out.n_spans, out.kept_sha256)) == expected


def test_op6(spark, docs):
    out = run(spark, "op6_source_mixing").toPandas().sort_values("doc_id").reset_index(drop=True)
    sizes = [len(WORDS.findall(t or "")) for t in docs.text]
    assert out["size"].tolist() == sizes and (out.taken <= 2 * out["size"]).all()
    out["source"] = docs.source
    by = out.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * sum(sizes)) < 1e-3
    assert ((by.taken - by.target).abs() <= 0.02 * by.target + 50).all()
    order = sorted(by.index)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free = by[by.target < 2 * by["size"] - 1e-6]
    ratio = [t / weight[s] for s, t in free.target.items()]
    assert max(ratio) - min(ratio) < 1e-6 * max(ratio)


def test_op7(spark, docs):
    out = run(spark, "op7_karmarkar_karp_shards").toPandas().sort_values("doc_id")
    raw = [(t or "").encode() for t in docs.text]
    assert out["size"].tolist() == [len(r) + 8 for r in raw] and out.text_crc32.tolist() == [zlib.crc32(r) for r in raw]
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all() and out.shard.between(0, 23).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.groupby("text_crc32").shard.nunique().max() == 1
    load = out.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= out["size"].max()


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    out = run(spark, "op10_best_fit_packing").toPandas()
    pieces = {(r.doc_id, r.piece): r for r in out.itertuples()}
    n = total = 0
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            r, part = pieces[doc_id, k], ids[s : s + 2048]
            assert (r.start, r.length, r.ids_crc32) == (s, len(part), zlib.crc32(part.tobytes()))
            n, total = n + 1, total + len(part)
    assert n == len(out)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= 1.02 * -(-total // 2048) + 1


def test_pipeline_against_brute_force(spark, docs):
    """Each stage's effect, redone on what the stage before it kept."""
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [source]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(common.materialize(stage(spark, kept[-1], DATA)))
    frames = [k.toPandas() for k in kept]
    scores = toxicity.annotate(source, toxicity.trained_on_folds(spark, source, DATA)).select("row.doc_id", "score").toPandas()
    assert sorted(frames[1].doc_id) == sorted(scores[scores.score < 0.5].doc_id)
    plain = frames[1].assign(norm=[re.sub(r"[\x20\x09-\x0D]", "", t) for t in frames[1].text], n=frames[1].text.str.len())
    best = plain.sort_values(["n", "doc_id"], ascending=[False, True]).groupby("norm").doc_id.first()
    assert sorted(frames[2].doc_id) == sorted(best)
    sets = {r.doc_id: set(simhash.distinct_shingles(r.text, 5).tolist()) for r in frames[2].itertuples()}
    label = {i: i for i in sorted(sets)}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and label[i] != label[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                lo, hi = sorted((label[i], label[j]))
                label = {k: lo if x == hi else x for k, x in label.items()}
    assert sorted(frames[3].doc_id) == sorted(set(label.values()))
    times = frames[4].groupby("doc_id").size()
    sizes = frames[3].set_index("doc_id").text.map(lambda t: len(WORDS.findall(t)))
    assert set(times.index) <= set(frames[3].doc_id) and times.max() <= 2
    assert abs((times * sizes.reindex(times.index)).sum() - 1.5 * sizes.sum()) <= 0.01 * sizes.sum() + 50
    assert frames[5].groupby("doc_id").piece.apply(lambda p: (p == 0).sum()).equals(times.rename("piece").reindex(sorted(times.index)).astype("int64"))
    assert (frames[5].groupby("sequence_id").length.sum() <= 2048).all()
    again = corpus_pipeline.run(spark, DATA)
    assert again.columns == kept[-1].columns and again.count() == len(frames[5])
