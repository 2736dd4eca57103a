"""Toxicity by a linear-chain conditional random field over tokens.

Tokens are runs of letters (ASCII letters in lower case, and any byte above 127); a chain is a sentence, of any length.
Token labels come from document labels: in a toxic document the witnesses are the tokens whose best feature (the word, or
its first 3, 4 or 5 bytes), found in at least ``LEAST_SHARE`` of the toxic documents, tells toxic from clean documents
about as well as the document's best one does. The field has two states with emissions from the same hashed features and
a full transition matrix, and is trained by maximum likelihood. Forward-backward marginals then give each token's chance
of being toxic; chains are worked off in segments of ``SEGMENT`` tokens side by side, and what a segment does to the odds
that come into it is a fraction of two linear forms, so that the segments of a long chain are joined exactly. Spans are
runs of tokens at or above ``SPAN``, in characters of the original text; the document score is a logistic function of
the two largest marginals and the expected number of toxic tokens, both over marginals above ``NOTICED``.

Only training is bounded, by what reaches the driver: at most ``max_toxic`` and ``max_clean`` labelled rows, in the order
of a hash of the id, while their whole texts have at most ``max_tokens`` tokens in each class; texts above ``MAX_BYTES``
are not learned from. No text is used in part. Scoring reads every whole text, in pieces that end with a sentence.

Defined results: null and empty texts, and texts without letters, have no tokens and get the score of no evidence; rows
with equal text get equal scores; label rows with a null id or label are left out, and of repeated label rows the
highest label counts; with no usable label of a class, or no
witness, every score is that of no evidence; an empty table gives an empty
result; the columns of the input are carried in one struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import give_back, table

SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
PREFIXES = (3, 4, 5)
SEGMENT, MAX_TOKENS, MAX_BYTES, MAX_TOXIC, MAX_CLEAN = 64, 300_000, 1 << 20, 1000, 1500
PIECE = 1 << 19  # bytes looked at together
SPAN, NOTICED, MARGIN, LEAST_ODDS, LEAST_DOCS, LEAST_SHARE = 0.5, 0.3, 1.0, 2.0, 3, 0.02
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
STOPS = (b".", b"!", b"?", b"\n")
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in STOPS]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, PIECE + 4096), base, dtype=np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


@dataclass
class Tokens:
    start: np.ndarray  # bytes
    end: np.ndarray
    features: np.ndarray  # 4 x n, slots of the word and of its prefixes
    chain: np.ndarray  # number of the chain, rising


def tokenize(raw: bytes) -> Tokens:
    """raw: UTF-8 text with ASCII letters in lower case."""
    b = np.frombuffer(raw, dtype=np.uint8)
    letter = np.zeros(len(b) + 2, dtype=np.int8)
    letter[1:-1] = _LETTER[b]
    edge = np.flatnonzero(np.diff(letter))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return Tokens(start, end, np.zeros((1 + len(PREFIXES), 0), dtype=np.int64), start)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(b.astype(np.uint64) * _power(_BASE, len(b)), out=sums[1:])
    low, unit = sums[start], _power(_INVERSE, len(b))[start]
    features = np.empty((1 + len(PREFIXES), len(start)), dtype=np.int64)
    for k, n in enumerate((None, *PREFIXES)):
        h = (sums[end if n is None else np.minimum(start + n, end)] - low) * unit
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        features[k] = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    stops = np.zeros(len(b) + 1, dtype=np.int32)
    np.cumsum(_STOP[b], out=stops[1:])
    chain = np.cumsum(np.diff(stops[start], prepend=-1) != 0) - 1
    return Tokens(start, end, features, chain)


@dataclass
class Crf:
    weights: np.ndarray  # float32, one for each slot; for state toxic against the other
    bias: float
    begin: float
    trans: np.ndarray  # 2 x 2, logs

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.full(features.shape[1], self.bias)
        for row in features:
            out += self.weights[row]
        return np.clip(out, -30, 30)

    def ratios(self, features: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odds of the toxic state at each token: forward, backward, and the emission's own."""
        psi = np.exp(self.emissions(features))
        n = len(chain)
        (oo, ot), (to, tt) = np.exp(np.clip(self.trans, -20, 20))
        fwd, bwd = np.empty(n), np.ones(n)
        if not n:
            return fwd, bwd, psi
        begins = np.flatnonzero(np.diff(chain, prepend=-1))
        place = np.arange(n) - np.repeat(begins, np.diff(begins, append=n))
        start = np.flatnonzero(place % SEGMENT == 0)
        size = np.diff(start, append=n)
        turn = place[start] // SEGMENT  # of the segments of a chain, from 0
        last = np.r_[turn[1:] == 0, True]

        def sweep(some: np.ndarray, into: np.ndarray, forward: bool) -> None:
            """Fill fwd, or bwd, of these segments. into: the value at the first token, or at the last."""
            order = np.argsort(-size[some], kind="stable")
            some, into = some[order], into[order]
            alive = np.searchsorted(-size[some], -np.arange(SEGMENT), side="left")  # segments longer than t
            r = into
            for t in range(int(size[some[0]]) if len(some) else 0):
                own = some[: alive[t]]
                if forward:
                    i = start[own] + t
                    r = into if t == 0 else psi[i] * (ot + r[: len(own)] * tt) / (oo + r[: len(own)] * to)
                    fwd[i] = r = np.minimum(r, 1e30)
                else:
                    i = start[own] + size[own] - 1 - t
                    x = psi[np.minimum(i + 1, n - 1)] * r[: len(own)]
                    r = into if t == 0 else (to + tt * x) / (oo + ot * x)
                    bwd[i] = r = np.minimum(r, 1e30)

        def effect(some: np.ndarray, forward: bool) -> np.ndarray:
            """Of whole segments, all SEGMENT long: the matrix (a, b, c, d) that takes odds x to (c + d x) / (a + b x). Forward: from
            the token before to the last; backward: from the first token after to the first."""
            a, b, c, d = np.ones(len(some)), np.zeros(len(some)), np.zeros(len(some)), np.ones(len(some))
            for t in range(SEGMENT):
                i = start[some] + t if forward else start[some] + SEGMENT - t
                e = psi[i]
                if forward:
                    a, b, c, d = oo * a + to * c, oo * b + to * d, e * (ot * a + tt * c), e * (ot * b + tt * d)
                else:
                    a, b, c, d = oo * a + ot * e * c, oo * b + ot * e * d, to * a + tt * e * c, to * b + tt * e * d
                most = np.maximum(np.maximum(a, b), np.maximum(c, d))
                a, b, c, d = a / most, b / most, c / most, d / most
            return np.stack([a, b, c, d])

        first = np.flatnonzero(turn == 0)
        sweep(first, psi[start[first]] * np.exp(np.clip(self.begin, -20, 20)), True)
        sweep(np.flatnonzero(last), np.ones(int(last.sum())), False)
        if len(first) == len(start):
            return fwd, bwd, psi
        # chains of several segments: what comes into each, one segment of all chains at a time
        middle = np.flatnonzero((turn > 0) & ~last)
        after = np.zeros((4, len(start)))
        after[:, middle] = effect(middle, True)
        before = np.zeros((4, len(start)))
        before[:, ~last] = effect(np.flatnonzero(~last), False)
        by_turn = np.argsort(turn, kind="stable")
        groups = np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1)
        out = np.zeros(len(start))  # forward odds at the last token
        out[first] = fwd[start[first] + size[first] - 1]
        came = np.zeros(len(start))
        for some in groups[1:]:
            came[some] = out[some - 1]
            a, b, c, d = after[:, some]
            out[some] = np.minimum((c + d * came[some]) / np.maximum(a + b * came[some], 1e-300), 1e30)
        rest = np.flatnonzero(turn > 0)
        i = start[rest]
        sweep(rest, psi[i] * (ot + came[rest] * tt) / (oo + came[rest] * to), True)
        back = np.zeros(len(start))  # backward odds at the first token
        back[last] = bwd[start[last]]
        for some in reversed(groups[:-1]):
            some = some[~last[some]]
            a, b, c, d = before[:, some]
            back[some] = np.minimum((c + d * back[some + 1]) / np.maximum(a + b * back[some + 1], 1e-300), 1e30)
        rest = np.flatnonzero(~last)
        x = psi[start[rest + 1]] * back[rest + 1]
        sweep(rest, (to + tt * x) / (oo + ot * x), False)
        return fwd, bwd, psi

    def marginals(self, features: np.ndarray, chain: np.ndarray) -> np.ndarray:
        fwd, bwd, _ = self.ratios(features, chain)
        x = np.minimum(fwd * bwd, 1e30)
        return x / (1 + x)


def train_crf(features: np.ndarray, chain: np.ndarray, labels: np.ndarray, rounds: int = 60, l2: float = 1e-3, rate: float = 1.0) -> Crf:
    """Maximum likelihood by AdaGrad over all chains at once."""
    used, local = np.unique(features, return_inverse=True)
    local = local.reshape(features.shape).astype(np.int32)
    w, rest = np.zeros(len(used)), np.array([-3.0, 0.0, 1.0, 0.0, 0.0, 1.0])  # bias, begin, trans
    gw, gr = np.full(len(used), 1e-6), np.full(6, 1e-6)
    y = labels.astype(float)
    first = np.diff(chain, prepend=-1) != 0
    later = np.flatnonzero(~first)
    pairs = np.bincount((2 * labels[later - 1] + labels[later]).astype(int), minlength=4) if len(later) else np.zeros(4)
    for _ in range(rounds):
        crf = Crf(w, rest[0], rest[1], rest[2:].reshape(2, 2))
        fwd, bwd, psi = crf.ratios(local, chain)
        x = np.minimum(fwd * bwd, 1e30)
        p = x / (1 + x)
        gap = y - p
        grad_w = np.zeros(len(used))
        for row in local:
            grad_w += np.bincount(row, weights=gap, minlength=len(used))
        r, z = np.minimum(fwd[later - 1], 1e30), np.minimum(psi[later] * bwd[later], 1e30)
        a = np.exp(rest[2:].reshape(2, 2))
        joint = np.stack([np.full(len(later), a[0, 0]), a[0, 1] * z, r * a[1, 0], r * a[1, 1] * z])
        joint = (joint / joint.sum(axis=0)).sum(axis=1)
        grad_r = np.concatenate([[gap.sum(), gap[first].sum()], pairs - joint])
        grad_w -= l2 * len(y) / max(1, len(used)) * w
        gw += grad_w**2
        gr += grad_r**2
        w = w + rate * grad_w / np.sqrt(gw)
        rest = np.clip(rest + rate * grad_r / np.sqrt(gr), -15, 15)
    full = np.zeros(SLOTS, dtype=np.float32)
    full[used] = w
    return Crf(full, float(rest[0]), float(rest[1]), rest[2:].reshape(2, 2))


def witnesses(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Token labels from document labels. doc: the document of each token; toxic: of each document, 0 or 1."""
    odds = np.full(features.shape[1], -np.inf)
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    for row in features:
        seen = np.unique(row.astype(np.int64) * len(toxic) + doc)
        slots, slot = np.unique(seen // len(toxic), return_inverse=True)
        of = toxic[seen % len(toxic)]
        pos, neg = np.bincount(slot, weights=of), np.bincount(slot, weights=1 - of)
        lo = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
        lo[pos < max(LEAST_DOCS, LEAST_SHARE * n_pos)] = -np.inf  # a few copies of one document prove nothing
        odds = np.maximum(odds, lo[np.searchsorted(slots, row)])
    best = np.full(len(toxic), -np.inf)
    np.maximum.at(best, doc, odds)
    return (toxic[doc] == 1) & (odds >= LEAST_ODDS) & (odds >= best[doc] - MARGIN)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-2) -> np.ndarray:
    """Newton steps for a small logistic regression; the first column of x is 1."""
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


@dataclass
class Model:
    crf: Crf | None
    doc_weights: np.ndarray  # of the columns of Evidence.table()

    def score(self, evidence: Evidence) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence.table() @ self.doc_weights, -30, 30)))


class Evidence:
    """Of each document: its two largest marginals and the sum of those above NOTICED."""

    def __init__(self, n: int):
        self.top, self.next, self.sum = np.zeros(n), np.zeros(n), np.zeros(n)

    def add(self, p: np.ndarray, doc: np.ndarray) -> None:
        seen = np.flatnonzero(p > NOTICED)
        p, doc = p[seen], doc[seen]
        np.add.at(self.sum, doc, p)
        order = np.lexsort((-p, doc))
        p, doc = p[order], doc[order]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        second = first[np.flatnonzero(np.diff(first, append=len(doc)) > 1)] + 1
        for i in (first, second):
            d, x = doc[i], p[i]
            self.next[d] = np.maximum(self.next[d], np.minimum(self.top[d], x))
            self.top[d] = np.maximum(self.top[d], x)

    def table(self) -> np.ndarray:
        return np.stack([np.ones(len(self.top)), self.top, self.next, np.log1p(self.sum)], axis=1)


def fit(features: list[np.ndarray], chains: list[np.ndarray], toxic: np.ndarray) -> Model:
    """features, chains: of each document. toxic: 0 or 1."""
    if not len(toxic) or toxic.min() == toxic.max() or not sum(len(c) for c in chains):
        return Model(None, np.array([-3.0, 0.0, 0.0, 0.0]))
    sizes = [len(c) for c in chains]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.concatenate(features, axis=1)
    steps = np.concatenate([np.diff(c, prepend=-1) != 0 for c in chains])
    chain = np.cumsum(steps) - 1
    labels = witnesses(flat, doc, toxic)
    if not labels.any():
        return Model(None, np.array([-3.0, 0.0, 0.0, 0.0]))
    crf = train_crf(flat, chain, labels.astype(np.int64))
    evidence = Evidence(len(sizes))
    evidence.add(crf.marginals(flat, chain), doc)
    return Model(crf, _logistic(evidence.table(), toxic.astype(float)))


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in UTF-8 in groups of about PIECE bytes; longer ones cut after the last sentence that fits, or the first that ends."""
    who, held, size = [], [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > PIECE:
                end = max(raw.rfind(c, at, at + PIECE) for c in STOPS) + 1
                end = end or min(x for c in STOPS if (x := raw.find(c, at + PIECE) + 1 or len(raw)))
            if size + end - at > PIECE and held:
                yield who, held
                who, held, size = [], [], 0
            who.append(i)
            held.append(raw[at:end])
            size += end - at
            at = end
    if held:
        yield who, held


def score_texts(texts: list[str | None], model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Of each text: the score, and the toxic spans (first character, character after the last, largest marginal)."""
    n = len(texts)
    evidence = Evidence(n)
    spans: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    passed = np.zeros(n, dtype=np.int64)  # characters of earlier pieces of the same text
    for who, raws in _pieces(texts) if model.crf else ():
        raw = b"\n".join(raws)
        tokens = tokenize(raw)
        at = np.cumsum([0, *(len(r) + 1 for r in raws)])
        piece = np.searchsorted(at, tokens.start, side="right") - 1
        p = model.crf.marginals(tokens.features, tokens.chain)
        doc = np.array(who, dtype=np.int64)[piece]
        evidence.add(p, doc)
        toxic = p >= SPAN
        if toxic.any() or len(who) != len(set(who)) or any(len(r) >= PIECE // 2 for r in raws):
            chars = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, out=chars[1:])
            runs = np.flatnonzero(toxic & ~np.r_[False, toxic[:-1] & (tokens.chain[1:] == tokens.chain[:-1])])
            for a in runs.tolist():
                z = a
                while z + 1 < len(toxic) and toxic[z + 1] and tokens.chain[z + 1] == tokens.chain[a]:
                    z += 1
                d, base = int(doc[a]), int(chars[at[piece[a]]])
                spans[d].append((int(passed[d] + chars[tokens.start[a]]) - base, int(passed[d] + chars[tokens.end[z]]) - base, float(p[a : z + 1].max())))
            for d, lo, r in zip(who, at, raws):
                passed[d] += chars[lo + len(r)] - chars[lo]
    return model.score(evidence), spans


def held_out(id_col: str):
    """Whether crc32 of the id as text is a multiple of 5; a null id is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_tokens: int = MAX_TOKENS) -> Model:
    """labels: the rows to learn from."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n).collect() for y, n in ((1, max_toxic), (0, max_clean))]
    ids = spark.createDataFrame([(x["id"], x["y"]) for rows in chosen for x in rows], "id long, y int")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                t = tokenize((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
                out.append((len(t.chain), t.features.astype("<i4").tobytes(), t.chain.astype("<i4").tobytes()))
            n, f, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f, pa.binary()), pa.array(c, pa.binary())], names=["id", "y", "n", "f", "c"])

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "id").select("id", "y", "t")
    found = found.filter(F.octet_length(F.coalesce("t", F.lit(""))) <= MAX_BYTES)
    rows = found.mapInArrow(featurize, "id long, y int, n long, f binary, c binary").groupBy("id").agg(F.min(F.struct("y", "n", "f", "c")).alias("x")).select("id", "x.*")
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))  # over the chosen rows, at most max_toxic or max_clean
    rows = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= max_tokens).toPandas().sort_values("id")
    features = [np.frombuffer(x, dtype="<i4").reshape(1 + len(PREFIXES), -1) for x in rows["f"]]
    model = fit(features, [np.frombuffer(x, dtype="<i4").astype(np.int64) for x in rows["c"]], rows["y"].to_numpy(dtype=np.int64))
    del rows, features
    give_back()
    return model


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows, as struct ``row``, with score and spans: array<struct<start, end, score>> in characters."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each of SLOTS, whatever the input

    @F.pandas_udf("score double, spans array<struct<start:long,end:long,score:double>>")
    def score(texts: pd.Series) -> pd.DataFrame:
        s, spans = score_texts(texts.tolist(), held.value)
        _powers.clear()
        give_back()
        return pd.DataFrame({"score": s, "spans": [[{"start": a, "end": b, "score": p} for a, b, p in x] for x in spans]})

    return docs.select(F.struct("*").alias("row"), score(F.col(text_col)).alias("scored")).select("row", "scored.score", "scored.spans")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that are not toxic, with the columns of docs."""
    return annotate(docs, model, text_col).filter(F.col("score") < threshold).select("row.*")


def trained_on_folds(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Learned from the label rows whose crc32(doc_id) mod 5 is not 0."""
    return train(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = annotate(docs, trained_on_folds(spark, docs, sf_dir))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )
