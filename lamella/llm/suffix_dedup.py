"""Suffix-array dedup of repeated byte strings, by a run-length index.

Any ``length``-byte string picks the least hash among its K-byte substrings as its anchor, so equal strings meet under
equal anchors. A fragment is the bytes of a document whose windows share an anchor. Of fragments that are equal whole,
the first one counts and the others go; anchors with one fragment need nothing else. Anchors with several different
fragments are indexed: those fragments, in document order, are sorted into a suffix array by prefix doubling, kept as
a run-compressed Burrows-Wheeler transform with suffix samples at both ends of each run, and every fragment is streamed
against it from right to left as matching statistics: a step inside a run of the wanted byte follows the LF mapping, any
other jumps to the end of the nearest run of that byte above or below, whichever matches longer. A position whose match
is ``length`` or more lies in a class of rows with that common prefix; it is removed unless it is its class's first.

Two bounded bit sets (2**26 bits) built from exact counts keep anchors that occur once, or with one fragment only, out of
the shuffles; where they fill up they let more through, and nothing is lost. An anchor with more than ``split_at``
fragments (so many that one index would grow with the input) has its windows compared one by one, grouped by content.

Defined results: null text is empty; texts under ``length`` bytes keep all; rows are ordered by id (null first), then by
the text's MD5 digest, and rows that share an id (or have none) and differ in text are documents of their own; rows equal in
id and text are one document listed twice and get equal results; bytes are removed even inside a character; an empty table gives an empty result. Texts of any size are read in pieces of PIECE bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lamella.llm.bits import key_filter, once
from lamella.llm.common import give_back, materialize, table

LENGTH, K, SPLIT_AT = 100, 20, 20_000
PIECE, BUCKET = 1 << 20, 1 << 19
BITS = 1 << 26
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, PIECE + 4096), base, dtype=np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    """In place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def fragments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """data: bytes of documents end to end; offsets: where each starts, and the end. Yields arrays: document, first and
    last window start in the document, place in data of the first, anchor hash, fragment hash."""
    k = min(K, length)
    width = length - k + 1
    low = np.uint64((1 << 22) - 1)
    n_docs = len(offsets) - 1
    d, at = 0, int(offsets[0]) if n_docs else 0
    while d < n_docs:
        # as many whole documents as fit, or a piece of one; a piece's windows go on into the next one
        if offsets[d + 1] - at > PIECE:
            stop, last = at + PIECE, d
            end = min(stop + length - 1, int(offsets[d + 1]))
        else:
            last = max(d, int(np.searchsorted(offsets, at + PIECE, side="right")) - 2)
            stop = end = int(offsets[last + 1])
        b = data[at:end]
        n = len(b)
        if n >= length:
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.multiply(_power(_BASE, n), b, out=sums[1:])
            np.cumsum(sums, out=sums)
            inverse = _power(_INVERSE, n)
            h = sums[k:] - sums[:-k]
            h *= inverse[: n - k + 1]
            _mix(h)
            least = h & ~low
            least |= np.arange(len(h), dtype=np.uint64)
            s = 1
            while 2 * s <= width:
                least = np.minimum(least[:-s], least[s:], out=least[:-s])
                s *= 2
            if width > s:
                least = np.minimum(least[: len(least) - (width - s)], least[width - s :])
            anchor = (least & low).astype(np.int64)
            # windows that a document has, of those that start in this piece
            edges = offsets[d : last + 2] - at
            first, over = np.maximum(edges[:-1], 0), np.minimum(np.minimum(edges[1:] - length + 1, stop - at), len(anchor))
            ok = np.zeros(len(anchor) + 1, dtype=np.int8)
            some = over > first
            ok[first[some]] += 1
            ok[over[some]] -= 1
            ok = np.cumsum(ok[:-1], dtype=np.int8).view(bool)
            turn = anchor[1:] != anchor[:-1]
            begins = np.ones(len(anchor), dtype=bool)
            np.logical_or(turn, ~ok[:-1], out=begins[1:])
            begins[first[some]] = True
            ends = np.ones(len(anchor), dtype=bool)
            np.logical_or(turn, ~ok[1:], out=ends[:-1])
            ends[over[some] - 1] = True
            a, z = np.flatnonzero(ok & begins), np.flatnonzero(ok & ends)
            f = _mix((sums[z + length] - sums[a]) * inverse[a] + np.uint64(0x632BE5AB) * (z - a).astype(np.uint64) + (anchor[a] - a).astype(np.uint64))
            own = np.searchsorted(edges, a, side="right") - 1 + d
            yield own, a + at - offsets[own], z + at - offsets[own], a + at, h[anchor[a]].view(np.int64), f.view(np.int64)
        at = stop
        if stop == offsets[last + 1]:
            d = last + 1


class RunLengthIndex:
    """Run-compressed BWT of texts, each with an end sign of its own; texts come in order of precedence.

    Kept: run heads and starts, the run of each row, symbol counts before each run, suffix samples at the first and last
    row of each run, ranks of the text's substrings of 8, 16, 32 and so on symbols (for comparing jumps), and the rows that share fewer
    than ``length`` symbols with the row above.
    """

    END = 256

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        sizes = np.array([len(t) + 1 for t in texts])
        self.length, self.ends = length, np.cumsum(sizes) - 1
        n, m = int(sizes.sum()), len(texts)
        text = np.full(n, self.END, dtype=np.int16)
        own = np.ones(n, dtype=bool)
        own[self.ends] = False
        text[own] = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.left = (np.repeat(self.ends, sizes) - np.arange(n)).astype(np.int32)  # symbols before the end sign
        sa = self._sort(text, np.repeat(np.arange(m), sizes), m)
        same = np.zeros(n, dtype=bool)
        x, y = sa[:-1], sa[1:]
        i = np.flatnonzero((self.left[x] >= length) & (self.left[y] >= length))
        same[i + 1] = self._alike(x[i], y[i])
        self.group = np.cumsum(~same) - 1  # class of each row
        first_rows = np.flatnonzero(~same)
        self.first = np.minimum.reduceat(sa, first_rows)  # of each class: its first place in the text
        bwt = text[sa - 1]  # row of place 0: the last end sign, as it should be
        self.starts = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        heads = bwt[self.starts]
        self.heads = heads.astype(np.int64)
        lengths = np.diff(self.starts, append=n)
        self.sample_first, self.sample_last = sa[self.starts], sa[self.starts + lengths - 1]
        counts = np.bincount(self.heads, weights=lengths, minlength=257).astype(np.int64)
        below = m + np.cumsum(counts[:256]) - counts[:256]  # end signs sort first
        order = np.argsort(heads, kind="stable")
        before = np.zeros(len(lengths), dtype=np.int64)
        c = np.cumsum(lengths[order]) - lengths[order]
        head = self.heads[order]
        base = np.r_[0, np.cumsum(counts)][head]
        before[order] = c - base
        self.lf_base = np.where(self.heads < 256, below[np.minimum(self.heads, 255)] + before, -1)
        self.by_head = head * (len(self.starts) + 1) + order  # sorted, for jumps
        self.lengths = lengths
        self.run_of = np.repeat(np.arange(len(lengths)), lengths)

    def _sort(self, text: np.ndarray, which: np.ndarray, m: int) -> np.ndarray:
        """The suffix array by prefix doubling, of groups that are not single yet. Keeps ranks by 2, 4, 8, ... symbols up to ``length``."""
        n = len(text)
        used = np.unique(text)
        code = np.zeros(257, dtype=np.int64)
        code[used] = np.arange(1, len(used) + 1)
        code[self.END] = 0  # hides what follows
        key, h, bits = code[text], 1, int(len(used)).bit_length()
        while 2 * h * bits <= 63 and 2 * h <= self.length:
            follow = np.zeros(n, dtype=np.int64)
            np.multiply(key[h:], self.left[: n - h] >= h, out=follow[: n - h])
            key = key << (h * bits) | follow
            h *= 2
        sa = np.argsort(key)
        new = np.r_[True, np.diff(key[sa]) != 0]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, dtype=np.int32)
        rank[sa] = start
        self.h, self.ranks = h, {h: rank.copy()}
        self.key, self.bits = key, bits
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))  # rows of groups of several
        wide = int(n + m).bit_length()
        while len(open_):
            at = sa[open_]
            reach = np.minimum(at + h, n - 1)
            beyond = np.where(self.left[at] >= h, rank[reach] + m, which[at]).astype(np.int64)
            old = rank[at].astype(np.int64)
            order = self._order(old << wide | beyond, 2 * wide)
            at, old, beyond = at[order], old[order], beyond[order]
            turn = np.r_[True, old[1:] != old[:-1]]
            new = turn | np.r_[True, beyond[1:] != beyond[:-1]]
            place = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(turn, place, 0))
            start = np.maximum.accumulate(np.where(new, place, 0))
            sa[open_] = at  # rows of a group lie side by side, in the order of groups
            rank[at] = old + start - begin
            open_ = open_[~(new & np.r_[new[1:], True])]
            h *= 2
            if h <= self.length:
                self.ranks[h] = rank.copy()
        return sa

    @staticmethod
    def _order(key: np.ndarray, bits: int) -> np.ndarray:
        """The order that sorts key, which has so many bits; with its place inside the number where both fit, which sorts faster."""
        tail = max(1, len(key) - 1).bit_length()
        if bits + tail > 63:
            return np.argsort(key)
        return np.sort(key << tail | np.arange(len(key))) & ((1 << tail) - 1)

    def _alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the ``length`` symbols at x and y, all before an end sign, are equal."""
        top = max(self.ranks)
        rank, step = self.ranks[top], 0
        eq = np.ones(len(x), dtype=bool)
        while step + top < self.length:
            eq &= rank[x + step] == rank[y + step]
            step += top
        return eq & (rank[x + self.length - top] == rank[y + self.length - top])

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the texts at a and at b, at most so long."""
        last = len(self.left) - 1
        most = np.minimum(most, np.minimum(self.left[a], self.left[b]))
        got = np.zeros(len(a), dtype=np.int64)
        for h in sorted(self.ranks, reverse=True):
            rank = self.ranks[h]
            while True:
                more = (rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)]) & (got < most)
                if not more.any():
                    break
                got += h * more
                if h < max(self.ranks):
                    break
        x, y = self.key[np.minimum(a + got, last)], self.key[np.minimum(b + got, last)]
        for k in range(1, self.h):  # fewer symbols than the first ranks tell apart
            got += (x >> (self.bits * (self.h - k)) == y >> (self.bits * (self.h - k))) & (got < most)
        return np.minimum(got, most)

    def matching_statistics(self, patterns: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Right to left, one position of every pattern still open at a time: pattern, position, match length
        (counted up to ``length``), row that matches so long."""
        sizes = np.array([len(p) for p in patterns])
        flat, first = np.frombuffer(b"".join(patterns), dtype=np.uint8), np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        falling = -sizes[order]
        row, place, long = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), int(self.ends[0])), np.zeros(len(patterns), dtype=np.int64)
        runs = len(self.starts) + 1
        for t in range(int(sizes.max(initial=0))):
            open_ = order[: int(np.searchsorted(falling, -t, side="left"))]
            position = sizes[open_] - 1 - t
            c = flat[first[open_] + position].astype(np.int64)
            j, p, ell = row[open_], place[open_], long[open_]
            run = self.run_of[j]
            off = np.flatnonzero(self.heads[run] != c)
            if len(off):
                # runs of the wanted byte next above and below; their ends are sampled
                below = np.searchsorted(self.by_head, c[off] * runs + run[off])
                up, down = self.by_head[np.maximum(below - 1, 0)], self.by_head[np.minimum(below, runs - 2)]
                up_ok, down_ok = (up // runs == c[off]) & (below > 0), (down // runs == c[off]) & (below < runs - 1)
                up, down = up % runs, down % runs
                up_p, down_p = self.sample_last[up], self.sample_first[down]
                up_l = np.where(up_ok, self._common(p[off], up_p, np.where(up_ok, ell[off], 0)), -1)
                down_l = np.where(down_ok, self._common(p[off], down_p, np.where(down_ok, ell[off], 0)), -1)
                take_up = up_l >= down_l
                run[off] = np.where(take_up, up, down)
                j[off] = np.where(take_up, self.starts[up] + self.lengths[up] - 1, self.starts[down])
                p[off] = np.where(take_up, up_p, down_p)
                ell[off] = np.maximum(up_l, down_l)
            known = ell >= 0  # a byte that no text has matches nothing
            j = np.where(known, self.lf_base[run] + j - self.starts[run], 0)
            p = np.where(known, p - 1, self.ends[0])
            ell = np.where(known, np.minimum(ell + 1, self.length), 0)
            row[open_], place[open_], long[open_] = j, p, ell
            yield open_, position, ell, j


def later_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """texts in order of precedence. Of each: the window starts whose string also starts earlier among them."""
    index = RunLengthIndex(texts, length)
    begin = np.r_[0, index.ends[:-1] + 1]
    who, where = [], []
    for pattern, position, ell, row in index.matching_statistics(texts):
        hit = ell >= length
        if hit.any():
            own = begin[pattern[hit]] + position[hit]
            late = index.first[index.group[row[hit]]] < own
            who.append(pattern[hit][late])
            where.append(position[hit][late])
    if not who:
        return [np.zeros(0, dtype=np.int64)] * len(texts)
    who, where = np.concatenate(who), np.concatenate(where)
    order = np.lexsort((where, who))
    return np.split(where[order], np.searchsorted(who[order], np.arange(1, len(texts))))


# A fragment's place in its document is one number: the start of its first window, then 8 bits of the windows after it.
_SPAN = 8


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(1)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)), offsets


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h.view(np.uint64) & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def _scan(length: int, emit: Callable, bits=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _columns(batch)
            doc = batch.column(0).to_numpy()
            for d, a, z, place, h, f in fragments(data, offsets, length):
                if bits is not None:
                    keep = _has(bits.value, h)
                    d, a, z, place, h, f = (x[keep] for x in (d, a, z, place, h, f))
                yield emit(data, doc[d], (a << _SPAN) | (z - a), z - a + length, place, h, f)
        give_back()

    return run


def _emit_hashes(data, doc, val, size, place, h, f) -> pa.RecordBatch:
    h, n = np.unique(h, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])


def _emit_rows(data, doc, val, size, place, h, f) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, f, doc, val)], names=["h", "f", "doc", "val"])


def _emit_contents(data, doc, val, size, place, h, f) -> pa.RecordBatch:
    """Of fragments that repeat here whole, the first."""
    order = np.lexsort((val, doc, f, h))
    h, f, doc, val, size, place = (x[order] for x in (h, f, doc, val, size, place))
    new = np.r_[True, (h[1:] != h[:-1]) | (f[1:] != f[:-1])] if len(h) else np.zeros(0, dtype=bool)
    contents = [data[p : p + s].tobytes() for p, s in zip(place[new].tolist(), size[new].tolist())]
    return pa.RecordBatch.from_arrays([*(pa.array(x[new]) for x in (h, f, doc, val)), pa.array(contents, pa.binary())], names=["h", "f", "doc", "val", "content"])


RANGES = "doc long, val long"


def _index_groups(length: int):
    """Rows (h, doc, val, content) sorted by h: the ranges of later windows, by an index for each bucket of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, done = 0, object()

        def flush() -> pa.RecordBatch:
            rows = sorted(held, key=lambda r: (r[1], r[2]))
            held.clear()
            docs, vals = [], []
            for (_, doc, val, _), late in zip(rows, later_windows([r[3] for r in rows], length)):
                if len(late):
                    base = val >> _SPAN
                    cut = np.flatnonzero(np.diff(late) > 1)
                    for s, e in zip(late[np.r_[0, cut + 1]].tolist(), late[np.r_[cut, len(late) - 1]].tolist()):
                        docs.append(doc)
                        vals.append(((base + s) << _SPAN) | (e - s))
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(vals, pa.int64())], names=["doc", "val"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != done and size >= BUCKET:
                    yield flush()
                    size = 0
                held.append(row)
                size += len(row[3])
                done = row[0]
        if held:
            yield flush()
        give_back()

    return run


def _windows(length: int):
    """Each window of each fragment: two hashes of its bytes, document, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, val, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for s in range(len(content) - length + 1):
                    w = content[s : s + length]
                    out.append((xxh3_64_intdigest(w, 1) - (1 << 63), xxh3_64_intdigest(w, 2) - (1 << 63), doc, ((val >> _SPAN) + s) << _SPAN))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), (), ()))], names=["h", "f", "doc", "val"])

    return run


def _bit_set(hashes: DataFrame):
    """hashes: column h, distinct. Its bits, 2**26 of them whatever the input, for every task."""
    words = hashes.select(F.expr(f"shiftright(h & {BITS - 1}L, 6)").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(BITS // 64, dtype=np.uint64)
    bits[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def _not_first(rows: DataFrame) -> DataFrame:
    """rows: h, f, doc, val. Those that are not the first with their (h, f). The firsts are stored, so that the join has
    a shuffle of its own on both sides, whose large partitions Spark can split: one fragment may be a third of all rows."""
    first = materialize(rows.groupBy("h", "f").agg(F.count("*").alias("n"), F.min(F.struct("doc", "val")).alias("first")).filter("n > 1").drop("n"))
    return rows.join(first, ["h", "f"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("val") != F.col("first.val"))).select("doc", "val")


def later_ranges(keyed: DataFrame, length: int = LENGTH, split_at: int = SPLIT_AT) -> DataFrame:
    """keyed: doc (long, in order of precedence), content (binary). Rows (doc, val): ranges of windows that start earlier elsewhere."""
    counted = keyed.mapInArrow(_scan(length, _emit_hashes), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    again = _bit_set(counted.filter("n > 1").select("h"))
    rows = materialize(keyed.mapInArrow(_scan(length, _emit_rows, again), "h long, f long, doc long, val long"))
    copies = materialize(_not_first(rows))
    several = materialize(rows.groupBy("h").agg(F.min("f").alias("f0"), F.max("f").alias("f1")).filter("f0 <> f1").select("h"))
    bits = _bit_set(several)
    found = keyed.mapInArrow(_scan(length, _emit_contents, bits), "h long, f long, doc long, val long, content binary")
    first = found.groupBy("h", "f").agg(F.min(F.struct("doc", "val", "content")).alias("x")).select("h", "x.*")
    first = materialize(first)
    per_anchor = first.groupBy("h").count().filter("count > 1")
    small = first.join(per_anchor.filter(F.col("count") <= split_at).select("h"), "h")
    indexed = small.repartition("h").sortWithinPartitions("h").select("h", "doc", "val", "content").mapInArrow(_index_groups(length), RANGES)
    large = first.join(per_anchor.filter(F.col("count") > split_at).select("h"), "h").select("doc", "val", "content")
    single = _not_first(large.mapInArrow(_windows(length), "h long, f long, doc long, val long"))
    return materialize(copies.unionByName(indexed).unionByName(single))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows id, doc, content. doc is a number in order of precedence that different texts never share: the id, unless ids
    are null or stand for several texts; then the place among all pairs of id and MD5 digest."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))
    digest = F.md5("content").alias("digest")
    clash = rows.select("id", digest).groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).filter("id is null or a <> z")
    if clash.isEmpty():
        return rows.select("id", F.col("id").cast("long").alias("doc"), "content")
    pairs = rows.select("id", digest).distinct().repartitionByRange("id", "digest").sortWithinPartitions("id", "digest")
    numbers = materialize(pairs.select(F.col("id").alias("of"), F.col("digest").alias("said"), F.monotonically_increasing_id().alias("doc")))
    joined = rows.withColumn("digest", digest).join(numbers, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("said")))
    return materialize(joined.select("id", "doc", "content"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, split_at: int = SPLIT_AT) -> DataFrame:
    """One row a document: doc_id, n_bytes, spans (array<struct<start, end>>, bytes, maximal), kept_sha256."""
    keyed = numbered(docs, id_col, text_col)
    per_doc = materialize(later_ranges(keyed.select("doc", "content"), length, split_at).groupBy("doc").agg(F.collect_list("val").alias("vals")))
    # documents that lose nothing do not shuffle
    some = key_filter(materialize(per_doc.select(F.xxhash64("doc").alias("h"))))(F.col("h"))
    hashed = once(keyed, "h", F.xxhash64("doc"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    untouched = hashed.filter(~some).select(F.col("id").alias("doc_id"), F.octet_length("content").cast("long").alias("n_bytes"), none.alias("spans"), F.sha2("content", 256).alias("kept_sha256"))
    joined = hashed.filter(some).drop("h").join(per_doc, "doc", "left")

    @F.pandas_udf("n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    def cut(contents: pd.Series, vals: pd.Series) -> pd.DataFrame:
        out = []
        for raw, found in zip(contents, vals):
            spans: list[tuple[int, int]] = []
            if found is not None and len(found):
                v = np.sort(np.asarray(found, dtype=np.int64))
                s = v >> _SPAN
                e = np.maximum.accumulate(s + (v & 255) + length)
                cuts = np.flatnonzero(s[1:] > e[:-1])
                spans = list(zip(s[np.r_[0, cuts + 1]].tolist(), e[np.r_[cuts, len(e) - 1]].tolist()))
            at, digest = 0, hashlib.sha256()
            for a, b in spans:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            out.append((len(raw), [{"start": a, "end": b} for a, b in spans], digest.hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept_sha256"])

    return untouched.unionByName(joined.select(F.col("id").alias("doc_id"), cut("content", "vals").alias("x")).select("doc_id", "x.*"))


def removed_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text's bytes without the spans."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def op5_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
