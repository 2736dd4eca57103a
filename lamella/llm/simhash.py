"""SimHash near-dedup by tiled exact comparison.

Fingerprints are compared once for each distinct value. Two values at ``radius`` or fewer differing bits agree in one of
radius + 1 blocks of bits, so each value enters one bucket for each block; a bucket with more than ``split_at`` values
is dealt again by blocks of its remaining bits, which loses no pair either. A bucket is sorted by population count
and cut into tiles; tile pairs whose counts differ by more than the radius are skipped (no pair in them can link), as
are pairs that are one component already; the others are compared whole by exclusive or and bit counts. A bucket gives
one edge for each value at most (to its local root), and star contraction joins the edges into components.

``deduplicate`` links by the exact Jaccard similarity of the sets of distinct shingles (five words) instead. Its
fingerprints are wide (``LANES`` x 64 bits of the same sets), and at their radius (``DEVIATIONS`` beyond what is expected of
the least similar pair) blocks of bits are too short to tell anything. Tiles are compared within buckets of the sets'
minima instead: texts share a bucket where the least hashes under ``ROWS`` permutations agree, in one of ``BANDS`` ways;
at a similarity of 0.8 a pair meets with a chance of 0.998, more above. A bucket of more than ``split_at`` texts is cut
into blocks, and each pair of its blocks is compared in a task of its own. Components of candidates are then linked by
their sets, each component in one task, or in one for each pair of its blocks of about ``BLOCK`` shingles, so that no row
is made for a pair of texts.

Defined results: null text is empty text; texts without words have fingerprint zero and link like any other; repeated
rows share a fingerprint and a component; a null id never names a component that has another id; an empty table gives
an empty result; input columns of any name are carried in one struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lamella.llm.bits import key_filter, once
from lamella.llm.common import give_back, materialize, table

WORDS, RADIUS, SEED, TILE, SPLIT_AT = 4, 4, 42, 128, 20_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
HELD = 1 << 18  # shingles counted at once, and bucket rows gathered before they are compared


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 of each run of so many words, repeats included; fewer words: of the whole sequence; none: no hash."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())]


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    """The set of shingle_hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), dtype="<u8"))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    hashes = np.array(shingle_hashes(text, words), dtype="<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HELD):
        ones += np.unpackbits(hashes[at : at + HELD].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words) for x in texts], dtype="int64")

    return of(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, length) of n blocks of bits, as equal as can be."""
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(value: Column, first: int, length: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << length) - 1))


def buckets(values: DataFrame, radius: int = RADIUS, split_at: int = SPLIT_AT) -> DataFrame:
    """values: column fp, distinct. Rows (band, key, sub, fp): whoever links shares (band, key, sub) somewhere."""
    spread = values.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), _bits(F.col("fp"), *b).alias("key")) for i, b in enumerate(_blocks(64, radius + 1))])).alias("b")).select("fp", "b.*")
    hot = spread.groupBy("band", "key").count().filter(F.col("count") > split_at).select("band", "key", F.lit(True).alias("hot"))
    marked = spread.join(hot, ["band", "key"], "left")
    plain = marked.filter("hot is null").select("band", "key", F.lit(-1).cast("long").alias("sub"), "fp")
    rest = F.lit(None).cast("long")
    for i, (first, length) in enumerate(_blocks(64, radius + 1)):
        high = F.shiftleft(F.shiftrightunsigned("fp", first + length), first) if first + length < 64 else F.lit(0).cast("long")
        rest = F.when(F.col("band") == i, high.bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << first) - 1)))).otherwise(rest)
    left = 64 - min(n for _, n in _blocks(64, radius + 1))
    subs = F.array(*[_bits(F.col("rest"), *b).bitwiseOR(F.lit(i << 40)) for i, b in enumerate(_blocks(left, radius + 1))])
    again = marked.filter("hot").withColumn("rest", rest).select("band", "key", F.explode(subs).alias("sub"), "fp")
    return plain.unionByName(again)


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_sorted(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS, tile: int = TILE, whole: int | None = None) -> np.ndarray:
    """fp (unsigned; a word for each row, or several), sorted by bucket, then by population count of the first word. The
    place of each row's local root. Rows link if their first words differ in ``radius`` bits or fewer, and all in ``whole``."""
    n = len(fp)
    words = fp.reshape(n, -1)
    lead = words[:, 0]
    pops = np.bitwise_count(lead).astype(np.int64)
    parent = np.arange(n)
    for a in range(0, n, tile):
        a_end = min(a + tile, n)
        for b in range(a, n, tile):
            if b > a and (bucket[b] != bucket[a_end - 1] or pops[b] - pops[a_end - 1] > radius):
                break
            b_end = min(b + tile, n)
            if bucket[a] == bucket[b_end - 1]:
                r = _root(parent, a)
                if all(parent[i] == r or _root(parent, i) == r for x, y in ((a, a_end), (b, b_end)) for i in range(x, y)):
                    continue
            near = (np.bitwise_count(lead[a:a_end, None] ^ lead[None, b:b_end]) <= radius) & (bucket[a:a_end, None] == bucket[None, b:b_end])
            i, j = np.nonzero(near)
            keep = i + a < j + b
            i, j = i[keep] + a, j[keep] + b
            if whole is not None:
                near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= whole
                i, j = i[near], j[near]
            if len(i):
                _union(parent, i, j)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _link(radius: int, tile: int, whole: int | None = None):
    """Rows of three columns that name a bucket, a node and its words, sorted by bucket. Edges a, b of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: np.ndarray) -> pa.RecordBatch:
            bucket = np.cumsum(np.any(np.diff(rows[:3], axis=1, prepend=rows[:3, :1]) != 0, axis=0))
            lead = rows[4].view(np.uint64)
            order = np.lexsort((rows[3], lead, np.bitwise_count(lead), bucket))
            node, words, bucket = rows[3, order], np.ascontiguousarray(rows[4:, order].T).view(np.uint64), bucket[order]
            root = link_sorted(bucket, words, radius, tile, whole)
            own = node != node[root]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[own], node[root][own])], names=["a", "b"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size >= HELD:
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero(np.any(np.diff(rows[:3], axis=1) != 0, axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
                if cut:
                    yield edges(rows[:, :cut])
                held = [rows[:, cut:]]
                size = rows.shape[1] - cut
        if size:
            yield edges(np.concatenate(held, axis=1))
        give_back()

    return run


LANES, DEVIATIONS, BANDS, ROWS = 4, 4, 16, 5
BLOCK = 1 << 20  # shingles of one candidate component that are held together, twice
_ODD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def wide_fingerprint(text: str | None, words: int) -> bytes:
    """LANES fingerprints side by side, of the distinct shingles' hashes and of LANES - 1 mixtures of them; little-endian."""
    return wide_of(distinct_shingles(text, words))


def wide_of(hashes: np.ndarray) -> bytes:
    out = []
    for lane in range(LANES):
        if not len(hashes):
            out.append(np.zeros(8, dtype=np.uint8))
            continue
        h = hashes
        if lane:
            h = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD[lane - 1])
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[0])
            h = (h ^ (h >> np.uint64(32))).astype("<u8")
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), HELD):
            ones += np.unpackbits(h[at : at + HELD].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h), bitorder="little"))
    return np.concatenate(out).tobytes()


def _differ(both: int, a: int, b: int) -> float:
    """Chance that a bit differs between two sets of that many common and own shingles; even counts of ones are zero."""

    def one(k: int, own: int) -> float:
        return sum(comb(own, x) for x in range(own + 1) if 2 * (k + x) > both + own) / 2**own

    chances = [(comb(both, k) / 2**both, one(k, a), one(k, b)) for k in range(both + 1)]
    return sum(p * (x * (1 - y) + y * (1 - x)) for p, x, y in chances)


@cache
def radii(similarity: float) -> tuple[int, int]:
    """Most differing bits of the first 64 and of all bits for candidates of that Jaccard similarity: the expected number
    and DEVIATIONS more. The share expected is that of the angle of two sets of one size, or of small sets if more."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    for whole in range(2, 41):
        least = next(k for k in range(whole + 1) if k / whole >= similarity)
        share = max(share, *(_differ(least, a, whole - least - a) for a in range(whole - least + 1)))
    most = [int(n * share + DEVIATIONS * np.sqrt(n * share * (1 - share))) for n in (64, 64 * LANES)]
    return most[0], most[1]


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        x, y = parent[i], parent[j]
        while (parent[x] != x).any() or (parent[y] != y).any():
            x, y = parent[x], parent[y]
        open_ = x != y
        i, j, lo, hi = i[open_], j[open_], np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        np.minimum.at(parent, hi, lo)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """sets: hashes, none empty. Of each, the BANDS numbers that name its buckets: of ROWS least hashes each."""
    rng = np.random.default_rng(SEED)
    turn, odd = (rng.integers(0, 1 << 64, size=BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    odd |= np.uint64(1)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    least = np.full((BANDS * ROWS, len(sets)), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(flat), HELD):
        h = flat[at : at + HELD]
        lo, hi = np.searchsorted(ends, [at, at + len(h) - 1], side="right")
        begins = np.maximum(ends[lo : hi + 1] - sizes[lo : hi + 1] - at, 0)
        for k in range(BANDS * ROWS):
            np.minimum(least[k, lo : hi + 1], np.minimum.reduceat((h ^ turn[k]) * odd[k], begins), out=least[k, lo : hi + 1])
    names = np.empty((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        x = np.full(len(sets), band + 1, dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            x = (x ^ least[k]) * np.uint64(_ODD[0])
            x ^= x >> np.uint64(29)
        names[:, band] = x
    return names.view(np.int64)


def similar_links(values: DataFrame, similarity: float, split_at: int = SPLIT_AT) -> DataFrame:
    """values: node (long), w0 to w3 (long), bands (array<long>), distinct. Edges a, b whose contraction has the components
    of all candidate pairs: those that share a bucket and whose fingerprints are near."""
    first, whole = radii(similarity)
    spread = values.select("node", *(f"w{i}" for i in range(LANES)), F.explode("bands").alias("key"))
    several = spread.groupBy("key").count().filter("count > 1")
    blocks = F.when(F.col("count") > split_at, F.ceil(2 * F.col("count") / split_at)).otherwise(1).cast("int")
    placed = spread.join(several, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    return _block_pairs(placed, "key", ["node", *(f"w{i}" for i in range(LANES))]).mapInArrow(_link(first, TILE, whole), "a long, b long")


def _block_pairs(placed: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """placed: group, blocks (how many the group has), block, columns. Every row once for each pair of blocks that holds its own, sorted by pair."""
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (F.col("blocks") == 1) | (k != F.col("block")))
    units = placed.select(group, "block", *columns, F.explode(other).alias("other"))
    units = units.select(group, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *columns)
    return units.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def link_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """sets: distinct hashes, none empty. The place of each one's root in the components of Jaccard similarity or more.

    A set at a time is compared with all of fitting size that are not joined to it; those of the largest component need no turn."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    vocabulary, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    parent, done, mine = np.arange(len(sets)), np.zeros(len(sets), dtype=bool), np.zeros(len(vocabulary), dtype=np.uint8)
    while True:
        turn = np.flatnonzero(~done & (parent != np.argmax(np.bincount(parent))))
        if not len(turn):
            break
        i = int(turn[0])
        done[i] = True
        n = sizes[i]
        lo, hi = np.searchsorted(sizes, [np.ceil(similarity * n - 1e-9), np.floor(n / similarity + 1e-9) + 1])
        if (parent[lo:hi] == parent[i]).all():
            continue
        own = codes[starts[i] : starts[i] + n]
        mine[own] = 1
        both = np.add.reduceat(mine[codes[starts[lo] : starts[hi - 1] + sizes[hi - 1]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        mine[own] = 0
        met = np.unique(parent[lo:hi][both / (n + sizes[lo:hi] - both) >= similarity])
        parent[np.isin(parent, met)] = met[0]
    root = np.empty(len(sets), dtype=np.int64)
    root[order] = order[parent]
    return root


def _link_sets(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> pa.RecordBatch:
            root = link_sets(sets, similarity)
            node = np.array(nodes, dtype=np.int64)
            own = node != node[root]
            return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], names=["a", "b"])

        of, nodes, sets = None, [], []
        for batch in batches:
            for r, unit in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if unit != of and nodes:
                    yield edges()
                    nodes, sets = [], []
                of = unit
                nodes.append(batch.column(3)[r].as_py())
                sets.append(np.frombuffer(batch.column(4)[r].as_py(), dtype="<u8"))
        if nodes:
            yield edges()

    return run


def verified_links(texts: DataFrame, candidates: DataFrame, values: DataFrame, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """texts: id, th, t. candidates: node, root. values: node, first (id, th), n. Edges a, b whose contraction has the
    components of all pairs in one candidate component whose distinct shingles have that Jaccard similarity or more."""

    @F.pandas_udf("binary")
    def distinct(found: pd.Series) -> pd.Series:
        return pd.Series([distinct_shingles(x, words).tobytes() for x in found])

    members = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct()).join(values.select("node", "first", "n"), "node")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
    placed = materialize(members.join(blocks, "root").select("node", "root", "first.id", "first.th", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))
    asked = key_filter(materialize(placed.select(F.xxhash64("id", "th").alias("h"))))
    few = once(texts, "h", F.xxhash64("id", "th")).filter(asked(F.col("h"))).drop("h")  # other texts do not shuffle
    held = few.join(placed, ["id", "th"]).dropDuplicates(["id", "th"]).select("root", "node", "blocks", "block", distinct("t").alias("set"))
    return _block_pairs(held, "root", ["node", "set"]).mapInArrow(_link_sets(similarity), "a long, b long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of similar texts, that of the smallest id (then of the least hash of the text), with
    the columns of docs; of rows equal in id and text, one."""

    lanes = [f"w{i}" for i in range(LANES)]

    @F.pandas_udf(f"node long, n long, {', '.join(f'{w} long' for w in lanes)}, bands array<long>")
    def described(texts: pd.Series) -> pd.DataFrame:
        sets = [distinct_shingles(x, words) for x in texts]
        able = [x for x in sets if len(x)]
        names = iter(minima(able).tolist())
        wide = np.array([np.frombuffer(wide_of(x), dtype="<i8") for x in sets], dtype=np.int64).reshape(-1, LANES)
        nodes = [int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in sets]
        out = {"node": np.array(nodes, dtype=np.int64), "n": np.array([len(x) for x in sets], dtype=np.int64)} | {w: wide[:, i] for i, w in enumerate(lanes)}
        out = pd.DataFrame(out | {"bands": [next(names) if len(x) else [] for x in sets]})
        give_back()
        return out

    text = F.coalesce(F.col(text_col), F.lit(""))
    key = lambda df: df.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), F.col(text_col).alias("t"))
    rows = materialize(key(docs).select("id", "th", described("t").alias("x")).select("id", "th", "x.*"))
    values = materialize(rows.groupBy("node", "n").agg(F.min(F.struct("id", "th", *lanes, "bands")).alias("x")).select("node", "n", F.struct("x.id", "x.th").alias("first"), *(f"x.{w}" for w in lanes), "x.bands"))
    able = values.filter(F.col("n") / (F.col("n") + 1) >= similarity)  # fewer shingles: similar to equal sets only, which are one node
    near = components(similar_links(able, similarity)).filter("node <> root")
    of = components(verified_links(key(docs).select("id", "th", "t"), near, values, words, similarity)).filter("node <> root")
    roots = values.join(of, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("keep"))
    keep = materialize(roots.select("keep.id", "keep.th").join(rows.groupBy("id", "th").count(), ["id", "th"]))
    # rows that go, or come several times; all others pass without a shuffle
    marked = materialize(rows.join(keep.filter("count = 1"), ["id", "th"], "left_anti").select(F.xxhash64("id", "th").alias("h")))
    of_marked = key_filter(marked)(F.col("h"))
    hashed = once(key(docs).drop("t"), "h", F.xxhash64("id", "th"))
    kept = hashed.filter(of_marked).drop("h").join(keep, ["id", "th"])
    alone = kept.filter(F.col("count") == 1).select("row")
    again = kept.filter(F.col("count") > 1).dropDuplicates(["id", "th"]).select("row")
    return hashed.filter(~of_marked).select("row").unionByName(alone).unionByName(again).select("row.*")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). Rows (node, root): the smallest node that each node reaches; nodes without edges are absent."""
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = materialize(small.filter("u <> v").distinct())
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(rows: DataFrame, radius: int = RADIUS, split_at: int = SPLIT_AT, tile: int = TILE) -> DataFrame:
    """rows: columns id, fp. One row for each distinct fp: fp, component_id (smallest id reachable)."""
    values = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")))
    entries = buckets(values.select("fp"), radius, split_at)
    dealt = entries.repartition("band", "key", "sub").sortWithinPartitions("band", "key", "sub")
    links = dealt.select("band", "key", "sub", "fp", F.col("fp").alias("word")).mapInArrow(_link(radius, tile), "a long, b long")
    of = components(links).withColumnRenamed("node", "fp")
    rooted = values.join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, split_at: int = SPLIT_AT) -> DataFrame:
    """One row a document: doc_id, fp (signed), component_id."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), words).alias("fp")))
    return rows.join(classes(rows, radius, split_at), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
