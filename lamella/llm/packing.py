"""Best-fit packing by hierarchical residual packing.

Every partition tokenizes its documents, cuts those of more than ``capacity`` tokens, and packs its pieces best-fit,
longest first. Bins filled to ``nearly_full`` are final. The others become items: a tree merges the partitions by
``fan_in``, and each round packs the underfull bins of the partitions it joined best-fit again, until one partition is
left. Where one would hold more than ``max_items`` bins there are more, dealt anew each round, until a round saves less than
one bin in a hundred (of middling bins that no two of fit together, no more can be saved). Only (bin, fill) pairs move;
pieces learn their last bin by one join.

Defined results: null text is empty text and gives one token; repeated rows are documents of their own; a table with no
rows gives no pieces; very long documents are cut, never shortened; a null id is carried through. Memory in a task: the
pieces of at most ``chunk`` documents and one text, one portion of texts, and a cache of words of bounded size.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import give_back, materialize, table

CAPACITY, NEARLY_FULL, FAN_IN, MAX_ITEMS, CHUNK = 2048, 0.995, 8, 2_000_000, 100_000
END_ID = 0
CACHE_WORDS, CACHED_WORD = 80_000, 32  # of a generation (about 15 MB); longer words are not kept
PORTION = 6_000_000
CLOSING = string.punctuation
#: Words whose letters are encoded apart from closing punctuation: the last letter is in lower case, so that neither
#: lower-casing nor composing can end it with a mark, which the tokenizer would keep with the punctuation.
STEM = r"^\p{L}*\p{Ll}$"


class WordIds:
    """Little-endian 32-bit ids of texts, word by word: this tokenizer drops white space and never joins text across it.

    Of a word of letters with closing punctuation the letters and the punctuation are encoded apart, as the tokenizer
    splits them there. Ids of words that a portion has more than once are kept, in two generations: what is used moves to the
    young one, and the old one goes when that has CACHE_WORDS. New ones are encoded together, between end signs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        vocabulary = self.tokenizer.get_vocab()
        self.closes, self.marks = (np.zeros(max(vocabulary.values()) + 1, dtype=bool) for _ in range(2))
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.marks[vocabulary[self.mark]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _cut(self, texts: list[str], between: str, last: np.ndarray, kept: int) -> list[bytes]:
        """Ids of texts, encoded at once. last: which ids end a text; kept: whether that id is the text's own."""
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(texts)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = 4 * (np.flatnonzero(last[ids]) + kept)
        if len(at) + 1 - kept != len(texts):
            return [self._alone(x) for x in texts]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(at + 4 * (1 - kept)).tolist()], at.tolist() if kept else [*at.tolist(), len(raw)])]

    def _together(self, words: list[str]) -> list[bytes]:
        """Words that are normal letters are one run of tokens each, told by the end-of-word sign; others get an end sign between them."""
        plain, other = [], []
        for i, x in enumerate(words):
            normal = x.isalpha() and (x.isascii() or (x.lower().isalpha() and is_normalized("NFC", x)))
            (plain if normal else other).append(i)
        found: list[bytes] = [b""] * len(words)
        for some, ids in ((plain, self._cut([words[i] for i in plain], " ", self.closes, 1) if plain else []), (other, self._cut([words[i] for i in other], f" {self.mark} ", self.marks, 0) if other else [])):
            for i, x in zip(some, ids):
                found[i] = x
        return found

    def _ids(self, words: list[str], again: np.ndarray) -> list[bytes]:
        """Ids of these distinct words. again: whether a word is likely to come again."""
        young, old = self.young, self.old
        found = [young.get(x) for x in words]
        missing = []
        for i in [i for i, x in enumerate(found) if x is None]:
            x = old.get(words[i])
            if x is None:
                missing.append(i)
            else:
                found[i] = young[words[i]] = x
        plain = [i for i in missing if "<|" not in words[i]]
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            for i, x in zip(some, self._together([words[i] for i in some])):
                found[i] = x
        for i in missing:
            if found[i] is None:
                found[i] = self._alone(words[i])
            if again[i] and len(words[i]) <= CACHED_WORD:
                young[words[i]] = found[i]
        if len(young) > CACHE_WORDS:
            self.young, self.old = {}, young
        return found

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin, and the end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        del split  # what is done with goes before the next large arrays are made
        words, which = coded.dictionary, coded.indices.to_numpy()
        stem = pc.utf8_rtrim(words, CLOSING)
        apart = pc.match_substring_regex(stem, STEM)
        # a word's two parts, the second mostly empty
        first = pc.if_else(apart, stem, words).dictionary_encode()
        second = pc.if_else(apart, pc.replace_substring_regex(words, r"^\p{L}+", ""), "").dictionary_encode()
        often = np.bincount(first.indices.to_numpy(), weights=np.bincount(which, minlength=len(words)), minlength=len(first.dictionary)) > 1
        heads, tails = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (first, second))
        ids, starts, sizes = _joined(self._ids(heads, often) + self._ids(tails, np.ones(len(tails), dtype=bool)))
        parts = np.stack([first.indices.to_numpy(), second.indices.to_numpy() + len(first.dictionary)], axis=1).ravel()
        of_word, ends = _gather(ids, starts, sizes, parts)
        del heads, tails, ids, words, stem, apart, first, second, parts, often
        flat, ends = _gather(of_word, ends[:-1:2], ends[2::2] - ends[:-1:2], which)
        return flat, ends[at - at[0]]


def _joined(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids end to end, and where each word's begin and how many they are."""
    sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
    return np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes, dtype=np.int64) - sizes, sizes


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these items one after the other, and where each one's begin, and the end."""
    n = sizes[which]
    small = np.int32 if max(len(ids), int(n.sum(dtype=np.int64))) < 1 << 31 else np.int64
    ends = np.zeros(len(n) + 1, dtype=small)
    np.cumsum(n, out=ends[1:])
    at = np.repeat((starts[which] - ends[:-1]).astype(small), n)
    at += np.arange(len(at), dtype=small)
    return ids[at], ends


_word_ids: dict[str, WordIds] = {}  # of this Python worker, which serves many tasks


def word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """In order, slices of about PORTION bytes, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        done = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + PORTION, side="right")))
        yield texts.slice(at, to - at)
        at = to


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit, longest first. Returns each item's bin and offset, and each bin's fill."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    fills: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    some = 0  # bit r: a bin with room r
    order = np.argsort(-sizes, kind="stable")
    for i, n in zip(order.tolist(), sizes[order].tolist()):
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            b, r = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left = r - n
        if left:
            room[left].append(b)
            some |= 1 << left
    return bins, offsets, fills


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
MERGED = "bin long, parent long, shift long, fill long"
LEVELS = 15  # of merging; numbers of bins hold four bits for them


def _pieces(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray, capacity: int) -> pa.RecordBatch:
    """Pieces of documents whose ids lie end to end; each document's end sign comes after its ids."""
    n = np.diff(at) + 1
    count = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    length = np.minimum(capacity, n[doc] - start)
    a = at[doc] + start
    z = np.minimum(a + length, at[doc + 1])
    raw, end = memoryview(np.ascontiguousarray(ids)).cast("B"), np.array([END_ID], dtype="<u4").tobytes()
    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), z.tolist())]
    for i in np.flatnonzero(start + length == n[doc]).tolist():
        crc[i] = zlib.crc32(end, crc[i])
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def _pack_texts(tokenizer_path: str, capacity: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = word_ids(tokenizer_path), TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            bins, offsets, fills = best_fit(np.concatenate([x.column(3).to_numpy() for x in held]), capacity)
            fill = np.array(fills, dtype=np.int64)[bins]
            done = 0
            for x in held:
                own = slice(done, done + x.num_rows)
                done = own.stop
                yield pa.RecordBatch.from_arrays([*x.columns, *(pa.array(c[own], pa.int64()) for c in (bins + first, offsets, fill))], names=[*x.schema.names, "bin", "offset", "fill"])
            first += len(fills)
            held.clear()

        for batch in batches:
            done = 0
            for texts in _portions(batch.column(1)):
                held.append(_pieces(batch.column(0).slice(done, len(texts)), *words.of(texts), capacity))
                done += len(texts)
                if sum(x.num_rows for x in held) >= chunk:
                    yield from flush()
        if held:
            yield from flush()
        words.old = {}
        give_back()

    return run


def _pack_bins(capacity: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        ids, sizes = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(ids, kind="stable")
        ids, sizes = ids[order], sizes[order]
        bins, offsets, fills = best_fit(sizes, capacity)
        first = (level << 59) + (TaskContext.get().partitionId() << 36)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, bins + first, offsets, np.array(fills, dtype=np.int64)[bins])], names=["bin", "parent", "shift", "fill"])

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    nearly_full: float = NEARLY_FULL, fan_in: int = FAN_IN, max_items: int = MAX_ITEMS, chunk: int = CHUNK,
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInArrow(_pack_texts(tokenizer_path, capacity, chunk), PIECES))
    full = int(nearly_full * capacity)
    parts = max(1, rows.rdd.getNumPartitions())
    last = None  # of the bins that were left underfull: which bin holds them now
    items = pieces.filter((F.col("offset") == 0) & (F.col("fill") < full)).select("bin", "fill")
    left = items.count()
    for level in range(1, LEVELS + 1):
        before, parts = parts, max(-(-parts // fan_in), -(-left // max_items), 1)
        # partitions that merge are neighbours; where none can, for the number of items, they are dealt anew each round
        own = F.shiftright("bin", 36).bitwiseAND(F.lit((1 << 23) - 1)) if parts < before else F.xxhash64("bin", F.lit(level))
        merged = materialize(items.repartition(parts, F.pmod(own, F.lit(parts))).mapInArrow(_pack_bins(capacity, level), MERGED))
        if last is None:
            last = merged
        else:
            up = merged.select(F.col("bin").alias("parent"), F.col("parent").alias("up"), F.col("shift").alias("by"))
            joined = last.join(up, "parent", "left")
            last = joined.select("bin", F.coalesce("up", "parent").alias("parent"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
        items = merged.filter((F.col("shift") == 0) & (F.col("fill") < full)).select(F.col("parent").alias("bin"), "fill")
        had, left = left, items.count()
        if parts == 1 or (parts >= before and left > 0.99 * had):
            break
    if last is not None:
        pieces = pieces.join(last.select("bin", "parent", "shift"), "bin", "left")
    else:
        pieces = pieces.withColumns({"parent": F.col("bin"), "shift": F.lit(0).cast("long")})
    return pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
