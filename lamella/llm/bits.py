"""Filters over 64-bit hashes, in DataFrame functions only: two bits of one 64-bit word for each key.

A filter has 16 bits a key, at most ``MAX_BITS`` (2**28, 32 MB: the bound of what is broadcast, for 16 million keys); beyond
that more keys pass that are not in it, which costs a shuffle and changes no result. Words come in pages, so that a filter
is built by many tasks and never as one row a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import materialize

BITS_PER_KEY, MIN_BITS, MAX_BITS, PAGE = 16, 1 << 16, 1 << 28, 1024


def bits_for(keys: int, max_bits: int = MAX_BITS) -> int:
    """A power of two."""
    bits = min(MIN_BITS, max_bits)
    while bits < min(max_bits, BITS_PER_KEY * keys):
        bits *= 2
    return bits


def word(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit(bits // 64 - 1))


def mask(h: Column) -> Column:
    """Two bits of a word, or one."""
    bit = lambda first: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, first).bitwiseAND(F.lit(63)).cast("int"))
    return bit(40).bitwiseOR(bit(48))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row, however often a test uses it: generated, so that it is not put in its place."""
    return rows.withColumn(name, F.explode(F.array(value)))


def probe(words: DataFrame, bits: int) -> Callable[[Column], Column]:
    """words: w, m, each w once. A test of hashes: whether both bits are set."""
    every = words.sparkSession.range(bits // 64).withColumnRenamed("id", "w").join(words, "w", "left")
    pages = every.groupBy(F.floor(F.col("w") / PAGE).alias("page")).agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0)).alias("m")))).alias("a"))
    whole = pages.agg(F.array_sort(F.collect_list(F.struct("page", F.col("a.m").alias("words")))).alias("p")).select(F.col("p.words").alias("pages"))
    found = materialize(whole).scalar()

    def test(h: Column) -> Column:
        at = word(h, bits)
        return F.get(F.get(found, F.floor(at / PAGE).cast("int")), F.pmod(at, F.lit(PAGE)).cast("int")).bitwiseAND(mask(h)) == mask(h)

    return test


def key_filter(hashes: DataFrame, max_bits: int = MAX_BITS) -> Callable[[Column], Column]:
    """hashes: column h, stored. A test that is true for all of them, and for about one other in a hundred."""
    bits = bits_for(hashes.count(), max_bits)
    return probe(hashes.groupBy(word(F.col("h"), bits).alias("w")).agg(F.bit_or(mask(F.col("h"))).alias("m")), bits)
