"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets two bits for every row in one 64-bit word of the filter, by the hash of the normalised text, and learns
which bits were hit again: of the masks that fall in a word, the exclusive or and the or tell the bits that were hit an even
number of times, and the number of hits tells whether any bit can have been hit three times (then the whole word counts as
hit again). These are sums that each task combines before the shuffle, so that pass one moves a few numbers for each word a
task met, and no row. Pass two probes every row: with a bit that was hit once it is unique for certain and passes straight
through; only the rest shuffle, as digests, and are grouped exactly. The size of the filter is bounded (see bits).

``annotate`` reads texts once and stores a short row for each; ``deduplicate`` reads them in each pass and stores suspects only.

Defined results: null text is empty text; empty texts equal each other; of rows that tie in length and id (repeated
rows) the one with the least stored number stays, so that one of them is kept; a null id sorts first; an empty table gives
an empty result; input columns of any name are carried in one struct and cannot clash. Numbers are stored before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.bits import MAX_BITS, bits_for, mask, once, probe, word
from lamella.llm.common import SPACES, materialize, table, text_or_empty


def normalised(text: Column) -> Column:
    """The text without any white space."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated(hashes: DataFrame, bits: int) -> Callable[[Column], Column]:
    """hashes: column h, a row for each document. A test of hashes: false only for those of one document."""
    hit = hashes.select(word(F.col("h"), bits).alias("w"), mask(F.col("h")).alias("m")).groupBy("w")
    sums = hit.agg(F.bit_or("m").alias("any"), F.bit_xor("m").alias("odd"), F.sum(F.bit_count("m")).alias("hits"))
    even = F.col("any").bitwiseAND(F.bitwise_not("odd"))
    clear = F.col("hits") == F.bit_count("odd") + 2 * F.bit_count(even)
    return probe(sums.select("w", F.when(clear, even).otherwise(F.col("any")).alias("m")).filter("m <> 0"), bits)


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of docs as one struct, and id, n, norm, h."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    return once(rows.select("row", "id", "t", F.length("t").alias("n"), normalised(F.col("t")).alias("norm")), "h", F.xxhash64("norm")).drop("t")


def _groups(suspects: DataFrame) -> DataFrame:
    """suspects: id, u, n, sha, stored. Of each group of several: sha, group_size, best_id, best_u. Stored, so that joins with
    it have a plain shuffle on both sides, whose large partitions Spark can split."""
    groups = suspects.groupBy("sha").agg(F.min(F.struct((-F.col("n")).alias("n"), "id", "u")).alias("best"), F.count("*").alias("group_size"))
    return materialize(groups.filter("group_size > 1").select("sha", "group_size", F.col("best.id").alias("best_id"), F.col("best.u").alias("best_u")))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each of docs: doc_id, keep_id, group_size, kept and text_sha256."""
    rows = _digests(docs, id_col, text_col).select("id", "n", "h", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("u"))
    base = materialize(rows)
    again = repeated(base.select("h"), bits_for(base.count(), max_bits))
    alone = lambda df: df.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    suspects = base.filter(again(F.col("h")))
    groups = _groups(suspects)
    copies = suspects.join(groups, "sha").select(F.col("id").alias("doc_id"), F.col("best_id").alias("keep_id"), "group_size", (F.col("u") == F.col("best_u")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone(base.filter(~again(F.col("h")))).unionByName(alone(suspects.join(groups, "sha", "left_anti"))).unionByName(copies)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with the columns of docs. Only suspects are stored with their texts; the rest pass as they are read."""
    rows = _digests(docs, id_col, text_col)
    hashes = materialize(rows.select("h"))
    again = repeated(hashes, bits_for(hashes.count(), max_bits))
    suspects = materialize(rows.filter(again(F.col("h"))).select("row", "id", "n", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("u")))
    gone = suspects.select("sha", "u").join(_groups(suspects).select("sha", "best_u"), "sha").filter("u <> best_u").select("u")
    kept = suspects.join(gone, "u", "left_anti").select("row.*")
    return rows.filter(~again(F.col("h"))).select("row.*").unionByName(kept)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents
), r as (
  select doc_id, t, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size,
         row_number() over w = 1 as kept
  from n window w as (partition by t order by n desc, doc_id)
)
select doc_id, keep_id, group_size, kept, sha256(t) as text_sha256 from r
"""
