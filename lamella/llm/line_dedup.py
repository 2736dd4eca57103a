"""Line dedup by a suffix array over line-id sequences, built by distributed prefix doubling.

Every line gets an id; a line that occurs once is a symbol of its own, and so is every document's end, so that only suffixes
that begin with a repeated line need a place. Suffixes are ranked by their first line, then by two, four and so on lines: a
suffix's rank over twice as many lines is that of the pair (its rank, the rank of the suffix that many lines on), and ranks
are numbers in sorted order, from a range-partitioned sort of the distinct pairs. Doubling goes on until every suffix stands
alone: that is the suffix array. What classes a suffix was in at each power of two stays with it.

The longest common prefix of neighbours in the array is put together from the highest power down: where both are in one class,
that many lines are common, and the rest is that of the suffixes so many lines on. A run of neighbours with common prefixes of
``min_lines`` or more is a longest-common-prefix interval; the larger of a suffix's two prefixes is the longest repeated run of
lines that starts there. All but the first window of an interval (smallest id, then place) are deleted, which deletes the
later copies of maximal repeated runs; runs are judged on the input and never cross documents.

Defined results: null text is empty text, one empty line; texts with fewer lines than ``min_lines`` stay whole; rows
equal in id and text are one document listed twice and get equal results; a null id sorts first; line ends are LF, and
any other character belongs to its line; an empty table gives an empty result; input columns cannot clash.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import SparkSession

from lamella.llm.bits import key_filter, once
from lamella.llm.common import materialize, table, text_or_empty

MIN_LINES = 3
PLACE = ["doc", "tag", "p"]
_LOW = 33  # bits of a number within its partition


def _numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """Distinct keys with a rank: numbers in sorted order, one after the other within a partition."""
    return keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("new", F.monotonically_increasing_id())


def suffix_array(lines: DataFrame) -> DataFrame:
    """lines: doc, tag, p (from 0), r1, r2 (the line's id). Of each suffix that begins with a repeated line: its place, rank
    (all different), and past: the classes it shared with others, by 1, 2, 4, ... lines."""
    several = lines.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1")
    ranks = materialize(_numbered(several, ["r1", "r2"]))
    state = materialize(lines.join(ranks, ["r1", "r2"]).select(*PLACE, F.col("new").alias("rank"), "n", F.array("new").alias("past")))
    length = 1
    while not state.filter("n > 1").isEmpty():
        after = F.max("rank").over(Window.partitionBy("doc", "tag").orderBy("p").rangeBetween(length, length))
        # alone: by its rank; followed by a symbol of its own: by its place, before the others; else by the pair
        kind = F.when(F.col("n") == 1, 0).when(F.col("after").isNull(), 1).otherwise(2)
        none = F.lit(0).cast("long")
        keyed = state.withColumn("after", after).withColumn("kind", kind)
        own = lambda c: F.when(F.col("kind") == 1, F.col(c).cast("long")).otherwise(none)
        keyed = keyed.withColumns({"k2": F.when(F.col("kind") == 2, F.col("after")).otherwise(none), "k3": own("doc"), "k4": own("tag"), "k5": own("p")})
        key = ["rank", "kind", "k2", "k3", "k4", "k5"]
        ranks = materialize(_numbered(keyed.groupBy(*key).agg(F.count("*").alias("m")), key))
        joined = keyed.join(ranks, key)
        past = F.when(F.col("m") > 1, F.array_append("past", F.col("new"))).otherwise(F.col("past"))
        state = materialize(joined.select(*PLACE, F.col("new").alias("rank"), F.col("m").alias("n"), past.alias("past")))
        length *= 2
    return state.select(*PLACE, "rank", "past")


def _level(a: Column, b: Column) -> Column:
    """The highest place at which two arrays of classes agree, or -1; below it they agree too."""
    return F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(-1), lambda n, z: n + F.when(z["x"] == z["y"], 1).otherwise(0))


def neighbours(array: DataFrame) -> DataFrame:
    """Each suffix but the first, beside the one before it: rank, i and j (their places), level (the highest power of two at
    which they are in one class, or -1)."""
    by = Window.partitionBy("part").orderBy("rank")
    cols = [*PLACE, "past"]
    rows = array.withColumn("part", F.shiftright("rank", _LOW))
    last = rows.groupBy("part").agg(F.max_by(F.struct(*cols), "rank").alias("last")).orderBy("part").collect()  # a row a partition
    spark = array.sparkSession
    kind = rows.select(F.struct(*cols).alias("last")).schema["last"].dataType.simpleString()
    before = spark.createDataFrame([(b["part"], a["last"]) for a, b in zip(last, last[1:])], f"part long, last {kind}")
    both = rows.withColumn("lag", F.lag(F.struct(*cols)).over(by)).join(F.broadcast(before), "part", "left").withColumn("j", F.coalesce("lag", "last"))
    pairs = both.filter("j is not null").withColumn("level", _level(F.col("past"), F.col("j.past")))
    return pairs.select("rank", F.struct(*PLACE).alias("i"), F.struct(*(F.col(f"j.{c}") for c in PLACE)).alias("j"), "level")


def common_prefixes(array: DataFrame) -> DataFrame:
    """rank, lcp: how many lines a suffix shares with the one before it in the array."""
    power = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    pairs = materialize(neighbours(array).withColumn("lcp", F.lit(0).cast("long")))
    done = []
    while True:
        done.append(pairs.filter("level < 1").select("rank", F.when(F.col("level") == 0, F.col("lcp") + 1).otherwise(F.col("lcp")).alias("lcp")))
        open_ = pairs.filter("level >= 1").withColumn("lcp", F.col("lcp") + power())
        if open_.isEmpty():
            break
        at = lambda side: F.xxhash64(f"{side}.doc", f"{side}.tag", (F.col(f"{side}.p") + F.col("lcp")).cast("int"))
        wanted = materialize(open_.select(F.explode(F.array(at("i"), at("j"))).alias("h")))
        few = array.filter(key_filter(wanted)(F.xxhash64("doc", "tag", F.col("p").cast("int"))))
        for side in "ij":
            right = few.select(*(F.col(c).alias(f"{side}{c}") for c in PLACE), F.col("past").alias(f"{side}past"))
            on = (F.col(f"{side}.doc") == F.col(f"{side}doc")) & (F.col(f"{side}.tag") == F.col(f"{side}tag")) & (F.col(f"{side}.p") + F.col("lcp") == F.col(f"{side}p"))
            open_ = open_.join(right, on, "left")
        pairs = materialize(open_.select("rank", "i", "j", F.coalesce(_level(F.col("ipast"), F.col("jpast")), F.lit(-1)).alias("level"), "lcp"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialize(out)


def intervals(array: DataFrame, prefixes: DataFrame, min_lines: int) -> DataFrame:
    """Suffixes of longest-common-prefix intervals of ``min_lines`` or more: doc, tag, p, interval, longest."""
    rows = array.select(*PLACE, "rank").join(prefixes, "rank", "left").withColumns({"lcp": F.coalesce("lcp", F.lit(0).cast("long")), "part": F.shiftright("rank", _LOW)})
    rows = materialize(rows.withColumn("head", F.when(F.col("lcp") < min_lines, F.col("rank"))))
    facts = rows.groupBy("part").agg(F.max("head").alias("head"), F.min_by("lcp", "rank").alias("lcp")).orderBy("part").collect()  # a row a partition
    carried, heads = None, []
    for k, x in enumerate(facts):
        heads.append((x["part"], carried, facts[k + 1]["lcp"] if k + 1 < len(facts) else 0))
        carried = x["head"] if x["head"] is not None else carried
    beyond = rows.sparkSession.createDataFrame(heads, "part long, carried long, next_lcp long")
    by = Window.partitionBy("part").orderBy("rank")
    found = rows.join(F.broadcast(beyond), "part").withColumns({
        "interval": F.coalesce(F.max("head").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried")),
        "longest": F.greatest("lcp", F.coalesce(F.lead("lcp").over(by), F.col("next_lcp"))),
    })
    return found.filter(F.col("longest") >= min_lines).select(*PLACE, "interval", "longest")


def repeated_windows(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """lines: doc, tag, p (from 0), r1, r2 (the line's id). Rows doc, tag, p, longest: windows that start earlier elsewhere, and
    the longest repeated run that starts with them."""
    array = suffix_array(lines)
    found = materialize(intervals(array, common_prefixes(array), min_lines))
    firsts = found.groupBy("interval").agg(F.min(F.struct(*PLACE)).alias("first"))
    # a place of an interval's own: stored on both sides, so that a join with a very common interval can be split
    first = materialize(firsts)
    return found.join(first, "interval").filter(F.struct(*PLACE) != F.col("first")).select(*PLACE, "longest")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """One row a document: doc_id, n_lines, runs (array<struct<start, end>>, deleted lines), longest (repeated run that starts
    at a deleted window, in lines; 0 if none), kept_text."""
    t = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(t).alias("tag"), t.alias("t"))
    ids = keyed.select("doc", "tag", F.transform(F.split("t", "\n"), lambda x: F.struct(F.xxhash64(x).alias("r1"), F.crc32(x.cast("binary")).alias("r2"))).alias("ids"))
    single = ids.groupBy("doc", "tag").agg(F.min("ids").alias("ids"))
    lines = materialize(single.select("doc", "tag", F.posexplode("ids").alias("p", "x")).select("doc", "tag", "p", "x.r1", "x.r2"))
    late = materialize(repeated_windows(lines, min_lines).groupBy("doc", "tag").agg(F.collect_list("p").alias("starts"), F.max("longest").alias("longest")))

    @F.pandas_udf("n_lines long, runs array<struct<start:long,end:long>>, kept_text string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, starts):
            if found is None or not len(found):
                out.append((text.count("\n") + 1, [], text))
                continue
            parts, s = text.split("\n"), np.sort(np.asarray(found, dtype=np.int64))
            cuts = np.flatnonzero(s[1:] > s[:-1] + min_lines)
            runs = list(zip(s[np.r_[0, cuts + 1]].tolist(), (s[np.r_[cuts, len(s) - 1]] + min_lines).tolist()))
            gone = np.zeros(len(parts), dtype=bool)
            for a, z in runs:
                gone[a:z] = True
            out.append((len(parts), [{"start": a, "end": z} for a, z in runs], "\n".join(x for x, g in zip(parts, gone) if not g)))
        return pd.DataFrame(out, columns=["n_lines", "runs", "kept_text"])

    # documents that lose nothing do not shuffle
    some = key_filter(materialize(late.select(F.xxhash64("doc", "tag").alias("h"))))(F.col("h"))
    keyed = once(keyed, "h", F.xxhash64("doc", "tag"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    untouched = keyed.filter(~some).select(F.col("id").alias("doc_id"), (F.length("t") - F.length(F.replace("t", F.lit("\n"))) + 1).cast("long").alias("n_lines"), none.alias("runs"), F.lit(0).cast("long").alias("longest"), F.col("t").alias("kept_text"))
    joined = keyed.filter(some).drop("h").join(late, ["doc", "tag"], "left").select(F.col("id").alias("doc_id"), F.coalesce("longest", F.lit(0)).alias("longest"), cut("t", "starts").alias("x"))
    return untouched.unionByName(joined.select("doc_id", "x.n_lines", "x.runs", "longest", "x.kept_text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_lines", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_runs"), F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
with l as (
  select doc_id, unnest(s) as line, cast(generate_subscripts(s, 1) as bigint) as p
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)
), w as (
  select doc_id, p, line, lead(line, 1) over d as l2, lead(line, 2) over d as l3 from l window d as (partition by doc_id order by p)
), late as (
  select doc_id, p from (
    select doc_id, p, row_number() over (partition by line, l2, l3 order by doc_id, p) as k from w where l3 is not null
  ) where k > 1
), marked as (
  select l.doc_id, l.p, l.line, exists (select 1 from late x where x.doc_id = l.doc_id and x.p = l.p)
    or exists (select 1 from late x where x.doc_id = l.doc_id and x.p = l.p - 1)
    or exists (select 1 from late x where x.doc_id = l.doc_id and x.p = l.p - 2) as gone
  from l
), r as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as opens from marked
)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_removed, cast(count(*) filter (opens) as bigint) as n_runs,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (not gone), '')) as kept_sha256
from r group by doc_id
"""
