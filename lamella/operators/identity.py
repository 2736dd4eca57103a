"""Identities: ordered hashes, fingerprints of long sources, dataset ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, QUICKHASH_LIMIT = 64 << 10, 5 << 20


def quickhash(parts: DataFrame, by: list[str], order: str, data: str) -> DataFrame:
    """SHA-256 of a group's parts in order; null where they are more than 5 MiB."""
    ordered = F.array_sort(F.collect_list(F.struct(order, data)))
    joined = F.aggregate("parts", F.lit("").cast("string"), lambda a, p: F.concat(a, F.coalesce(p[data], F.lit(""))))
    out = parts.groupBy(*by).agg(F.sum(F.octet_length(data)).alias("bytes"), ordered.alias("parts"))
    return out.withColumn("quickhash", F.when(F.col("bytes") <= QUICKHASH_LIMIT, F.sha2(joined, 256))).drop("parts")


# Text tags in the order in which a TIFF's identity takes them, with the names that it gives them.
HASHED_TEXTS = [
    ("tiff.ImageDescription", 270), ("tiff.Make", 271), ("tiff.Model", 272), ("tiff.Software", 305), ("tiff.DateTime", 306), ("tiff.Artist", 315), ("tiff.HostComputer", 316), ("tiff.Copyright", 33432), ("tiff.DocumentName", 269),
]


def text_properties(tags: DataFrame, of: DataFrame) -> DataFrame:
    """of: path, ifd_id (the directory whose texts count). path, texts: names and values, each ended by a zero byte."""
    own = tags.join(of.select("path", "ifd_id"), ["path", "ifd_id"])
    value = lambda n: F.coalesce(F.max(F.when(F.col("tag") == n, F.col("text"))), F.lit(""))
    zero = F.unhex(F.lit("00"))
    parts = [p for name, n in HASHED_TEXTS for p in (F.lit(name).cast("binary"), zero, value(n).cast("binary"), zero)]
    return own.groupBy("path").agg(F.concat(*parts).alias("texts"))


def tiff_identity(ranges: DataFrame, texts: DataFrame, facts: DataFrame) -> DataFrame:
    """ranges: path, index, offset, length, payload of the lowest level. texts: of ``text_properties``. facts: path, ifds, top_ifds,
    big_endian, big, ifd_id (of that level). Adds quickhash, null where the level has more than 5 MiB, and dataset_id: the hash's
    128 bits, else those of a hash over the file's structure."""
    c = F.col
    cut = lambda column, kind: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("index", column))), lambda x: x[kind]), F.unhex(F.lit("")), lambda a, p: F.concat(a, p))
    small = F.sum("length").over(Window.partitionBy("path")) <= QUICKHASH_LIMIT
    rows = ranges.withColumns({"part": F.when(small, c("payload")), "place": F.unhex(F.concat(little_endian(c("offset")), little_endian(c("length"))))})
    level = rows.groupBy("path").agg(F.sum("length").alias("bytes"), cut("part", "part").alias("data"), cut("place", "place").alias("places"))
    flag = lambda b: F.when(b, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    number = lambda n: F.unhex(little_endian(c(n).cast("long")))
    out = level.join(texts, "path").join(facts, "path")
    structure = F.concat(number("ifds"), number("top_ifds"), flag(c("big_endian")), flag(c("big")), number("ifd_id"), c("places"), c("texts"))
    hashed = F.when(c("bytes") <= QUICKHASH_LIMIT, F.sha2(F.concat("data", "texts"), 256))
    return out.select("path", hashed.alias("quickhash"), dataset_id(F.coalesce(hashed, F.sha2(structure, 256))).alias("dataset_id"))


def sample_offsets(length: Column, window: int = WINDOW) -> Column:
    """Sorted, distinct starts of up to five windows: the start, the quarters, and one that ends with the source."""
    quarter = F.floor(length / 4)
    return F.array_sort(F.array_distinct(F.array(F.lit(0).cast("long"), quarter, F.floor(length / 2), quarter * 3, F.greatest(length - window, F.lit(0)).cast("long"))))


def little_endian(n: Column) -> Column:
    """Eight bytes of a number, as hex."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)])


def fingerprint(content: Column, window: int = WINDOW) -> Column:
    """SHA-256 over a source's length, and over each sampled window's place and bytes. content: binary."""
    length = F.octet_length(content).cast("long")
    part = lambda o: F.concat(little_endian(o), F.hex(F.substr(content, (o + 1).cast("int"), F.lit(window))))
    return F.sha2(F.unhex(F.concat(little_endian(length), F.array_join(F.transform(sample_offsets(length, window), part), ""))), 256)


def dataset_id(hash_hex: Column) -> Column:
    """128 bits of a hash, as 32 hex digits: no number type here holds them."""
    return F.substring(hash_hex, 1, 32)
