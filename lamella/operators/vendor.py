"""What the vendors' readers decide: codes, roles, probes, groups, mosaics, serpentine scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.fold import folded

# The TIFF compression tags.
COMPRESSION = {1: "None", 5: "Lzw", 6: "Jpeg", 7: "Jpeg", 8: "Deflate", 32946: "Deflate", 33003: "Jp2kYcbcr", 33004: "Jp2kRgb", 33005: "Jp2kYcbcr", 50000: "Zstd"}
# The TIFF field types (id, name, bytes of one value).
TIFF_TYPES = [
    (1, "BYTE", 1), (2, "ASCII", 1), (3, "SHORT", 2), (4, "LONG", 4), (5, "RATIONAL", 8), (6, "SBYTE", 1), (7, "UNDEFINED", 1), (8, "SSHORT", 2),
    (9, "SLONG", 4), (10, "SRATIONAL", 8), (11, "FLOAT", 4), (12, "DOUBLE", 8), (13, "IFD", 4), (16, "LONG8", 8), (17, "SLONG8", 8), (18, "IFD8", 8),
]
# DICOM transfer syntaxes.
TRANSFER_SYNTAX = {
    "1.2.840.10008.1.2": "None", "1.2.840.10008.1.2.1": "None", "1.2.840.10008.1.2.5": "Rle", "1.2.840.10008.1.2.4.50": "Jpeg",
    "1.2.840.10008.1.2.4.80": "JpegLs", "1.2.840.10008.1.2.4.81": "JpegLs", "1.2.840.10008.1.2.4.90": "Jp2k", "1.2.840.10008.1.2.4.91": "Jp2k",
}
#: The registry: priority, vendor. The cache comes first.
REGISTRY = ["svcache", "dicom", "mirax", "vms", "vsi", "raw_jp2k", "zvi", "czi", "tiff"]


def lookup(value: Column, table: dict, otherwise: Column) -> Column:
    out = otherwise
    for k, v in reversed(table.items()):
        out = F.when(value == k, v).otherwise(out)
    return out


def compression(tag: Column) -> Column:
    return lookup(tag, COMPRESSION, F.concat(F.lit("Other("), tag.cast("string"), F.lit(")")))


def codec_kind(name: Column) -> Column:
    return F.when(name == "Jpeg", "Jpeg").when(name.startswith("Jp2k"), "Jp2k").otherwise("Other")


def best_probe(probes: DataFrame) -> DataFrame:
    """probes: path, priority, vendor, detected, confidence (Definite or Likely), error. Definite beats Likely, the first in
    the registry wins ties, and an error counts only where nothing matched: then the first one."""
    c = F.col
    rank = F.when(c("confidence") == "Definite", 0).otherwise(1)
    found = c("detected") & c("error").isNull()
    best = probes.groupBy("path").agg(
        F.min(F.when(found, F.struct(rank.alias("rank"), c("priority"), c("vendor"), c("confidence")))).alias("m"), F.min(F.when(c("error").isNotNull(), F.struct("priority", "error"))).alias("e")
    )
    return best.select("path", "m.vendor", "m.confidence", F.when(c("m").isNull(), c("e.error")).alias("error"))


# ImageType arrays and their roles; any other array is ignored.
IMAGE_TYPES = [
    ("ORIGINAL", "PRIMARY", "VOLUME", "NONE", "Level"), ("DERIVED", "PRIMARY", "VOLUME", "NONE", "Level"), ("DERIVED", "PRIMARY", "VOLUME", "RESAMPLED", "Level"),
    ("ORIGINAL", "PRIMARY", "LABEL", "NONE", "label"), ("DERIVED", "PRIMARY", "LABEL", "NONE", "label"),
    ("ORIGINAL", "PRIMARY", "OVERVIEW", "NONE", "macro"), ("DERIVED", "PRIMARY", "OVERVIEW", "NONE", "macro"),
    ("ORIGINAL", "PRIMARY", "THUMBNAIL", "RESAMPLED", "thumbnail"), ("DERIVED", "PRIMARY", "THUMBNAIL", "RESAMPLED", "thumbnail"),
]


def dicom_role(image_type: Column) -> Column:
    """Role by the whole ImageType array."""
    out = F.lit("Ignore")
    for *values, role in IMAGE_TYPES:
        out = F.when(image_type == F.array(*map(F.lit, values)), role).otherwise(out)
    return out


def common_value(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The one value that the rows of a group have, nulls aside; conflict where they have several."""
    return rows.groupBy(by).agg(F.count_distinct(value).alias("n"), F.max(value).alias("v")).select(by, F.when(F.col("n") <= 1, F.col("v")).alias("value"), (F.col("n") > 1).alias("conflict"))


def read_groups(spans: DataFrame, by: list[str], gap: int) -> DataFrame:
    """spans: offset, length. Spans no more than ``gap`` apart are read together (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy("offset", "length")
    reach = F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("offset") > reach + gap).cast("int"), F.lit(1)))
    numbered = marked.withColumn("group_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "group_id").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("n_spans"))


def read_groups_capped(spans: DataFrame, by: list[str], gap: int, most: int) -> DataFrame:
    """The same with groups no longer than ``most``: an ordered fold that keeps the open group only."""

    def step(state: dict, row) -> list[tuple]:
        key, a, z = tuple(getattr(row, b) for b in by), int(row.offset), int(row.offset + row.length)
        group = state.get("open")
        if group and a <= group[1] + gap and max(z, group[1]) - group[0] <= most:
            group[1], group[2] = max(group[1], z), group[2] + 1
            return []
        out = done(state, key)
        state["n"], state["open"] = state.get("n", 0) + 1, [a, z, 1]
        return out

    def done(state: dict, key) -> list[tuple]:
        key = key if isinstance(key, tuple) else (key,)
        return [(*key, state["n"], *state["open"])] if "open" in state else []

    rows = spans.select(*by, "offset", "length")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(by)])
    return folded(rows, by, ["offset", "length"], dict, step, done, f"{keys}, group_id long, start long, end long, n_spans long")


def common_ratios(rows: DataFrame, by: str, scene: str, ratio: str) -> DataFrame:
    """Ratios that every scene of a slide has, and 1."""
    sets = rows.groupBy(by, scene).agg(F.collect_set(ratio).alias("r")).groupBy(by).agg(F.collect_list("r").alias("rs"))
    both = F.aggregate(F.slice("rs", F.lit(2), F.size("rs")), F.get("rs", F.lit(0)), lambda a, r: F.array_intersect(a, r))
    return sets.select(by, F.explode(F.array_sort(F.array_union(both, F.array(F.lit(1).cast("long"))))).alias(ratio))


def mosaic_offsets(planes: DataFrame, by: list[str], mpp: float) -> DataFrame:
    """Stage positions (sx, sy) as pixel offsets from the least of each group."""
    w = Window.partitionBy(*by)
    at = lambda n: F.round((F.col(n) - F.min(n).over(w)) / mpp).cast("long")
    return planes.withColumns({"px": at("sx"), "py": at("sy")})


def median_step(positions: Column, least: int = 128) -> Column:
    """Upper median of the steps above ``least`` between sorted positions."""
    s = F.array_sort(positions)
    steps = F.array_sort(F.filter(F.zip_with(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), lambda b, a: b - a), lambda d: d > least))
    return F.get(steps, F.floor(F.size(steps) / 2).cast("int"))


def dedup_positions(positions: Column, least: int = 128) -> Column:
    """Sorted positions; one within ``least`` of the last that was kept goes."""
    kind = "array<bigint>"
    keep = lambda a, p: F.when((F.size(a) == 0) | (p - F.element_at(a, -1) > least), F.array_append(a, p)).otherwise(a)
    return F.aggregate(F.array_sort(positions), F.array().cast(kind), lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(keep(a, p)))


def nearest_index(values: Column, target: Column) -> Column:
    """Index of the value nearest the target, the first on ties."""
    near = F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - target).alias("d"), i.alias("i"))))
    return near["i"]


def serpentine(tile_id: Column, columns: Column) -> tuple[Column, Column]:
    """Column and row of tile 1, 2, ...: rows run forth and back."""
    row = F.floor((tile_id - 1) / columns)
    at = F.pmod(tile_id - 1, columns)
    return F.when(row % 2 == 0, at).otherwise(columns - 1 - at).cast("long"), row.cast("long")


def ndpi_offset(directory: Column, offset: Column) -> Column:
    """A 32-bit offset that wrapped: the largest with these low bits that lies below the directory, zero at least."""
    whole = directory - F.pmod(directory, F.lit(1 << 32)) + F.pmod(offset, F.lit(1 << 32))
    return F.when(whole >= directory, F.greatest(whole - (1 << 32), F.lit(0))).otherwise(whole)


def unique_names(rows: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """Names made unique in a slide: the second ``macro`` is ``macro-1``."""
    n = F.row_number().over(Window.partitionBy(by, name).orderBy(order)) - 1
    return rows.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(name, F.lit("-"), n.cast("string"))))
