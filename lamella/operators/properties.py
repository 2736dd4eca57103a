"""Properties: parsing vendor text, typed access, colours, INI and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pipe_properties(text: Column, prefix: str) -> Column:
    """``header|key = value|key = value`` as a map; parts without a sign of equality are left out."""
    parts = F.filter(F.split(text, "[|]"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(F.concat(F.lit(prefix), F.trim(F.substring_index(p, "=", 1))).alias("key"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("value")))
    return F.map_from_entries(pairs)


def number(properties: Column, key: str) -> Column:
    return F.element_at(properties, F.lit(key)).try_cast("double")


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """Both numbers or none."""
    have = x.isNotNull() & y.isNotNull()
    return F.when(have, x), F.when(have, y)


def mpp_from_resolution(resolution: Column, unit: Column, default_unit: int) -> Column:
    """Micrometres per pixel from pixels per unit; 2 is inch, 3 is centimetre. 25400, 10000."""
    u = F.coalesce(unit, F.lit(default_unit))
    return F.when((resolution > 0) & (u == 2), 25400 / resolution).when((resolution > 0) & (u == 3), 10000 / resolution)


def hex_rgb(text: Column) -> Column:
    """Six hex digits, after any number signs, as three numbers; anything else is white."""
    text = F.ltrim(text, F.lit("#"))
    ok = F.regexp_like(text, F.lit("^[0-9a-fA-F]{6}$"))
    part = lambda i: F.when(ok, F.conv(F.substring(text, i, 2), 16, 10).cast("int")).otherwise(255)
    return F.array(part(1), part(3), part(5))


def format_float(x: Column) -> Column:
    """Whole numbers with one decimal, others as they print."""
    return F.when(x == F.floor(x), F.format_string("%.1f", x)).otherwise(x.cast("string"))


def parse_ini(lines: DataFrame, key: str) -> DataFrame:
    """lines: key, n (line number), line. Rows key, section, name, value; comments start with ; or #; the last of equal names counts."""
    c = F.col
    text = lines.withColumn("line", F.trim("line")).filter((c("line") != "") & ~c("line").startswith(";") & ~c("line").startswith("#"))
    heads = text.withColumn("head", F.when(F.regexp_like("line", F.lit(r"^\[.*\]$")), F.expr("substring(line, 2, length(line) - 2)")))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    within = heads.withColumn("section", F.last("head", ignorenulls=True).over(w)).filter(c("head").isNull() & F.contains("line", F.lit("=")) & c("section").isNotNull())
    pairs = within.select(key, "section", "n", F.trim(F.substring_index("line", "=", 1)).alias("name"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"))
    return pairs.groupBy(key, "section", "name").agg(F.max_by("value", "n").alias("value"))


def attributes(markup: Column, name: str) -> Column:
    """All values of one attribute, in order."""
    return F.regexp_extract_all(markup, F.lit(rf'\s{name}="([^"]*)"'), 1)


def overlap_pairs(text: Column) -> Column:
    """Numbers after each other, two by two: ``64 62 48 46`` is (64, 62), (48, 46); a last odd one is left out."""
    numbers = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return F.transform(F.sequence(F.lit(1), F.floor(F.size(numbers) / 2).cast("int")), lambda i: F.struct(F.get(numbers, 2 * i - 2).alias("x"), F.get(numbers, 2 * i - 1).alias("y")))


def capi_properties(levels: DataFrame, key: str) -> DataFrame:
    """level-count and level[i].width, .height, .downsample as one map for each slide."""
    c = F.col
    entry = lambda name, value: F.struct(F.concat(F.lit("level["), c("level").cast("string"), F.lit(f"].{name}")).alias("key"), value.alias("value"))
    rows = levels.select(key, F.explode(F.array(entry("width", c("width").cast("string")), entry("height", c("height").cast("string")), entry("downsample", format_float(c("downsample"))))).alias("e"))
    count = levels.groupBy(key).agg(F.struct(F.lit("level-count").alias("key"), F.count("*").cast("string").alias("value")).alias("e"))
    return rows.unionByName(count).select(key, "e.key", "e.value")
