"""VMS slides: which JPEG file is which part of the image, from pairs of the INI file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = r"^ImageFile(?:\(\s*(?:(\d+)\s*,)?\s*(\d+)\s*,\s*(\d+)\s*\))?$"


def images(pairs: DataFrame, section: str = "Virtual Microscope Specimen") -> DataFrame:
    """pairs: path, section, name, value. The image files: path, layer, col, row, file, error. A name without a suffix is the
    first one; (column, row) and (layer, column, row) are known, others an error."""
    c = F.col
    rows = pairs.filter((c("section") == section) & c("name").startswith("ImageFile"))
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract("name", KEY, i), F.lit("")).cast("int"), F.lit(0))
    known = F.regexp_like("name", F.lit(KEY))
    return rows.select("path", *(F.when(known, part(i)).alias(n) for i, n in ((1, "layer"), (2, "col"), (3, "row"))), c("value").alias("file"), F.when(~known, "ImageKey").alias("error"))


def shards(found: DataFrame, pairs: DataFrame, section: str = "Virtual Microscope Specimen") -> DataFrame:
    """The first layer's files by place: path, shard (row-major), col, row, file, and an error for slides whose grid is not whole."""
    c = F.col
    value = lambda n: F.max(F.when(c("name") == n, c("value"))).try_cast("int")
    sizes = pairs.filter(c("section") == section).groupBy("path").agg(value("NoJpegColumns").alias("across"), value("NoJpegRows").alias("down"))
    rows = found.filter("error is null and layer = 0").join(sizes, "path")
    n = rows.groupBy("path").agg(F.count_if((c("col") < c("across")) & (c("row") < c("down"))).alias("inside"))
    whole = c("inside") == c("across") * c("down")
    return rows.join(n, "path").select("path", (c("row") * c("across") + c("col")).alias("shard"), "col", "row", "file", F.when(~F.coalesce(whole, F.lit(False)), "MissingShard").alias("error"))


def properties(pairs: DataFrame, widths: DataFrame, section: str = "Virtual Microscope Specimen") -> DataFrame:
    """path, key, value: every pair under ``hamamatsu.``, the objective, and micrometres per pixel from nanometres. widths:
    path, width, height of the base."""
    c = F.col
    own = pairs.filter(c("section") == section)
    value = lambda n: F.max(F.when(c("name") == n, c("value")))
    one = own.groupBy("path").agg(value("SourceLens").alias("lens"), value("PhysicalWidth").try_cast("long").alias("nm_x"), value("PhysicalHeight").try_cast("long").alias("nm_y")).join(widths, "path")
    mpp = lambda nm, n: F.when(c(nm) > 0, (c(nm) / (1000.0 * c(n))).cast("string"))
    general = one.select("path", F.explode(F.create_map(F.lit("vendor"), F.lit("hamamatsu"), F.lit("objective-power"), c("lens"), F.lit("mpp-x"), mpp("nm_x", "width"), F.lit("mpp-y"), mpp("nm_y", "height"))).alias("key", "value"))
    return general.filter("value is not null").unionByName(own.select("path", F.concat(F.lit("hamamatsu."), "name").alias("key"), "value"))
