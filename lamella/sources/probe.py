"""Which backend a file is for, by its first bytes and its name, and paths that a slide may name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators.vendor import REGISTRY, best_probe
from lamella.sources.rows import heads


def _starts(content: Column, *heads: str) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(content, F.unhex(F.lit(h)))
    return out


def probes(files: DataFrame) -> DataFrame:
    """files: path, content (the head is enough). A row for each backend: path, priority, vendor, detected, confidence, error."""
    head, ext = F.col("content"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    tiff = _starts(head, "49492A00", "4D4D002A", "49492B00", "4D4D002B")
    rules = {
        "svcache": (_starts(head, "5356434143484531"), "Definite"),
        "dicom": (F.substring(head, 129, 4) == F.lit("DICM").cast("binary"), "Definite"),
        "mirax": (ext == "mrxs", "Definite"),
        "vms": (ext == "vms", "Definite"),
        "vsi": (ext == "vsi", "Definite"),
        "raw_jp2k": (ext.isin("j2k", "j2c", "jp2k") & _starts(head, "FF4F"), "Definite"),
        "zvi": (_starts(head, "D0CF11E0A1B11AE1") & (ext == "zvi"), "Definite"),
        "czi": (_starts(head, "5A495352415746494C45"), "Definite"),
        "tiff": (tiff, "Definite"),
    }
    broken = F.when((ext == "ndpi") & ~tiff, "malformed .ndpi")
    structs = [
        F.struct(F.lit(i).alias("priority"), F.lit(v).alias("vendor"), F.coalesce(rules[v][0], F.lit(False)).alias("detected"), F.lit(rules[v][1]).alias("confidence"), (broken if v == "tiff" else F.lit(None).cast("string")).alias("error"))
        for i, v in enumerate(REGISTRY)
    ]
    return files.select("path", F.explode(F.array(*structs)).alias("p")).select("path", "p.*")


def detect(files: DataFrame) -> DataFrame:
    """path, vendor, confidence, error: the best match of each file."""
    return best_probe(probes(files))


def open_slides(spark: SparkSession, path: str) -> DataFrame:
    """Files under path with the backend that is for them; UnsupportedFormat where there is none."""
    identity = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    found = detect(heads(identity, 4096))
    return identity.join(found, "path").withColumn("error", F.when(F.col("vendor").isNull(), F.coalesce("error", F.lit("UnsupportedFormat"))))


def confined(name: Column) -> Column:
    """Whether a name in metadata stays below the slide's folder: not absolute, no parent steps, no drive."""
    return ~F.regexp_like(name, F.lit(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")) & (name != "")
