"""Backends in order: built-in ones, a registry without the cache, and ones that a user adds; and opening by the best match.

A backend says whether a file is for it (a column over ``path`` and the file's head) and how confident it is, and reads its
files into named DataFrames. Opening groups files by backend: each reader runs once, over all its files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import model, tiff_layout
from lamella.operators.vendor import REGISTRY, best_probe
from lamella.sources import cache, dicom, ets, probe, tiff
from lamella.sources.rows import heads

HEAD = 4096


@dataclass(frozen=True)
class Options:
    """How slides are opened. By default nothing is cached, so that reads are the same each time."""

    cache: str = "Off"
    cache_folder: str | None = None
    shared_tile_bytes: int | None = None
    display_tile_bytes: int | None = None
    output: str = "Cpu"

    def tile_budget(self, hint: int | None = None) -> int:
        return next(x for x in (self.shared_tile_bytes, hint, model.SHARED_TILE_BYTES) if x is not None)

    def display_budget(self) -> int:
        return self.display_tile_bytes if self.display_tile_bytes is not None else model.DISPLAY_TILE_BYTES


@dataclass(frozen=True)
class Backend:
    vendor: str
    probe: Callable[[Column, Column], Column] | None  # of path and head; None: the built-in rule of that name
    reader: Callable[[DataFrame, Options], dict[str, DataFrame]] | None = None
    confidence: str = "Definite"


def _tiff(files: DataFrame, options: Options) -> dict[str, DataFrame]:
    tags = tiff.tags_at(files) if "content" not in files.columns else tiff.tags_of(files)
    ifds = tiff_layout.images(tags)
    vendors = tiff_layout.vendors(ifds)
    return {"tags": tags, "vendors": vendors, "levels": tiff_layout.levels(ifds, vendors), "associated": tiff_layout.associated(ifds, vendors), "properties": tiff_layout.slide_properties(ifds, vendors)}


def _cache(files: DataFrame, options: Options) -> dict[str, DataFrame]:
    opened = cache.opened(files)
    levels = cache.levels(opened)
    return {"metadata": opened, "levels": levels, "tiles": cache.entries(levels)}


READERS = {"tiff": _tiff, "svcache": _cache, "dicom": lambda files, _: {"instances": dicom.instances(files)}, "vsi": lambda files, _: {"tiles": ets.tiles(files)}}


@dataclass
class Registry:
    backends: list[Backend] = field(default_factory=list)

    @classmethod
    def builtin(cls) -> Registry:
        """All that are built in, the cache first."""
        return cls([Backend(v, None, READERS.get(v)) for v in REGISTRY])

    @classmethod
    def native(cls) -> Registry:
        """Those of vendors' formats: without the cache."""
        return cls([b for b in cls.builtin().backends if b.vendor != "svcache"])

    def register(self, backend: Backend) -> Registry:
        """After those that are there; equal confidence goes to the earlier one."""
        self.backends.append(backend)
        return self

    def probes(self, files: DataFrame) -> DataFrame:
        """files: path, content (the head). A row for each backend: path, priority, vendor, detected, confidence, error."""
        built_in = probe.probes(files).filter(F.col("vendor").isin([b.vendor for b in self.backends if b.probe is None]))
        place = F.lit(None).cast("int")
        for i, b in enumerate(self.backends):
            place = F.when(F.col("vendor") == b.vendor, i).otherwise(place)
        out = built_in.withColumn("priority", place)
        for i, b in enumerate(self.backends):
            if b.probe is not None:
                said = F.coalesce(b.probe(F.col("path"), F.col("content")), F.lit(False))
                out = out.unionByName(files.select("path", F.lit(i).alias("priority"), F.lit(b.vendor).alias("vendor"), said.alias("detected"), F.lit(b.confidence).alias("confidence"), F.lit(None).cast("string").alias("error")))
        return out

    def detect(self, files: DataFrame) -> DataFrame:
        found = best_probe(self.probes(files))
        return found.withColumn("error", F.when(F.col("vendor").isNull(), F.coalesce("error", F.lit("UnsupportedFormat"))))

    def open(self, files: DataFrame, options: Options = Options()) -> dict[str, dict[str, DataFrame]]:
        """files: path, and content or not. By vendor: what its reader makes of its files; under "" what was detected."""
        first = files.select("path", F.substring("content", 1, HEAD).alias("content")) if "content" in files.columns else heads(files, HEAD)
        found = self.detect(first)
        out = {"": {"detected": found}}
        for b in self.backends:
            if b.reader:
                own = files.join(found.filter((F.col("vendor") == b.vendor) & F.col("error").isNull()).select("path"), "path", "left_semi")
                out[b.vendor] = b.reader(own, options)
        return out


def open_slides(spark: SparkSession, path: str, registry: Registry | None = None, options: Options = Options()) -> dict[str, dict[str, DataFrame]]:
    """Files under path, by position: nothing is read but heads and what the readers ask for."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return (registry or Registry.builtin()).open(files, options)
