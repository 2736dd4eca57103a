"""Slides out of TIFF tags: images, vendor, levels, associated images and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators import properties, pyramid, vendor, vendor_meta

# Tag numbers.
INTS = {"width": 256, "height": 257, "tile_w": 322, "tile_h": 323, "compression": 259, "photometric": 262, "samples": 277, "planar": 284, "unit": 296}
TEXTS = {"description": 270, "software": 305, "xmp": 700}
REALS = {"x_resolution": 282, "y_resolution": 283}
NDPI_LENS, NDPI_MARK = 65421, 65420


def images(tags: DataFrame) -> DataFrame:
    """One row a directory. One grouped pass over the tags, whatever their number."""
    tag = lambda n, value: F.max(F.when(F.col("tag") == n, value))
    first = F.get("ints", F.lit(0))
    columns = [tag(n, first).alias(c) for c, n in INTS.items()] + [tag(n, F.coalesce(F.col("text"), F.col("raw").cast("string"))).alias(c) for c, n in TEXTS.items()]
    columns += [tag(n, F.get("floats", F.lit(0))).alias(c) for c, n in REALS.items()]
    columns += [tag(NDPI_LENS, F.get("floats", F.lit(0))).alias("lens"), F.max((F.col("tag") == NDPI_MARK).cast("int")).alias("ndpi")]
    return tags.filter("error is null").groupBy("path", "ifd_id", "parent_id", "ifd_index").agg(*columns).withColumn("tiled", F.col("tile_w").isNotNull())


def vendors(ifds: DataFrame) -> DataFrame:
    """path, vendor: the first interpreter that knows the file."""
    top = F.col("parent_id").isNull() & (F.col("ifd_index") == 0)
    at0 = lambda c: F.max(F.when(top, F.col(c)))
    facts = ifds.groupBy("path").agg(
        at0("ndpi").alias("ndpi"), F.bool_or(F.col("tiled") & F.startswith("description", F.lit("Aperio"))).alias("aperio"), F.bool_or(F.lower("description").contains("<scn")).alias("leica"),
        F.bool_or(F.startswith("software", F.lit("Philips"))).alias("philips"), F.bool_or(F.startswith("software", F.lit("MedScan")) & F.col("tiled")).alias("trestle"), F.bool_and("tiled").alias("all_tiled"),
        F.bool_or(F.col("xmp").contains("iScan")).alias("ventana"), F.bool_or("tiled").alias("any_tiled"),
    )
    name = F.when(F.col("ndpi") == 1, "hamamatsu-ndpi")
    for column, value in (("aperio", "aperio"), ("leica", "leica"), ("philips", "philips")):
        name = name.when(F.col(column), value)
    return facts.select("path", name.when(F.col("trestle") & F.col("all_tiled"), "trestle").when(F.col("ventana"), "ventana").when(F.col("any_tiled"), "generic-tiff").alias("vendor"))


def levels(ifds: DataFrame, of: DataFrame) -> DataFrame:
    """Tiled images by falling area, with grid, downsample and codec. Philips levels halve the base and keep the grid of
    their padded images; Ventana takes images that name their level; of a collection of scenes these are the first scene's
    (``scene_levels`` has all)."""
    c = F.col
    first = scene_levels(ifds, of).filter("scene = 0 and z = 0 and c = 0").select("path", "ifd_id")
    rows = ifds.join(of, "path").filter(c("tiled") & ((c("vendor") != "ventana") | c("description").contains("level=")))
    rows = rows.join(first.withColumn("of_scene", F.lit(True)), ["path", "ifd_id"], "left").filter((c("vendor") != "leica") | c("of_scene")).drop("of_scene")
    w = Window.partitionBy("path").orderBy(F.desc(c("width") * c("height")), "ifd_index")
    ranked = pyramid.regular_levels(rows).withColumn("level", F.row_number().over(w) - 1)
    base_w, base_h = F.first("width").over(w), F.first("height").over(w)
    two = F.call_function("shiftleft", F.lit(1).cast("long"), c("level"))
    halves = c("vendor").isin("philips", "ventana")
    return ranked.withColumns(
        {
            "public_w": F.when(halves, pyramid.public_dimension(base_w, c("level"))).otherwise(c("width")), "public_h": F.when(halves, pyramid.public_dimension(base_h, c("level"))).otherwise(c("height")),
            "downsample": F.when(halves, two.cast("double")).otherwise((base_w / c("width") + base_h / c("height")) / 2), "codec": vendor.compression(c("compression")),
        }
    ).select("path", "vendor", "ifd_id", "level", F.col("public_w").alias("width"), F.col("public_h").alias("height"), "tile_w", "tile_h", "tiles_across", "tiles_down", "downsample", "codec")


def scene_levels(ifds: DataFrame, of: DataFrame) -> DataFrame:
    """Levels of all scenes of collections, for each z and c: path, scene, level, z, c, ifd_id, width, height, tile sizes, grid,
    downsample, codec. The collection's XML names directories; macros are no scenes."""
    texts = ifds.filter("parent_id is null and ifd_index = 0").join(of.filter("vendor = 'leica'"), "path").select("path", "description")
    found = vendor_meta.collection_levels(vendor_meta.collection_images(texts, "path", "description"), "path")
    own = ifds.filter("parent_id is null and tiled").select("path", F.col("ifd_index").alias("ifd"), "ifd_id", "tile_w", "tile_h", "compression")
    out = pyramid.regular_levels(found.join(own, ["path", "ifd"]))
    return out.select("path", "scene", "level", "z", "c", "ifd_id", "width", "height", "tile_w", "tile_h", "tiles_across", "tiles_down", "downsample", vendor.compression(F.col("compression")).alias("codec"))


def associated(ifds: DataFrame, of: DataFrame) -> DataFrame:
    """Stripped images by name: for Aperio the second image is the thumbnail; label and macro by description."""
    c = F.col
    rows = ifds.join(of, "path").filter(~c("tiled") & c("parent_id").isNull())
    text = F.lower(F.coalesce("description", F.lit("")))
    name = F.when((c("vendor") == "aperio") & (c("ifd_index") == 1), "thumbnail").when(text.contains("label"), "label").when(text.contains("macro"), "macro")
    named = rows.withColumn("name", name.otherwise(F.concat(F.lit("image_"), c("ifd_index").cast("string"))))
    return vendor.unique_names(named, "path", "name", "ifd_index").select("path", c("unique_name").alias("name"), "ifd_id", "width", "height")


def slide_properties(ifds: DataFrame, of: DataFrame) -> DataFrame:
    """path, key, value: the vendor, what its description says, and micrometres per pixel from the resolution."""
    c = F.col
    base = ifds.filter("parent_id is null and ifd_index = 0").join(of, "path")
    default = F.when(c("vendor") == "hamamatsu-ndpi", 3).otherwise(2)
    mpp = properties.mpp_from_resolution(c("x_resolution"), F.coalesce(c("unit"), default), 2)
    said = F.when(c("vendor") == "aperio", properties.pipe_properties(c("description"), "aperio."))
    said = F.coalesce(said, F.expr("cast(map() as map<string, string>)"))
    general = F.create_map(F.lit("vendor"), c("vendor"), F.lit("mpp-x"), F.coalesce(F.element_at(said, "aperio.MPP"), F.format_string("%.6f", mpp)))
    return base.select("path", F.explode(F.map_concat(general, said)).alias("key", "value")).filter("value is not null and value <> 'null'")
