"""What TIFF vendors' metadata says: collections of scenes, spacings, descriptions, tile extents, stripped images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DECODED_BYTES = 512 << 20

#: A multi-scene collection as Spark's own XML reader sees it; attributes carry an underscore.
_DIMENSION = "struct<_ifd:string,_sizeX:long,_sizeY:long,_r:int,_z:int,_c:int>"
_VIEW = "struct<_sizeX:long,_sizeY:long,_offsetX:long,_offsetY:long,_type:string>"
_CHANNEL = "struct<_index:int,_name:string>"
_SETTINGS = f"struct<objectiveSettings:struct<objective:string>,illuminationSettings:struct<numericalAperture:string,illuminationSource:string>,channelSettings:struct<channel:array<{_CHANNEL}>>>"
_IMAGE = f"struct<_name:string,creationDate:string,device:struct<_model:string,_version:string>,pixels:struct<dimension:array<{_DIMENSION}>>,view:{_VIEW},scanSettings:{_SETTINGS}>"
COLLECTION = f"collection struct<_sizeX:long,_sizeY:long,image:array<{_IMAGE}>>"


def collection_images(files: DataFrame, key: str, xml: str) -> DataFrame:
    """A row for each image of a collection that has a view and at least one usable dimension: key, place, name, dimensions
    (ifd, width, height, r, z, c), view size and offset, is_macro, the axes, channel names and settings.

    A dimension without an ifd or a size is left out. An image is the macro if its view says so, or covers the whole
    collection from its corner."""
    c = F.col
    parsed = files.select(key, F.from_xml(c(xml), COLLECTION, {"rowTag": "scn"}).alias("x")).select(key, "x.collection")
    rows = parsed.select(key, c("collection._sizeX").alias("cw"), c("collection._sizeY").alias("ch"), F.posexplode("collection.image").alias("place", "im"))
    usable = F.filter(c("im.pixels.dimension"), lambda d: d["_ifd"].isNotNull() & (d["_sizeX"] > 0) & (d["_sizeY"] > 0))
    zero = lambda x: F.coalesce(x, F.lit(0))
    dims = F.transform(usable, lambda d: F.struct(d["_ifd"].cast("int").alias("ifd"), d["_sizeX"].alias("width"), d["_sizeY"].alias("height"), zero(d["_r"]).alias("r"), zero(d["_z"]).alias("z"), zero(d["_c"]).alias("c")))
    view = c("im.view")
    out = rows.withColumn("dimensions", dims).filter((F.size("dimensions") > 0) & view.isNotNull() & view["_sizeX"].isNotNull() & view["_sizeY"].isNotNull())
    whole = (zero(view["_offsetX"]) == 0) & (zero(view["_offsetY"]) == 0) & (view["_sizeX"] == c("cw")) & (view["_sizeY"] == c("ch"))
    n_z, n_c = (F.array_max(F.col(f"dimensions.{a}")) + 1 for a in ("z", "c"))
    light = c("im.scanSettings.illuminationSettings.illuminationSource")
    out = out.withColumns({"n_z": n_z, "n_c": n_c, "is_macro": F.coalesce(F.lower(view["_type"]) == "macro", F.lit(False)) | F.coalesce(whole, F.lit(False))})
    set_ = F.coalesce(c("im.scanSettings.channelSettings.channel"), F.expr(f"cast(array() as array<{_CHANNEL}>)"))
    return out.select(
        key, "place", c("im._name").alias("name"), "dimensions", view["_sizeX"].alias("view_w"), view["_sizeY"].alias("view_h"), zero(view["_offsetX"]).alias("view_x"), zero(view["_offsetY"]).alias("view_y"),
        "is_macro", "n_z", "n_c", channel_names(c("n_c"), set_, c("im._name"), light).alias("channels"), c("im.scanSettings.objectiveSettings.objective").alias("objective"),
        c("im.scanSettings.illuminationSettings.numericalAperture").alias("aperture"), light.alias("illumination"), c("im.device._model").alias("device"),
    )


def channel_names(n: Column, settings: Column, name: Column, light: Column) -> Column:
    """Names of n channels: what the settings say, else their number; a lone channel without settings is called after the
    image or its light, and is none at all under brightfield."""
    none = F.size(settings) == 0
    plain = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(F.filter(settings, lambda s: s["_index"] == i), F.lit(0))["_name"], F.concat(F.lit("Channel "), i.cast("string"))))
    lone = F.array(F.coalesce(name, light, F.lit("Channel 0")))
    return F.when((n == 1) & none & (light == "brightfield"), F.array().cast("array<string>")).when((n == 1) & none, lone).otherwise(plain)


def collection_levels(images: DataFrame, key: str) -> DataFrame:
    """Levels of the scenes: images that are no macro are scenes by place; of each, dimensions by r, z and c."""
    scenes = images.filter("not is_macro").withColumn("scene", F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1)
    d = scenes.select(key, "scene", F.explode("dimensions").alias("d")).select(key, "scene", "d.*").withColumnRenamed("r", "level")
    base = F.max("width").over(Window.partitionBy(key, "scene"))
    return d.withColumn("downsample", base / F.col("width"))


def spacing_pair(text: Column) -> Column:
    """(row, column) spacing: the first two positive numbers between white space, quotes and commas aside; one stands for both."""
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, "^[\"',]+|[\"',]+$", "").try_cast("double"))
    good = F.filter(words, lambda v: (v > 0) & (v < float("inf")))
    return F.when(F.size(good) > 0, F.struct(F.get(good, F.lit(0)).alias("row"), F.coalesce(F.get(good, F.lit(1)), F.get(good, F.lit(0))).alias("column")))


def mpp_pair(raw: Column, base: Column) -> Column:
    """(x, y) micrometres per pixel from spacings in millimetres; the base's where a level has none of its own."""
    pair = spacing_pair(raw)
    x, y = F.coalesce(pair["column"], base) * 1000, F.coalesce(pair["row"], base) * 1000
    return F.when(x.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def key_values(text: Column, entry: str = ";", pair: str = "=") -> Column:
    """A map of ``key=value;key=value``, trimmed; entries without a key or a value go, the last of equal keys counts."""
    at = lambda e: F.instr(e, pair)
    entries = F.transform(F.split(text, entry), lambda e: F.struct(F.trim(F.substr(e, F.lit(1), F.greatest(at(e) - 1, F.lit(0)))).alias("k"), F.trim(F.substr(e, at(e) + F.lit(len(pair)))).alias("v"), (at(e) > 0).alias("ok")))
    good = F.filter(entries, lambda e: e["ok"] & (e["k"] != "") & (e["v"] != ""))
    keys = F.array_distinct(F.transform(good, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(good, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def exact_tile_extents(tiles: DataFrame, area: list[str]) -> DataFrame:
    """tiles: area, col, row, x, y, num_cols, num_rows, area_w, area_h, tile_w, tile_h. Adds width and height: the step to
    the next tile; at the end, or where that is no step, what is left of the area; else the step before; else the tile's own."""
    c = F.col

    def extent(at: str, n: str, place: str, whole: str, own: str, across: str) -> Column:
        w = Window.partitionBy(*area, across).orderBy(place)
        next_ = F.when(F.lead(place).over(w) == c(place) + 1, F.lead(at).over(w) - c(at))
        before = F.when(F.lag(place).over(w) == c(place) - 1, c(at) - F.lag(at).over(w))
        step = lambda v: F.when(v > 0.5, v)
        inner = F.when(c(place) + 1 < c(n), F.coalesce(step(next_), step(c(whole) - c(at)), step(before), c(own)))
        return inner.when(c(place) > 0, F.coalesce(step(c(whole) - c(at)), step(before), c(own))).otherwise(c(own))

    size = lambda v: F.greatest(F.round(v), F.lit(1)).cast("long")
    return tiles.withColumns({"width": size(extent("x", "num_cols", "col", "area_w", "tile_w", "row")), "height": size(extent("y", "num_rows", "row", "area_h", "tile_h", "col"))})


def stitched_dimensions(areas: DataFrame, by: str) -> DataFrame:
    """areas: by, x, y, tiles_across, tiles_down, advance_x, advance_y, tile_w, tile_h. The box around all areas from the
    least corner, each with its tiles an advance apart; areas without tiles count for the corner only. Null where it is empty."""
    c = F.col
    reach = lambda p, n, a, t: F.when((c("tiles_across") > 0) & (c("tiles_down") > 0), c(p) + (c(n) - 1) * c(a) + c(t))
    out = areas.groupBy(by).agg((F.ceil(F.max(reach("x", "tiles_across", "advance_x", "tile_w")) - F.min("x"))).alias("width"), F.ceil(F.max(reach("y", "tiles_down", "advance_y", "tile_h")) - F.min("y")).alias("height"))
    return out.withColumns({n: F.when((c("width") > 0) & (c("height") > 0), c(n)) for n in ("width", "height")})


def overlapping_tiles(tiles: DataFrame, by: str, cell: int) -> DataFrame:
    """tiles: by, id, x, y, w, h. Pairs whose areas meet, and how much. An equi-join on the cells of a grid that a tile
    touches, so that a tile meets its neighbours only."""
    c = F.col
    span = lambda p, n: F.sequence(F.floor(c(p) / cell), F.greatest(F.floor(c(p) / cell), F.ceil((c(p) + c(n)) / cell) - 1))
    spread = tiles.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    a, b = spread.alias("a"), spread.alias("b")
    side = lambda p, n: F.least(c(f"a.{p}") + c(f"a.{n}"), c(f"b.{p}") + c(f"b.{n}")) - F.greatest(f"a.{p}", f"b.{p}")
    met = a.join(b, (c(f"a.{by}") == c(f"b.{by}")) & (c("a.cx") == c("b.cx")) & (c("a.cy") == c("b.cy")) & (c("a.id") < c("b.id")))
    pairs = met.select(c(f"a.{by}").alias(by), c("a.id").alias("a"), c("b.id").alias("b"), side("x", "w").alias("sx"), side("y", "h").alias("sy"))
    return pairs.filter("sx > 0 and sy > 0").distinct().select(by, "a", "b", (c("sx") * c("sy")).alias("area"))


def readable_strips(ifd: dict[str, Column]) -> Column:
    """Whether a stripped image is plain 8-bit RGB whose strips hold it exactly. ifd: columns width, height, compression,
    photometric, samples, orientation, predictor, planar, rows_per_strip (null where the tag is absent), and arrays bits,
    formats, offsets, counts."""
    get = lambda n, default: F.coalesce(ifd[n], F.lit(default))
    w, h, planar = ifd["width"], ifd["height"], get("planar", 1)
    size = F.try_multiply(F.try_multiply(w, h), F.lit(3))
    rows = F.coalesce(ifd["rows_per_strip"], h)
    strips = F.ceil(h / rows) * F.when(planar == 2, 3).otherwise(1)
    total = F.aggregate(ifd["counts"], F.lit(0).cast("long"), lambda a, x: F.try_add(a, x))
    plain = (get("compression", 1) == 1) & (get("photometric", 0) == 2) & (get("samples", 1) == 3) & (get("orientation", 1) == 1) & (get("predictor", 1) == 1) & planar.isin(1, 2)
    deep = (F.size(ifd["bits"]) > 0) & F.forall(ifd["bits"], lambda b: b == 8) & F.coalesce(F.forall(ifd["formats"], lambda f: f == 1), F.lit(True))
    whole = (rows > 0) & (F.size(ifd["offsets"]) == strips) & (F.size(ifd["counts"]) == strips) & F.forall(ifd["offsets"], lambda o: o > 0) & F.forall(ifd["counts"], lambda n: n > 0) & (total == size)
    return F.coalesce((w > 0) & (h > 0) & (size <= MAX_DECODED_BYTES) & plain & deep & whole, F.lit(False))
