"""Pixels: windows, colour conversion, downsampling, predictors, composition, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp_u8(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")


def windowed(sample: Column, low: float, high: float) -> Column:
    """A sample scaled from [low, high] to 0..255, rounded and clamped; a window must be finite and rising."""
    if not (low < high and abs(low) < float("inf") and abs(high) < float("inf")):
        raise ValueError("a display window needs finite bounds, max above min")
    return clamp_u8(F.round((sample.cast("double") - low) / (high - low) * 255))


def box_downsample(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One pass of 2 x 2 averages over x, y, v: divides by the samples there are, and truncates."""
    c = F.col
    return pixels.groupBy(*keys, F.expr("x div 2").cast("int").alias("x"), F.expr("y div 2").cast("int").alias("y")).agg(F.expr("cast(sum(v) div count(v) as int)").alias("v"))


def box_downsample_pow2(pixels: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Repeated passes of 2, each of which truncates; not one average over factor x factor."""
    while factor > 1:
        pixels, factor = box_downsample(pixels, keys), factor // 2
    return pixels


def compose(canvas: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """canvas: keys, w, h. hits: keys, ordinal, px, py, v (pixels in region coordinates). Later ordinals overwrite; what no
    tile covers is zero. The canvas's own pixels are the lowest of all: one grouped pass, without a join of pixels."""
    c = F.col
    inside = canvas.join(hits, keys).filter((c("px") >= 0) & (c("py") >= 0) & (c("px") < c("w")) & (c("py") < c("h")))
    grid = canvas.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), c("h") - 1)).alias("py"), "w").withColumn("px", F.explode(F.sequence(F.lit(0).cast("long"), c("w") - 1)))
    under = grid.select(*keys, "px", "py", F.lit(None).cast(inside.schema["ordinal"].dataType).alias("ordinal"), F.lit(None).cast(inside.schema["v"].dataType).alias("v"))
    both = inside.select(*keys, "px", "py", "ordinal", "v").unionByName(under)
    return both.groupBy(*keys, "px", "py").agg(F.coalesce(F.max_by("v", "ordinal"), F.lit(0)).alias("v"))


def undo_predictor(samples: DataFrame, row_keys: list[str], order: str, bits: int) -> DataFrame:
    """Horizontal differencing undone: running sums of v modulo 2**bits along each row and lane."""
    w = Window.partitionBy(*row_keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("v", F.pmod(F.sum("v").over(w), F.lit(1 << bits)).cast("int"))


def ycbcr_float(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """The float form, rounded. 1.402, 0.344136, 0.714136, 1.772."""
    b, r = cb - 128, cr - 128
    return clamp_u8(F.round(y + 1.402 * r)), clamp_u8(F.round(y - 0.344136 * b - 0.714136 * r)), clamp_u8(F.round(y + 1.772 * b))


def ycbcr_int(y: str, cb: str, cr: str) -> tuple[Column, Column, Column]:
    """The integer form in thousandths, whose division truncates. 1402, 344, 714, 1772."""
    b, r = f"({cb} - 128)", f"({cr} - 128)"
    return clamp_u8(F.expr(f"{y} + (1402 * {r}) div 1000")), clamp_u8(F.expr(f"{y} - (344 * {b} + 714 * {r}) div 1000")), clamp_u8(F.expr(f"{y} + (1772 * {b}) div 1000"))


def premultiplied_argb(r: Column, g: Column, b: Column, a: Column) -> Column:
    """One unsigned 32-bit number: alpha, then each channel times alpha over 255, rounded."""
    pre = lambda v: F.floor((v * a + 127) / 255)
    return (a.cast("long") * (1 << 24) + pre(r) * (1 << 16) + pre(g) * (1 << 8) + pre(b)).cast("long")


def bgr_to_rgb(bgr: Column) -> Column:
    return F.shiftleft(bgr.bitwiseAND(F.lit(0xFF)), 16).bitwiseOR(bgr.bitwiseAND(F.lit(0xFF00))).bitwiseOR(F.shiftright(bgr, 16).bitwiseAND(F.lit(0xFF)))


def palette_rgb(index: Column, lut: list[tuple[int, int, int]]) -> Column:
    """The palette's colour; an index past its end is black."""
    table = F.array(*[F.array(*map(F.lit, rgb)) for rgb in lut])
    return F.coalesce(F.get(table, index), F.array(F.lit(0), F.lit(0), F.lit(0)))


def inverted(v: Column, bits: int) -> Column:
    """A sample of an image whose white is its least value."""
    return F.lit((1 << bits) - 1) - v


def planar_index(i: Column, k: Column, channels: int, plane: Column, planar: Column) -> Column:
    """Where channel k of pixel i is in a buffer."""
    return F.when(planar, k * plane + i).otherwise(i * channels + k)


def compare(actual: DataFrame, expected: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Largest and mean absolute difference, share of equal samples, and PSNR (null where all are equal)."""
    d = F.abs(F.col("a.v") - F.col("e.v"))
    both = actual.alias("a").join(expected.alias("e"), keys)
    out = both.groupBy(*by).agg(F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.avg((d == 0).cast("double")).alias("equal_rate"), F.avg(d * d).alias("mse"))
    return out.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(65025 / F.col("mse"))))


def tissue_stats(pixels: DataFrame, by: list[str]) -> DataFrame:
    """r, g, b: share and mean colour of tissue, which is darker than 235 and has chroma above 12."""
    c = F.col
    brightness = (c("r") + c("g") + c("b")) / 3
    chroma = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    tissue = (brightness < 235) & (chroma > 12)
    mean = lambda v: F.avg(F.when(tissue, c(v)))
    return pixels.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(tissue).alias("tissue"), mean("r").alias("mean_r"), mean("g").alias("mean_g"), mean("b").alias("mean_b"))
