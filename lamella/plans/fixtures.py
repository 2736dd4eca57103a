"""The deterministic slides, levels, regions, tiles and traces that the driver's tables stand for, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as dataset_id", "cast(1024 + 64 * p_size as bigint) as width0", "cast(768 + 48 * p_size as bigint) as height0", "p_size", "p_brand")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slides(spark, sf_dir).select("dataset_id", "width0", "height0", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    return out.selectExpr(
        "dataset_id", "level", "shiftright(width0, level) as width", "shiftright(height0, level) as height", "cast(shiftleft(1, level) as double) as downsample",
        f"cast({TILE} as bigint) as tile_w", f"cast({TILE} as bigint) as tile_h",
    ).withColumns({"tiles_across": F.ceil(F.col("width") / TILE), "tiles_down": F.ceil(F.col("height") / TILE)})


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests joined to the level they ask for."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey as request_id", "o_custkey as dataset_id", "cast(o_orderkey % 4 as int) as level")
    return orders.join(levels(spark, sf_dir), ["dataset_id", "level"]).withColumns(
        {
            "x": F.expr("(request_id * 7919) % (width + 128) - 64"),
            "y": F.expr("(request_id * 104729) % (height + 128) - 64"),
            "w": F.expr("64 + (request_id % 13) * 64"),
            "h": F.expr("64 + (request_id % 7) * 64"),
        }
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 float tiles: vec_id, x, y, s."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "s")).selectExpr("vec_id", "i % 8 as x", "i div 8 as y", "s")


LEVELS = """levels as (
  select dataset_id, level, w0 >> level as width, h0 >> level as height, cast(1 << level as double) as downsample,
    ((w0 >> level) + 255) // 256 as tiles_across, ((h0 >> level) + 255) // 256 as tiles_down
  from (select p_partkey as dataset_id, cast(1024 + 64 * p_size as bigint) as w0, cast(768 + 48 * p_size as bigint) as h0, unnest([0, 1, 2, 3]) as level from part)
)"""
REGIONS = (
    LEVELS
    + """, regions as (
  select o.o_orderkey as request_id, l.*, (o_orderkey * 7919) % (width + 128) - 64 as x, (o_orderkey * 104729) % (height + 128) - 64 as y,
    64 + (o_orderkey % 13) * 64 as w, 64 + (o_orderkey % 7) * 64 as h
  from orders o join levels l on l.dataset_id = o.o_custkey and l.level = o.o_orderkey % 4
)"""
)
PIXELS = """pixels as (
  select vec_id, (i - 1) % 8 as x, (i - 1) // 8 as y, embedding[i] as s from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)
)"""
U8 = PIXELS + ", u8 as (select vec_id, x, y, cast(greatest(0, least(255, round((cast(s as double) + 0.5) * 255))) as int) as v from pixels)"
