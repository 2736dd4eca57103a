"""Where work is dealt out and kept: rows spread over tasks by their number, and tables that end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def spread(rows: DataFrame, per_task: int = 500) -> DataFrame:
    """Rows that are small but cost much work each, dealt evenly: over all cores, and so that no task gets more than
    ``per_task``. By its bytes Spark would give a file of keys to one task."""
    n = rows.count()
    return rows.repartition(max(1, min(n, max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // per_task)))))


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the folder of ``spark.checkpoint.dir``, so that its Python runs once, however many branches of a plan
    read it. Where no folder is named and there are several machines, df itself."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            return df
        named = tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named}/lamella/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
