"""Reads that can be cancelled: jobs under a tag, which another thread may stop."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts inside carry the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops what runs under the tag."""
    spark.sparkContext.cancelJobsWithTag(tag)
