"""Tailing record files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwell.sources.recordfile import register


def tail(spark: SparkSession, path: str, **options) -> DataFrame:
    """A streaming frame of the records of ``path``; a chunk is delivered once it is complete, a growing file is read on."""
    register(spark)
    return spark.readStream.format("recordfile").options(**options).load(path)

