"""Parquet table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data root; the path is ``{root}/{name}.parquet`` (a file or a folder)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
