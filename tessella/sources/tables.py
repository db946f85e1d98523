"""Scans of the named parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: one parquet file or a folder of parts."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
