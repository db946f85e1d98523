"""Streaming variants of counts and checks (an extension: the analyses themselves are batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.identifiers import finite, type_key


def arrivals(spots: DataFrame, *, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Distinct cells and bad positions by window of acquisition and cell type, over a stream of spots.

    A cell delivered again within the watermark counts once; rows later than ``late`` are dropped
    by the watermark.
    """
    s = spots.withColumn("at", F.col("acquired_at").cast("timestamp")).withWatermark("at", late)
    s = s.dropDuplicatesWithinWatermark(["cell_id"])
    return s.groupBy(F.window("at", window).alias("w"), type_key("cell_type").alias("cell_type")).agg(
        F.count("*").alias("cells"), F.count_if(~(finite("x") & finite("y"))).alias("bad_positions")
    ).select(F.col("w.start").alias("start"), "cell_type", "cells", "bad_positions")
