"""The cell view of ``spots``: every cell once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.identifiers import clean_id


def distinct_cells(spots: DataFrame, columns: list[str]) -> DataFrame:
    """One row per cell with the given columns, taken from its last delivery.

    Ties of ``ingested_at`` go to the largest values; rows without a cell id are dropped.
    """
    last = F.max(F.struct(F.col("ingested_at").alias("__at"), *columns)).alias("m")
    return (
        spots.select(clean_id("cell_id").alias("cell_id"), "ingested_at", *columns)
        .filter(F.col("cell_id").isNotNull())
        .groupBy("cell_id").agg(last)
        .select("cell_id", *[F.col(f"m.{c}").alias(c) for c in columns])
    )
