"""The queries of the core operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.cells import distinct_cells
from tessella.operators.spatial_join import near_pairs, points_in_outlines
from tessella.operators.units import positions_in_nm
from tessella.plans import reference, review  # noqa: F401  (review adds its queries to those of reference)
from tessella.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of one sample at most 5 microns apart, and the outline around each cell without a region."""
    cells = distinct_cells(table(spark, folder, "spots"), ["sample_id", "x", "y", "region"])
    near = near_pairs(cells, 5.0).select(F.lit("near").alias("kind"), "key_a", "key_b")
    homeless = cells.filter(F.col("region").isNull() | (F.col("region") == ""))
    inside = points_in_outlines(homeless, table(spark, folder, "region_shapes"))
    return near.unionByName(inside.select(F.lit("inside").alias("kind"), F.col("cell_id").alias("key_a"), F.col("shape_id").cast("string").alias("key_b")))


def p4_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered position with its unit, the basis of the unit and a mark for review."""
    return positions_in_nm(table(spark, folder, "raw_rows"), table(spark, folder, "raw_sources"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_positions(spark, folder).filter("x_nm is not null and y_nm is not null").select("row_id", "x_nm", "y_nm")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_positions": p4_positions,
} | reference.QUERIES

SQL: dict[str, str] = dict(reference.SQL)
