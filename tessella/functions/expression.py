"""The expression view: one row per cell and expression gene with a positive count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.identifiers import clean_id, finite, gene_name, raw_is_expression


def expression_rows(expr: DataFrame) -> DataFrame:
    """Rows of ``expr`` that are expression: (sample_id, cell_id, gene, raw, value).

    Dropped: whole-cell measurements, control probes, rows without a cell or gene, and rows
    whose raw or value is not finite or whose raw is not above 0.  Repeated deliveries are
    still in (see ``expression``).  Other columns of ``expr`` are not read.
    """
    kept = expr.filter(finite("raw") & (F.col("raw") > 0) & finite("value") & raw_is_expression("gene"))
    return kept.select("sample_id", clean_id("cell_id").alias("cell_id"), gene_name("gene").alias("gene"), "raw", "value").filter("cell_id is not null")


def expression(expr: DataFrame) -> DataFrame:
    """``expression_rows`` with every cell and gene once (the largest raw, then value, wins)."""
    best = F.max(F.struct("raw", "value", "sample_id")).alias("m")
    return (
        expression_rows(expr).groupBy("cell_id", "gene").agg(best)
        .select("m.sample_id", "cell_id", "gene", "m.raw", "m.value")
    )
