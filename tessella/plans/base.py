"""The views that queries over the reference's operators start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.cells import distinct_cells
from tessella.functions.expression import expression
from tessella.functions.identifiers import clean_id, finite, type_key
from tessella.sources.tables import table


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell once; blank regions and placeholder types are null, types stand under their key."""
    c = distinct_cells(table(spark, folder, "spots"), ["sample_id", "x", "y", "cell_type", "region"])
    return c.select("cell_id", "sample_id", "x", "y", type_key("cell_type").alias("cell_type"), F.nullif("region", F.lit("")).alias("region"))


def positioned(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).filter(finite("x") & finite("y"))


def genes(spark: SparkSession, folder: str) -> DataFrame:
    return expression(table(spark, folder, "expr"))


def clustered(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "cell_index").select("sample_id", clean_id("cell_id").alias("cell_id"), clean_id("cluster").alias("cluster"))
    return c.filter("cell_id is not null and cluster is not null and lower(cluster) <> 'unclustered'").groupBy("cell_id").agg(F.min("sample_id").alias("sample_id"), F.min("cluster").alias("cluster"))


CELLS = r"""
cells AS (SELECT trim(cell_id, ' "') AS cell_id, max(sample_id) AS sample_id, max(x) AS x, max(y) AS y,
    max(nullif(region, '')) AS region, max(CASE WHEN k NOT IN ('', 'unknown', 'unannotatedcell') THEN k END) AS cell_type
  FROM (SELECT *, regexp_replace(lower(cell_type), '[^\p{L}\p{N}+]', '', 'g') AS k FROM spots) GROUP BY 1),
pos AS (SELECT * FROM cells WHERE isfinite(x) AND isfinite(y))"""

EXPRESSION = r"""
named AS (SELECT trim(cell_id, ' "') AS cell_id, sample_id, upper(regexp_replace(gene, '^(gene_)?(marker_)?', '', 'i')) AS gene, raw, value FROM expr),
classed AS (SELECT *, CASE WHEN regexp_matches(gene, '^(UNASSIGNEDCODEWORD|NEGCONTROLCODEWORD|NEGCONTROLPROBE|DEPRECATEDCODEWORD|GENOMICCONTROL|BLANK|ANTISENSE|NEGPROBE|NEGCONTROL)($|[-_.0-9])') THEN 'control'
    WHEN gene IN ('TRANSCRIPT_COUNTS', 'TOTAL_COUNTS', 'CELL_AREA', 'NUCLEUS_AREA', 'CONTROL_PROBE_COUNTS', 'CONTROL_CODEWORD_COUNTS', 'UNASSIGNED_CODEWORD_COUNTS') THEN 'measurement' ELSE 'expression' END AS class FROM named),
e AS (SELECT cell_id, gene, max(sample_id) AS sample_id, max(raw) AS raw, max(value) AS value FROM classed
  WHERE class = 'expression' AND isfinite(raw) AND isfinite(value) AND raw > 0 GROUP BY 1, 2)"""

CLUSTERED = r"""
idx AS (SELECT trim(cell_id, ' "') AS cell_id, min(sample_id) AS sample_id, min(trim(cluster, ' "')) AS cluster FROM cell_index
  WHERE trim(cluster, ' "') NOT IN ('', 'unclustered') GROUP BY 1)"""

KNN = """
knn AS (SELECT sample_id, src, dst, d2, rank FROM (SELECT a.sample_id AS sample_id, a.cell_id AS src, b.cell_id AS dst, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2,
    row_number() OVER (PARTITION BY a.cell_id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.cell_id) AS rank
  FROM pos a JOIN pos b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id) WHERE rank <= 6)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + " "
