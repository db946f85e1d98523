"""Result tables with a provenance header, read back with it; a digest of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """A folder of TSV parts, each beginning with ``#`` lines of provenance, then a header. K1.

    Written in parallel; a result is never pulled together in one task.
    """
    lines = [f"# {k}: {v}" for k, v in provenance.items()]
    columns = list(df.columns)

    def parts(batches):
        import pandas as pd

        first = True
        for pdf in batches:
            out = ["\t".join("" if v is None or v != v else str(v) for v in row) for row in pdf.itertuples(index=False)]
            if first:
                out = [*lines, "\t".join(columns), *out]
                first = False
            yield pd.DataFrame({"value": out})

    df.mapInPandas(parts, "value string").write.mode("overwrite").text(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_table``; all columns as text. K5."""
    return spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)


def tested_and_screened(tested: DataFrame, screened: DataFrame) -> DataFrame:
    """Tested rows and, without p, the screened-out ones; the tested row wins. K2."""
    rest = screened.join(tested.select("gene"), "gene", "left_anti")
    return tested.withColumn("tested", F.lit(True)).unionByName(rest.withColumn("tested", F.lit(False)), allowMissingColumns=True)


def cells_table(cells: DataFrame, parts: list[DataFrame], *, reviewed: bool) -> DataFrame:
    """Cells with clusters, labels and local statistics; labels are provisional unless reviewed. K4."""
    out = cells
    for p in parts:
        out = out.join(p, "cell_id", "left")
    return out if reviewed else out.withColumnRenamed("cell_type", "cell_type_provisional")


def digest(df: DataFrame) -> str:
    """Digest of the rows in any order: sums of two halves of each row's hash, and the count. K8."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    low = F.sum((h.bitwiseAND(0xFFFFFFFF)).cast("decimal(38,0)"))
    high = F.sum(F.shiftrightunsigned(h, 32).cast("decimal(38,0)"))
    r = df.agg(low.alias("a"), high.alias("b"), F.count("*").alias("n")).first()
    return f"{int(r.a or 0):x}-{int(r.b or 0):x}-{r.n}"
