"""Scans of tidy cell tables, manifests, cluster files and several references at once."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.identifiers import finite
from tessella.plans.dataset import Dataset

# Columns of a tidy table that are no features.
KNOWN = ("sample_id", "x", "y", "cell_type", "region", "spot_id", "barcode", "cell_id")
# File endings and the kind of source they mark, longest first.
KINDS = ((".xenium", "xenium_experiment"), (".csv.gz", "tidy_csv"), (".tsv.gz", "tidy_csv"), (".csv", "tidy_csv"), (".tsv", "tidy_csv"), (".parquet", "parquet"), (".json", "manifest"), (".h5ad", "h5ad"), (".zarr", "spatialdata_zarr"))


def source_kind(path: str) -> str:
    """Kind of a source by its name; a folder with experiment.xenium is a Xenium bundle. S1, S2."""
    if os.path.isdir(path) and os.path.exists(os.path.join(path, "experiment.xenium")):
        return "xenium_bundle"
    low = path.lower().rstrip("/")
    return next((kind for end, kind in KINDS if low.endswith(end)), "unknown")


def read_tidy(spark: SparkSession, path: str, *, sample: str | None = None, sep: str | None = None) -> Dataset:
    """Cells and long expression of a tidy CSV or TSV (gzip too). S3, S5.

    Every column that is not known is a feature; ``gene_``/``marker_`` prefixes fall and names
    are upper-cased; values that are no numbers are skipped.  Rows without numeric x and y or
    with an empty cell_type are rejected and counted in ``meta['rejected']``.
    """
    sep = sep or ("\t" if ".tsv" in path.lower() else ",")
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    lower = {c.lower(): c for c in raw.columns}
    missing = [c for c in ("sample_id", "x", "y", "cell_type") if c not in lower]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    known = {c: F.col(f"`{lower[c]}`") for c in KNOWN if c in lower}
    ids = [F.nullif(F.btrim(known[c]), F.lit("")) for c in ("cell_id", "barcode", "spot_id") if c in known]
    features = [c for c in raw.columns if c.lower() not in KNOWN]
    row = F.concat_ws("|", "sample_id", "x", "y", F.monotonically_increasing_id().cast("string"))
    base = raw.select(
        F.coalesce(*ids, F.md5(row)).alias("cell_id") if ids else F.md5(row).alias("cell_id"), known["sample_id"].alias("sample_id"),
        known["x"].try_cast("double").alias("x"), known["y"].try_cast("double").alias("y"), F.btrim(known["cell_type"]).alias("cell_type"),
        (F.nullif(F.btrim(known["region"]), F.lit("")) if "region" in known else F.lit(None).cast("string")).alias("region"),
        *[F.col(f"`{c}`").alias(f"__f{i}") for i, c in enumerate(features)],
    )
    if sample is not None:
        base = base.filter(F.col("sample_id") == sample)
    good = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.coalesce("cell_type", F.lit("")) != "")
    rejected = base.filter(~good).count()
    base = base.filter(good)
    names = [_feature(c) for c in features]
    cells = base.select("cell_id", "sample_id", "x", "y", "cell_type", "region")
    if names:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("gene"), F.col(f"__f{i}").try_cast("double").alias("raw")) for i, n in enumerate(names)])).alias("p")
        expr = base.select("cell_id", "sample_id", pairs).select("sample_id", "cell_id", "p.gene", "p.raw").filter("raw is not null")
        # non-finite values become 0
        expr = expr.withColumn("raw", F.when(finite("raw"), F.col("raw")).otherwise(0.0))
    else:
        expr = spark.createDataFrame([], "sample_id string, cell_id string, gene string, raw double")
    return Dataset(cells.filter(finite("x") & finite("y")), expr, {"rejected": rejected, "path": path})


def _feature(name: str) -> str:
    for prefix in ("gene_", "marker_"):
        if name.lower().startswith(prefix):
            name = name[len(prefix) :]
    return name.upper()


def read_manifest(spark: SparkSession, path: str) -> Dataset:
    """The first tabular source of a manifest; its other keys become metadata. S4."""
    with open(path) as f:
        m = json.load(f)
    sources = m.get("sources", [])
    for s in sources:
        s["path"] = s["path"] if os.path.isabs(s["path"]) else os.path.normpath(os.path.join(os.path.dirname(path), s["path"]))
    first = next((s for s in sources if source_kind(s["path"]) == "tidy_csv"), None)
    if first is None:
        raise ValueError("the manifest has no tabular source")
    ds = read_tidy(spark, first["path"], sample=first.get("sample_id"))
    return Dataset(ds.cells, ds.expr, ds.meta | {k: v for k, v in m.items() if k != "sources"} | {"sources": sources})


def read_xenium_metadata(folder: str) -> dict:
    """experiment.xenium, the first row of metrics_summary.csv and gene_panel.json merged, later ones winning. S10."""
    import csv

    out: dict = {}
    for name in ("experiment.xenium", "metrics_summary.csv", "gene_panel.json"):
        p = os.path.join(folder, name)
        if not os.path.exists(p):
            continue
        with open(p, newline="") as f:
            if name.endswith(".csv"):
                out |= next(csv.DictReader(f), {})
            else:
                out |= json.load(f)
    return out


def read_cell_table(spark: SparkSession, folder: str) -> DataFrame:
    """The cell table of a bundle: cells.parquet, cells.csv.gz or cells.csv; measurements as doubles. S8, S14."""
    for name, reader in (("cells.parquet", lambda p: spark.read.parquet(p)), ("cells.csv.gz", lambda p: spark.read.option("header", True).csv(p)), ("cells.csv", lambda p: spark.read.option("header", True).csv(p))):
        p = os.path.join(folder, name)
        if os.path.exists(p):
            df = reader(p)
            renamed = {"x_centroid": "x", "y_centroid": "y"}
            return df.select(*[(F.btrim(F.col(c).cast("string"), F.lit(' "')) if c == "cell_id" else F.col(c).try_cast("double")).alias(renamed.get(c, c)) for c in df.columns])
    raise FileNotFoundError(f"no cell table in {folder}")


def read_clusters(spark: SparkSession, folder: str, method: str) -> DataFrame:
    """(cell_id, cluster) of analysis/clustering/<method>/clusters.csv. S13."""
    df = spark.read.option("header", True).csv(os.path.join(folder, "analysis", "clustering", method, "clusters.csv"))
    a, b = df.columns[:2]
    return df.select(F.btrim(F.col(a), F.lit(' "')).alias("cell_id"), F.btrim(F.col(b), F.lit(' "')).alias("cluster"))


def union_references(parts: list[Dataset]) -> Dataset:
    """All references as one; mixed organisms or expression semantics are refused. S12, U1."""
    for key in ("organism", "semantics"):
        seen = {p.meta.get(key) for p in parts} - {None}
        if len(seen) > 1:
            raise ValueError(f"mixed {key}: {', '.join(sorted(map(str, seen)))}")
    cells, expr = parts[0].cells, parts[0].expr
    for p in parts[1:]:
        cells, expr = cells.unionByName(p.cells, allowMissingColumns=True), expr.unionByName(p.expr, allowMissingColumns=True)
    return Dataset(cells, expr, {k: v for p in parts for k, v in p.meta.items()})


def read_reference(spark: SparkSession, path: str) -> Dataset:
    """Refuses what cannot be read here: H5AD and Zarr stores need libraries Spark lacks; export them to parquet. S6, S18."""
    kind = source_kind(path)
    if kind in ("h5ad", "spatialdata_zarr", "unknown"):
        raise ValueError(f"{kind} can't be read; export cells and long expression to parquet (cell_id, gene, raw)")
    return read_tidy(spark, path)
