"""The named tools: which operators they run, what must run before, and which refuse to."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.identifiers import finite
from tessella.operators import clustering, graph, summaries, transfer
from tessella.plans.dataset import Dataset


class NotComputed(RuntimeError):
    """The tool is known, but nothing computes it; made-up numbers are not returned."""


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    gives: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    words: tuple[str, ...] = ()


def _pos(ds: Dataset) -> DataFrame:
    return ds.cells.filter(finite("x") & finite("y"))


def _groups(ds: Dataset, group_key: str = "cell_type") -> DataFrame:
    """Labels by cell type or cluster. F16, F17."""
    key = {"cell_type": "cell_type", "cluster": "cluster", "clusters": "cluster", "leiden": "cluster", "leiden_cluster": "cluster"}.get(group_key)
    if key is None:
        raise ValueError(f"unknown group key {group_key}")
    source = ds.cells if key == "cell_type" else ds.meta["clusters"]
    return source.select("cell_id", F.col(key).alias("label"))


def _overlay(ds: Dataset, feature: str = "") -> DataFrame:
    g = summaries.gene_summary(ds.expr, ds.cells)
    if feature:
        return g.filter(F.col("gene") == feature)
    return g.orderBy("gene").limit(1)  # the default is the first gene


def _variable(ds: Dataset, n_top: int = 50, n_neighs: int = 6) -> DataFrame:
    i = graph.morans_i(graph.knn_edges(_pos(ds), n_neighs), ds.expr, _pos(ds))
    tested = graph.gene_screen(ds.expr, ds.cells).filter("tested").select("gene")
    return i.join(tested, "gene").orderBy(F.desc("i"), "gene").limit(n_top)


def _enrichment(ds: Dataset, n_neighs: int = 6, n_perms: int = 100, radius: float | None = None) -> DataFrame:
    c = _pos(ds)
    e = graph.radius_edges(c, radius) if radius else graph.knn_edges(c, max(2, n_neighs))
    return graph.enrichment(e, c, perms=n_perms)


def _markers(ds: Dataset, group_key: str = "cell_type", n_top: int = 25) -> DataFrame:
    from pyspark.sql import Window

    z = summaries.rank_sums(ds.expr, _groups(ds, group_key))
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("z"), "gene"))).filter(F.col("rank") <= n_top)


def _transfer(ds: Dataset, reference_dataset: Dataset, n_neighbors: int = 15, class_prior_power: float = 0.0) -> DataFrame:
    r = reference_dataset
    return transfer.transfer_labels(r.expr.select("cell_id", "gene", "raw"), r.cells.select("cell_id", F.col("cell_type").alias("label")), ds.expr.select("cell_id", "gene", "raw"), k=n_neighbors, prior_power=class_prior_power)


TOOLS = {
    t.name: t
    for t in (
        Tool("qc_and_cluster", lambda ds, resolution=0.5: clustering.expression_clusters(ds.expr, resolution=resolution), ("clusters",), (), ("cluster", "quality")),
        Tool("spatial_clustering", lambda ds, resolution=0.5: clustering.expression_clusters(ds.expr, resolution=resolution), ("clusters",), (), ("spatial cluster", "domain")),
        Tool("annotation", lambda ds: summaries.counts(ds.cells, "cell_type"), ("annotation",), (), ("annotat", "cell type")),
        Tool("cell_type_annotation", lambda ds: summaries.counts(ds.cells, "cell_type"), (), (), ("label",)),
        Tool("feature_overlay", _overlay, (), (), ("overlay", "express")),
        Tool("marker_detection", _markers, (), ("annotation",), ("marker",)),
        Tool("differential_expression", lambda ds, group1, group2, group_key="cell_type": summaries.mean_difference(ds.expr, _groups(ds, group_key), group1, group2), (), ("annotation",), ("differential",)),
        Tool("spatial_variable_genes", _variable, (), (), ("spatially variable", "moran", "pattern")),
        Tool("region_summary", lambda ds, top_n_features=8, min_region_cells=50: summaries.region_summary(ds.cells, ds.expr, top=top_n_features, least=min_region_cells), (), ("annotation",), ("region",)),
        Tool("neighborhood_enrichment", _enrichment, (), ("annotation",), ("neighbo", "adjacen")),
        Tool("cell_neighborhood_enrichment", _enrichment, (), ("annotation",), ("cell neighbo", "interact")),
        Tool("reference_label_transfer", _transfer, (), (), ("transfer", "reference")),
    )
}

# Tools that are known but compute nothing.
PLACEHOLDERS = (
    "motif_tf_activity", "spatial_deconvolution", "ligand_receptor_analysis", "trajectory_inference", "cnv_inference", "tumor_niche_analysis",
    "protein_coexpression", "cell_phenotyping_spatial", "pathway_activity", "transcription_factor_activity", "spatial_communication_flow",
    "niche_differential_analysis", "chromatin_accessibility_spatial", "motif_enrichment_spatial", "multi_sample_comparison", "tissue_segmentation",
    "spatial_gene_programs", "cell_abundance_heatmap_regions",
)


def run(name: str, ds: Dataset, **params: object) -> DataFrame:
    """The lazy result of a tool; placeholders and unknown names raise."""
    if name in PLACEHOLDERS:
        raise NotComputed(f"{name} is a placeholder and computes nothing")
    if name not in TOOLS:
        raise KeyError(name)
    return TOOLS[name].run(ds, **params)


def order(names: list[str]) -> list[str]:
    """The tools and what they need, producers first, each once. G7."""
    makers = {g: t.name for t in reversed(list(TOOLS.values())) for g in t.gives}
    out: list[str] = []

    def add(name: str, above: tuple[str, ...]) -> None:
        if name in out or name in above:
            return
        for need in TOOLS[name].needs if name in TOOLS else ():
            if makers.get(need, name) != name:
                add(makers[need], (*above, name))
        out.append(name)

    for n in dict.fromkeys(names):
        add(n, ())
    return out


def route(question: str) -> list[str]:
    """Tools whose words begin a word of the question, in plan order. G9."""
    hit = [t.name for t in TOOLS.values() if any(re.search(rf"\b{re.escape(w)}", question, re.I) for w in t.words)]
    return order(hit)
