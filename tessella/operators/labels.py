"""Labels: marker rules, lineages, review decisions, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keyword of a label and the lineage it stands for, most specific first.
LABEL_LINEAGES = (
    ("oligodendrocyte precursor", "opc"), ("opc", "opc"), ("oligodendrocyte", "oligodendrocyte"), ("astrocyte", "astrocyte"),
    ("microglia", "myeloid"), ("microglial", "myeloid"), ("macrophage", "myeloid"), ("monocyte", "myeloid"), ("dendritic", "myeloid"),
    ("neutrophil", "myeloid"), ("myeloid", "myeloid"), ("t cell", "lymphoid"), ("nk cell", "lymphoid"), ("natural killer", "lymphoid"),
    ("b cell", "lymphoid"), ("plasma cell", "lymphoid"), ("lymphocyte", "lymphoid"), ("endothelial", "endothelial"), ("pericyte", "stromal"),
    ("smooth muscle", "stromal"), ("fibroblast", "stromal"), ("stromal", "stromal"), ("epithelial", "epithelial"), ("neoplastic", "epithelial"),
    ("tumor", "epithelial"), ("neuron", "neuronal"), ("neuronal", "neuronal"), ("glutamatergic", "neuronal"), ("gabaergic", "neuronal"),
)

# Markers of a lineage.
LINEAGE_MARKERS = {
    "lymphoid": ("PTPRC", "CD3D", "CD3E", "CD8A", "CD4", "NKG7", "GNLY", "MS4A1", "CD79A", "MZB1"),
    "myeloid": ("CD68", "LYZ", "C1QA", "AIF1", "CTSS", "ITGAX", "P2RY12", "CX3CR1", "MS4A6A", "FCGR3A"),
    "endothelial": ("PECAM1", "VWF", "KDR", "FLT1", "CLDN5", "RAMP2"),
    "stromal": ("COL1A1", "COL1A2", "DCN", "LUM", "ACTA2", "PDGFRB"),
    "epithelial": ("EPCAM", "KRT8", "KRT18", "KRT19", "KRT15"),
    "neuronal": ("SNAP25", "RBFOX3", "SYT1", "NRGN", "SLC17A7", "GAD1", "GAD2", "ENC1"),
    "oligodendrocyte": ("MBP", "MOG", "MOBP", "PLP1", "CLDN11", "OPALIN", "ERMN", "CNDP1"),
    "opc": ("PDGFRA", "CSPG4", "BCAN", "VCAN", "PTPRZ1", "OLIG1", "OLIG2", "SOX10"),
    "astrocyte": ("GFAP", "AQP4", "SLC1A3", "GJA1", "SOX9"),
}

# Markers of a label, and the weight of markers shared by several.
MARKER_RULES = {
    "T/NK cell": ("CD3D", "CD3E", "CD8A", "NKG7", "GNLY", "PTPRC", "CD4"),
    "B cell": ("MS4A1", "CD79A", "CD79B", "CD19", "MZB1"),
    "Myeloid cell": ("LYZ", "CD68", "LST1", "C1QA", "FCGR3A", "AIF1", "P2RY12"),
    "Endothelial cell": ("PECAM1", "VWF", "KDR", "RAMP2", "CLDN5", "FLT1"),
    "Fibroblast/Stromal cell": ("COL1A1", "COL1A2", "DCN", "LUM", "ACTA2", "PDGFRB"),
    "Epithelial/Tumor-like cell": ("EPCAM", "KRT8", "KRT18", "KRT19", "MKI67"),
    "Neural/Glial cell": ("GFAP", "AQP4", "MBP", "SNAP25", "RBFOX3", "PLP1", "MOG", "SLC1A3"),
}
MARKER_WEIGHTS = {"PTPRC": 0.4, "CD4": 0.4, "ACTA2": 0.6, "MKI67": 0.5}

COMPATIBLE = (("oligodendrocyte", "opc"), ("astrocyte", "neuronal"))


def dominant_label(expr: DataFrame, rules: dict[str, tuple[str, ...]], weights: dict[str, float] | None = None, *, least: float = 2.0, dominance: float = 1.5) -> DataFrame:
    """(cell_id, label, score): the label whose markers weigh most, if clearly. F8, F11.

    Scores are sums of positive values times weights.  No label where the best is below
    ``least`` or below ``dominance`` times a positive runner-up; equal scores go to the larger
    name first.  The rule table is a small constant of the caller.
    """
    weights = weights or {}
    table = [(g, label, float(weights.get(g, 1.0))) for label, genes in rules.items() for g in genes]
    r = expr.sparkSession.createDataFrame(table, "gene string, label string, w double")
    s = expr.filter("value > 0").join(F.broadcast(r), "gene").groupBy("cell_id", "label").agg(F.sum(F.col("value") * F.col("w")).alias("score"))
    w = Window.partitionBy("cell_id").orderBy(F.desc("score"), F.desc("label"))
    s = s.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).filter("n = 1")
    return s.filter((F.col("score") >= least) & (F.col("second").isNull() | (F.col("score") >= F.col("second") * dominance))).select("cell_id", "label", F.bround("score", 6).alias("score"))


def label_lineage(label: Column, keywords: tuple[tuple[str, str], ...] = LABEL_LINEAGES) -> Column:
    """Lineage of the first keyword a label contains; '' without one. F10."""
    text = F.lower(F.btrim(F.coalesce(label, F.lit(""))))
    out = F.lit("")
    for word, lineage in reversed(keywords):
        out = F.when(text.contains(word), lineage).otherwise(out)
    return out


def lineages_conflict(a: Column, b: Column) -> Column:
    """Both known, different, and not a compatible pair. F12."""
    fits = F.lit(False)
    for x, y in COMPATIBLE:
        fits = fits | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return (a != "") & (b != "") & (a != b) & ~fits


def label_audit(cells: DataFrame, observed: DataFrame, *, floor: float = 0.15) -> DataFrame:
    """Per label: cells, assessed, conflicting, dominant observed lineage, share, flagged. A7.

    ``cells``: cell_id, label, claimed; ``observed``: cell_id, lineage.  Blank labels are
    skipped; ties of the dominant lineage go to the smaller name.
    """
    j = cells.filter("label is not null and label <> ''").join(observed, "cell_id", "left").withColumn("lineage", F.coalesce("lineage", F.lit("")))
    conflict = lineages_conflict(F.col("claimed"), F.col("lineage"))
    per = j.groupBy("label", "claimed", "lineage").agg(F.count("*").alias("n"), F.count_if(conflict).alias("c"))
    top = F.min(F.when(F.col("lineage") != "", F.struct((-F.col("n")).alias("m"), F.col("lineage").alias("l"))))
    a = per.groupBy("label", "claimed").agg(F.sum("n").alias("cells"), F.coalesce(F.sum(F.when(F.col("lineage") != "", F.col("n"))), F.lit(0)).alias("assessed"), F.sum("c").alias("conflicting"), F.coalesce(top["l"], F.lit("")).alias("dominant"))
    share = F.coalesce(F.bround(F.try_divide("conflicting", "assessed"), 4), F.lit(0.0))
    return a.withColumn("share", share).withColumn("flagged", (F.col("assessed") > 0) & (F.col("share") >= floor) & (F.col("claimed") != ""))


# Identities and statuses of review decisions.
UNRESOLVED = ("", "unknown", "uncertain", "unreviewed", "unlabeled", "unannotated", "unknown cell", "unannotated cell", "unlabeled cell")


def review_issues(rows: DataFrame, *, key: str = "cell_id") -> DataFrame:
    """(key, issues): what keeps a review row from being accepted; an empty array accepts it. F18, C11.

    Columns read: review_status, expert_label, reviewer_id, evidence_ref, reviewed_at (text),
    confidence (text).  A key given twice, or blank, is never accepted.
    """
    s = lambda c: F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    n = s("confidence").try_cast("double")
    many = F.count("*").over(Window.partitionBy(key))
    tests = [
        ("not_approved", ~F.lower(s("review_status")).isin("reviewed", "approved")),
        ("unresolved_identity", F.lower(s("expert_label")).isin(*UNRESOLVED)),
        ("missing_reviewer", (s("reviewer_id") == "") | F.lower(s("reviewer_id")).startswith("unidentified")),
        ("missing_evidence", s("evidence_ref") == ""),
        ("invalid_reviewed_at", F.replace(s("reviewed_at"), F.lit("Z"), F.lit("+00:00")).try_cast("timestamp").isNull()),
        ("invalid_confidence", n.isNull() | F.isnan(n) | (n < 0) | (n > 1)),
        ("missing_or_duplicate_cell_id", F.col(key).isNull() | (s(key) == "") | (many > 1)),
    ]
    return rows.select(key, F.filter(F.array(*[F.when(t, name) for name, t in tests]), lambda x: x.isNotNull()).alias("issues"))


def reviewed_view(cells: DataFrame, reviewed: DataFrame, columns: list[str]) -> DataFrame:
    """Cells whose current values equal the reviewed ones. F15."""
    return cells.join(reviewed.select("cell_id", *columns), ["cell_id", *columns], "left_semi")


def apply_labels(cells: DataFrame, labels: DataFrame, *, label: str = "cell_type") -> DataFrame:
    """Cells with the label of their reviewer where there is one, and a mark of it. J2-J4, J13."""
    new = labels.select("cell_id", F.col(label).alias("__new"))
    return cells.join(new, "cell_id", "left").withColumn("matched", F.col("__new").isNotNull()).withColumn(label, F.coalesce("__new", label)).drop("__new")


def label_coverage(applied: DataFrame, *, by: str = "sample_id") -> DataFrame:
    """Share of cells with a reviewed label, to 4 digits. J2, C5."""
    return applied.groupBy(by).agg(F.count("*").alias("cells"), F.count_if("matched").alias("matched"), F.bround(F.avg(F.col("matched").cast("double")), 4).alias("coverage"))


def lineage_coverage(lineages: DataFrame, *, least: int = 25, share: float = 0.002) -> DataFrame:
    """(lineage, n, present): a lineage is present from max(25, ceil(0.002 n)) cells. A8."""
    c = lineages.filter("lineage <> ''").groupBy("lineage").agg(F.count("*").alias("n"))
    total = lineages.agg(F.greatest(F.lit(least), F.ceil(F.count("*") * F.lit(share)).cast("long")).alias("floor"))
    return c.join(F.broadcast(total)).select("lineage", "n", (F.col("n") >= F.col("floor")).alias("present"))  # total is one row


def astrocyte_rule(genes: DataFrame) -> DataFrame:
    """(cell_id, candidate, confidence) for glial cells by three genes, given as columns. R10.

    CD68 has to be absent throughout; AQP4 suggests an astrocyte (0.70 with EGFR, else 0.62),
    EGFR alone one of low confidence (0.55).  A missing gene is 0; other cells have no candidate.
    """
    g = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    glial = (F.col("label") == "Neural/Glial cell") & (g("CD68") <= 0)
    by_egfr = F.when(glial & (g("EGFR") > 0), 0.55)
    confidence = F.when(glial & (g("AQP4") > 0), F.when(g("EGFR") > 0, 0.70).otherwise(0.62)).otherwise(by_egfr)
    return genes.select("cell_id", F.when(confidence.isNotNull(), "astrocyte").alias("candidate"), confidence.alias("confidence"))


def breast_relabel(label: Column, g: dict[str, Column]) -> Column:
    """Names of the breast reference for coarse marker labels; ``g``: expression columns by gene. F9."""
    v = lambda n: F.coalesce(g[n], F.lit(0.0))
    return (
        F.when(label == "T/NK cell", F.when(v("CD8A") >= v("CD4"), "CD8+_T_Cells").otherwise("CD4+_T_Cells"))
        .when(label == "B cell", "B_Cells")
        .when(label == "Myeloid cell", F.when(v("CD68") + v("C1QA") > v("LYZ"), "Macrophages_2").otherwise("Macrophages_1"))
        .when(label == "Fibroblast/Stromal cell", F.when(v("ACTA2") > 0, "Myoepi_ACTA2+").otherwise("Stromal"))
        .when(label == "Epithelial/Tumor-like cell", F.when(v("KRT15") > 0, "Myoepi_KRT15+").when(v("MKI67") > 0, "Prolif_Invasive_Tumor").otherwise("Invasive_Tumor"))
        .when(label == "Endothelial cell", "Endothelial").when(label == "Unannotated cell", "Unlabeled").otherwise(label)
    )


# Names of the species.
SPECIES = {"human": "human", "homo sapiens": "human", "h. sapiens": "human", "hs": "human", "mouse": "mouse", "mus musculus": "mouse", "m. musculus": "mouse", "mm": "mouse"}


def species(name: Column) -> Column:
    """Normal name of a species; unknown names in lower case. F13."""
    key = F.lower(F.btrim(name))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPECIES.items() for x in kv]), key), key)
