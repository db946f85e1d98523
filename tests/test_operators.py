"""Known answers of operators that the SQL comparison does not pin down."""

import gzip
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.expression import expression
from tessella.functions.identifiers import clean_id, gene_name, is_control, type_key
from tessella.operators import graph, labels, points, quality, reliability, summaries, transfer
from tessella.plans import tools
from tessella.plans.dataset import Dataset
from tessella.sources import sinks, tidy

CELLS = "sample_id string, cell_id string, x double, y double, cell_type string, region string"


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_identifiers(spark):
    assert one(spark, clean_id(F.lit(' "a-1" ')), clean_id(F.lit(" ")), gene_name(F.lit("Gene_marker_cd8A")), type_key(F.lit(" CD4+-Helper_cell")), type_key(F.lit("Unknown"))) == ("a-1", None, "CD8A", "cd4+helpercell", None)
    assert one(spark, *[is_control(F.lit(x)) for x in ("BLANK_0001", "BLANK", "BLANKET", "NEGCONTROLPROBE7", "NEGPROBE")]) == (True, True, False, True, True)


def test_expression_once(spark):
    rows = [("s", '"a"', "gene_X", 2.0, 1.0), ("s", "a", "x", 2.0, 1.0), ("s", "a", "TOTAL_COUNTS", 5.0, 5.0), ("s", "a", "Y", float("nan"), 1.0), ("s", "a", "Z", 0.0, 0.0), ("s", None, "X", 1.0, 1.0), ("s", "b", None, 1.0, 1.0)]
    e = expression(spark.createDataFrame(rows, "sample_id string, cell_id string, gene string, raw double, value double"))
    assert [tuple(r) for r in e.collect()] == [("s", "a", "X", 2.0, 1.0)]


@pytest.mark.parametrize(("n", "k"), [(10, 4), (10, 10), (10, 20), (1, 5), (7, 1), (101, 13), (0, 3)])
def test_even_sample(spark, n, k):
    df = spark.createDataFrame([(i,) for i in range(n)], "i int")
    got = sorted(r.i for r in quality.even_sample(df, "i", k).collect())
    want = list(range(n)) if k >= n else sorted({round(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})
    assert got == want


def test_knn_is_exact_for_clumps_and_small_samples(spark):
    rng = np.random.default_rng(3)
    xy = np.r_[rng.normal(0, 1, (60, 2)), rng.normal(500, 50, (40, 2)), [[9000, 9000]], np.tile([[3.0, 3.0]], (8, 1))]
    rows = [("a", f"c{i:03}", float(x), float(y), None, None) for i, (x, y) in enumerate(xy)] + [("b", f"d{i}", float(i), 0.0, None, None) for i in range(3)] + [("c", "alone", 1.0, 1.0, None, None)]
    got = {(r.src, r.dst, r["rank"]) for r in graph.knn_edges(spark.createDataFrame(rows, CELLS), 5).collect()}
    want = set()
    for r in rows:
        near = sorted((((q[2] - r[2]) * (q[2] - r[2]) + (q[3] - r[3]) * (q[3] - r[3])), q[1]) for q in rows if q[0] == r[0] and q[1] != r[1])
        want |= {(r[1], k, i + 1) for i, (_, k) in enumerate(near[:5])}
    assert got == want


def test_stripe_is_a_hotspot(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 400, (1200, 2))
    rows = [("s", f"c{i:04}", float(x), float(y), None, None) for i, (x, y) in enumerate(xy)]
    c = spark.createDataFrame(rows, CELLS)
    e = spark.createDataFrame([(f"c{i:04}", g, max(v, 0.0)) for i, (x, y) in enumerate(xy) for g, v in (("STRIPE", (8.0 if 160 < y < 240 else 0.2) + rng.normal(0, 0.3)), ("NOISE", 5 + rng.normal()))], "cell_id string, gene string, value double")
    edges = graph.knn_edges(c, 18).cache()
    hot = lambda g: graph.lisa(edges, c, e, g, perms=39).filter("quadrant = 'high-high' and zscore >= 4").count()
    assert hot("STRIPE") > 50 and hot("NOISE") <= 3


def test_window_fills_a_gap(spark):
    rows = [("s", f"c{i}{j}", i + 0.5, j + 0.5, None, None) for i in range(7) for j in range(7) if (i, j) != (3, 3)]
    r = points.window_area(spark.createDataFrame(rows, CELLS), 1.0).first()
    assert (r.occupied, r.filled, r.area) == (48, 1, 49.0)


def test_labels(spark):
    e = spark.createDataFrame([("a", "CD3D", 2.0), ("a", "LYZ", 1.0), ("b", "CD3D", 2.0), ("b", "LYZ", 1.5), ("c", "PTPRC", 4.0), ("d", "CD3D", -1.0)], "cell_id string, gene string, value double")
    assert {(r.cell_id, r.label) for r in labels.dominant_label(e, labels.MARKER_RULES, labels.MARKER_WEIGHTS).collect()} == {("a", "T/NK cell")}
    got = one(spark, labels.label_lineage(F.lit("Oligodendrocyte precursor cell")), labels.label_lineage(F.lit("CD8+ T cell")), labels.label_lineage(F.lit(None)), labels.lineages_conflict(F.lit("opc"), F.lit("oligodendrocyte")), labels.lineages_conflict(F.lit("opc"), F.lit("myeloid")))
    assert got == ("opc", "lymphoid", "", False, True)
    g = {n: F.lit(v) for n, v in (("CD8A", 1.0), ("CD4", 2.0), ("CD68", 0.0), ("C1QA", 0.0), ("LYZ", 1.0), ("ACTA2", 0.0), ("MKI67", 1.0), ("KRT15", 0.0))}
    assert one(spark, *[labels.breast_relabel(F.lit(x), g) for x in ("T/NK cell", "Myeloid cell", "Epithelial/Tumor-like cell", "other")]) == ("CD4+_T_Cells", "Macrophages_1", "Prolif_Invasive_Tumor", "other")
    assert one(spark, labels.species(F.lit(" Homo sapiens ")), labels.species(F.lit("Zebrafish"))) == ("human", "zebrafish")
    glia = spark.createDataFrame([("a", "Neural/Glial cell", 1.0, 0.0, 2.0), ("b", "Neural/Glial cell", 0.0, 0.0, 2.0), ("c", "B cell", 1.0, 0.0, 1.0), ("d", "Neural/Glial cell", 0.0, 1.0, 2.0), ("e", "Neural/Glial cell", 1.0, 1.0, 2.0), ("f", "Neural/Glial cell", 1.0, None, None)], "cell_id string, label string, AQP4 double, CD68 double, EGFR double")
    assert {r.cell_id: (r.candidate, r.confidence) for r in labels.astrocyte_rule(glia).collect()} == {"a": ("astrocyte", 0.7), "b": ("astrocyte", 0.55), "c": (None, None), "d": (None, None), "e": (None, None), "f": ("astrocyte", 0.62)}


def test_cell_qc_known_answers(spark):
    counts = {"a": (50.0, 100.0, 5.0, 0.0, 0.0), "b": (50.0, 100.0, 3.0, 2.0, 1.0), "c": (9.0, 100.0, 0.0, 0.0, 0.0), "d": (95.0, 0.0, 5.0, 0.0, 0.0), "e": (94.0, 0.0, 6.0, 0.0, 0.0), "f": (None, 100.0, 0.0, 0.0, 0.0)}
    names = ("TRANSCRIPT_COUNTS", "TOTAL_COUNTS", "CONTROL_PROBE_COUNTS", "CONTROL_CODEWORD_COUNTS", "UNASSIGNED_CODEWORD_COUNTS")
    rows = [(c, n, v) for c, vs in counts.items() for n, v in zip(names, vs, strict=True)] + [("a", "NegControlProbe_1", 90.0), ("g", "EPCAM", 500.0)]
    got = quality.cell_qc(spark.createDataFrame(rows, "cell_id string, gene string, raw double"))
    assert {r.cell_id: r.verdict for r in got.collect()} == {"a": "kept", "b": "high_background", "c": "low_transcripts", "d": "kept", "e": "high_background", "f": "low_transcripts", "g": "low_transcripts"}
    assert {r.cell_id for r in quality.qc_kept(got).collect()} == {"a", "d"}
    with pytest.raises(Exception, match="removed every cell"):
        quality.qc_kept(got.filter("cell_id in ('c', 'e')")).collect()


def test_group_morans_floors(spark):
    """Labels of under 50 cells, and samples with one label left, have no value; two halves are nearly 1."""
    rows = [("s", f"c{i:03}", float(i % 12), float(i // 12), "left" if i % 12 < 6 else "right") for i in range(144)] + [("s", f"r{i}", 20.0 + i, 0.0, "rare") for i in range(49)]
    rows += [("t", f"t{i:03}", float(i % 12), float(i // 12), "one" if i < 60 else "two") for i in range(100)]
    c = spark.createDataFrame(rows, "sample_id string, cell_id string, x double, y double, cell_type string")
    got = {(r.sample_id, r.label): r.i for r in graph.group_morans(graph.knn_edges(c, 6), c).collect()}
    assert set(got) == {("s", "left"), ("s", "right")} and all(v > 0.6 for v in got.values())


def test_transfer_finds_planted_labels(spark):
    rng = np.random.default_rng(2)
    rows, lab = [], []
    for i in range(60):
        kind = i % 2
        for g in range(12):
            v = rng.poisson(20 if (g < 6) == bool(kind) else 2)
            rows.append((f"r{i}", f"G{g}", float(v + 1)))
        lab.append((f"r{i}", f"type{kind}"))
    cols = "cell_id string, gene string, raw double"
    ref, tgt = spark.createDataFrame(rows[: 40 * 12], cols), spark.createDataFrame(rows[40 * 12 :], cols)
    out = transfer.transfer_labels(ref, spark.createDataFrame(lab[:40], "cell_id string, label string"), tgt, k=5).collect()
    assert {(r.cell_id, r.label) for r in out} == set(lab[40:])
    with pytest.raises(ValueError, match="shared genes"):
        transfer.shared_panel(ref, spark.createDataFrame([("a", "Q", 1.0)], cols))


def test_reliability(spark):
    assert one(spark, reliability.weakest_link(F.lit(0.5), F.lit(2.0), F.lit(None).cast("double")), reliability.robustness_component(F.lit(1.0), F.lit(1.0), F.lit(0.5)), reliability.grounded(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == (0.5, 0.8, "softened")
    p = spark.range(1).select(graph.two_sided_p(F.lit(1.959964))).first()[0]
    assert abs(p - 0.05) < 1e-6
    rows = spark.createDataFrame([(i / 20, i > 9) for i in range(20)], "s double, truth boolean")
    assert reliability.logistic_calibration(rows, ["s"])["coefficients"]["s"] > 0
    assert reliability.logistic_calibration(rows.limit(3), ["s"])["status"] == "not_fit"
    d = spark.createDataFrame([("d1", "train", True), ("d1", "train", False), ("d2", "calibration", True), ("d2", "calibration", False), ("d1", "test", True), ("d3", "test", False)], "donor_id string, split string, truth boolean")
    assert tuple(reliability.donor_disjoint(d).first()) == (False, "shared_donors")


def test_sources_and_sinks(spark, tmp_path):
    text = "sample_id,x,y,cell_type,region,gene_CD8A,marker_B,note\nS,1,2,T cell,,3,nan,abc\nS,x,2,T cell,r,3,4,\nS,1,2,,r,3,4,\nT,5,6,B cell,r,,2,\n"
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write(text)
    ds = tidy.read_tidy(spark, str(tmp_path / "t.csv.gz"))
    assert ds.meta["rejected"] == 2 and {(r.gene, r.raw) for r in ds.expr.collect()} == {("CD8A", 3.0), ("B", 0.0), ("B", 2.0)}
    assert {(r.sample_id, r.region) for r in ds.cells.collect()} == {("S", None), ("T", "r")}
    (tmp_path / "m.json").write_text(json.dumps({"project": "p", "sources": [{"path": "t.csv.gz", "sample_id": "T"}]}))
    m = tidy.read_manifest(spark, str(tmp_path / "m.json"))
    assert m.meta["project"] == "p" and m.cells.count() == 1
    with pytest.raises(ValueError):
        tidy.read_reference(spark, "x.h5ad")
    with pytest.raises(ValueError):
        tidy.union_references([Dataset(ds.cells, ds.expr, {"organism": "human"}), Dataset(ds.cells, ds.expr, {"organism": "mouse"})])
    sinks.write_table(ds.expr.select("gene", "raw"), str(tmp_path / "out"), {"made": "by a test"})
    back = sinks.read_table(spark, str(tmp_path / "out"))
    assert back.columns == ["gene", "raw"] and back.count() == 3
    assert sinks.digest(ds.expr) == sinks.digest(ds.expr.repartition(3).orderBy("gene"))


def test_tools(spark, small):
    from tessella.plans.base import genes, positioned

    ds = Dataset(positioned(spark, small), genes(spark, small))
    assert tools.run("region_summary", ds).count() > 0 and tools.run("feature_overlay", ds).count() == 1
    with pytest.raises(tools.NotComputed):
        tools.run("trajectory_inference", ds)
    assert tools.order(["marker_detection", "annotation"]) == ["annotation", "marker_detection"]
    assert "marker_detection" in tools.route("Which markers tell them apart?") and tools.route("nearly linear") == []
    assert len(tools.TOOLS) == 12 and len(tools.PLACEHOLDERS) == 18


def test_empty_inputs(spark):
    c = spark.createDataFrame([], CELLS)
    e = spark.createDataFrame([], "sample_id string, cell_id string, gene string, raw double, value double")
    assert summaries.region_summary(c, e).count() == 0 and graph.knn_edges(c, 6).count() == 0
    assert points.tissue_window(c, 10.0).count() == 0 and quality.ingestion_qc(c).first().records == 0
    assert graph.morans_i(graph.radius_edges(c, 5.0).select("sample_id", "src", "dst"), e, c).count() == 0


def test_stream_counts_redeliveries_once(spark, small, tmp_path):
    from tessella.streaming.counts import arrivals

    schema = spark.read.parquet(f"{small}/spots.parquet").schema
    spark.read.parquet(f"{small}/spots.parquet").write.parquet(str(tmp_path / "in"))
    q = arrivals(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").outputMode("complete").start()
    try:
        q.processAllAvailable()
        total = spark.sql("select sum(cells) from arrived").first()[0]
    finally:
        q.stop()
    assert total == spark.read.parquet(f"{small}/spots.parquet").select("cell_id").distinct().count()


def test_robustness_of_every_sample(spark):
    z = [("s", "k6", "a", "a", 5.0), ("s", "k6", "a", "b", -4.0), ("s", "k6", "b", "b", 1.0), ("s", "k10", "a", "a", 3.0), ("s", "k10", "a", "b", 2.0), ("s", "k10", "b", "b", 1.0)]
    z += [("t", "k6", "a", "a", 5.0), ("t", "k6", "a", "b", -4.0), ("t", "k10", "a", "a", 3.0), ("t", "k10", "b", "b", 9.0), ("t", "k10", "a", "b", -1.0), ("t", "band", "a", "a", -3.0)]
    samples = spark.createDataFrame([("s",), ("t",), ("u",)], "sample_id string")
    got = {(r.sample_id, r.setting): r for r in graph.robustness(spark.createDataFrame(z, "sample_id string, setting string, a string, b string, z double"), samples, ["k6", "k10"], top=2).collect()}
    assert {k: (r.sign, r.jaccard, r.score) for k, r in got.items()} == {
        ("s", "knn"): (0.5, 1.0, 0.7), ("s", "k10"): (0.5, 1.0, 0.7), ("s", "band"): (None, None, 0.0),
        ("t", "knn"): (1.0, 0.3333, 0.7333), ("t", "k10"): (1.0, 0.3333, 0.7333), ("t", "band"): (0.0, 0.5, 0.2),
        ("u", "knn"): (None, None, 0.0), ("u", "k10"): (None, None, 0.0), ("u", "band"): (None, None, 0.0),
    }
    assert [tuple(p) for p in got["t", "knn"].pairs] == [("a", "a", 5.0, 2, 1.0, 1.0), ("a", "b", -4.0, 2, 1.0, 0.5)]


def test_enrichment_of_settings_counts_as_enrichment(spark, small):
    from tessella.plans import queries
    from tessella.plans.base import positioned

    c = positioned(spark, small)
    edges = graph.knn_edges(c, 6).cache()
    want = {(r.sample_id, r.a, r.b): r for r in graph.enrichment(edges, c, perms=100).collect()}
    got = {(r.sample_id, r.a, r.b): r for r in graph.enrichment_settings({"k6": edges}, c, perms=100, part_cells=30).collect()}
    both = want.keys() & got.keys()
    assert len(both) > 0.9 * len(want.keys() | got.keys()) and all(want[k].n == got[k].n for k in both)
    assert np.corrcoef([want[k].z for k in both], [got[k].z for k in both])[0, 1] > 0.9
    every = {r.sample_id for r in c.select("sample_id").distinct().collect()}
    rows = queries.QUERIES["enrichment_robustness"](spark, small).collect()
    assert {(r.sample_id, r.setting) for r in rows} == {(s, k) for s in every for k in ("knn", "k10", "k15", "band")}


def test_hotspots_are_significant(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 400, (1200, 2))
    c = spark.createDataFrame([("s", f"c{i:04}", float(x), float(y), None, None) for i, (x, y) in enumerate(xy)], CELLS)
    rows = [(f"c{i:04}", g, float(v)) for i, (x, y) in enumerate(xy) for g, v in (("STRIPE", (8.0 if 160 < y < 240 else 0.2) + abs(rng.normal(0, 0.3))), ("NOISE", 5 + rng.normal()), ("FLAT", 1.0))]
    e = spark.createDataFrame(rows, "cell_id string, gene string, value double")
    edges = graph.knn_edges(c, 18).cache()
    order = ["NOISE", "STRIPE", "FLAT"]
    k = graph.lisa_classes(edges, c, e, order, perms=199, part_cells=500).cache()
    assert {r.gene: r["count"] for r in k.groupBy("gene").count().collect()} == {"NOISE": 1200, "STRIPE": 1200}
    pdf = k.toPandas()
    z = {g: np.array([v for _, h, v in rows if h == g]) for g in order[:2]}
    near = np.argsort(((xy[:, None] - xy[None]) ** 2).sum(-1) + np.diag(np.full(1200, np.inf)), axis=1)[:, :18]
    for g, own in pdf.groupby("gene"):
        own, x = own.sort_values("cell_id"), (z[g] - z[g].mean()) / z[g].std()
        assert np.allclose(own["i"], x * x[near].mean(axis=1), atol=1e-5)
        # the moments that permutations without end would give
        assert np.corrcoef(own["zscore"], np.sign(x) * x[near].mean(axis=1) / np.sqrt((1200 - 18) / 18 / 1199))[0, 1] > 0.99
        p = own["p"].to_numpy()
        o = np.argsort(p)
        adj = np.empty(1200)
        adj[o] = np.minimum(np.minimum.accumulate((p[o] * 1200 / np.arange(1, 1201))[::-1])[::-1], 1)
        assert np.allclose(own["p_adj"], adj) and ((own["p_adj"] <= 0.05) == (own["class"] != "not-significant")).all()
    raw = pdf[(pdf["gene"] == "NOISE") & (pdf["zscore"] >= 2)]
    hot = graph.hotspot_regions(k, order, least=5).toPandas()
    assert len(raw) > 10 and set(hot["gene"]) == {"STRIPE"} and len(hot) > 50
    assert graph.hotspot_regions(k, order, least=5000).count() == 0


def test_every_label_has_its_own_verdict(spark):
    rng = np.random.default_rng(4)
    x, y = rng.uniform(0, 300, (2, 400))
    radii = np.linspace(0, 40, 40)
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)[~np.eye(400, dtype=bool)]
    want = np.sqrt([(d <= r).sum() / 400 / (400 / 9e4) / np.pi for r in radii])
    assert np.allclose(points.l_curve(x, y, radii, 9e4, chunk=500), want)
    assert np.isclose(points.hull_area(np.array([0.0, 2, 2, 0, 1]), np.array([0.0, 0, 3, 3, 1])), 6.0)
    even = rng.uniform(0, 400, (900, 2))
    clump = np.clip(rng.normal(0, 12, (300, 2)) + rng.choice([[100, 100], [300, 250]], 300), 0, 400)
    rows = [("s", f"{kind}{i}", float(p), float(q), kind, None) for kind, pts in (("even", even), ("clump", clump), ("few", even[:20] + 0.5)) for i, (p, q) in enumerate(pts)]
    c = spark.createDataFrame(rows, CELLS)
    got = {r.cell_type: r for r in points.ripley_verdicts(c, graph.knn_edges(c, 1)).collect()}
    assert set(got) == {"even", "clump"} and got["clump"].verdict == "clustered" and got["clump"].peak_deviation > 0 and got["clump"].n == 300
    assert got["even"].verdict != "clustered"


def md5_order(ids, perm):
    import hashlib

    return sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"0|{perm}|{ids[i]}".encode()).hexdigest() if perm else ids[i], ids[i]))


def planted_graph(spark):
    """Samples of cells with labels (some none), values, and edges, one to a cell that is not there; the last has no edge."""
    rng = np.random.default_rng(5)
    cells = [(s, f"{s}{i:03}", float(x), float(y), str(rng.choice(["a", "b", "c"])) if i % 9 else None, None) for s, n in (("s", 70), ("t", 40), ("u", 2)) for i, (x, y) in enumerate(rng.uniform(0, 100, (n, 2)))]
    edges = [(s, f"{s}{i:03}", f"{s}{j:03}") for s, n in (("s", 70), ("t", 40)) for i in range(n) for j in rng.choice([x for x in range(n) if x != i], 4, replace=False)] + [("s", "s000", "gone")]
    return cells, edges, spark.createDataFrame(cells, CELLS), spark.createDataFrame(edges, "sample_id string, src string, dst string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part_cells", [50_000, 30, 2])
def test_enrichment_counts_by_places(spark, part_cells):
    """The brute force's z whatever the blocks; no table of all cells is broadcast and no row stands for an edge under a permutation."""
    cells, edges, c, e = planted_graph(spark)
    want = {}
    for s in "st":
        ids = sorted(r[1] for r in cells if r[0] == s and r[4])
        label = dict((r[1], r[4]) for r in cells)
        own = [(x, y) for g, x, y in edges if g == s and x in ids and y in ids]
        counts = []
        for p in range(21):
            v = dict(zip(ids, (label[ids[i]] for i in md5_order(ids, p)), strict=True))
            counts.append({})
            for x, y in own:
                k = (s, *sorted((v[x], v[y])))
                counts[-1][k] = counts[-1].get(k, 0) + 1
        for k in set().union(*counts):
            n = np.array([x.get(k, 0) for x in counts], float)
            if n[1:].var() > 1e-9:
                want[k] = (n[0], (n[0] - n[1:].mean()) / n[1:].std())
    df = graph.enrichment(e, c, part_cells=part_cells)
    got = {(r.sample_id, r.a, r.b): (r.n, r.z) for r in df.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert "Broadcast" not in plan_of(df) and "posexplode" not in plan_of(df)


@pytest.mark.parametrize("part_cells", [50_000, 30, 2])
def test_lisa_counts_by_places(spark, part_cells):
    cells, edges, c, e = planted_graph(spark)
    value = {r[1]: float(i % 7) for i, r in enumerate(cells)}
    want = {}
    for s in "st":
        ids = sorted(r[1] for r in cells if r[0] == s)
        z = np.array([value[k] for k in ids])
        z = (z - z.mean()) / z.std()
        near = {k: [ids.index(y) for g, x, y in edges if x == k and y in ids] for k in ids}
        i = np.array([[z[a] * z[md5_order(ids, p)][near[k]].mean() for a, k in enumerate(ids)] for p in range(20)])
        sd = i[1:].std(axis=0)
        want |= {k: (i[0, a], (i[0, a] - i[1:, a].mean()) / sd[a] if sd[a] > 1e-9 else 0.0) for a, k in enumerate(ids)}
    expr = spark.createDataFrame([(k, "G", v) for k, v in value.items()], "cell_id string, gene string, value double")
    df = graph.lisa(e, c, expr, "G", part_cells=part_cells)
    got = {r.cell_id: (r.i, r.zscore) for r in df.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=6e-5) for k in want)
    # the joins of the edges with all cells
    assert plan_of(df).count("SortMergeJoin") >= 2 and "posexplode" not in plan_of(df)


@pytest.mark.parametrize(("block", "wide"), [(16_384, 65_536), (20, 50)])
def test_nearest_references_are_exact(spark, block, wide):
    """Sparse products, genes of every cell, copies (ties by id) and any blocks give what brute force gives; the search runs once."""
    rng = np.random.default_rng(6)
    m = np.where(rng.random((200, 30)) < 0.15, rng.integers(1, 9, (200, 30)), 0)
    m[:, :2] = rng.integers(1, 9, (200, 2))
    m[100:130] = m[0]
    ids = [f"c{i:03}" for i in range(200)]
    rows = [(ids[i], f"G{j:02}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    cols = "cell_id string, gene string, raw double"
    ref, tgt = spark.createDataFrame([r for r in rows if r[0] >= "c080"], cols), spark.createDataFrame([r for r in rows if r[0] < "c080"], cols)
    v = np.log1p(m / m.sum(1, keepdims=True) * 1e4)
    d2 = np.round(((v[:80, None] - v[None, 80:]) ** 2).sum(-1), 9)
    want = {(ids[i], ids[80 + j], n + 1) for i in range(80) for n, j in enumerate(np.argsort(d2[i], kind="stable")[:7].tolist())}
    assert {(r.cell_id, r.ref, r["rank"]) for r in transfer.nearest_references(ref, tgt, 7, block=block, wide=wide).collect()} == want
    near = {(r.cell_id, r.ref): r.distance for r in transfer.nearest_references(ref, tgt, 7, block=block, wide=wide).collect()}
    assert all(abs(d - np.sqrt(d2[ids.index(a), ids.index(b) - 80])) < 1e-6 for (a, b), d in near.items())
    sparse = [(np.flatnonzero(x), x[x > 0]) for x in v]
    for i, (top, d) in enumerate(transfer._nearest(iter(sparse[:80]), *map(list, zip(*sparse[80:], strict=True)), 7, probe=20)):
        assert top.tolist() == np.argsort(d2[i], kind="stable")[:7].tolist() and np.allclose(d, np.sort(d2[i])[:7])
    lab = spark.createDataFrame([(k, f"t{i % 3}") for i, k in enumerate(ids)], "cell_id string, label string")
    assert "CoGroups" not in plan_of(transfer.transfer_labels(ref, lab, tgt, k=7))


def test_no_cell_is_shuffled_for_a_block(spark, monkeypatch):
    """label_transfer: however many blocks there are, target cells are shuffled once, and a row for each comes back."""
    rng = np.random.default_rng(8)
    rows = [(f"c{i:03}", f"G{j:02}", float(rng.integers(1, 9))) for i in range(120) for j in rng.choice(25, 9, replace=False)]
    cols = "cell_id string, gene string, raw double"
    ref, tgt = spark.createDataFrame([r for r in rows if r[0] >= "c060"], cols), spark.createDataFrame([r for r in rows if r[0] < "c060"], cols)
    plans = []
    monkeypatch.setattr(transfer, "materialise", lambda df, keep=transfer.materialise: plans.append(plan_of(df)) or keep(df))
    near = transfer.nearest_references(ref, tgt, 5, block=10, wide=10)
    plans.append(plan_of(near))
    assert plans[-1].count("Exchange") == 1 and not [p for p in plans if "CoGroups" in p or "sequence(" in p]
    assert near.count() == 60 * 5


@pytest.mark.parametrize("genes", [300, 8])
def test_bits_of_genes_leave_out_no_near_cell(genes):
    """label_transfer: with bounds of earlier blocks or none, near groups, far cells, copies and cells full of genes give what brute force gives."""
    rng = np.random.default_rng(9)
    m = np.zeros((3000, genes))
    for i in range(3000):
        if i % 2 and i > 40:  # a member of a group
            m[i] = m[i % 40] * rng.uniform(0.8, 1.25, genes)
        else:
            at = rng.choice(genes, min(genes, int(rng.integers(12, 20))), replace=False)
            m[i, at] = rng.integers(1, 200, len(at))
    m[2000:2020] = m[7]
    v = np.log1p(m / m.sum(1, keepdims=True) * 1e4)
    sparse = [(np.flatnonzero(x), x[x > 0]) for x in v]
    blocks = [(a, transfer.References(np.cumsum([len(g) for g, _ in s]), *map(np.concatenate, zip(*s, strict=True)), genes)) for a, s in ((a, sparse[a : a + 1000]) for a in (100, 1100, 2100)) if s]
    for t in range(100):
        d2 = np.round(((v[100:] - v[t]) ** 2).sum(1), 9)
        want = np.argsort(d2, kind="stable")[:15]
        at, d = np.zeros(0, int), np.zeros(0)
        for first, refs in blocks:
            new, n = refs.near(*sparse[t], 15, d[-1] if len(d) == 15 else np.inf)
            d, at = np.r_[d, n], np.r_[at, new + first - 100]
            at, d = at[o := np.argsort(d, kind="stable")[:15]], d[o]
        assert np.allclose(d, d2[want]) and np.allclose(d2[at], d2[want]) and len(set(at)) == 15
        if np.diff(np.sort(d2)[:16]).min() > 1e-6 or t == 7:
            assert at.tolist() == want.tolist()


@pytest.mark.parametrize("name", ["local_morans", "bh_adjust", "evidence_status", "pair_consistency"])
def test_no_row_for_an_edge_under_a_permutation(spark, small, name):
    """The plan permutes by place: labels are no self-join of all permutations, edges are not unfolded."""
    from tessella.plans import queries

    plan = plan_of(queries.QUERIES[name](spark, small))
    assert "MapInArrow" in plan and "posexplode" not in plan


def test_settled_cells_are_never_broadcast(spark, small, monkeypatch):
    """bh_adjust: no step of the neighbour search broadcasts a side that has a row for each cell."""
    from tessella.plans import queries

    plans = []
    monkeypatch.setattr(graph, "materialise", lambda df, keep=graph.materialise: plans.append(plan_of(df)) or keep(df))
    plans.append(plan_of(queries.QUERIES["bh_adjust"](spark, small)))
    assert len(plans) > 4 and not [p for p in plans if re.search(r"BroadcastHashJoin \[sample_id#\d+, (cell_id|src)#", p)]


def test_status_broadcasts_no_count_of_labels(spark, small):
    """evidence_status: counts of labels have a row for each sample and label and are joined by merging."""
    from tessella.plans import queries

    assert not re.search(r"BroadcastHashJoin \[sample_id#\d+, [ab]#", plan_of(queries.QUERIES["evidence_status"](spark, small)))


def test_consistency_broadcasts_nothing(spark, small):
    """pair_consistency: the plan over the written rounds of the neighbour search has no broadcast."""
    from tessella.plans import queries

    assert "Broadcast" not in plan_of(queries.QUERIES["pair_consistency"](spark, small))


def test_cells_of_the_squares_are_never_broadcast(spark, small, monkeypatch):
    """pair_consistency: no plan that ran broadcasts a side that has a row for each cell, as adaptive execution did up to the limit."""
    from tessella.plans import queries

    plans = []
    ran = lambda df: (df.collect(), plans.append(plan_of(df)))
    monkeypatch.setattr(graph, "materialise", lambda df, keep=graph.materialise: ran(df) and keep(df))
    ran(queries.QUERIES["pair_consistency"](spark, small))
    assert len(plans) > 4 and not [p for p in plans if re.search(r"BroadcastHashJoin \[sample_id#\d+, ", p)]
    assert [p for p in plans if re.search(r"SortMergeJoin \[sample_id#\d+, sx#", p)]
