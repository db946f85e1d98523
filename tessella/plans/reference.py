"""Queries over the operators of spatial and expression analysis, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.expression import expression_rows
from tessella.functions.identifiers import clean_id, gene_name
from tessella.operators import graph, labels, points, quality, reliability, summaries
from tessella.plans.base import CELLS, CLUSTERED, EXPRESSION, KNN, cells, clustered, genes, positioned, with_
from tessella.session import materialise
from tessella.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _features(spark: SparkSession, folder: str) -> DataFrame:
    """All features with a finite raw count, each cell and feature once."""
    e = table(spark, folder, "expr").select(clean_id("cell_id").alias("cell_id"), gene_name("gene").alias("gene"), "raw", "sample_id")
    return e.filter("cell_id is not null and raw is not null and not isnan(raw) and abs(raw) < double('inf')").groupBy("cell_id", "gene").agg(F.max("raw").alias("raw"), F.max("sample_id").alias("sample_id"))


_FEATURES = "f AS (SELECT cell_id, gene, class, max(raw) AS raw, max(sample_id) AS sample_id FROM classed WHERE isfinite(raw) GROUP BY 1, 2, 3)"
GENES = ("XPAZ14B", "GLIT20", "PQUG30A", "RWAN14L", "PXIX31L", "NQOR39L", "GBIK39", "QLUV32", "ZJUF8")
RULES = {"alpha": GENES[0:3], "beta": GENES[3:6], "gamma": GENES[6:9]}
_RULES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{k}', {0.5 if g == GENES[0] else 1.0})" for k, v in RULES.items() for g in v) + ") t(gene, label, w))"
WEIGHTS = {GENES[0]: 0.5}
KEYWORDS = (("fibroblast", "stromal"), ("pericyte", "stromal"), ("plasma", "lymphoid"), ("nkcell", "lymphoid"), ("helper", "lymphoid"), ("endothelium", "endothelial"), ("keratinocyte", "epithelial"), ("cell", "other"))
_KEYWORDS = "CASE " + " ".join(f"WHEN contains(cell_type, '{k}') THEN '{v}'" for k, v in KEYWORDS) + " ELSE '' END"
CLAIMS = {"fibroblast": "alpha", "goblet": "beta", "cell": "gamma"}


# --- ingestion, quality, features -------------------------------------------------------------


@query(with_(CELLS) + """SELECT count(*) AS records, count(*) FILTER (NOT coalesce(isfinite(x) AND isfinite(y), false)) AS bad_positions,
  count(*) FILTER (isfinite(x) AND isfinite(y)) - count(DISTINCT CASE WHEN isfinite(x) AND isfinite(y) THEN (x, y) END) AS duplicate_positions,
  coalesce(min(x) FILTER (isfinite(x) AND isfinite(y)), 0.0) AS x_min, coalesce(max(x) FILTER (isfinite(x) AND isfinite(y)), 0.0) AS x_max,
  coalesce(min(y) FILTER (isfinite(x) AND isfinite(y)), 0.0) AS y_min, coalesce(max(y) FILTER (isfinite(x) AND isfinite(y)), 0.0) AS y_max FROM cells""")
def ingestion_qc(spark: SparkSession, folder: str) -> DataFrame:
    return quality.ingestion_qc(cells(spark, folder))


@query(with_(EXPRESSION, _FEATURES) + """, t AS (SELECT *, sum(CASE WHEN class = 'expression' THEN greatest(raw, 0) ELSE 0 END) OVER (PARTITION BY cell_id) AS t FROM f)
SELECT cell_id, gene, round_even(CASE WHEN class = 'expression' AND t > 0 THEN ln(1 + greatest(raw, 0) / t * 10000) ELSE raw END, 6) AS value FROM t""")
def normalise(spark: SparkSession, folder: str) -> DataFrame:
    return quality.normalise(_features(spark, folder)).select("cell_id", "gene", F.bround("value", 6).alias("value"))


@query(with_(EXPRESSION, _FEATURES) + """, c AS (SELECT cell_id, coalesce(sum(raw) FILTER (gene = 'TRANSCRIPT_COUNTS'), 0) AS t, coalesce(sum(raw) FILTER (gene = 'TOTAL_COUNTS'), 0) AS n,
  coalesce(sum(raw) FILTER (gene IN ('CONTROL_PROBE_COUNTS', 'CONTROL_CODEWORD_COUNTS', 'UNASSIGNED_CODEWORD_COUNTS')), 0) AS b FROM f GROUP BY 1)
SELECT cell_id, CASE WHEN t < 10 THEN 'low_transcripts' WHEN b / nullif(CASE WHEN n > 0 THEN n ELSE t + b END, 0) > 0.05 THEN 'high_background' ELSE 'kept' END AS verdict FROM c""")
def cell_qc(spark: SparkSession, folder: str) -> DataFrame:
    return quality.cell_qc(_features(spark, folder))


@query(with_(EXPRESSION) + ", c AS (SELECT cell_id, sum(raw) AS counts, count(DISTINCT gene) AS genes FROM e GROUP BY 1) SELECT cell_id, round_even(counts, 6) AS counts, genes FROM c WHERE (counts >= 300 AND genes >= 15) OR NOT EXISTS (SELECT 1 FROM c WHERE counts >= 300 AND genes >= 15)")
def threshold_qc(spark: SparkSession, folder: str) -> DataFrame:
    return quality.threshold_qc(genes(spark, folder), min_counts=300, min_genes=15).withColumn("counts", F.bround("counts", 6))


@query(with_(EXPRESSION) + """SELECT gene, class, starts_with(gene, 'MT-') AS mitochondrial, count(*) AS "rows" FROM classed WHERE gene IS NOT NULL GROUP BY 1, 2, 3""")
def feature_classes(spark: SparkSession, folder: str) -> DataFrame:
    return quality.feature_classes(table(spark, folder, "expr").select(gene_name("gene").alias("gene")).filter("gene is not null"))


@query(with_(EXPRESSION) + "SELECT gene FROM e GROUP BY 1 HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM e)")
def gene_intersection(spark: SparkSession, folder: str) -> DataFrame:
    return quality.gene_intersection(genes(spark, folder))


@query(with_(CELLS) + """, n AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS p, count(*) OVER () AS n FROM cells)
SELECT cell_id FROM n WHERE p IN (SELECT CAST(round_even(i * ((SELECT max(n) FROM n) - 1.0::DOUBLE) / 49, 0) AS BIGINT) FROM range(50) t(i))""")
def even_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quality.even_sample(cells(spark, folder).select("cell_id"), "cell_id", 50)


@query(with_(CELLS) + """, t AS (SELECT cell_id, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY md5('0|' || cell_id), cell_id) AS turn FROM cells WHERE cell_type IS NOT NULL)
SELECT cell_id, cell_type, CAST(turn AS INTEGER) AS turn FROM t ORDER BY t.turn, cell_type LIMIT 200""")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quality.stratified_sample(cells(spark, folder).select("cell_id", "cell_type"), "cell_type", "cell_id", 200)


@query(with_(CELLS) + """, b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM pos),
d AS (SELECT cell_id, CAST(least(4, floor((x - x0) / greatest(x1 - x0, 1e-9) * 5)) AS INTEGER) AS bx, CAST(least(4, floor((y - y0) / greatest(y1 - y0, 1e-9) * 5)) AS INTEGER) AS "by" FROM pos, b),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY bx, "by" ORDER BY cell_id) AS INTEGER) AS depth FROM d)
SELECT cell_id, bx, "by", depth FROM r ORDER BY depth, bx, "by" LIMIT 100""")
def display_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quality.display_sample(cells(spark, folder), 100)


@query(with_(EXPRESSION) + ", t AS (SELECT cell_id, gene, value, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene) AS rank FROM e WHERE value > 0) SELECT cell_id, gene, value, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 5")
def top_features(spark: SparkSession, folder: str) -> DataFrame:
    return quality.top_features(genes(spark, folder), 5)


@query(with_(CELLS) + "SELECT cell_id, CAST(((floor((x + y) / 60)::BIGINT % 2) + 2) % 2 AS INTEGER) AS stripe FROM pos WHERE x BETWEEN -1000 AND 1000 AND y BETWEEN -1000 AND 1000")
def rectangle_stripes(spark: SparkSession, folder: str) -> DataFrame:
    return positioned(spark, folder).filter(quality.in_rectangle(1000, 1000, -1000, -1000)).select("cell_id", quality.stripe().alias("stripe"))


@query(with_(CELLS) + "SELECT sample_id, round_even(avg((cell_type IS NULL)::INT), 4) AS unassigned FROM cells GROUP BY 1")
def unassigned_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unassigned_fraction(cells(spark, folder))


@query(with_(EXPRESSION) + f"SELECT round_even(count(DISTINCT gene) FILTER (gene IN {GENES + ('CD3D',)}) / 10.0::DOUBLE, 4) AS overlap FROM e")
def panel_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return quality.panel_overlap(genes(spark, folder), [*GENES, "CD3D"])


@query(with_(EXPRESSION) + """, c AS (SELECT cell_id, sum(raw) AS t, count(DISTINCT gene) AS g FROM e GROUP BY 1)
SELECT count(*) AS cells, round_even(avg(t), 6) AS mean_counts, round_even(median(t), 6) AS median_counts, round_even(min(t), 6) AS min_counts,
  round_even(avg(g), 6) AS mean_genes, round_even(CAST(median(g) AS DOUBLE), 6) AS median_genes, min(g) AS min_genes FROM c""")
def expression_totals(spark: SparkSession, folder: str) -> DataFrame:
    return quality.expression_totals(genes(spark, folder))


# --- labels -----------------------------------------------------------------------------------

_DOMINANT = f"""{_RULES}, s AS (SELECT cell_id, label, sum(value * w) AS score FROM e JOIN r USING (gene) WHERE value > 0 GROUP BY 1, 2),
dom AS (SELECT cell_id, label, score, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY cell_id ORDER BY score DESC, label DESC)),
seen AS (SELECT cell_id, label, round_even(score, 6) AS score FROM dom WHERE n = 1 AND score >= 2 AND (second IS NULL OR score >= second * 1.5))"""


@query(with_(EXPRESSION, _DOMINANT) + "SELECT cell_id, label, score FROM seen")
def marker_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels.dominant_label(genes(spark, folder), RULES, WEIGHTS)


@query(with_(CELLS) + f"SELECT cell_id, CASE WHEN cell_type IS NULL THEN '' ELSE {_KEYWORDS} END AS lineage FROM cells")
def label_lineages(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).select("cell_id", labels.label_lineage(F.col("cell_type"), KEYWORDS).alias("lineage"))


_CLAIM = "CASE " + " ".join(f"WHEN contains(cell_type, '{k}') THEN '{v}'" for k, v in CLAIMS.items()) + " ELSE '' END"


@query(with_(CELLS, EXPRESSION, _DOMINANT) + f""", j AS (SELECT cell_type AS label, {_CLAIM} AS claimed, coalesce(seen.label, '') AS lineage FROM cells LEFT JOIN seen USING (cell_id) WHERE cell_type IS NOT NULL),
p AS (SELECT label, claimed, lineage, count(*) AS n, count(*) FILTER (claimed <> '' AND lineage <> '' AND claimed <> lineage) AS c FROM j GROUP BY 1, 2, 3),
a AS (SELECT label, claimed, CAST(sum(n) AS BIGINT) AS cells, CAST(coalesce(sum(n) FILTER (lineage <> ''), 0) AS BIGINT) AS assessed, CAST(sum(c) AS BIGINT) AS conflicting,
  coalesce((list(lineage ORDER BY n DESC, lineage) FILTER (lineage <> ''))[1], '') AS dominant FROM p GROUP BY 1, 2),
b AS (SELECT *, coalesce(round_even(conflicting / nullif(assessed, 0), 4), 0.0) AS share FROM a)
SELECT *, assessed > 0 AND share >= 0.15 AND claimed <> '' AS flagged FROM b""")
def label_audit(spark: SparkSession, folder: str) -> DataFrame:
    c = cells(spark, folder).select("cell_id", F.col("cell_type").alias("label"), labels.label_lineage(F.col("cell_type"), tuple(CLAIMS.items())).alias("claimed"))
    seen = labels.dominant_label(genes(spark, folder), RULES, WEIGHTS).select("cell_id", F.col("label").alias("lineage"))
    return labels.label_audit(c, seen)


@query(with_(CELLS) + f""", l AS (SELECT CASE WHEN cell_type IS NULL THEN '' ELSE {_KEYWORDS} END AS lineage FROM cells)
SELECT lineage, count(*) AS n, count(*) >= (SELECT greatest(25, ceil(count(*) * 0.002)) FROM l) AS present FROM l WHERE lineage <> '' GROUP BY 1""")
def lineage_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return labels.lineage_coverage(label_lineages(spark, folder))


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "training_records")
    return r.select(
        F.col("record_id").alias("cell_id"), F.col("label_status").alias("review_status"), F.col("record_type").alias("expert_label"), F.col("sample_id").alias("reviewer_id"),
        F.col("dataset_path").alias("evidence_ref"), F.col("created_at").cast("string").alias("reviewed_at"), F.col("score").cast("string").alias("confidence"),
    )


@query("""SELECT record_id AS cell_id, list_filter([CASE WHEN lower(trim(coalesce(label_status, ''))) NOT IN ('reviewed', 'approved') THEN 'not_approved' END,
  CASE WHEN lower(trim(coalesce(record_type, ''))) IN ('', 'unknown', 'uncertain', 'unreviewed', 'unlabeled', 'unannotated', 'unknown cell', 'unannotated cell', 'unlabeled cell') THEN 'unresolved_identity' END,
  CASE WHEN trim(coalesce(sample_id, '')) = '' OR starts_with(lower(trim(sample_id)), 'unidentified') THEN 'missing_reviewer' END,
  CASE WHEN trim(coalesce(dataset_path, '')) = '' THEN 'missing_evidence' END, CASE WHEN created_at IS NULL THEN 'invalid_reviewed_at' END,
  CASE WHEN score IS NULL OR isnan(score) OR score < 0 OR score > 1 THEN 'invalid_confidence' END,
  CASE WHEN count(*) OVER (PARTITION BY record_id) > 1 THEN 'missing_or_duplicate_cell_id' END], lambda x: x IS NOT NULL) AS issues FROM training_records""")
def review_issues(spark: SparkSession, folder: str) -> DataFrame:
    return labels.review_issues(_reviews(spark, folder))


@query(with_(CELLS) + "SELECT cell_id, cell_type, region FROM cells c WHERE EXISTS (SELECT 1 FROM spots s WHERE s.cell_id = c.cell_id AND s.region = c.region AND regexp_replace(lower(s.cell_type), '[^\\p{L}\\p{N}+]', '', 'g') = c.cell_type AND s.ingested_at - s.acquired_at > INTERVAL 25 MINUTE)")
def reviewed_view(spark: SparkSession, folder: str) -> DataFrame:
    c = cells(spark, folder).select("cell_id", "cell_type", "region")
    from tessella.functions.identifiers import type_key

    s = table(spark, folder, "spots").filter(F.col("ingested_at") - F.col("acquired_at") > F.expr("INTERVAL 25 MINUTE")).select(clean_id("cell_id").alias("cell_id"), type_key("cell_type").alias("cell_type"), "region").distinct()
    return labels.reviewed_view(c, s, ["cell_type", "region"])


@query(with_(CELLS, CLUSTERED) + "SELECT c.sample_id, count(*) AS cells, count(i.cell_id) AS matched, round_even(avg((i.cell_id IS NOT NULL)::INT), 4) AS coverage FROM cells c LEFT JOIN idx i USING (cell_id) GROUP BY 1")
def label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    new = clustered(spark, folder).select("cell_id", F.col("cluster").alias("cell_type"))
    return labels.label_coverage(labels.apply_labels(cells(spark, folder), new))


@query(with_(CELLS, CLUSTERED) + "SELECT cell_id, sample_id FROM cells ANTI JOIN idx USING (cell_id)")
def unmatched_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).join(clustered(spark, folder), "cell_id", "left_anti").select("cell_id", "sample_id")


# --- summaries --------------------------------------------------------------------------------


@query(with_(CELLS) + "SELECT sample_id, cell_type, count(*) AS n FROM cells GROUP BY 1, 2")
def cell_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.counts(cells(spark, folder), "sample_id", "cell_type")


@query(with_(CELLS) + "SELECT sample_id, cell_type, count(*) AS n, round_even(avg(x), 8) AS x_mean, round_even(avg(y), 8) AS y_mean FROM pos GROUP BY 1, 2")
def cell_type_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.centroids(positioned(spark, folder), "sample_id", "cell_type", digits=8)


@query(with_(CELLS, EXPRESSION) + """, n AS (SELECT count(*) AS n FROM cells)
SELECT gene, round_even(sum(value) / any_value(n), 5) AS mean, round_even(max(value), 5) AS max, round_even(CASE WHEN count(*) < any_value(n) THEN least(min(value), 0.0) ELSE min(value) END, 5) AS min, count(*) FILTER (value > 0) AS positive FROM e, n GROUP BY 1""")
def gene_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.gene_summary(genes(spark, folder), cells(spark, folder))


@query(with_(CELLS, EXPRESSION) + """, c AS (SELECT cell_id, coalesce(region, 'unassigned') AS region FROM cells), k AS (SELECT region, count(*) AS cell_count FROM c GROUP BY 1),
g AS (SELECT region, gene, round_even(sum(value), 6) AS s FROM e JOIN c USING (cell_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY s DESC, gene) AS rank FROM g)
SELECT region, cell_count, cell_count >= 50 AS reliable, gene, CAST(rank AS INTEGER) AS rank, round_even(s / cell_count, 5) AS mean FROM r JOIN k USING (region) WHERE rank <= 8""")
def region_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.region_summary(cells(spark, folder), genes(spark, folder))


@query(with_(CELLS) + "SELECT region, cell_type, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY region), 4) AS fraction FROM (SELECT coalesce(region, 'unassigned') AS region, cell_type FROM cells) GROUP BY 1, 2")
def region_composition(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.composition(cells(spark, folder).withColumn("region", F.coalesce("region", F.lit("unassigned"))), "region")


_TWO = "two AS (SELECT min(sample_id) AS a, max(sample_id) AS b FROM cells)"


@query(with_(CELLS, _TWO) + """, t AS (SELECT coalesce(cell_type, '') AS cell_type, count(*) FILTER (sample_id = a) AS na, count(*) FILTER (sample_id = b) AS nb FROM cells, two WHERE sample_id IN (a, b) GROUP BY 1)
SELECT cell_type, round_even(nb / greatest(sum(nb) OVER (), 1) - na / greatest(sum(na) OVER (), 1), 6) AS delta FROM t""")
def composition_delta(spark: SparkSession, folder: str) -> DataFrame:
    c = cells(spark, folder).fillna({"cell_type": ""})
    two = c.agg(F.min("sample_id").alias("a"), F.max("sample_id").alias("b")).first()  # one row
    return summaries.composition_delta(c, two.a, two.b)


@query(with_(CELLS) + 'SELECT sample_id, cell_type, floor(x / 50)::BIGINT AS bx, floor(y / 50)::BIGINT AS "by", count(*) AS n FROM pos GROUP BY 1, 2, 3, 4')
def type_densities(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.densities(positioned(spark, folder), 50.0, "sample_id", "cell_type")


_PEARSON = "round_even(coalesce((k * ab - sa * sb) / sqrt(nullif((k * aa - sa * sa) * (k * bb - sb * sb), 0)), 0), {d})"


@query(with_(CELLS) + """, n AS (SELECT sample_id, floor(x / 100) AS bx, floor(y / 100) AS b_y, count(*) FILTER (cell_type = 'fibroblast')::DOUBLE AS na, count(*) FILTER (cell_type = 'gobletcell')::DOUBLE AS nb FROM pos WHERE cell_type IN ('fibroblast', 'gobletcell') GROUP BY 1, 2, 3),
s AS (SELECT sample_id, count(*) AS k, sum(na) AS sa, sum(nb) AS sb, sum(na * nb) AS ab, sum(na * na) AS aa, sum(nb * nb) AS bb FROM n GROUP BY 1)
SELECT sample_id, k AS bins, """ + _PEARSON.format(d=4) + " AS pearson FROM s")
def colocalisation(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.colocalisation(positioned(spark, folder), "fibroblast", "gobletcell", 100.0)


@query(with_(CELLS) + """, n AS (SELECT floor(x / 200)::BIGINT::VARCHAR || '_' || floor(y / 200)::BIGINT::VARCHAR AS key, count(*) FILTER (cell_type = 'fibroblast')::DOUBLE AS na, count(*) FILTER (cell_type = 'gobletcell')::DOUBLE AS nb FROM pos WHERE cell_type IN ('fibroblast', 'gobletcell') GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY key) AS rn FROM n), p AS (SELECT o.*, perm FROM o, range(0, 100) t(perm)),
q AS (SELECT *, row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm = 0 THEN key ELSE md5('0|' || perm || '|' || key) END, key) AS rb FROM p),
j AS (SELECT a.perm, a.na, b.nb FROM q a JOIN q b ON a.perm = b.perm AND a.rn = b.rb),
s AS (SELECT perm, count(*) AS k, sum(na) AS sa, sum(nb) AS sb, sum(na * nb) AS ab, sum(na * na) AS aa, sum(nb * nb) AS bb FROM j GROUP BY 1), r AS (SELECT perm, k, """ + _PEARSON.format(d=9) + """ AS r FROM s)
SELECT z.k AS bins, round_even(z.r, 4) AS pearson, ((count(*) FILTER (r.perm > 0 AND abs(r.r) >= abs(z.r))) + 1) / 100.0::DOUBLE AS p FROM r, (SELECT * FROM r WHERE perm = 0) z GROUP BY z.k, z.r""")
def colocalisation_p(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.colocalisation_p(positioned(spark, folder), "fibroblast", "gobletcell", 200.0, perms=99)


_TYPED = "g AS (SELECT cell_id, cell_type AS label FROM cells)"


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).select("cell_id", F.col("cell_type").alias("label"))


@query(with_(CELLS, EXPRESSION, _TYPED) + """, k AS (SELECT count(*) FILTER (label = 'fibroblast') AS ka, count(*) FILTER (label = 'gobletcell') AS kb FROM g)
SELECT gene, round_even(sum(CASE WHEN label = 'fibroblast' THEN value ELSE 0 END) / any_value(ka) - sum(CASE WHEN label = 'gobletcell' THEN value ELSE 0 END) / any_value(kb), 4) AS difference FROM e JOIN g USING (cell_id), k WHERE label IN ('fibroblast', 'gobletcell') GROUP BY 1""")
def mean_difference(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.mean_difference(genes(spark, folder), _typed(spark, folder), "fibroblast", "gobletcell")


_REST = """n AS (SELECT count(*) AS n FROM g), k AS (SELECT label, count(*) AS k FROM g WHERE label IS NOT NULL GROUP BY 1), s AS (SELECT label, gene, sum(value) AS s FROM e JOIN g USING (cell_id) GROUP BY 1, 2), w AS (SELECT gene, sum(s) AS t FROM s GROUP BY 1),
d AS (SELECT label, gene, round_even(coalesce(s / k - (t - s) / nullif(n - k, 0), s / k), 4) AS difference FROM s JOIN w USING (gene) JOIN k USING (label), n),
ovr AS (SELECT label, gene, CAST(row_number() OVER (PARTITION BY label ORDER BY difference DESC, gene) AS INTEGER) AS rank, difference FROM d)"""


@query(with_(CELLS, EXPRESSION, _TYPED, _REST) + "SELECT * FROM ovr WHERE rank <= 10")
def one_vs_rest(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.one_vs_rest(genes(spark, folder), _typed(spark, folder))


@query(with_(CELLS, EXPRESSION, _TYPED, _REST) + """, m AS (SELECT label, gene FROM ovr WHERE rank <= 10), z AS (SELECT label, count(*) AS k FROM m GROUP BY 1),
b AS (SELECT a.label, o.label AS other, count(*) AS both_ FROM m a JOIN m o ON a.gene = o.gene AND a.label < o.label GROUP BY 1, 2)
SELECT b.label, other, round_even(both_ / (z.k + y.k - both_), 4) AS jaccard, round_even(both_ / (z.k + y.k - both_), 4) >= 0.34 AS flagged FROM b JOIN z ON z.label = b.label JOIN z y ON y.label = other""")
def marker_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.marker_jaccard(one_vs_rest(spark, folder))


@query(with_(CELLS, EXPRESSION) + """, n AS (SELECT count(*) AS n FROM cells), v AS (SELECT gene, round_even(sum(value * value) / any_value(n) - (sum(value) / any_value(n)) * (sum(value) / any_value(n)), 6) AS variance FROM e, n GROUP BY 1),
r AS (SELECT gene, variance, CAST(row_number() OVER (ORDER BY variance DESC, gene) AS INTEGER) AS rank FROM v) SELECT * FROM r WHERE rank <= 20""")
def variance_rank(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.variance_rank(genes(spark, folder), cells(spark, folder))


@query(with_(CELLS, EXPRESSION) + """, k AS (SELECT cell_type AS label, count(*) AS k FROM cells WHERE cell_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 3), c AS (SELECT cell_id, cell_type AS label FROM cells WHERE cell_type IN (SELECT label FROM k)), n AS (SELECT count(*) AS n FROM c),
v AS (SELECT gene, label, round_even(value, 9) AS value FROM e JOIN c USING (cell_id) WHERE value > 0),
p AS (SELECT gene, count(*) AS pos, sum(exp(value) - 1) AS all_e FROM v GROUP BY 1),
r AS (SELECT v.gene, label, value, rank() OVER (PARTITION BY v.gene ORDER BY value) + (count(*) OVER (PARTITION BY v.gene, value) - 1) / 2.0::DOUBLE AS r FROM v),
s AS (SELECT gene, label, sum(r + n - pos) AS rs, count(*) AS np, sum(exp(value) - 1) AS ex, any_value(pos) AS pos, any_value(n) AS n, any_value(all_e) AS all_e FROM r JOIN p USING (gene), n GROUP BY 1, 2)
SELECT label, gene, k, round_even((rs + (k - np) * (n - pos + 1) / 2.0::DOUBLE - k * (n + 1) / 2.0::DOUBLE) / sqrt(k * nullif(n - k, 0) * (n + 1) / 12.0::DOUBLE), 6) AS z, round_even(log2((ex / k + 1e-9) / (CASE WHEN np = pos THEN 0 ELSE all_e - ex END / nullif(n - k, 0) + 1e-9)), 4) AS log_fold FROM s JOIN k USING (label)""")
def rank_sums(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.rank_sums(genes(spark, folder), _typed(spark, folder))


@query("""SELECT r_name AS condition, count(DISTINCT c_nationkey) AS sections, count(DISTINCT c_custkey) AS donors, 0::BIGINT AS unknown, count(DISTINCT c_nationkey) >= 2 AND count(DISTINCT c_custkey) >= 2 AS replicated
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def replication(spark: SparkSession, folder: str) -> DataFrame:
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    s = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("condition"), F.col("c_nationkey").alias("section_id"), F.col("c_custkey").alias("donor_id"))
    return summaries.replication(s)


@query(with_(CLUSTERED) + """, c AS (SELECT sample_id, cluster, count(*) AS n FROM idx GROUP BY 1, 2), f AS (SELECT *, n / sum(n) OVER (PARTITION BY sample_id) AS f FROM c)
SELECT sample_id, cluster, n, round_even(f, 6) AS fraction, CASE WHEN n < 100 OR f < 0.005 THEN 'low' ELSE 'ok' END AS confidence FROM f""")
def cluster_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.cluster_confidence(clustered(spark, folder))


_LABELLED = "lab AS (SELECT i.sample_id, i.cluster, c.cell_type AS label FROM idx i JOIN cells c USING (cell_id) WHERE c.cell_type IS NOT NULL)"
_CONSENSUS = """cc AS (SELECT sample_id, cluster, label, count(*) AS n FROM lab GROUP BY 1, 2, 3), cw AS (SELECT *, sum(n) OVER (PARTITION BY sample_id, cluster) AS t, lead(label) OVER w AS runner_up, row_number() OVER w AS r FROM cc WINDOW w AS (PARTITION BY sample_id, cluster ORDER BY n DESC, label)),
con AS (SELECT sample_id, cluster, label AS top_label, round_even(n / t, 4) AS share, runner_up, n / t > 0.5 AS consensus, 1 - n / t >= 0.15 AS disagreement FROM cw WHERE r = 1)"""


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    c = cells(spark, folder).filter("cell_type is not null").select("cell_id", F.col("cell_type").alias("label"))
    return clustered(spark, folder).join(c, "cell_id")


@query(with_(CELLS, CLUSTERED, _LABELLED, _CONSENSUS) + "SELECT * FROM con")
def cluster_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.cluster_consensus(_labelled(spark, folder))


_JUDGED = "j AS (SELECT label AS truth, top_label AS predicted FROM lab JOIN con USING (sample_id, cluster))"


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder)
    return rows.join(summaries.cluster_consensus(rows), ["sample_id", "cluster"]).select(F.col("label").alias("truth"), F.col("top_label").alias("predicted"))


_CLASSES = """t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = predicted) AS tp FROM j GROUP BY 1), s AS (SELECT predicted AS label, count(*) AS said FROM j GROUP BY 1),
q AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM t FULL JOIN s USING (label)),
k AS (SELECT label, support, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM q)"""


@query(with_(CELLS, CLUSTERED, _LABELLED, _CONSENSUS, _JUDGED, _CLASSES) + "SELECT * FROM k")
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.classification(_judged(spark, folder))


@query(with_(CELLS, CLUSTERED, _LABELLED, _CONSENSUS, _JUDGED, _CLASSES) + """SELECT (SELECT round_even(avg((truth = predicted)::INT), 4) FROM j) AS accuracy, round_even(avg(f1), 4) AS macro, round_even(sum(f1 * support) / sum(support), 4) AS weighted, round_even(avg(recall) FILTER (support > 0), 4) AS balanced FROM k""")
def classification_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.classification_summary(_judged(spark, folder))


@query(with_(CELLS, CLUSTERED, _LABELLED) + """, c AS (SELECT cluster, label, count(*) AS n FROM lab GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS ra, sum(n) OVER (PARTITION BY label) AS rb FROM c)
SELECT CAST(sum(n) AS BIGINT) AS n, count(DISTINCT cluster) AS ka, count(DISTINCT label) AS kb, round_even(sqrt(greatest(sum(n * n / (ra * rb::DOUBLE)) - 1, 0) / nullif(least(count(DISTINCT cluster), count(DISTINCT label)) - 1, 0)), 6) AS v FROM m""")
def cramers_v(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.cramers_v(_labelled(spark, folder), "cluster", "label")


@query(with_(CELLS) + """SELECT sample_id, region, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, round_even((max(x) - min(x)) * (max(y) - min(y)), 3) AS area, round_even(avg(x), 1) AS cx, round_even(avg(y), 1) AS cy FROM pos WHERE region IS NOT NULL GROUP BY 1, 2""")
def domain_geometry(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.domain_geometry(positioned(spark, folder).filter("region is not null"), "sample_id", "region")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "training_records").select("score", F.coalesce(F.col("label_status") == "reviewed", F.lit(False)).alias("positive"))


_SCORED = "sc AS (SELECT score, coalesce(label_status = 'reviewed', false) AS positive FROM training_records)"


@query(with_(_SCORED) + """, r AS (SELECT positive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM sc WHERE score IS NOT NULL),
s AS (SELECT sum(r) FILTER (positive) AS rs, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM r) SELECT round_even(coalesce((rs - p * (p + 1) / 2.0::DOUBLE) / nullif(p * n, 0), 0), 4) AS auroc FROM s""")
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.auroc(_scored(spark, folder))


@query(with_(_SCORED) + "SELECT CAST(least(9, floor(score * 10)) AS INTEGER) AS bin, count(*) AS n, round_even(avg(score), 6) AS confidence, round_even(avg(positive::INT), 6) AS observed FROM sc WHERE score BETWEEN 0 AND 1 GROUP BY 1")
def calibration_bins(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.calibration_bins(_scored(spark, folder))


@query(with_(_SCORED) + ", b AS (SELECT least(9, floor(score * 10)) AS bin, count(*) AS n, sum(score) AS s, sum(positive::INT) AS p, sum((score - positive::INT) * (score - positive::INT)) AS q FROM sc WHERE score BETWEEN 0 AND 1 GROUP BY 1) SELECT round_even(sum(abs(s - p)) / sum(n), 4) AS ece, round_even(sum(q) / sum(n), 4) AS brier FROM b")
def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.calibration_error(_scored(spark, folder))


@query("""WITH s AS (SELECT trim(sample_id) AS sample_id, trim(cluster, ' "') AS name, count(DISTINCT trim(cell_id, ' "')) AS n FROM cell_index GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY sample_id) AS t FROM s), u AS (SELECT sample_id, name, n, t, CAST(coalesce(sum(n) OVER (PARTITION BY sample_id ORDER BY n DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM t
 WHERE lower(coalesce(name, '')) NOT IN ('', 'unassigned', 'none', 'nan', 'na', '-1', 'unclustered')) SELECT sample_id, name, n, before FROM u WHERE before / t < 0.7""")
def coverage_decisions(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "cell_index").select(F.btrim("sample_id").alias("sample_id"), F.btrim("cluster", F.lit(' "')).alias("name"), clean_id("cell_id").alias("c"))
    return summaries.coverage_decisions(s.groupBy("sample_id", "name").agg(F.count_distinct("c").alias("n")))


@query("""WITH i AS (SELECT DISTINCT record_id FROM training_records), c AS (SELECT record_id, list_sum(list_transform(string_split(record_id, ''), lambda c: ascii(c))) % 10 AS m FROM i),
s AS (SELECT record_id, CASE WHEN m < 7 THEN 'train' WHEN m < 9 THEN 'validation' ELSE 'test' END AS split FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY record_id) AS n FROM s) SELECT record_id, split FROM r WHERE n <= 100""")
def char_split(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.char_split(table(spark, folder, "training_records"), "record_id")


@query(with_(CELLS) + """, d AS (SELECT sample_id, floor(x / 100)::BIGINT AS bx, floor(y / 100)::BIGINT AS "by", count(*) AS n FROM pos GROUP BY 1, 2, 3),
h AS (SELECT *, concat('0x', substr(sha256('0|' || sample_id || '|' || bx || '|' || "by"), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM d) SELECT sample_id, bx, "by", n, CASE WHEN h < 0.6 THEN 'train' WHEN h < 0.8 THEN 'validation' ELSE 'test' END AS split FROM h""")
def block_split(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.block_split(positioned(spark, folder), 100.0)


@query(with_(CELLS, CLUSTERED, EXPRESSION, _DOMINANT) + """, t AS (SELECT cell_id, sum(raw) AS t FROM e GROUP BY 1), f AS (SELECT c.cell_id, c.cell_type, coalesce(t.t < 200, true) AS high, seen.label IS NULL AS lineage_absent, i.cell_id IS NULL AS distant, coalesce(seen.score / 20, 0) AS confidence FROM cells c LEFT JOIN t USING (cell_id) LEFT JOIN seen USING (cell_id) LEFT JOIN idx i USING (cell_id))
SELECT cell_id, 6 * high::INT + 5 * lineage_absent::INT + 3 * distant::INT + 3 * (confidence < 0.6)::INT + (cell_type IS NULL)::INT AS priority,
 concat_ws(';', CASE WHEN high THEN 'high_priority' END, CASE WHEN lineage_absent THEN 'lineage_absent' END, CASE WHEN distant THEN 'distant' END, CASE WHEN confidence < 0.6 THEN 'low_confidence' END, CASE WHEN cell_type IS NULL THEN 'unannotated' END) AS reasons FROM f""")
def evidence_priority(spark: SparkSession, folder: str) -> DataFrame:
    e = genes(spark, folder)
    t = e.groupBy("cell_id").agg(F.sum("raw").alias("t"))
    seen = labels.dominant_label(e, RULES, WEIGHTS).withColumnRenamed("label", "seen")
    idx = clustered(spark, folder).select("cell_id", F.lit(True).alias("in_index"))
    f = cells(spark, folder).join(t, "cell_id", "left").join(seen, "cell_id", "left").join(idx, "cell_id", "left")
    return summaries.evidence_priority(f.select(
        "cell_id", F.coalesce(F.col("t") < 200, F.lit(True)).alias("high"), F.lit(False).alias("marker_conflict"), F.col("seen").isNull().alias("lineage_absent"),
        F.col("in_index").isNull().alias("distant"), F.coalesce(F.col("score") / 20, F.lit(0.0)).alias("confidence"), F.col("cell_type").alias("label"),
    ))


# --- neighbour graphs -------------------------------------------------------------------------


@query(with_(CELLS) + """SELECT a.sample_id, a.cell_id AS src, b.cell_id AS dst, round_even(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM pos a JOIN pos b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 324.0000001""")
def radius_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.radius_edges(positioned(spark, folder), 18.0).withColumn("distance", F.bround("distance", 6))


@query(with_(CELLS, KNN) + "SELECT sample_id, src, dst, round_even(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM knn")
def knn_graph(spark: SparkSession, folder: str) -> DataFrame:
    return graph.knn_edges(positioned(spark, folder), 6).withColumn("d2", F.bround("d2", 6))


@query(with_(CELLS) + """, d AS (SELECT a.sample_id, a.cell_type AS l, a.cell_id, min(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS d FROM pos a JOIN pos b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id AND ((a.cell_type = 'fibroblast' AND b.cell_type = 'gobletcell') OR (a.cell_type = 'gobletcell' AND b.cell_type = 'fibroblast')) GROUP BY 1, 2, 3),
m AS (SELECT sample_id, l, median(d) AS d FROM d GROUP BY 1, 2) SELECT sample_id, round_even(sum(d) / 2, 4) AS distance FROM m GROUP BY 1 HAVING count(*) = 2""")
def group_nn_distance(spark: SparkSession, folder: str) -> DataFrame:
    return graph.nearest_group_distance(positioned(spark, folder), "fibroblast", "gobletcell")


@query(with_(CELLS) + """SELECT a.sample_id, least(a.cell_type, b.cell_type) AS a, greatest(a.cell_type, b.cell_type) AS b, count(*) AS n FROM pos a JOIN pos b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id WHERE a.cell_type IS NOT NULL AND b.cell_type IS NOT NULL AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 324.0000001 GROUP BY 1, 2, 3""")
def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = positioned(spark, folder)
    return graph.label_pairs(graph.radius_edges(c, 18.0), c)


_ENRICH = """o AS (SELECT sample_id, cell_id, cell_type AS v, row_number() OVER (PARTITION BY sample_id ORDER BY cell_id) AS rn FROM pos WHERE cell_type IS NOT NULL), p AS (SELECT o.*, perm FROM o, range(0, 21) t(perm)),
q AS (SELECT *, row_number() OVER (PARTITION BY perm, sample_id ORDER BY CASE WHEN perm = 0 THEN cell_id ELSE md5('0|' || perm || '|' || cell_id) END, cell_id) AS rb FROM p),
lab AS (SELECT a.perm, a.sample_id, a.cell_id, b.v FROM q a JOIN q b ON a.perm = b.perm AND a.sample_id = b.sample_id AND a.rn = b.rb),
n AS (SELECT k.sample_id, s.perm, least(s.v, d.v) AS a, greatest(s.v, d.v) AS b, count(*) AS n FROM knn k JOIN lab s ON s.cell_id = k.src JOIN lab d ON d.cell_id = k.dst AND d.perm = s.perm GROUP BY 1, 2, 3, 4),
g AS (SELECT sample_id, a, b, coalesce(max(n) FILTER (perm = 0), 0) AS o, sum(CASE WHEN perm > 0 THEN n ELSE 0 END) / 20 AS m, sum(CASE WHEN perm > 0 THEN n * n ELSE 0 END) / 20 AS q FROM n GROUP BY 1, 2, 3),
enr AS (SELECT sample_id, a, b, o AS n, round_even((o - m) / sqrt(q - m * m), 6) AS z FROM g WHERE q - m * m > 1e-9)"""


@query(with_(CELLS, KNN, _ENRICH) + "SELECT * FROM enr")
def neighbourhood_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    c = positioned(spark, folder)
    return graph.enrichment(graph.knn_edges(c, 6), c)


@query(with_(CELLS, KNN, _ENRICH) + """, pp AS (SELECT a, b, count(*) FILTER (abs(z) >= 2) AS supported, count(*) FILTER (z >= 2) AS pos, count(*) FILTER (z <= -2) AS neg, count(*) AS regions FROM enr GROUP BY 1, 2), f AS (SELECT a, b, regions, supported, round_even(greatest(pos, neg) / nullif(supported, 0), 4) AS agreement FROM pp)
SELECT *, CASE WHEN supported < 2 THEN 'insufficient' WHEN agreement >= 0.8 THEN 'consistent' ELSE 'mixed' END AS status FROM f""")
def pair_consistency(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.region_consistency(neighbourhood_enrichment(spark, folder))


_MORAN = """w AS (SELECT sample_id, src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM knn), cw AS (SELECT dst AS cell_id, sum(w) AS cw FROM w GROUP BY 1), rw AS (SELECT DISTINCT src AS cell_id FROM w), ws AS (SELECT sample_id, count(DISTINCT src)::DOUBLE AS wt FROM w GROUP BY 1), n AS (SELECT sample_id, count(*) AS n FROM pos GROUP BY 1),
m AS (SELECT sample_id, gene, sum(value) / any_value(n) AS m, sum(value * value) AS q, any_value(n) AS n FROM v JOIN n USING (sample_id) GROUP BY 1, 2),
x AS (SELECT a.sample_id, a.gene, sum(w * a.value * b.value) AS x FROM w JOIN v a ON a.cell_id = src JOIN v b ON b.cell_id = dst AND a.gene = b.gene GROUP BY 1, 2),
s AS (SELECT sample_id, gene, sum(value * ((rw.cell_id IS NOT NULL)::INT + coalesce(cw, 0))) AS s FROM v LEFT JOIN rw USING (cell_id) LEFT JOIN cw USING (cell_id) GROUP BY 1, 2)
SELECT sample_id, gene AS {name}, round_even(n / wt * (coalesce(x, 0) - m * s + m * m * wt) / (q - n * m * m), 6) AS i FROM m JOIN s USING (sample_id, gene) JOIN ws USING (sample_id) LEFT JOIN x USING (sample_id, gene) WHERE q - n * m * m > 1e-9"""


@query(with_(CELLS, KNN, EXPRESSION, "v AS (SELECT e.sample_id, cell_id, gene, value FROM e SEMI JOIN pos USING (sample_id, cell_id))", _MORAN.format(name="gene")))
def morans_i(spark: SparkSession, folder: str) -> DataFrame:
    c = positioned(spark, folder)
    return graph.morans_i(graph.knn_edges(c, 6), genes(spark, folder), c)


@query(with_(CELLS, KNN, "v0 AS (SELECT sample_id, cell_id, cell_type AS gene, 1.0::DOUBLE AS value FROM pos WHERE cell_type IS NOT NULL QUALIFY count(*) OVER (PARTITION BY sample_id, cell_type) >= 50), two AS (SELECT sample_id FROM v0 GROUP BY 1 HAVING count(DISTINCT gene) >= 2), v AS (SELECT v0.* FROM v0 JOIN two USING (sample_id))", _MORAN.format(name="label")))
def group_morans(spark: SparkSession, folder: str) -> DataFrame:
    c = positioned(spark, folder)
    return graph.group_morans(graph.knn_edges(c, 6), c)


@query(with_(CELLS, EXPRESSION) + """, n AS (SELECT count(*) AS n FROM cells), g AS (SELECT gene, count(*) AS detected, count(*) >= greatest(10, floor(any_value(n) * 0.01)) AS ok FROM e, n WHERE value > 0 GROUP BY 1) SELECT gene, detected, ok OR (SELECT count(*) FILTER (ok) FROM g) < 2 AS tested FROM g""")
def gene_screen(spark: SparkSession, folder: str) -> DataFrame:
    return graph.gene_screen(genes(spark, folder), cells(spark, folder))


def _z(gene: str, name: str) -> str:
    return f"""{name}0 AS (SELECT p.sample_id, p.cell_id, coalesce(e.value, 0) AS v FROM pos p LEFT JOIN e ON e.cell_id = p.cell_id AND e.gene = '{gene}'), {name}m AS (SELECT sample_id, sum(v) / count(*) AS m, sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 0)) AS sd FROM {name}0 GROUP BY 1),
{name} AS (SELECT sample_id, cell_id, (v - m) / sd AS z FROM {name}0 JOIN {name}m USING (sample_id) WHERE sd > 1e-9)"""


@query(with_(CELLS, KNN, EXPRESSION, _z(GENES[0], "z")) + """, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY cell_id) AS rn FROM z), p AS (SELECT o.*, perm FROM o, range(0, 20) t(perm)),
q AS (SELECT *, row_number() OVER (PARTITION BY perm, sample_id ORDER BY CASE WHEN perm = 0 THEN cell_id ELSE md5('0|' || perm || '|' || cell_id) END, cell_id) AS rb FROM p), sh AS (SELECT a.perm, a.cell_id, b.z AS v FROM q a JOIN q b ON a.perm = b.perm AND a.sample_id = b.sample_id AND a.rn = b.rb),
l AS (SELECT perm, src AS cell_id, avg(v) AS lag FROM knn JOIN sh ON sh.cell_id = dst GROUP BY 1, 2), j AS (SELECT sample_id, l.cell_id, perm, z, lag, z * lag AS i FROM l JOIN z USING (cell_id)),
g AS (SELECT sample_id, cell_id, max(z) AS z, max(lag) FILTER (perm = 0) AS lag, max(i) FILTER (perm = 0) AS i, sum(CASE WHEN perm > 0 THEN i ELSE 0 END) / 19 AS m, sum(CASE WHEN perm > 0 THEN i * i ELSE 0 END) / 19 AS q FROM j GROUP BY 1, 2)
SELECT sample_id, cell_id, round_even(i, 6) AS i, round_even(CASE WHEN sqrt(greatest(q - m * m, 0)) > 1e-9 THEN (i - m) / sqrt(q - m * m) ELSE 0 END, 4) AS zscore,
 CASE WHEN z > 0 AND lag > 0 THEN 'high-high' WHEN z < 0 AND lag < 0 THEN 'low-low' WHEN z > 0 AND lag < 0 THEN 'high-low' WHEN z < 0 AND lag > 0 THEN 'low-high' ELSE 'none' END AS quadrant FROM g""")
def local_morans(spark: SparkSession, folder: str) -> DataFrame:
    c = positioned(spark, folder)
    return graph.lisa(graph.knn_edges(c, 6), c, genes(spark, folder), GENES[0])


@query(with_(CELLS, KNN, EXPRESSION, _z(GENES[0], "za"), _z(GENES[1], "zb")) + """, la AS (SELECT knn.sample_id, src, avg(z) AS l FROM knn JOIN za ON za.cell_id = dst GROUP BY 1, 2), lb AS (SELECT src, avg(z) AS l FROM knn JOIN zb ON zb.cell_id = dst GROUP BY 1),
ll AS (SELECT sample_id, sum(la.l * lb.l) AS ll FROM la JOIN lb USING (src) GROUP BY 1), pz AS (SELECT za.sample_id, sum(za.z * zb.z) AS zz FROM za JOIN zb USING (cell_id) GROUP BY 1), n AS (SELECT sample_id, count(*) AS n FROM pos GROUP BY 1)
SELECT sample_id, round_even(ll / n, 6) AS l, round_even(zz / n, 6) AS pearson, CASE WHEN ll / n > 0.05 THEN 'together' WHEN ll / n < -0.05 THEN 'apart' ELSE 'independent' END AS verdict FROM ll JOIN pz USING (sample_id) JOIN n USING (sample_id)""")
def lees_l(spark: SparkSession, folder: str) -> DataFrame:
    c = positioned(spark, folder)
    return graph.lees_l(graph.knn_edges(c, 6), c, genes(spark, folder), GENES[0], GENES[1])


@query(with_(CELLS, KNN, _ENRICH) + """, pv AS (SELECT sample_id, a || '/' || b AS pair, round_even(exp(-abs(z)), 9) AS p FROM enr), r AS (SELECT *, p * count(*) OVER (PARTITION BY sample_id) / row_number() OVER (PARTITION BY sample_id ORDER BY p, pair) AS q FROM pv)
SELECT sample_id, pair, p, round_even(least(min(q) OVER (PARTITION BY sample_id ORDER BY p DESC, pair DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0), 6) AS p_adj FROM r""")
def bh_adjust(spark: SparkSession, folder: str) -> DataFrame:
    z = neighbourhood_enrichment(spark, folder).select("sample_id", F.concat_ws("/", "a", "b").alias("pair"), F.bround(F.exp(-F.abs("z")), 9).alias("p"))
    return graph.benjamini_hochberg(z, by="sample_id", key="pair").withColumn("p_adj", F.bround("p_adj", 6))


@query(with_(CELLS) + """, c AS (SELECT cell_type, region, count(*) AS n FROM cells WHERE cell_type IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2), f AS (SELECT *, n / sum(n) OVER (PARTITION BY cell_type) AS f FROM c)
SELECT x.cell_type AS a, y.cell_type AS b, round_even(sum(least(x.f, y.f)), 4) AS overlap FROM f x JOIN f y ON x.region = y.region AND x.cell_type < y.cell_type GROUP BY 1, 2""")
def region_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return graph.region_overlap(cells(spark, folder))


# --- point patterns ---------------------------------------------------------------------------

_WINDOW = """lo AS (SELECT sample_id, min(x) AS x0, min(y) AS y0 FROM pos GROUP BY 1), occ AS (SELECT DISTINCT sample_id, floor((x - x0) / 40)::BIGINT AS bx, floor((y - y0) / 40)::BIGINT AS by_ FROM pos JOIN lo USING (sample_id)),
st AS (SELECT a, b FROM range(-1, 2) t(a), range(-1, 2) u(b) WHERE a <> 0 OR b <> 0), nb AS (SELECT sample_id, bx + a AS bx, by_ + b AS by_, count(*) AS k FROM occ, st GROUP BY 1, 2, 3 HAVING count(*) >= 6),
win AS (SELECT *, false AS filled FROM occ UNION ALL SELECT sample_id, bx, by_, true FROM nb ANTI JOIN occ USING (sample_id, bx, by_))"""


@query(with_(CELLS, _WINDOW) + "SELECT * FROM win")
def tissue_window(spark: SparkSession, folder: str) -> DataFrame:
    return points.tissue_window(positioned(spark, folder), 40.0)


@query(with_(CELLS, _WINDOW) + "SELECT sample_id, count(*) FILTER (NOT filled) AS occupied, count(*) FILTER (filled) AS filled, count(*) * 1600.0::DOUBLE AS area FROM win GROUP BY 1")
def window_area(spark: SparkSession, folder: str) -> DataFrame:
    return points.window_area(positioned(spark, folder), 40.0)


_RADII = [10.0, 20.0, 30.0, 40.0]
_PAIRS = "pr AS (SELECT a.sample_id, a.cell_type AS la, b.cell_type AS lb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pos a JOIN pos b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600.0000001)"


@query(with_(CELLS, _WINDOW, _PAIRS) + """, ar AS (SELECT sample_id, count(*) * 1600.0::DOUBLE AS area FROM win GROUP BY 1), n AS (SELECT sample_id, count(*) AS n FROM pos GROUP BY 1)
SELECT sample_id, r AS radius, round_even(sqrt((SELECT count(*) FROM pr WHERE pr.sample_id = n.sample_id AND d <= r + 1e-9) / n / (n / area) / pi()), 6) AS l FROM n JOIN ar USING (sample_id), (VALUES (10.0::DOUBLE), (20.0::DOUBLE), (30.0::DOUBLE), (40.0::DOUBLE)) t(r)""")
def besag_l(spark: SparkSession, folder: str) -> DataFrame:
    c = positioned(spark, folder)
    return points.besag_l(c, points.window_area(c, 40.0).select("sample_id", "area"), _RADII)


@query(with_(CELLS, _PAIRS) + """, h AS (SELECT la AS a, lb AS b, r AS radius, count(*) AS n FROM pr, (VALUES (10.0::DOUBLE), (20.0::DOUBLE), (30.0::DOUBLE), (40.0::DOUBLE)) t(r) WHERE la IS NOT NULL AND lb IS NOT NULL AND d <= r + 1e-9 GROUP BY 1, 2, 3),
s AS (SELECT *, sum(n) OVER (PARTITION BY a, radius) AS na, sum(n) OVER (PARTITION BY b, radius) AS nb, sum(n) OVER (PARTITION BY radius) AS nn FROM h) SELECT a, b, radius, round_even(n * nn / (na * nb::DOUBLE), 6) AS ratio FROM s""")
def co_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return points.co_occurrence(positioned(spark, folder), _RADII)


@query()
def ripley_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell type of every sample against 100 patterns of its own size. P12."""
    c = positioned(spark, folder)
    return points.ripley_verdicts(c, graph.knn_edges(c, 1))


@query()
def enrichment_robustness(spark: SparkSession, folder: str) -> DataFrame:
    """Every sample's settings against k = 6, under 250 permutations. P2."""
    c = positioned(spark, folder)
    near = materialise(graph.knn_edges(c, 15))
    graphs = {f"k{k}": near.filter(F.col("rank") <= k) for k in (6, 10, 15)} | {"band": graph.distance_band(c, near.filter("rank = 1"))}
    return graph.robustness(graph.enrichment_settings(graphs, c), c.filter("sample_id is not null").select("sample_id"), ["k6", "k10", "k15"])


# --- transfer, reliability, control -----------------------------------------------------------


@query()
def label_transfer(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the second half of the samples from the first."""
    from tessella.operators.transfer import transfer_labels

    c = cells(spark, folder)
    names = c.select("sample_id").distinct()
    half = F.percentile(F.xxhash64("sample_id").cast("double"), 0.5)
    mid = names.agg(half.alias("m")).first().m
    ref = F.xxhash64("sample_id").cast("double") < mid
    lab = c.filter(ref).select("cell_id", F.col("cell_type").alias("label"))
    # the view of genes, but shuffled once, by cell, for both of its aggregations
    e = expression_rows(table(spark, folder, "expr")).repartition("cell_id").groupBy("cell_id", "gene").agg(F.max(F.struct("raw", "value", "sample_id")).alias("m")).select("m.sample_id", "cell_id", "gene", "m.raw")
    of = lambda side: F.collect_list(F.when(side, F.struct("gene", "raw")))
    e = materialise(e.groupBy("cell_id").agg(of(ref).alias("r"), of(~ref).alias("t")))
    r, t = (e.filter(F.size(x) > 0).select("cell_id", F.col(f"{x}.gene").alias("gene"), F.col(f"{x}.raw").alias("raw")) for x in ("r", "t"))
    return transfer_labels(r, lab, t)


@query(with_(_SCORED) + "SELECT record_id, round_even(CASE WHEN score <= 0 THEN 1 WHEN score >= 1 THEN 0 ELSE least(1, -log10(score) / 3) END, 6) AS strength, round_even(least(greatest(0, least(1, score)), greatest(0, least(1, len(actual_tools) / 3.0::DOUBLE))), 4) AS reliability FROM training_records WHERE score IS NOT NULL AND actual_tools IS NOT NULL")
def claim_strength(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "training_records").filter("score is not null and actual_tools is not null")
    return r.select("record_id", F.bround(reliability.evidence_strength(F.col("score")), 6).alias("strength"), reliability.weakest_link(F.col("score"), F.size("actual_tools") / F.lit(3.0)).alias("reliability"))


@query("""WITH t AS (SELECT record_id, list_distinct(coalesce(expected_tools, [])) AS a, list_distinct(coalesce(actual_tools, [])) AS b FROM training_records), c AS (SELECT record_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS k FROM t)
SELECT record_id, round_even(CASE WHEN na = 0 THEN 1.0 ELSE coalesce(2.0::DOUBLE * k / nullif(na + nb, 0), 0) END, 6) AS f1, CASE WHEN na = 0 THEN 1.0 ELSE coalesce(2.0::DOUBLE * k / nullif(na + nb, 0), 0) END >= 0.8 AS passed FROM c""")
def routing_scores(spark: SparkSession, folder: str) -> DataFrame:
    """F1 of expected and actual tools; 1.0 where none is expected. A36."""
    a, b = F.array_distinct(F.coalesce("expected_tools", F.array().cast("array<string>"))), F.array_distinct(F.coalesce("actual_tools", F.array().cast("array<string>")))
    f1 = F.when(F.size(a) == 0, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0)))
    return table(spark, folder, "training_records").select("record_id", F.bround(f1, 6).alias("f1"), (f1 >= 0.8).alias("passed"))


@query("""SELECT record_id, CASE WHEN len(list_filter(list_distinct(coalesce(expected_tools, [])), lambda x: NOT list_contains(coalesce(actual_tools, []), x))) = 0 THEN 'grounded'
 WHEN len(list_filter(list_distinct(coalesce(expected_tools, [])), lambda x: NOT list_contains(coalesce(actual_tools, []), x))) < len(list_distinct(coalesce(expected_tools, []))) THEN 'softened' ELSE 'dropped' END AS grounding FROM training_records""")
def claim_grounding(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return table(spark, folder, "training_records").select("record_id", reliability.grounded(F.coalesce("expected_tools", none), F.coalesce("actual_tools", none)).alias("grounding"))


@query("""WITH t AS (SELECT doc_id, sample_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('pericytes', 'transcripts', 'gradient'))) + CASE WHEN sample_id = 'ADNX_0000000' THEN 3 ELSE 0 END AS score, len(list_filter(w, lambda x: x IN ('pericytes', 'transcripts', 'gradient'))) AS hits FROM t)
SELECT doc_id, CAST(score AS INTEGER) AS score FROM s WHERE hits > 0 ORDER BY score DESC, doc_id LIMIT 5""")
def memory_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 texts with most hits of the terms, 3 more for the same sample. G12."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"))
    hits = F.size(F.filter(w, lambda x: x.isin("pericytes", "transcripts", "gradient")))
    d = table(spark, folder, "documents").filter("text is not null").withColumn("hits", hits).filter("hits > 0")
    score = F.col("hits") + F.when(F.col("sample_id") == "ADNX_0000000", 3).otherwise(0)
    return d.withColumn("score", score).orderBy(F.desc("score"), "doc_id").limit(5).select("doc_id", "score")


@query(with_(EXPRESSION) + """, g AS (SELECT DISTINCT gene FROM e), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(text), '[A-Z0-9_-]+')) AS gene FROM documents WHERE text IS NOT NULL) SELECT gene, count(*) AS docs FROM t JOIN g USING (gene) GROUP BY 1""")
def gene_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that mention each measured gene. R13."""
    t = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("([A-Z0-9_-]+)")))).alias("gene"))
    return t.join(genes(spark, folder).select("gene").distinct(), "gene").groupBy("gene").agg(F.count("*").alias("docs"))


@query("""SELECT record_id, sample_id, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY created_at DESC, record_id DESC) AS n FROM training_records WHERE sample_id IS NOT NULL) WHERE n = 1""")
def latest_per_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of each sample: the upsert of a keyed table. G11, G13, U5."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("created_at"), F.desc("record_id"))
    return table(spark, folder, "training_records").filter("sample_id is not null").withColumn("n", F.row_number().over(w)).filter("n = 1").select("record_id", "sample_id", "score")


@query()
def expression_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.operators.clustering import expression_clusters as cluster

    return cluster(genes(spark, folder))


@query()
def spatial_domains(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.operators.clustering import spatial_domains as domains

    return domains(positioned(spark, folder), 60.0)


@query()
def local_moran_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell's class under the first 8 genes: 18 neighbours, 999 permutations. P6."""
    c = positioned(spark, folder)
    return graph.lisa_classes(graph.knn_edges(c, 18), c, genes(spark, folder), list(GENES[:8]))


@query()
def hotspot_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of the first 8 genes' significant high-high cells. P18."""
    return graph.hotspot_regions(local_moran_classes(spark, folder), list(GENES[:8]))


@query()
def marker_p_values(spark: SparkSession, folder: str) -> DataFrame:
    """Rank-sum p and adjusted p of every label's genes. A17, P15."""
    z = rank_sums(spark, folder)
    p = z.withColumn("p", graph.two_sided_p(F.col("z")))
    return graph.benjamini_hochberg(p, by="label")
