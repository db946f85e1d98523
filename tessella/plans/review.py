"""Queries over the review and benchmark operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.identifiers import clean_id
from tessella.operators import graph, review, summaries
from tessella.plans.base import CELLS, CLUSTERED, EXPRESSION, KNN, cells, clustered, genes, positioned, with_
from tessella.plans.reference import _ENRICH, RULES, neighbourhood_enrichment, query
from tessella.sources.tables import table

_TOTALS = "tot AS (SELECT cell_id, any_value(sample_id) AS sample_id, sum(raw) AS t FROM e GROUP BY 1)"


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return genes(spark, folder).groupBy("cell_id").agg(F.min("sample_id").alias("sample_id"), F.sum("raw").alias("t"))


@query(with_(EXPRESSION, _TOTALS) + ", q AS (SELECT sample_id, quantile_cont(t, 0.1) AS p10, quantile_cont(t, 0.9) AS p90 FROM tot GROUP BY 1) SELECT cell_id, sample_id, CASE WHEN t < p10 THEN 'low' WHEN t > p90 THEN 'high' ELSE 'typical' END AS stratum FROM tot JOIN q USING (sample_id)")
def qc_strata(spark: SparkSession, folder: str) -> DataFrame:
    return review.qc_strata(_totals(spark, folder)).select("cell_id", "sample_id", "stratum")


@query(with_(CLUSTERED) + """, s AS (SELECT sample_id, cluster AS name, count(*) AS n FROM idx GROUP BY 1, 2), i AS (SELECT *, round_even(sqrt(n) / sum(sqrt(n)) OVER (PARTITION BY sample_id) * 40, 9) AS ideal FROM s),
b AS (SELECT *, floor(ideal)::BIGINT AS base FROM i), r AS (SELECT *, 40 - sum(base) OVER (PARTITION BY sample_id) AS rest_n, row_number() OVER (PARTITION BY sample_id ORDER BY round_even(ideal - base, 6) DESC, name) AS rank FROM b)
SELECT sample_id, name, n, least(n, base + CASE WHEN rank <= rest_n THEN 1 ELSE 0 END) AS quota FROM r""")
def sqrt_quotas(spark: SparkSession, folder: str) -> DataFrame:
    return review.sqrt_quotas(clustered(spark, folder).groupBy("sample_id", F.col("cluster").alias("name")).agg(F.count("*").alias("n")), 40)


@query(with_(CELLS) + """, g AS (SELECT trim(sample_id) AS sample_id, trim(cell_id, ' "') AS cell_id, count(*) AS g FROM cell_index GROUP BY 1, 2), x AS (SELECT sample_id, cell_id, 1 AS e FROM cells)
SELECT sample_id, count(e) AS expected, count(g) AS given, count(*) FILTER (g IS NULL) AS missing, count(*) FILTER (e IS NULL) AS extra, count(*) FILTER (g > 1) AS duplicated FROM x FULL JOIN g USING (sample_id, cell_id) GROUP BY 1""")
def packet_check(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "cell_index").select(F.btrim("sample_id").alias("sample_id"), clean_id("cell_id").alias("cell_id"))
    return review.id_sets(cells(spark, folder), given, "cell_id", by="sample_id")


@query("""WITH b AS (SELECT created_at::DATE::VARCHAR AS d, sum(score) AS s, count(score) AS n FROM training_records WHERE score IS NOT NULL GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS k FROM b),
d AS (SELECT rep, floor(concat('0x', substr(md5('0|' || rep || '|' || r), 1, 8))::BIGINT / 4294967296.0::DOUBLE * k)::BIGINT AS r FROM o, range(1, 201) t(rep)), m AS (SELECT rep, sum(s) / sum(n) AS m FROM d JOIN o USING (r) GROUP BY 1)
SELECT round_even((SELECT sum(s) / sum(n) FROM b), 6) AS mean, round_even(quantile_cont(m, 0.025), 6) AS low, round_even(quantile_cont(m, 0.975), 6) AS high FROM m""")
def score_interval(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "training_records").filter("score is not null").select(F.col("created_at").cast("date").cast("string").alias("d"), "score")
    return review.bootstrap_interval(r, "d", "score")


_SPLIT = """sp AS (SELECT *, CASE WHEN h < 0.6 THEN 'train' WHEN h < 0.8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, concat('0x', substr(sha256('0|' || sample_id || '|' || floor(x / 100)::BIGINT || '|' || floor(y / 100)::BIGINT), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM pos))"""


@query(with_(CELLS, _SPLIT) + "SELECT a.cell_id, round_even(min(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))), 6) AS distance FROM sp a JOIN sp b ON a.sample_id = b.sample_id AND a.split <> b.split GROUP BY 1")
def other_split_distance(spark: SparkSession, folder: str) -> DataFrame:
    c = positioned(spark, folder)
    bins = summaries.block_split(c, 100.0).select("sample_id", "bx", "by", "split")
    s = c.withColumn("bx", F.floor(F.col("x") / 100.0)).withColumn("by", F.floor(F.col("y") / 100.0)).join(bins, ["sample_id", "bx", "by"])
    return review.other_split_distance(s, ["train", "validation", "test"])


@query(with_(EXPRESSION) + "SELECT lineage, count(g.gene) AS measured, count(*) AS total, round_even(count(g.gene) / count(*), 4) AS ceiling FROM (VALUES " + ", ".join(f"('{k}', '{g}')" for k, v in (RULES | {"absent": ("CD3D", "LYZ")}).items() for g in v) + ") t(lineage, gene) LEFT JOIN (SELECT DISTINCT gene FROM e) g USING (gene) GROUP BY 1")
def panel_adequacy(spark: SparkSession, folder: str) -> DataFrame:
    return review.panel_adequacy(genes(spark, folder), RULES | {"absent": ("CD3D", "LYZ")})


@query(with_(EXPRESSION, _TOTALS) + ", b AS (SELECT min(t) AS lo, max(t) AS hi FROM tot) SELECT CAST(least(17, floor((t - lo) / greatest(hi - lo, 1e-9) * 18)) AS INTEGER) AS bin, count(*) AS n FROM tot, b GROUP BY 1")
def count_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return review.count_histogram(_totals(spark, folder))


@query(with_(CELLS) + "SELECT sample_id, cell_type, count(*) AS n, count(*) >= 50 AS testable FROM cells WHERE cell_type IS NOT NULL GROUP BY 1, 2")
def testable_groups(spark: SparkSession, folder: str) -> DataFrame:
    return review.testable_groups(cells(spark, folder))


@query(with_(CELLS, EXPRESSION) + """, n AS (SELECT count(*) AS n FROM cells), g AS (SELECT gene, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS q, any_value(n) AS n FROM e, n GROUP BY 1),
d AS (SELECT gene, ln(1 + s / n) AS mean, ln((q - n * (s / n) * (s / n)) / greatest(n - 1, 1) / (s / n)) AS d FROM g), b AS (SELECT min(mean) AS lo, max(mean) AS hi FROM d),
k AS (SELECT gene, mean, d, least(19, floor((mean - lo) / greatest(hi - lo, 1e-9) * 20)) AS bin FROM d, b), z AS (SELECT gene, mean, round_even(CASE WHEN stddev_samp(d) OVER w > 0 THEN (d - avg(d) OVER w) / stddev_samp(d) OVER w ELSE 1.0 END, 6) AS score FROM k WINDOW w AS (PARTITION BY bin)),
r AS (SELECT gene, round_even(mean, 6) AS mean, score, CAST(row_number() OVER (ORDER BY score DESC, gene) AS INTEGER) AS rank FROM z) SELECT * FROM r WHERE rank <= 50""")
def dispersion_genes(spark: SparkSession, folder: str) -> DataFrame:
    return review.dispersion_genes(genes(spark, folder), cells(spark, folder))


_STATUS = "CASE WHEN z > 0 THEN 'enriched' WHEN z < 0 THEN 'depleted' END"


@query(with_(CELLS, KNN, _ENRICH) + f""", k AS (SELECT sample_id, cell_type, count(*) AS k FROM pos WHERE cell_type IS NOT NULL GROUP BY 1, 2), j AS (SELECT enr.*, least(x.k, y.k) AS least_n FROM enr JOIN k x ON x.sample_id = enr.sample_id AND x.cell_type = a JOIN k y ON y.sample_id = enr.sample_id AND y.cell_type = b)
SELECT sample_id, a, b, CASE WHEN abs(z) >= 2 AND least_n >= 20 THEN 'stable_' || {_STATUS} WHEN abs(z) >= 2 THEN {_STATUS} || '_sensitivity_limited' ELSE 'weak_or_indeterminate' END AS status FROM j""")
def evidence_status(spark: SparkSession, folder: str) -> DataFrame:
    k = summaries.counts(positioned(spark, folder).filter("cell_type is not null"), "sample_id", "cell_type").hint("merge")
    z = neighbourhood_enrichment(spark, folder)
    j = z.join(k.withColumnsRenamed({"cell_type": "a", "n": "ka"}), ["sample_id", "a"]).join(k.withColumnsRenamed({"cell_type": "b", "n": "kb"}), ["sample_id", "b"])
    one = F.lit(1.0)
    return j.select("sample_id", "a", "b", graph.evidence_status(F.col("z"), F.least("ka", "kb"), one, F.lit(3), one, one).alias("status"))
