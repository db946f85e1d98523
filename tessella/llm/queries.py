"""The queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.cells import distinct_cells
from tessella.functions.expression import expression_rows
from tessella.functions.identifiers import clean_id, type_key
from tessella.llm.birch import clusters, describe, tight_groups
from tessella.llm.encoding import encode_texts
from tessella.llm.language import corrected_labels, document_languages, learn, segment_languages
from tessella.llm.leakage import leaked_items
from tessella.llm.linked_split import assign_splits, linked_groups, path_key, sample_key
from tessella.llm.proportional import draw, report
from tessella.llm.similar import similar
from tessella.llm.sparse import packed_vectors
from tessella.llm.top_n import top_n_per_group
from tessella.session import materialise
from tessella.sources.tables import table


def p5_top(spark: SparkSession, folder: str) -> DataFrame:
    """The 3 cells with the highest raw expression of every sample, cluster and gene, with rank."""
    cluster = clean_id("cluster")
    index = (
        table(spark, folder, "cell_index").select(clean_id("cell_id").alias("cell_id"), cluster.alias("cluster"))
        .filter(F.col("cell_id").isNotNull() & F.col("cluster").isNotNull() & (F.lower("cluster") != "unclustered"))
        .groupBy("cell_id").agg(F.min("cluster").alias("cluster"))
    )
    rows = expression_rows(table(spark, folder, "expr")).select("sample_id", "cell_id", "gene", "raw").join(index, "cell_id")
    return top_n_per_group(rows, ["sample_id", "cluster", "gene"], "raw", "cell_id", 3)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_top(spark, folder).select("sample_id", "cluster", "gene", "cell_id")


def cell_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(cell_id, vec): the expression of every cell as a packed unit vector."""
    rows = expression_rows(table(spark, folder, "expr")).select("cell_id", "gene", "value")
    return packed_vectors(rows, "cell_id", F.col("gene"), F.col("value"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of cells of similarity 0.995 or more of which one is among the 5 most similar to the other."""
    near = similar(cell_vectors(spark, folder), 5, min_similarity=0.995)
    return near.select(F.least("a", "b").alias("cell_a"), F.greatest("a", "b").alias("cell_b")).distinct()


def p1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar cells of every 50th cell (by a hash of its id) among all cells, near or far."""
    vectors = materialise(cell_vectors(spark, folder))
    asked = vectors.filter(F.pmod(F.xxhash64("cell_id"), F.lit(50)) == 0).select("cell_id")
    found = similar(vectors, 5, queries=asked, dims=None, ef=96, keep=24)
    return found.select(F.col("a").alias("cell_id"), F.col("b").alias("neighbour"), "similarity", "rank")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of three or more cells alike to 0.8 among themselves and to no other cell."""
    return tight_groups(clusters(cell_vectors(spark, folder))).select("cluster_first", F.col("k").alias("cell_id"))


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster with its size and its 3 most typical cells."""
    return describe(clusters(cell_vectors(spark, folder)))


def p3_split(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every training record, 80/10/10, linked records together."""
    records = table(spark, folder, "training_records")
    groups = linked_groups(records, "record_id", [sample_key("sample_id"), path_key("dataset_path")])
    return assign_splits(materialise(groups), "record_id", ["train", "validation", "test"], [0.8, 0.1, 0.1]).select("record_id", "split")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records in groups of two or more, with the smallest sample id of the group."""
    records = table(spark, folder, "training_records").select("record_id", "sample_id", "dataset_path")
    groups = materialise(linked_groups(records, "record_id", [sample_key("sample_id"), path_key("dataset_path")]))
    named = groups.join(records.select("record_id", sample_key("sample_id").alias("s")), "record_id")
    first = named.groupBy("group").agg(F.count_distinct("record_id").alias("n"), F.min("s").alias("group_sample")).filter("n > 1")
    return groups.join(first, "group").select("record_id", "group_sample")


def _draws(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "draw_targets").select(
        F.col("draw_id").alias("draw"), F.col("sample_id").alias("stratum"), type_key("cell_type").alias("category"), "cell_type",
        F.col("target_share").alias("share"), F.col("min_rows").alias("least"), F.col("max_records").alias("size"),
    )
    cells = distinct_cells(table(spark, folder, "spots"), ["sample_id", "cell_type"])
    return targets, cells.select(F.col("sample_id").alias("stratum"), type_key("cell_type").alias("category"), F.col("cell_id").alias("item")).filter("category is not null")


def _sampled(spark: SparkSession, folder: str) -> DataFrame:
    targets, cells = _draws(spark, folder)
    cells = materialise(cells)
    return report(targets, cells, draw(targets, cells))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of which the drawn sample has fewer rows than needed."""
    return _sampled(spark, folder).filter("missing > 0").select(F.col("draw").alias("draw_id"), "cell_type")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Needed, present, drawn and missing rows of every target."""
    return _sampled(spark, folder).select(F.col("draw").alias("draw_id"), "cell_type", "need", "there", "drawn", "missing")


def p7_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn cells."""
    targets, cells = _draws(spark, folder)
    return draw(targets, materialise(cells)).select(F.col("draw").alias("draw_id"), F.col("category").alias("type_key"), F.col("item").alias("cell_id"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items they hold, with the share of the item's words."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    documents = table(spark, folder, "documents")
    return segment_languages(documents, learn(documents))


def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of documents whose label is missing, wrong or not the only one, with share, confidence and reason."""
    documents = table(spark, folder, "documents")
    return corrected_labels(documents, materialise(document_languages(segment_languages(documents, learn(documents)))))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_labels(spark, folder).select("doc_id", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_nearest": p1_nearest,
    "p3_found": p3_found,
    "p3_split": p3_split,
    "p5_found": p5_found,
    "p5_top": p5_top,
    "p6_found": p6_found,
    "p6_clusters": p6_clusters,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_sample": p7_sample,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_labels": p10_labels,
    "p10_segments": p10_segments,
}

_EXPRESSION = r"""
expression AS (
  SELECT max(sample_id) AS sample_id, cell_id, gene, max(raw) AS raw, max(value) AS value FROM (
    SELECT sample_id, trim(cell_id, ' "') AS cell_id, upper(regexp_replace(gene, '^(gene_)?(marker_)?', '', 'i')) AS gene, raw, value
    FROM expr WHERE isfinite(raw) AND isfinite(value) AND raw > 0)
  WHERE gene NOT IN ('TRANSCRIPT_COUNTS', 'TOTAL_COUNTS', 'CELL_AREA', 'NUCLEUS_AREA', 'CONTROL_PROBE_COUNTS', 'CONTROL_CODEWORD_COUNTS', 'UNASSIGNED_CODEWORD_COUNTS')
    AND NOT regexp_matches(gene, '^(UNASSIGNEDCODEWORD|NEGCONTROLCODEWORD|NEGCONTROLPROBE|DEPRECATEDCODEWORD|GENOMICCONTROL|BLANK|ANTISENSE|NEGPROBE|NEGCONTROL)($|[-_.0-9])')
  GROUP BY cell_id, gene)"""

_P5 = f"""
WITH {_EXPRESSION},
idx AS (SELECT trim(cell_id, ' "') AS cell_id, min(trim(cluster, ' "')) AS cluster FROM cell_index
        WHERE trim(cluster, ' "') NOT IN ('', 'unclustered') GROUP BY 1),
ranked AS (SELECT sample_id, cluster, gene, e.cell_id AS cell_id, raw,
  row_number() OVER (PARTITION BY sample_id, cluster, gene ORDER BY raw DESC, e.cell_id) AS rank
  FROM expression e JOIN idx USING (cell_id))
"""

_P7 = """
WITH cells AS (SELECT cell_id, max(sample_id) AS sample_id, max(regexp_replace(lower(cell_type), '[^\\p{L}\\p{N}+]', '', 'g')) AS k FROM spots GROUP BY 1),
n AS (SELECT sample_id, k, count(*) AS there FROM cells WHERE k NOT IN ('', 'unknown', 'unannotatedcell') GROUP BY 1, 2),
t AS (SELECT d.draw_id, d.cell_type, greatest(d.min_rows, CAST(floor(d.target_share * d.max_records + 0.5 + 1e-9) AS BIGINT)) AS need, coalesce(n.there, 0) AS there
  FROM draw_targets d LEFT JOIN n ON n.sample_id = d.sample_id AND n.k = regexp_replace(lower(d.cell_type), '[^\\p{L}\\p{N}+]', '', 'g'))
"""

SQL: dict[str, str] = {
    "p7_found": _P7 + "SELECT draw_id, cell_type FROM t WHERE there < need",
    "p7_report": _P7 + "SELECT draw_id, cell_type, need, there, least(need, there) AS drawn, greatest(need - there, 0) AS missing FROM t",
    "p5_found": _P5 + "SELECT sample_id, cluster, gene, cell_id FROM ranked WHERE rank <= 3",
    "p5_top": _P5 + "SELECT sample_id, cluster, gene, cell_id, raw, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3",
}
