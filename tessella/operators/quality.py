"""Ingestion checks, normalisation, feature sets and deterministic row samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.identifiers import finite, is_control, is_expression


def ingestion_qc(cells: DataFrame) -> DataFrame:
    """One row: counts of records, non-finite and duplicate positions, and the bounds (0.0 when empty).

    Null coordinates count as non-finite.  F1.
    """
    ok = finite("x") & finite("y")
    pos = F.when(ok, F.struct("x", "y"))
    lo = lambda c: F.coalesce(F.min(F.when(ok, F.col(c))), F.lit(0.0))
    hi = lambda c: F.coalesce(F.max(F.when(ok, F.col(c))), F.lit(0.0))
    return cells.agg(
        F.count("*").alias("records"), F.count_if(~ok).alias("bad_positions"),
        (F.count(pos) - F.count_distinct(pos)).alias("duplicate_positions"),
        lo("x").alias("x_min"), hi("x").alias("x_max"), lo("y").alias("y_min"), hi("y").alias("y_max"),
    )


def normalise(expr: DataFrame, *, target: float = 1e4) -> DataFrame:
    """Adds ``value`` = ln(1 + raw+ / total * target); total over expression genes of the cell. F2.

    Other features keep their raw value, and so does a cell whose total is not positive.
    Negative counts are taken as 0.
    """
    positive = F.greatest(F.col("raw"), F.lit(0.0))
    own = is_expression(F.col("gene"))
    total = F.sum(F.when(own, positive).otherwise(0.0)).over(Window.partitionBy("cell_id"))
    return expr.withColumn("__t", total).withColumn("value", F.when(own & (F.col("__t") > 0), F.log1p(positive / F.col("__t") * target)).otherwise(F.col("raw"))).drop("__t")


def cell_qc(expr: DataFrame, *, min_transcripts: float = 10.0, max_background: float = 0.05) -> DataFrame:
    """(cell_id, verdict): low_transcripts is tested first, then high_background, else kept. F3.

    Background is the sum of the three control counts, single control probes not among them; the
    denominator is TOTAL_COUNTS if above 0, else transcripts plus background.  A count that is
    missing or null is 0, so a cell without TRANSCRIPT_COUNTS is low.
    """
    of = lambda *names: F.sum(F.when(F.col("gene").isin(*names), F.coalesce("raw", F.lit(0.0))).otherwise(0.0))
    c = expr.groupBy("cell_id").agg(of("TRANSCRIPT_COUNTS").alias("t"), of("TOTAL_COUNTS").alias("n"), of("CONTROL_PROBE_COUNTS", "CONTROL_CODEWORD_COUNTS", "UNASSIGNED_CODEWORD_COUNTS").alias("b"))
    whole = F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("t") + F.col("b"))
    share = F.when(whole > 0, F.col("b") / whole)
    return c.select("cell_id", F.when(F.col("t") < min_transcripts, "low_transcripts").when(share > max_background, "high_background").otherwise("kept").alias("verdict"))


def qc_kept(verdicts: DataFrame) -> DataFrame:
    """The cells ``cell_qc`` keeps; running it fails if there are cells and none is kept. F3."""
    n = verdicts.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "kept").alias("kept"))
    none = F.when((F.col("n") > 0) & (F.col("kept") == 0), F.raise_error(F.lit("cell quality control removed every cell")).cast("boolean"))
    return verdicts.join(F.broadcast(n)).filter(F.coalesce(none, F.col("verdict") == "kept")).select("cell_id")  # n is one row


def threshold_qc(expr: DataFrame, *, min_counts: float, min_genes: int) -> DataFrame:
    """Cells with at least the counts and genes; all cells if none would be left. F4."""
    c = expr.groupBy("cell_id").agg(F.sum("raw").alias("counts"), F.count_distinct("gene").alias("genes"))
    c = c.withColumn("ok", (F.col("counts") >= min_counts) & (F.col("genes") >= min_genes))
    any_ = c.agg(F.max("ok").alias("any_ok"))
    return c.join(F.broadcast(any_)).filter(F.col("ok") | ~F.col("any_ok")).select("cell_id", "counts", "genes")  # any_ is one row


def feature_classes(expr: DataFrame) -> DataFrame:
    """(gene, class, mitochondrial, rows): expression, control or measurement of each feature. F5-F7."""
    g = F.col("gene")
    kind = F.when(is_control(g), "control").when(is_expression(g), "expression").otherwise("measurement")
    return expr.groupBy("gene").agg(F.count("*").alias("rows")).select("gene", kind.alias("class"), g.startswith("MT-").alias("mitochondrial"), "rows")


def gene_intersection(expr: DataFrame, *, groups: str = "sample_id") -> DataFrame:
    """Genes measured in every group. S16, U2."""
    n = expr.agg(F.count_distinct(groups).alias("all_groups"))
    g = expr.groupBy("gene").agg(F.count_distinct(groups).alias("n"))
    return g.join(F.broadcast(n)).filter("n = all_groups").select("gene")  # n is one row


def even_sample(rows: DataFrame, order: str, k: int) -> DataFrame:
    """The rows at positions round(i (n-1) / (k-1)), i < k, in the order of a unique column. S17.

    Halves round to even; with k of 1 the first row, with k of n or more all rows.  Positions
    come from range-sorted partitions and their counts, not from one task ordering everything.
    """
    numbered, n = positions(rows, order)
    if n == 0 or k >= n:
        return numbered.drop("__n")
    if k <= 1:
        return numbered.filter("__n = 0").drop("__n")
    # position p is taken iff some i rounds to it: i is one of the integers next to p (k-1) / (n-1)
    near = F.col("__n") * F.lit(float(k - 1)) / F.lit(float(n - 1))
    hit = F.lit(False)
    for i in (F.floor(near) - 1, F.floor(near), F.floor(near) + 1, F.floor(near) + 2):
        hit = hit | ((i >= 0) & (i < k) & (F.rint(i * F.lit(float(n - 1)) / F.lit(float(k - 1))) == F.col("__n")))
    return numbered.filter(hit).drop("__n")


def positions(rows: DataFrame, order: str) -> tuple[DataFrame, int]:
    """Rows with their position ``__n`` (from 0) in the order of a column, and their number."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    from tessella.session import materialise

    laid = rows.repartitionByRange(parts, F.col(order)).withColumn("__p", F.spark_partition_id())
    laid = materialise(laid)
    counts = laid.groupBy("__p").agg(F.count("*").alias("c")).orderBy("__p").collect()  # one row per partition
    before, total = [], 0
    for r in counts:
        before.append((r["__p"], total))
        total += r.c
    if not before:
        return rows.withColumn("__n", F.lit(0)), 0
    offset = F.element_at(F.create_map(*[F.lit(x) for p in before for x in p]), F.col("__p"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return laid.withColumn("__n", (rank + offset).cast("long")).drop("__p"), total


def stratified_sample(rows: DataFrame, strata: str, key: str, limit: int, *, seed: str = "0") -> DataFrame:
    """Round robin over strata, each in a hashed order, up to ``limit`` rows. S7, W3, L6.

    Null strata are left out.  The global cut is a top-``limit`` by (turn, stratum), which Spark
    takes from per-partition tops.
    """
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    turn = F.row_number().over(Window.partitionBy(strata).orderBy(h, key))
    return rows.filter(F.col(strata).isNotNull()).withColumn("turn", turn).filter(F.col("turn") <= limit).orderBy("turn", strata).limit(limit)


def display_sample(cells: DataFrame, cap: int) -> DataFrame:
    """Round robin over a square grid of ceil(sqrt(cap/4)) bins an axis, in key order within a bin. L3."""
    import math

    bins = max(1, math.ceil(math.sqrt(cap / 4)))
    b = cells.filter(finite("x") & finite("y"))
    e = b.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda v, lo, hi: F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) * bins)).cast("int")
    b = b.join(F.broadcast(e)).withColumn("bx", at("x", "x0", "x1")).withColumn("by", at("y", "y0", "y1"))  # e is one row
    depth = F.row_number().over(Window.partitionBy("bx", "by").orderBy("cell_id"))
    return b.withColumn("depth", depth).orderBy("depth", "bx", "by").limit(cap).select("cell_id", "bx", "by", "depth")


def top_features(expr: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest positive features of each cell (all for n of 0 or less); ties by gene. S9, W1."""
    e = expr.filter("value > 0").withColumn("rank", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("value"), "gene")))
    e = e.filter(F.col("rank") <= n) if n > 0 else e
    return e.select("cell_id", "gene", "value", "rank")


def in_rectangle(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Inside or on the rectangle of any two opposite corners. F14."""
    return F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))


def stripe(offset: float = 0.0, width: float = 60.0) -> Column:
    """Diagonal stripe (0 or 1) of a position. F24."""
    return F.pmod(F.floor((F.col("x") + F.col("y") + offset) / width), F.lit(2)).cast("int")


def unassigned_fraction(cells: DataFrame, *, by: str = "sample_id", label: str = "cell_type") -> DataFrame:
    """Share of cells without a usable label, to 4 digits. F20."""
    return cells.groupBy(by).agg(F.bround(F.avg(F.col(label).isNull().cast("double")), 4).alias("unassigned"))


def panel_overlap(expr: DataFrame, panel: list[str]) -> DataFrame:
    """Share of a marker panel that is measured, to 4 digits; null without any gene. F21, C6, C14."""
    hit = F.count_distinct(F.when(F.col("gene").isin(*panel), F.col("gene")))
    return expr.agg(F.when(F.count("*") > 0, F.bround(hit / F.lit(float(len(panel))), 4)).alias("overlap"))


def expression_totals(expr: DataFrame) -> DataFrame:
    """Mean, median and least count and number of genes of a cell. A6, A32."""
    c = expr.groupBy("cell_id").agg(F.sum("raw").alias("t"), F.count_distinct("gene").alias("g"))
    r = lambda e, n: F.bround(e, 6).alias(n)
    return c.agg(
        F.count("*").alias("cells"), r(F.avg("t"), "mean_counts"), r(F.percentile("t", 0.5), "median_counts"), r(F.min("t"), "min_counts"),
        r(F.avg("g"), "mean_genes"), r(F.percentile("g", 0.5), "median_genes"), F.min("g").alias("min_genes"),
    )
