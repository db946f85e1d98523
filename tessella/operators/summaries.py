"""Aggregates over cells, labels, regions and expression; missing expression counts as 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(cells: DataFrame, *by: str) -> DataFrame:
    """A1, A33, A35."""
    return cells.groupBy(*by).agg(F.count("*").alias("n"))


def centroids(cells: DataFrame, *by: str, digits: int = 3) -> DataFrame:
    """Number and mean position, rounded. A2."""
    return cells.groupBy(*by).agg(F.count("*").alias("n"), F.bround(F.avg("x"), digits).alias("x_mean"), F.bround(F.avg("y"), digits).alias("y_mean"))


def gene_summary(expr: DataFrame, cells: DataFrame, *, digits: int = 5) -> DataFrame:
    """Mean over all cells, largest value and positive cells of every gene. A3, A4."""
    n = cells.agg(F.count("*").alias("cells"))
    g = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.max("value").alias("m"), F.count_if(F.col("value") > 0).alias("positive"), F.count("*").alias("k"), F.min("value").alias("lo"))
    return g.join(F.broadcast(n)).select(  # n is one row
        "gene", F.bround(F.col("s") / F.col("cells"), digits).alias("mean"), F.bround("m", digits).alias("max"),
        F.bround(F.when(F.col("k") < F.col("cells"), F.least("lo", F.lit(0.0))).otherwise(F.col("lo")), digits).alias("min"), "positive",
    )


def region_summary(cells: DataFrame, expr: DataFrame, *, top: int = 8, least: int = 50) -> DataFrame:
    """Per region the ``top`` genes by sum, with the mean over its cells. A5.

    Regions of fewer than ``least`` cells are not reliable; cells without a region are
    ``unassigned``; equal sums go to the smaller gene.
    """
    c = cells.select("cell_id", F.coalesce("region", F.lit("unassigned")).alias("region"))
    size = c.groupBy("region").agg(F.count("*").alias("cell_count"))
    g = expr.join(c, "cell_id").groupBy("region", "gene").agg(F.sum("value").alias("s"))
    g = g.withColumn("s", F.bround("s", 6)).withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("s"), "gene"))).filter(F.col("rank") <= top)
    return g.join(size, "region").select("region", "cell_count", (F.col("cell_count") >= least).alias("reliable"), "gene", "rank", F.bround(F.col("s") / F.col("cell_count"), 5).alias("mean"))


def composition(cells: DataFrame, by: str, label: str = "cell_type") -> DataFrame:
    """Share of each label in each group, to 4 digits. A5."""
    n = F.count("*")
    c = cells.groupBy(by, label).agg(n.alias("n"))
    return c.withColumn("fraction", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 4))


def composition_delta(cells: DataFrame, a: str, b: str, *, by: str = "sample_id", label: str = "cell_type") -> DataFrame:
    """Share of each label in section b less that in a, over the labels of either. R1."""
    part = lambda s, n: cells.filter(F.col(by) == s).groupBy(label).agg(F.count("*").alias(n))
    total = lambda n: F.greatest(F.coalesce(F.sum(n).over(Window.partitionBy(F.lit(1))), F.lit(0)), F.lit(1))
    j = part(a, "na").join(part(b, "nb"), label, "full")
    share = lambda n: F.coalesce(F.col(n), F.lit(0)) / total(n)
    return j.select(label, F.bround(share("nb") - share("na"), 6).alias("delta"))


def densities(cells: DataFrame, bin_size: float, *by: str) -> DataFrame:
    """Cells in each square bin. A9, A12, R3."""
    return cells.groupBy(*by, F.floor(F.col("x") / bin_size).alias("bx"), F.floor(F.col("y") / bin_size).alias("by")).agg(F.count("*").alias("n"))


def colocalisation(cells: DataFrame, a: str, b: str, bin_size: float, *, by: str = "sample_id", label: str = "cell_type") -> DataFrame:
    """Pearson correlation of two labels over the bins either occupies, 0 where undefined, to 4 digits. A10, U3."""
    d = densities(cells.filter(F.col(label).isin(a, b)), bin_size, by, label)
    n = d.groupBy(by, "bx", "by").agg(*[F.sum(F.when(F.col(label) == v, F.col("n")).otherwise(0)).cast("double").alias(c) for v, c in ((a, "na"), (b, "nb"))])
    s = n.groupBy(by).agg(F.count("*").alias("k"), F.sum("na").alias("sa"), F.sum("nb").alias("sb"), F.sum(F.col("na") * F.col("nb")).alias("ab"), F.sum(F.col("na") * F.col("na")).alias("aa"), F.sum(F.col("nb") * F.col("nb")).alias("bb"))
    va, vb = F.col("k") * F.col("aa") - F.col("sa") * F.col("sa"), F.col("k") * F.col("bb") - F.col("sb") * F.col("sb")
    r = (F.col("k") * F.col("ab") - F.col("sa") * F.col("sb")) / F.sqrt(F.nullif(va * vb, F.lit(0.0)))
    return s.select(by, F.col("k").alias("bins"), F.bround(F.coalesce(r, F.lit(0.0)), 4).alias("pearson"))


def colocalisation_p(cells: DataFrame, a: str, b: str, bin_size: float, *, perms: int = 499, seed: str = "0", label: str = "cell_type") -> DataFrame:
    """(bins, r, p): (1 + permutations at least as far from 0) / (1 + perms), over bins. A11.

    The densities of b are dealt anew to the bins in the order of an md5 of (seed, permutation,
    bin); the bins of a window are few, and permutations are rows, so it is one distributed job.
    """
    d = densities(cells.filter(F.col(label).isin(a, b)), bin_size, label)
    n = d.groupBy("bx", "by").agg(*[F.sum(F.when(F.col(label) == v, F.col("n")).otherwise(0)).cast("double").alias(c) for v, c in ((a, "na"), (b, "nb"))])
    n = n.withColumn("key", F.concat_ws("_", F.col("bx").cast("string"), F.col("by").cast("string")))
    n = n.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("key")))
    p = n.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms))))
    h = F.when(F.col("perm") == 0, F.col("key")).otherwise(F.md5(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), F.col("key"))))
    p = p.withColumn("rb", F.row_number().over(Window.partitionBy("perm").orderBy(h, "key")))
    j = p.select("perm", "rn", "na").join(p.select("perm", F.col("rb").alias("rn"), "nb"), ["perm", "rn"])
    s = j.groupBy("perm").agg(F.count("*").alias("k"), F.sum("na").alias("sa"), F.sum("nb").alias("sb"), F.sum(F.col("na") * F.col("nb")).alias("ab"), F.sum(F.col("na") * F.col("na")).alias("aa"), F.sum(F.col("nb") * F.col("nb")).alias("bb"))
    va, vb = F.col("k") * F.col("aa") - F.col("sa") * F.col("sa"), F.col("k") * F.col("bb") - F.col("sb") * F.col("sb")
    s = s.select("perm", "k", F.bround(F.coalesce((F.col("k") * F.col("ab") - F.col("sa") * F.col("sb")) / F.sqrt(F.nullif(va * vb, F.lit(0.0))), F.lit(0.0)), 9).alias("r"))
    seen = s.filter("perm = 0").select(F.col("k").alias("bins"), F.col("r").alias("r0"))
    return s.join(F.broadcast(seen)).groupBy("bins", "r0").agg(F.count_if((F.col("perm") > 0) & (F.abs("r") >= F.abs("r0"))).alias("far")).select("bins", F.bround("r0", 4).alias("pearson"), ((F.col("far") + 1) / F.lit(float(perms + 1))).alias("p"))


def mean_difference(expr: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """Mean of a less mean of b of every gene, to 4 digits, zero-filled. A13."""
    size = groups.agg(*[F.nullif(F.count_if(F.col("label") == v), F.lit(0)).alias(c) for v, c in ((a, "ka"), (b, "kb"))])
    g = expr.join(groups.filter(F.col("label").isin(a, b)), "cell_id").groupBy("gene").agg(*[F.sum(F.when(F.col("label") == v, F.col("value")).otherwise(0.0)).alias(c) for v, c in ((a, "sa"), (b, "sb"))])
    return g.join(F.broadcast(size)).select("gene", F.bround(F.col("sa") / F.col("ka") - F.col("sb") / F.col("kb"), 4).alias("difference"))  # size is one row


def one_vs_rest(expr: DataFrame, groups: DataFrame, *, top: int = 10) -> DataFrame:
    """The genes whose mean in a group most exceeds that of all other cells, with or without a label. A14.

    ``groups``: cell_id, label (null for none) of every cell.
    """
    total = groups.agg(F.count("*").alias("cells"))
    size = groups.filter("label is not null").groupBy("label").agg(F.count("*").alias("k"))
    sums = expr.join(groups, "cell_id").groupBy("label", "gene").agg(F.sum("value").alias("s"))
    whole = sums.groupBy("gene").agg(F.sum("s").alias("all_s"))
    j = sums.filter("label is not null").join(whole, "gene").join(size, "label")
    j = j.join(F.broadcast(total))  # total is one row
    d = F.col("s") / F.col("k") - (F.col("all_s") - F.col("s")) / F.nullif(F.col("cells") - F.col("k"), F.lit(0))
    j = j.withColumn("difference", F.bround(F.coalesce(d, F.col("s") / F.col("k")), 4))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("difference"), "gene"))).filter(F.col("rank") <= top).select("label", "gene", "rank", "difference")


def variance_rank(expr: DataFrame, cells: DataFrame, *, top: int = 20) -> DataFrame:
    """Genes by population variance over all cells, zero-filled. A15, A18 (moments)."""
    n = cells.agg(F.count("*").alias("cells"))
    g = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(F.broadcast(n))  # n is one row
    v = F.bround(F.col("q") / F.col("cells") - (F.col("s") / F.col("cells")) * (F.col("s") / F.col("cells")), 6)
    return g.select("gene", v.alias("variance")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "gene"))).filter(F.col("rank") <= top)


def rank_sums(expr: DataFrame, groups: DataFrame, *, least: int = 3) -> DataFrame:
    """(label, gene, n, z, log_fold): rank-sum z of each group against the others. A17, W6.

    Zeros are not stored: a gene's zeros share the average rank of its lowest block, so only
    positive values are ranked.  Blank labels and groups under ``least`` cells take no part.  z
    has no tie correction; log_fold is log2 of the ratio of mean expm1 values, each plus 1e-9.
    Per gene, ranks come from counts of distinct values, so a gene of many equal values is one row.
    """
    size = groups.filter("label is not null").groupBy("label").agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    kept = groups.join(F.broadcast(size), "label").select("cell_id", "label")  # one row per label
    total = size.agg(F.sum("k").alias("cells"))
    v = expr.filter("value > 0").join(kept, "cell_id").select("gene", "label", F.bround("value", 9).alias("value"))
    per = v.groupBy("gene", "value", "label").agg(F.count("*").alias("m"))
    ties = per.groupBy("gene", "value").agg(F.sum("m").alias("t"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy("gene").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ties = ties.withColumn("below", below)
    positive = v.groupBy("gene").agg(F.count("*").alias("pos"))
    ranked = per.join(ties, ["gene", "value"]).join(positive, "gene").join(F.broadcast(total))  # total is one row
    rank = (F.col("cells") - F.col("pos")) + F.col("below") + (F.col("t") + 1) / 2
    sums = ranked.groupBy("gene", "label").agg(F.sum(rank * F.col("m")).alias("rs"), F.sum("m").alias("n_pos"), F.sum(F.expm1("value") * F.col("m")).alias("e"))
    j = sums.join(positive, "gene").join(F.broadcast(size), "label").join(F.broadcast(total))
    zero = F.col("cells") - F.col("pos")
    r1 = F.col("rs") + (F.col("k") - F.col("n_pos")) * (zero + 1) / 2
    other = F.col("cells") - F.col("k")
    z = (r1 - F.col("k") * (F.col("cells") + 1) / 2) / F.sqrt(F.col("k") * F.nullif(other, F.lit(0)) * (F.col("cells") + 1) / 12.0)
    every = ranked.groupBy("gene").agg(F.sum(F.expm1("value") * F.col("m")).alias("all_e"))
    j = j.join(every, "gene")
    rest = F.when(F.col("n_pos") == F.col("pos"), 0.0).otherwise(F.col("all_e") - F.col("e"))
    fold = F.log2((F.col("e") / F.col("k") + 1e-9) / (rest / F.nullif(other, F.lit(0)) + 1e-9))
    return j.select("label", "gene", "k", F.bround(z, 6).alias("z"), F.bround(fold, 4).alias("log_fold"))


def replication(sections: DataFrame) -> DataFrame:
    """Sections and known donors per condition, and whether there are two of each. A21."""
    s = sections.groupBy("condition").agg(F.count_distinct("section_id").alias("sections"), F.count_distinct("donor_id").alias("donors"), F.count_if(F.col("donor_id").isNull()).alias("unknown"))
    return s.withColumn("replicated", (F.col("sections") >= 2) & (F.col("donors") >= 2) & (F.col("unknown") == 0))


def cluster_confidence(index: DataFrame) -> DataFrame:
    """Clusters under 100 cells or 0.5 % of the sample are of low confidence. A22."""
    c = index.groupBy("sample_id", "cluster").agg(F.count("*").alias("n"))
    f = F.col("n") / F.sum("n").over(Window.partitionBy("sample_id"))
    return c.select("sample_id", "cluster", "n", F.bround(f, 6).alias("fraction"), F.when((F.col("n") < 100) | (f < 0.005), "low").otherwise("ok").alias("confidence"))


def cluster_consensus(labelled: DataFrame) -> DataFrame:
    """Per cluster the leading label, its share, the runner-up, consensus (> 0.5) and disagreement (>= 0.15). A23, J15."""
    c = labelled.groupBy("sample_id", "cluster", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sample_id", "cluster").orderBy(F.desc("n"), "label")
    c = c.withColumn("all", F.sum("n").over(Window.partitionBy("sample_id", "cluster"))).withColumn("next", F.lead("label").over(w)).withColumn("r", F.row_number().over(w)).filter("r = 1")
    share = F.col("n") / F.col("all")
    return c.select("sample_id", "cluster", F.col("label").alias("top_label"), F.bround(share, 4).alias("share"), F.col("next").alias("runner_up"), (share > 0.5).alias("consensus"), (1 - share >= 0.15).alias("disagreement"))


def marker_jaccard(markers: DataFrame, *, least: float = 0.34) -> DataFrame:
    """Pairs of groups whose marker sets overlap by ``least`` or more. A24."""
    m = markers.select("label", "gene").distinct()
    size = m.groupBy("label").agg(F.count("*").alias("k"))
    b = m.select(F.col("label").alias("other"), "gene")
    both = m.join(b, "gene").filter("label < other").groupBy("label", "other").agg(F.count("*").alias("both"))
    j = both.join(size, "label").join(size.select(F.col("label").alias("other"), F.col("k").alias("ko")), "other")
    x = F.bround(F.col("both") / (F.col("k") + F.col("ko") - F.col("both")), 4)
    return j.select("label", "other", x.alias("jaccard"), (x >= least).alias("flagged"))


def domain_geometry(cells: DataFrame, *by: str) -> DataFrame:
    """Number, bounding box, its area and centroid (1 digit) of each domain. A25."""
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return cells.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.bround(w * h, 3).alias("area"), F.bround(F.avg("x"), 1).alias("cx"), F.bround(F.avg("y"), 1).alias("cy"))


def cramers_v(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cramer's V of two categories; empty cells of the table count through the marginals. A26."""
    c = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    c = c.withColumn("ra", F.sum("n").over(Window.partitionBy(a))).withColumn("rb", F.sum("n").over(Window.partitionBy(b)))
    # chi2 / N = sum(n^2 / (ra rb)) - 1
    s = c.agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb").cast("double"))).alias("q"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"), F.sum("n").alias("n"))
    return s.select("n", "ka", "kb", F.bround(F.sqrt(F.greatest(F.col("q") - 1, F.lit(0.0)) / F.nullif(F.least("ka", "kb") - 1, F.lit(0))), 6).alias("v"))


def classification(rows: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) of truth against prediction, 0 where undefined. A27."""
    t = rows.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("predicted")).alias("tp"))
    p = rows.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("said"))
    j = t.join(p, "label", "full").fillna(0)
    pr, re = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re")), F.lit(0.0))
    return j.withColumn("pr", pr).withColumn("re", re).select("label", "support", F.bround("pr", 6).alias("precision"), F.bround("re", 6).alias("recall"), F.bround(f1, 6).alias("f1"))


def classification_summary(rows: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 and balanced accuracy. A27."""
    c = classification(rows).filter("label is not null")
    acc = rows.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))
    m = c.agg(F.avg("f1").alias("macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced"))
    return m.join(F.broadcast(acc)).select(*[F.bround(x, 4).alias(x) for x in ("accuracy", "macro", "weighted", "balanced")])  # one row each


def auroc(rows: DataFrame) -> DataFrame:
    """Share of pairs in which the positive scores higher, ties half; 0.0 with one class only; 4 digits. A29.

    Rows: score, positive.  Ranks come from counts of distinct scores; the running sum is over those.
    """
    c = rows.filter("score is not null").groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = c.withColumn("b", below).agg(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)).alias("w"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return s.select(F.bround(F.coalesce(F.try_divide("w", F.col("np") * F.col("nn")), F.lit(0.0)), 4).alias("auroc"))


def calibration_bins(rows: DataFrame, *, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, observed) over equal bins, the last closed; empty bins have no row. A30."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    return rows.filter("score between 0 and 1").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.bround(F.avg("score"), 6).alias("confidence"), F.bround(F.avg(F.col("positive").cast("double")), 6).alias("observed"))


def calibration_error(rows: DataFrame, *, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score, 4 digits. A30."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    y = F.col("positive").cast("double")
    c = rows.filter("score between 0 and 1").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(y).alias("p"), F.sum((F.col("score") - y) * (F.col("score") - y)).alias("q"))
    return c.agg(F.bround(F.sum(F.abs(F.col("s") - F.col("p"))) / F.sum("n"), 4).alias("ece"), F.bround(F.sum("q") / F.sum("n"), 4).alias("brier"))


def coverage_decisions(sizes: DataFrame, *, by: str = "sample_id", share: float = 0.7) -> DataFrame:
    """Groups to decide, largest first, until their cells reach ``share`` of all. A34, W5.

    Rows: by, name, n.  Unassigned names count in the total but are no decision; equal sizes by name.
    """
    none = F.lower(F.coalesce("name", F.lit(""))).isin("", "unassigned", "none", "nan", "na", "-1", "unclustered")
    s = sizes.withColumn("all", F.sum("n").over(Window.partitionBy(by))).filter(~none)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(F.desc("n"), "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("before", before).filter(F.col("before") / F.col("all") < share).select(by, "name", "n", "before")


def char_split(ids: DataFrame, key: str, *, first: int = 100) -> DataFrame:
    """Split by the sum of character codes modulo 10 (train below 7, validation below 9, else test); the first ids of each. R2."""
    total = F.aggregate(F.transform(F.split(F.col(key), ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a + c)
    m = F.pmod(total, F.lit(10))
    s = ids.select(key).distinct().withColumn("split", F.when(m < 7, "train").when(m < 9, "validation").otherwise("test"))
    return s.withColumn("n", F.row_number().over(Window.partitionBy("split").orderBy(key))).filter(F.col("n") <= first).select(key, "split")


def block_split(cells: DataFrame, block: float, *, seed: str = "0") -> DataFrame:
    """(sample_id, bx, by, n, split): spatial blocks dealt by a hash: 60 % train, 20 % validation, 20 % test. L7."""
    d = densities(cells, block, "sample_id")
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "sample_id", F.col("bx").cast("string"), F.col("by").cast("string")), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return d.withColumn("split", F.when(h < 0.6, "train").when(h < 0.8, "validation").otherwise("test"))


def region_consistency(pairs: DataFrame) -> DataFrame:
    """Supported (|z| >= 2) regions of each pair, agreement of signs and status. A20, J16."""
    p = pairs.groupBy("a", "b").agg(F.count_if(F.abs("z") >= 2).alias("supported"), F.count_if(F.col("z") >= 2).alias("pos"), F.count_if(F.col("z") <= -2).alias("neg"), F.count("*").alias("regions"))
    agree = F.bround(F.try_divide(F.greatest("pos", "neg"), "supported"), 4)
    return p.select("a", "b", "regions", "supported", agree.alias("agreement"), F.when(F.col("supported") < 2, "insufficient").when(agree >= 0.8, "consistent").otherwise("mixed").alias("status"))


def evidence_priority(rows: DataFrame) -> DataFrame:
    """Additive review priority and its reasons. R4.

    Flags (boolean columns): high, marker_conflict, lineage_absent, distant; confidence; label.
    """
    parts = [
        (6, "high_priority", F.col("high")), (5, "marker_disagreement", F.col("marker_conflict")), (5, "lineage_absent", F.col("lineage_absent")),
        (3, "distant", F.col("distant")), (3, "low_confidence", F.col("confidence") < 0.6), (1, "unannotated", F.col("label").isNull()),
    ]
    score = sum((F.when(c, n).otherwise(0) for n, _, c in parts), F.lit(0))
    return rows.select("cell_id", score.alias("priority"), F.concat_ws(";", *[F.when(c, r) for _, r, c in parts]).alias("reasons"))
