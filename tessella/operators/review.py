"""Operators behind review packets and benchmarks: strata, quotas, id checks, bootstrap, controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import knn_edges


def uniform(*keys: Column, seed: str = "0") -> Column:
    """Uniform in [0, 1) from an md5 of seed and keys."""
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def qc_strata(totals: DataFrame, *, by: str = "sample_id", value: str = "t") -> DataFrame:
    """Adds ``stratum``: low under the 10th percentile of the group, high above the 90th, else typical. L8, W7."""
    q = totals.groupBy(by).agg(F.percentile(value, 0.1).alias("p10"), F.percentile(value, 0.9).alias("p90"))
    s = F.when(F.col(value) < F.col("p10"), "low").when(F.col(value) > F.col("p90"), "high").otherwise("typical")
    return totals.join(q, by).withColumn("stratum", s).drop("p10", "p90")


def sqrt_quotas(sizes: DataFrame, total: int, *, by: str = "sample_id") -> DataFrame:
    """(by, name, n, quota): ``total`` shared out by the roots of the sizes, largest remainders first. L5.

    No group gets more than it has; ties of remainders go to the smaller name.
    """
    r = F.sqrt("n")
    s = sizes.withColumn("ideal", F.bround(r / F.sum(r).over(Window.partitionBy(by)) * total, 9))
    s = s.withColumn("base", F.floor("ideal").cast("long")).withColumn("rest", F.col("ideal") - F.col("base"))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.bround("rest", 6)), "name"))
    return s.select(by, "name", "n", F.least("n", F.col("base") + F.when(rank <= left, 1).otherwise(0)).alias("quota"))


def id_sets(expected: DataFrame, given: DataFrame, key: str, *, by: str) -> DataFrame:
    """(by, expected, given, missing, extra, duplicated): how two sets of ids differ. R6, R9."""
    a = expected.groupBy(by, key).agg(F.lit(1).alias("e"))
    b = given.groupBy(by, key).agg(F.count("*").alias("g"))
    j = a.join(b, [by, key], "full")
    return j.groupBy(by).agg(
        F.count("e").alias("expected"), F.count("g").alias("given"), F.count_if(F.col("g").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("extra"), F.count_if(F.col("g") > 1).alias("duplicated"),
    )


def bootstrap_interval(rows: DataFrame, block: str, value: str, *, reps: int = 200, seed: str = "0") -> DataFrame:
    """(mean, low, high): the mean of a value with its 2.5 and 97.5 percentiles over resampled blocks. A28.

    Blocks are summed first; a resample draws as many blocks as there are, by md5 uniforms over
    their positions, so it works on one row per block and repetition.
    """
    b = rows.groupBy(block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    b = b.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(block)) - 1).withColumn("k", F.count("*").over(Window.partitionBy(F.lit(1))))
    d = b.select("r", "k").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    d = d.select("rep", F.floor(uniform(F.col("rep"), F.col("r"), seed=seed) * F.col("k")).cast("int").alias("r"))
    m = d.join(b.select("r", "s", "n"), "r").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("m"))
    whole = b.agg((F.sum("s") / F.sum("n")).alias("mean"))
    e = m.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return whole.join(F.broadcast(e)).select(*[F.bround(c, 6).alias(c) for c in ("mean", "low", "high")])  # one row each


def other_split_distance(cells: DataFrame, names: list[str]) -> DataFrame:
    """(cell_id, distance) to the nearest cell of the sample in another split. J10.

    ``cells`` has a column split; every split asks the others once.
    """
    out = None
    for name in names:
        e = knn_edges(cells.filter(F.col("split") == name), 1, targets=cells.filter(F.col("split") != name))
        out = e if out is None else out.union(e)
    return out.select(F.col("src").alias("cell_id"), F.bround(F.sqrt("d2"), 6).alias("distance"))


def panel_adequacy(measured: DataFrame, lineages: dict[str, tuple[str, ...]]) -> DataFrame:
    """(lineage, measured, total, ceiling): share of each lineage's markers on the panel. C6, C14."""
    t = measured.sparkSession.createDataFrame([(k, g) for k, v in lineages.items() for g in v], "lineage string, gene string")
    hit = F.broadcast(t).join(measured.select("gene").distinct().withColumn("hit", F.lit(1)), "gene", "left")  # t is a constant table
    return hit.groupBy("lineage").agg(F.count("hit").alias("measured"), F.count("*").alias("total")).withColumn("ceiling", F.bround(F.col("measured") / F.col("total"), 4))


def count_histogram(totals: DataFrame, *, bins: int = 18, value: str = "t") -> DataFrame:
    """(bin, n) over equal bins from the least to the largest value, the last closed. A32."""
    e = totals.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * bins)).cast("int")
    return totals.join(F.broadcast(e)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))  # e is one row


def testable_groups(cells: DataFrame, *, least: int = 50, by: str = "sample_id", label: str = "cell_type") -> DataFrame:
    """(by, label, n, testable): labels of ``least`` cells or more can be tested. A33."""
    return cells.filter(F.col(label).isNotNull()).groupBy(by, label).agg(F.count("*").alias("n")).withColumn("testable", F.col("n") >= least)


def dispersion_genes(expr: DataFrame, cells: DataFrame, *, bins: int = 20, top: int = 50) -> DataFrame:
    """(gene, mean, score, rank): log dispersion of expm1 values, standardised within bins of the mean. A18."""
    n = cells.agg(F.count("*").alias("cells"))
    v = F.expm1("value")
    g = expr.groupBy("gene").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q")).join(F.broadcast(n))  # n is one row
    mean = F.col("s") / F.col("cells")
    var = (F.col("q") - F.col("cells") * mean * mean) / F.greatest(F.col("cells") - 1, F.lit(1))
    g = g.select("gene", F.log1p(mean).alias("mean"), F.ln(var / mean).alias("d")).filter("d is not null")
    e = g.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    g = g.join(F.broadcast(e)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("mean") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * bins)))
    w = Window.partitionBy("bin")
    sd = F.stddev_samp("d").over(w)
    z = F.when(sd > 0, (F.col("d") - F.avg("d").over(w)) / sd).otherwise(F.lit(1.0))
    g = g.withColumn("score", F.bround(z, 6)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "gene")))
    return g.filter(F.col("rank") <= top).select("gene", F.bround("mean", 6).alias("mean"), "score", "rank")
