"""Clusters of cells in expression space and of cells on the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialise


def expression_clusters(expr: DataFrame, *, resolution: float = 0.5, components: int = 30, buckets: int = 1024, seed: int = 0) -> DataFrame:
    """(cell_id, cluster): k-means on principal components of hashed expression. P16.

    Cells without expression have no row.  The number of clusters grows with the resolution
    (about 20 at 0.5).  Ids are this engine's own: a stand-in for graph clustering, alike on
    planted structure only.  ``buckets`` bounds the dense width whatever the panel.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    g = expr.filter("value > 0").select("cell_id", F.pmod(F.xxhash64("gene"), F.lit(buckets)).cast("int").alias("b"), "value").groupBy("cell_id", "b").agg(F.sum("value").alias("v"))
    m = g.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"))
    used = [r.b for r in g.select("b").distinct().orderBy("b").collect()]  # at most ``buckets`` numbers
    dense = F.transform(F.lit(used).cast("array<int>"), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0)))
    x = materialise(m.select("cell_id", dense.alias("a"))).select("cell_id", array_to_vector("a").alias("x"))
    k = max(2, round(resolution * 40))
    pc = PCA(k=min(components, len(used)), inputCol="x", outputCol="pc").fit(x).transform(x).select("cell_id", "pc")
    model = KMeans(k=k, featuresCol="pc", predictionCol="cluster", seed=seed).fit(pc)
    return model.transform(pc).select("cell_id", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("cluster"))


def spatial_domains(cells: DataFrame, bin_size: float, *, least: int = 100) -> DataFrame:
    """(cell_id, domain): connected occupied squares of the map, named by size; domains under ``least`` cells are null. P17, A12."""
    c = cells.select("sample_id", "cell_id", F.floor(F.col("x") / bin_size).alias("bx"), F.floor(F.col("y") / bin_size).alias("by"))
    bins = materialise(c.select("sample_id", "bx", "by").distinct().withColumn("root", F.struct("bx", "by")))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while True:  # each round takes the smallest root among neighbours, then the root's own root
        near = bins.withColumn("s", F.explode(steps)).select("sample_id", (F.col("bx") + F.col("s.a")).alias("bx"), (F.col("by") + F.col("s.b")).alias("by"), F.col("root").alias("r"))
        new = bins.join(near, ["sample_id", "bx", "by"]).groupBy("sample_id", "bx", "by", "root").agg(F.min("r").alias("r"))
        up = bins.select("sample_id", F.struct("bx", "by").alias("r"), F.col("root").alias("rr"))
        new = materialise(new.join(up, ["sample_id", "r"]).select("sample_id", "bx", "by", "root", F.least("r", "rr").alias("r")))
        moved = not new.filter("r <> root").isEmpty()
        bins = new.select("sample_id", "bx", "by", F.col("r").alias("root"))
        if not moved:
            break
    d = c.join(bins, ["sample_id", "bx", "by"])
    size = d.groupBy("sample_id", "root").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    size = size.withColumn("domain", F.concat(F.lit("domain_"), F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("n"), "root")).cast("string")))
    return d.join(size, ["sample_id", "root"], "left").select("cell_id", "domain")
