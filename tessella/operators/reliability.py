"""Reliability of claims: evidence strength, components, weakest link, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import two_sided_p


def evidence_strength(p: Column) -> Column:
    """1 for p of 0 or less, 0 from 1 on, else min(1, -log10(p) / 3). C3."""
    return F.when(p <= 0, 1.0).when(p >= 1, 0.0).otherwise(F.least(F.lit(1.0), -F.log10(p) / 3))


def statistical_support(pairs: DataFrame) -> DataFrame:
    """Strength of each pair: adjusted p, else raw p times the pairs tested, else from z. C4.

    Columns: a, b, z, p, p_adj, tested; the first present evidence counts.
    """
    from_z = two_sided_p(F.col("z")) * F.col("tested")
    p = F.coalesce("p_adj", F.least(F.col("p") * F.col("tested"), F.lit(1.0)), F.least(from_z, F.lit(1.0)))
    return pairs.withColumn("strength", evidence_strength(p))


def robustness_component(present: Column, sign: Column, top: Column) -> Column:
    """present * (0.6 sign + 0.4 top), each within 0 and 1. C7."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    return unit(present) * (0.6 * unit(sign) + 0.4 * unit(top))


def weakest_link(*components: Column) -> Column:
    """Least of the components, each cut to [0, 1], to 4 digits; nulls are skipped, none gives 0. C8."""
    cut = [F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))) for c in components]
    return F.bround(F.coalesce(F.least(*cut) if len(cut) > 1 else cut[0], F.lit(0.0)), 4)


def grounded(required: Column, evidence: Column) -> Column:
    """grounded if the evidence covers all that is required, softened if some, else dropped. C1."""
    missing = F.size(F.array_except(required, evidence))
    return F.when(missing == 0, "grounded").when(missing < F.size(F.array_distinct(required)), "softened").otherwise("dropped")


def logistic_calibration(rows: DataFrame, components: list[str], *, least: int = 4, c: float = 10.0) -> dict:
    """Coefficients of the probability that a claim is right; ``not_fit`` with few records or one class. C9.

    rows: the component columns and ``truth`` (boolean).  The penalty is 1 / c over the records.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    use = rows.filter("truth is not null").na.drop(subset=components)
    seen = use.agg(F.count("*").alias("n"), F.count_distinct("truth").alias("k")).first()
    if seen.n < least or seen.k < 2:
        return {"status": "not_fit", "records": seen.n}
    data = VectorAssembler(inputCols=components, outputCol="x").transform(use.withColumn("y", F.col("truth").cast("double")))
    m = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (c * seen.n), standardization=False).fit(data)
    return {"status": "fit", "records": seen.n, "intercept": float(m.intercept), "coefficients": dict(zip(components, map(float, m.coefficients), strict=True))}


def donor_disjoint(rows: DataFrame, splits: tuple[str, ...] = ("train", "calibration", "test")) -> DataFrame:
    """(ok, reason): all splits there, both classes in each, and no donor in two. C12."""
    s = rows.groupBy("split").agg(F.count_distinct("truth").alias("k"))
    shared = rows.groupBy("donor_id").agg(F.count_distinct("split").alias("m")).agg(F.count_if(F.col("m") > 1).alias("shared"))
    a = s.filter(F.col("split").isin(*splits)).agg(F.count("*").alias("n"), F.coalesce(F.min("k"), F.lit(0)).alias("least"))
    why = F.when(F.col("n") < len(splits), "missing_split").when(F.col("least") < 2, "one_class").when(F.col("shared") > 0, "shared_donors").otherwise("")
    return a.join(F.broadcast(shared)).select((why == "").alias("ok"), why.alias("reason"))  # one row each
