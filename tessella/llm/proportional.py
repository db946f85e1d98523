"""Samples that match wanted shares of categories.

Per category a probability of acceptance follows from needed and observed counts; rows are
accepted independently by a hash of their key with a slight excess, the few accepted rows are
counted off exactly, and what could not be met is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialise


def needed_rows(share: Column, least: Column, size: Column) -> Column:
    """The larger of the minimum and the share of the sample, rounded to the nearest integer."""
    return F.greatest(F.coalesce(least, F.lit(0)).cast("long"), F.floor(F.coalesce(share, F.lit(0.0)) * F.coalesce(size, F.lit(0)) + 0.5 + 1e-9).cast("long"))


def wanted_and_there(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Targets with ``need`` and ``there``, the rows of their stratum and category (0 if none).

    ``targets``: draw, stratum, category, share, least, size.  ``rows``: stratum, category, item.
    A target whose category is null wants nothing that exists.  Equal targets of a draw are
    each kept.
    """
    there = rows.groupBy("stratum", "category").agg(F.count("*").alias("there"))
    t = targets.withColumn("need", needed_rows(F.col("share"), F.col("least"), F.col("size")))
    return t.join(there, ["stratum", "category"], "left").withColumn("there", F.coalesce("there", F.lit(0)))


def _lowest(rows: DataFrame, by: list[str], limit: Column, step_rows: int = 50_000) -> DataFrame:
    """The ``limit`` rows of lowest (u, item) of every group; u lies in [0, 1), limit is the same throughout a group.

    u is cut into as many steps as the limit has times ``step_rows``; rows are ranked within
    their step and the counts of the steps before are added, so no task ranks a large group.
    """
    r = rows.withColumn("__limit", limit).withColumn("__step", F.floor(F.col("u") * F.ceil(F.col("__limit") / F.lit(step_rows))).cast("int"))
    n = r.groupBy(*by, "__step").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("__before", before).filter("__before > 0").select(*by, "__step", "__before")
    order = F.row_number().over(Window.partitionBy(*by, "__step").orderBy("u", "item"))
    ranked = r.withColumn("__rank", order).filter("__rank <= __limit").join(n, [*by, "__step"], "left")
    return ranked.filter("coalesce(__before, 0) + __rank <= __limit").select(*rows.columns)


def draw(targets: DataFrame, rows: DataFrame, *, seed: int = 17, sigmas: float = 6.0) -> DataFrame:
    """(draw, stratum, category, item): ``min(need, there)`` rows of each category, chosen by a seeded hash.

    A row is accepted if its uniform hash is below p = (need + sigmas * sqrt(need) + sigmas^2) /
    there.  The expected excess is small, so the exact count is taken from few rows.  The hash is
    stretched over all of [0, 1) and p reaches 1 wherever need is not far below there; should
    fewer than needed be accepted (less than one draw in 10^8), the shortfall is filled from the
    rejected rows, so counts are always exact.  Equal targets of a draw count as the largest of them.
    """
    by = ["draw", "stratum", "category"]
    t = materialise(wanted_and_there(targets, rows).filter("there > 0 and need > 0").groupBy(*by).agg(F.max("need").alias("need"), F.max("there").alias("there")))
    p = F.least((F.col("need") + sigmas * F.sqrt("need") + sigmas * sigmas) / F.col("there"), F.lit(1.0))
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", "item"), F.lit(1 << 40)) / float(1 << 40)
    met = rows.join(t, ["stratum", "category"]).withColumn("u", u).withColumn("p", p)
    accepted = materialise(met.filter("u < p").select(*by, "item", (F.col("u") / F.col("p")).alias("u"), "need", "there"))
    exact = _lowest(accepted, by, F.col("need")).select(*by, "item")
    got = accepted.groupBy(*by).agg(F.count("*").alias("got"))
    short = materialise(t.join(got, by, "left").withColumn("gap", F.least("need", "there") - F.coalesce("got", F.lit(0))).filter("gap > 0").select(*by, "gap"))
    if short.isEmpty():
        return exact
    rest = met.filter("u >= p").join(short, by).withColumn("u", (F.col("u") - F.greatest("p", F.lit(0.0))) / (1 - F.greatest("p", F.lit(0.0))))
    return exact.unionByName(_lowest(rest, by, F.col("gap")).select(*by, "item"))


def report(targets: DataFrame, rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """Every target with ``need``, ``there`` and, counted from the sample ``drawn``, ``drawn`` and ``missing`` rows."""
    by = ["draw", "stratum", "category"]
    n = drawn.groupBy(*by).agg(F.count("*").alias("__drawn"))
    t = wanted_and_there(targets, rows).join(n, by, "left").withColumn("drawn", F.least(F.coalesce("__drawn", F.lit(0)), "need"))
    return t.drop("__drawn").withColumn("missing", F.col("need") - F.col("drawn"))
