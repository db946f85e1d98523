"""Point patterns: tissue windows, Besag's L, envelopes, distance co-occurrence."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.identifiers import finite
from tessella.operators.spatial_join import near_pairs
from tessella.session import materialise, shuffle_partitions


def tissue_window(cells: DataFrame, bin_size: float, *, by: str = "sample_id") -> DataFrame:
    """(by, bx, by_, filled): occupied square bins from the lower corner, and empty bins with 6 or
    more occupied of their 8 neighbours.  P8.

    All bins are judged at once by the occupied ones (no order of filling).
    """
    c = cells.filter(finite("x") & finite("y"))
    lo = c.groupBy(by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    occ = c.join(lo, by).select(by, F.floor((F.col("x") - F.col("x0")) / bin_size).alias("bx"), F.floor((F.col("y") - F.col("y0")) / bin_size).alias("by_")).distinct()
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    near = occ.withColumn("s", F.explode(steps)).groupBy(by, (F.col("bx") + F.col("s.a")).alias("bx"), (F.col("by_") + F.col("s.b")).alias("by_")).agg(F.count("*").alias("k")).filter("k >= 6")
    new = near.join(occ, [by, "bx", "by_"], "left_anti").select(by, "bx", "by_", F.lit(True).alias("filled"))
    return occ.select(by, "bx", "by_", F.lit(False).alias("filled")).union(new)


def window_area(cells: DataFrame, bin_size: float, *, by: str = "sample_id") -> DataFrame:
    """(by, occupied, filled, area) of the tissue window. P8, P9."""
    w = tissue_window(cells, bin_size, by=by)
    return w.groupBy(by).agg(F.count_if(~F.col("filled")).alias("occupied"), F.count_if("filled").alias("filled"), (F.count("*") * F.lit(bin_size * bin_size)).alias("area"))


def uniform_points(window: DataFrame, sizes: DataFrame, bin_size: float, *, by: str = "sample_id", sims: int = 1, seed: str = "0") -> DataFrame:
    """(by, sim, i, x, y): uniform points in the bins of a window, by md5 uniforms. P10.

    ``sizes``: by, n.  The bin of a point is its uniform times the number of bins.
    """
    w = window.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("bx", "by_")) - 1)
    k = w.groupBy(by).agg(F.count("*").alias("bins"))
    u = lambda tag: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(tag), F.col(by), F.col("sim").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    p = sizes.join(k, by).withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims)))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    p = p.withColumn("r", F.floor(u("bin") * F.col("bins")).cast("int"))
    return p.join(w, [by, "r"]).select(by, "sim", "i", ((F.col("bx") + u("x")) * bin_size).alias("x"), ((F.col("by_") + u("y")) * bin_size).alias("y"))


def besag_l(points: DataFrame, areas: DataFrame, radii: list[float], *, group: str = "sample_id", key: str = "cell_id") -> DataFrame:
    """(group, radius, l): sqrt(K / pi), K = ordered pairs within r / n / (n / area), no edge correction. P11.

    ``areas``: group, area.  Pairs up to the largest radius are met by squares, then counted per radius.
    """
    pairs = near_pairs(points, max(radii), group=group, key=key)
    n = points.filter(finite("x") & finite("y")).groupBy(F.col(group)).agg(F.count("*").alias("n")).join(areas, group)
    r = F.array(*[F.lit(float(x)) for x in radii])
    first = F.size(F.filter(r, lambda v: v < F.col("distance") - 1e-9)) + 1
    hist = pairs.groupBy(F.col("group").alias(group), first.alias("j")).agg((2 * F.count("*")).alias("c"))
    grid = n.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(len(radii)))))
    cum = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy(group).orderBy("j"))
    g = grid.join(hist, [group, "j"], "left").withColumn("cum", cum)
    k = F.col("cum") / F.col("n") / (F.col("n") / F.col("area"))
    return g.select(group, F.element_at(r, F.col("j")).alias("radius"), F.bround(F.sqrt(k / F.lit(math.pi)), 6).alias("l"))


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull."""
    pts = np.unique(np.column_stack([x, y]), axis=0).tolist()
    ring: list[list[float]] = []
    for way in (pts, pts[::-1]):
        chain: list[list[float]] = []
        for q in way:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(q)
        ring += chain[:-1]
    h = np.array(ring or [[0.0, 0.0]])
    return float(abs((h[:, 0] * np.roll(h[:, 1], -1) - h[:, 1] * np.roll(h[:, 0], -1)).sum()) / 2)


def l_curve(x: np.ndarray, y: np.ndarray, radii: np.ndarray, area: float, chunk: int = 1_000_000) -> np.ndarray:
    """Besag's L of one pattern at rising radii; pairs are met by squares as large as the last. P11."""
    n, side = len(x), radii[-1] * (1 + 1e-9)
    sx, sy = np.floor((x - x.min()) / side).astype(np.int64) + 1, np.floor((y - y.min()) / side).astype(np.int64)
    wide = sx.max() + 2
    at = sy * wide + sx
    o = np.argsort(at, kind="stable")
    x, y, at = x[o], y[o], at[o]
    # later points of the own square and the next one; the three squares of the next row
    low = np.r_[np.arange(1, n + 1), np.searchsorted(at, at + wide - 1, "left")]
    high = np.r_[np.searchsorted(at, at + 1, "right"), np.searchsorted(at, at + wide + 1, "right")]
    who, many = np.r_[np.arange(n), np.arange(n)], high - low
    hist, ends, first = np.zeros(len(radii) + 1, np.int64), np.cumsum(many), 0
    while first < len(who):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + chunk, "right")))
        m = many[first:last]
        j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[first:last], m)
        i = np.repeat(who[first:last], m)
        d = np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2)
        hist += np.bincount(np.searchsorted(radii, d[d <= radii[-1]], "left"), minlength=len(radii) + 1)
        first = last
    return np.sqrt(2 * np.cumsum(hist[:-1]) / n / (n / area) / math.pi)


def verdict_of(curve: np.ndarray, null: np.ndarray, radii: np.ndarray, effect: float = 0.05) -> tuple:
    """(verdict, above, below, relative effect, peak radius, peak deviation) of L against simulated curves. P12.

    Clustered or dispersed needs half of the radii outside the 2.5/97.5 envelope on that side and a
    largest deviation from the simulations' median of ``effect`` of the radius; outside by less is
    consistent_with_csr; some excursion without half is scale_dependent; else consistent_with_csr.
    """
    use = radii > 0
    r, lo, hi = radii[use], *np.quantile(null[:, use], [0.025, 0.975], axis=0)
    dev = curve[use] - np.median(null[:, use], axis=0)
    above, below, most = float((curve[use] > hi).mean()), float((curve[use] < lo).mean()), float(np.abs(dev / r).max())
    if max(above, below) < 0.5:
        verdict = "scale_dependent" if above or below else "consistent_with_csr"
    else:
        verdict = "consistent_with_csr" if most < effect else "clustered" if above >= 0.5 else "dispersed"
    way = {"clustered": dev, "dispersed": -dev}.get(verdict, np.abs(dev))
    peak = int(np.argmax(way if way.max() > 0 else np.abs(dev)))
    return verdict, round(above, 4), round(below, 4), round(most, 4), round(float(r[peak]), 2), round(float(dev[peak]), 3)


def ripley_verdicts(cells: DataFrame, nearest: DataFrame, *, sims: int = 100, steps: int = 40, least: int = 50, multiple: float = 12.0, seed: str = "0") -> DataFrame:
    """(sample_id, cell_type, n, verdict, above, below, effect, peak_radius, peak_deviation) of labels of ``least`` cells or more. P8-P12.

    ``nearest``: (sample_id, d2), one row a cell.  Each label is judged against ``sims`` patterns (20 at
    least) of its own number of points in the tissue window of the whole sample; ``steps`` radii (10 at
    least) from 0 to ``multiple`` median nearest-neighbour distances or a quarter of the smaller
    span.  Bins hold 4 cells: sized by the convex hull, then by the window so found.  A task holds one
    label of one sample and simulates a share of its patterns.
    """
    sims, steps = max(20, sims), max(10, steps)
    c = cells.filter("sample_id is not null").select("sample_id", "cell_id", "x", "y", "cell_type")

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        spans = [v for v in (np.ptp(x), np.ptp(y)) if v > 0]
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "n": [len(x)], "hull": [hull_area(x, y) or float(np.ptp(x) * np.ptp(y))], "span": [float(min(spans, default=0.0))]})

    near = nearest.groupBy("sample_id").agg(F.percentile(F.sqrt("d2"), 0.5).alias("near"))
    box = c.select("sample_id", "x", "y").groupBy("sample_id").applyInPandas(hull, "sample_id string, n long, hull double, span double").join(near, "sample_id")
    side = lambda area: F.greatest(F.sqrt(4.0 * F.col(area) / F.col("n")), F.col("near"))
    box = materialise(box.filter("near > 0 and n >= 3 and span > 0").withColumn("bin", side("hull")))
    scaled = lambda b: c.join(b, "sample_id").select("sample_id", (F.col("x") / F.col("bin")).alias("x"), (F.col("y") / F.col("bin")).alias("y"))
    area = window_area(scaled(box), 1.0).select("sample_id", "area").join(box, "sample_id").select("sample_id", (F.col("area") * F.col("bin") * F.col("bin")).alias("area"))
    box = materialise(box.join(area, "sample_id").withColumn("bin", side("area")).select("sample_id", "near", "span", "bin"))
    win = materialise(tissue_window(scaled(box), 1.0).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.array(F.col("bx"), F.col("by_")))).alias("bins")).join(box, "sample_id"))
    g = c.filter("cell_type is not null").groupBy("sample_id", "cell_type").agg(F.array_sort(F.collect_list(F.array("x", "y"))).alias("xy")).filter(F.size("xy") >= least)
    share = F.least(F.lit(sims), F.ceil(F.size("xy") * F.lit(sims) / F.lit(200_000))).cast("int")
    t = g.withColumn("parts", share).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("n", F.size("xy"))
    t = t.withColumn("xy", F.when(F.col("part") == 0, F.col("xy"))).join(win, "sample_id").repartition(4 * shuffle_partitions(c.sparkSession), "sample_id", "cell_type", "part")

    def curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                bins, radii = np.array([list(v) for v in r.bins], float), np.linspace(0.0, min(multiple * r.near, 0.25 * r.span), steps)
                all_ = len(bins) * r.bin * r.bin
                if r.part == 0:
                    xy = np.array([list(v) for v in r.xy])
                    out.append((r.sample_id, r.cell_type, r.n, 0, radii, l_curve(xy[:, 0], xy[:, 1], radii, all_)))
                for s in range(1 + r.part, sims + 1, r.parts):
                    rng = np.random.default_rng(int(hashlib.md5(f"{seed}|{r.sample_id}|{r.cell_type}|{s}".encode()).hexdigest(), 16))
                    xy = (bins[rng.integers(0, len(bins), r.n)] + rng.random((r.n, 2))) * r.bin
                    out.append((r.sample_id, r.cell_type, r.n, s, radii, l_curve(xy[:, 0], xy[:, 1], radii, all_)))
            yield pd.DataFrame(out, columns=["sample_id", "cell_type", "n", "sim", "radii", "l"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sim")
        l_, one = np.stack(pdf["l"].to_list()), pdf.iloc[0]
        return pd.DataFrame([(one["sample_id"], one["cell_type"], one["n"], *verdict_of(l_[0], l_[1:], np.asarray(one["radii"])))], columns=["sample_id", "cell_type", "n", "verdict", "above", "below", "effect", "peak_radius", "peak_deviation"])

    drawn = t.mapInPandas(curves, "sample_id string, cell_type string, n long, sim int, radii array<double>, l array<double>")
    return drawn.groupBy("sample_id", "cell_type").applyInPandas(judge, "sample_id string, cell_type string, n long, verdict string, above double, below double, effect double, peak_radius double, peak_deviation double")


def co_occurrence(cells: DataFrame, radii: list[float], *, by: str = "sample_id", label: str = "cell_type") -> DataFrame:
    """(a, b, radius, ratio): P(b near a) / P(b) within each radius, over all samples. P13."""
    c = cells.filter(F.col(label).isNotNull())
    p = near_pairs(c, max(radii), group=by)
    both = p.select(F.col("key_a").alias("s"), F.col("key_b").alias("t"), "distance").union(p.select("key_b", "key_a", "distance"))
    lab = c.select(F.col("cell_id"), F.col(label).alias("l"))
    r = F.array(*[F.lit(float(x)) for x in radii])
    first = F.size(F.filter(r, lambda v: v < F.col("distance") - 1e-9)) + 1
    h = both.join(lab.withColumnsRenamed({"cell_id": "s", "l": "a"}), "s").join(lab.withColumnsRenamed({"cell_id": "t", "l": "b"}), "t").groupBy("a", "b", first.alias("j")).agg(F.count("*").alias("n"))
    h = h.withColumn("j", F.explode(F.sequence(F.col("j"), F.lit(len(radii))))).groupBy("a", "b", "j").agg(F.sum("n").alias("n"))
    h = h.withColumn("na", F.sum("n").over(Window.partitionBy("a", "j"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b", "j"))).withColumn("nn", F.sum("n").over(Window.partitionBy("j")))
    return h.select("a", "b", F.element_at(r, F.col("j")).alias("radius"), F.bround(F.col("n") * F.col("nn") / (F.col("na") * F.col("nb").cast("double")), 6).alias("ratio"))
