"""Points near other points, and points inside outlines.

``near_pairs`` is a grid-bucketed equi join.  ``points_in_outlines`` cuts outlines into
triangles by ear clipping, spreads the triangles over map tiles, and tests the points of a
tile against a bounding-volume hierarchy of its triangles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.identifiers import finite
from tessella.session import shuffle_partitions


def near_pairs(points: DataFrame, radius: float, *, group: str = "sample_id", key: str = "cell_id", x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of different points of one group at most ``radius`` apart: (group, key_a, key_b, distance).

    The smaller key is ``key_a``.  Points with a null group, null key or non-finite position
    are left out.  Every key must stand once.  Squares of side ``radius`` are the join key; a
    point is kept in its own square and asks that square and four of its neighbours, so each
    pair is met exactly once.  An edge of 1e-10 of the radius is granted to binary rounding.
    """
    side = radius * (1 + 1e-9)
    p = (
        points.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .filter(F.col("g").isNotNull() & F.col("k").isNotNull() & finite("x") & finite("y"))
        .withColumn("sx", F.floor(F.col("x") / side)).withColumn("sy", F.floor(F.col("y") / side))
    )
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    asking = p.select("g", F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "sx", "sy", F.explode(steps).alias("s")).select(
        "g", "k2", "x2", "y2", (F.col("sx") + F.col("s.dx")).alias("sx"), (F.col("sy") + F.col("s.dy")).alias("sy"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("own")
    )
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    met = p.join(asking, ["g", "sx", "sy"]).filter((d2 <= radius * radius * (1 + 1e-10)) & (~F.col("own") | (F.col("k") < F.col("k2"))))
    return met.select(
        F.col("g").alias("group"),
        F.least("k", "k2").alias("key_a"),
        F.greatest("k", "k2").alias("key_b"),
        F.sqrt(d2).alias("distance"),
    )


def ear_clip(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Triangles (n, 3, 2) of a simple outline of any direction; n is 0 without an area.

    A repeated first corner, repeated neighbours and non-finite corners are dropped first.
    Where rounding leaves no proper ear, the flattest corner is cut off.
    """
    pts = np.column_stack([np.asarray(xs, float), np.asarray(ys, float)])
    pts = pts[np.isfinite(pts).all(axis=1)]
    if len(pts):
        pts = pts[np.r_[True, (np.diff(pts, axis=0) != 0).any(axis=1)]]
    while len(pts) > 1 and (pts[0] == pts[-1]).all():
        pts = pts[:-1]
    if len(pts) < 3:
        return np.empty((0, 3, 2))
    nxt = np.roll(pts, -1, axis=0)
    if (pts[:, 0] * nxt[:, 1] - nxt[:, 0] * pts[:, 1]).sum() < 0:
        pts = pts[::-1]
    before, after = np.roll(np.arange(len(pts)), 1), np.roll(np.arange(len(pts)), -1)
    out, left = [], len(pts)
    inside = np.ones(len(pts), bool)  # corners still in the ring

    def cross(o, a, b):
        return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])

    def is_ear(i: int) -> bool:
        a, b, c = pts[before[i]], pts[i], pts[after[i]]
        if turn[i] <= 0:
            return False
        # only corners that are not convex can lie in an ear
        rest = pts[inside & (turn <= 0) & (xy[:, 0] >= min(a[0], b[0], c[0])) & (xy[:, 0] <= max(a[0], b[0], c[0]))]
        rest = rest[~((rest == a).all(1) | (rest == b).all(1) | (rest == c).all(1))]
        held = np.ones(len(rest), bool)
        for p, q in ((a, b), (b, c), (c, a)):
            held &= (q[0] - p[0]) * (rest[:, 1] - p[1]) - (q[1] - p[1]) * (rest[:, 0] - p[0]) >= 0
        return not held.any()

    xy, turn = pts, cross(pts[before], pts, pts[after])
    at, tried = 0, 0
    while left > 3:
        if tried > left:  # no proper ear: the flattest corner goes
            ring = np.flatnonzero(inside)
            at = int(ring[np.argmin(np.abs(turn[ring]))])
        elif not is_ear(at):
            at, tried = int(after[at]), tried + 1
            continue
        a, c = int(before[at]), int(after[at])
        if turn[at] != 0:
            out.append(pts[[a, at, c]])
        inside[at] = False
        after[a], before[c] = c, a
        turn[a], turn[c] = cross(pts[before[a]], pts[a], pts[c]), cross(pts[a], pts[c], pts[after[c]])
        left, tried, at = left - 1, 0, a
    tri = pts[np.flatnonzero(inside)]
    if cross(tri[0], tri[1], tri[2]) != 0:
        out.append(tri)
    return np.array(out).reshape(-1, 3, 2)


class TriangleBVH:
    """Bounding-volume hierarchy of triangles in flat arrays, asked with blocks of points."""

    LEAF = 8

    def __init__(self, tri: np.ndarray):
        self.tri = tri
        lo, hi = tri.min(axis=1), tri.max(axis=1)
        mid = (lo + hi) / 2
        boxes, kids, leaves, stack = [], [], [], [(np.arange(len(tri)), -1, 0)]
        while stack:
            ids, parent, side = stack.pop()
            node = len(boxes)
            boxes.append(np.r_[lo[ids].min(axis=0), hi[ids].max(axis=0)])
            kids.append([-1, -1])
            if parent >= 0:
                kids[parent][side] = node
            if len(ids) <= self.LEAF:
                leaves.append(ids)
                continue
            leaves.append(None)
            axis = int(np.argmax(np.ptp(mid[ids], axis=0)))
            ids = ids[np.argsort(mid[ids, axis], kind="stable")]
            half = len(ids) // 2
            stack += [(ids[:half], node, 0), (ids[half:], node, 1)]
        self.boxes, self.kids, self.leaves = np.array(boxes).reshape(-1, 4), kids, leaves

    def hits(self, px: np.ndarray, py: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of arrays (point, triangle): the point is in the triangle or on its edge."""
        stack = [(0, np.arange(len(px)))] if len(self.boxes) else []
        while stack:
            node, ids = stack.pop()
            x0, y0, x1, y1 = self.boxes[node]
            ids = ids[(px[ids] >= x0) & (px[ids] <= x1) & (py[ids] >= y0) & (py[ids] <= y1)]
            if not len(ids):
                continue
            if self.leaves[node] is None:
                stack += [(k, ids) for k in self.kids[node]]
                continue
            t = self.leaves[node]
            a, b, c = (self.tri[t][:, i] for i in range(3))
            X, Y = px[ids][:, None], py[ids][:, None]
            ok = np.ones((len(ids), len(t)), bool)
            for p, q in ((a, b), (b, c), (c, a)):
                ok &= (q[:, 0] - p[:, 0]) * (Y - p[:, 1]) - (q[:, 1] - p[:, 1]) * (X - p[:, 0]) >= 0
            i, j = np.nonzero(ok)
            yield ids[i], t[j]


def triangulate(shapes: DataFrame, *, group: str = "sample_id", shape: str = "shape_id", xs: str = "xs", ys: str = "ys") -> DataFrame:
    """Triangles of every outline: (g, s, t: six doubles). Outlines with unequal or null arrays give none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g, s, t = [], [], []
            for row in pdf.itertuples(index=False):
                if row.xs is None or row.ys is None or len(row.xs) != len(row.ys):
                    continue
                tri = ear_clip(np.array(row.xs, float), np.array(row.ys, float))
                g += [row.g] * len(tri)
                s += [row.s] * len(tri)
                t += list(tri.reshape(-1, 6))
            yield pd.DataFrame({"g": pd.Series(g, dtype=object), "s": pd.Series(s, dtype="int64"), "t": pd.Series(t, dtype=object)})

    src = shapes.select(F.col(group).cast("string").alias("g"), F.col(shape).cast("long").alias("s"), F.col(xs).cast("array<double>").alias("xs"), F.col(ys).cast("array<double>").alias("ys"))
    # clipping is the costly step, so outlines are spread over all cores whatever their few bytes; by
    # another expression than the keys before, as an equal distribution would be dropped from the plan
    cores = shapes.sparkSession.sparkContext.defaultParallelism
    src = src.filter("g is not null and s is not null").dropDuplicates(["g", "s"]).repartition(min(2 * cores, shuffle_partitions(shapes.sparkSession)), F.xxhash64("g", "s"))
    return src.mapInPandas(cut, "g string, s long, t array<double>")


def points_in_outlines(
    points: DataFrame, shapes: DataFrame, *, group: str = "sample_id", key: str = "cell_id", x: str = "x", y: str = "y",
    shape: str = "shape_id", xs: str = "xs", ys: str = "ys", tile: float = 2048.0, tile_points: int = 50_000,
) -> DataFrame:
    """For each point the outline of its group that contains it: (key, shape).

    A point on a border shared by outlines goes to the smallest shape id; points outside all
    outlines, with a null group or key or a non-finite position, have no row.  Triangles are
    copied to each square of side ``tile`` that their box touches.  Squares with more than
    ``tile_points`` points are dealt to several groups by a hash of the point's key, and their
    triangles copied to each, so no task gets more than its share of a crowded place.
    """
    tri = triangulate(shapes, group=group, shape=shape, xs=xs, ys=ys)
    low = lambda i: F.floor(F.array_min(F.array(*[F.col("t")[j] for j in (i, i + 2, i + 4)])) / tile)
    high = lambda i: F.floor(F.array_max(F.array(*[F.col("t")[j] for j in (i, i + 2, i + 4)])) / tile)
    tri = tri.withColumn("tx", F.explode(F.sequence(low(0), high(0)))).withColumn("ty", F.explode(F.sequence(low(1), high(1))))
    p = (
        points.select(F.col(group).cast("string").alias("g"), F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .filter(F.col("g").isNotNull() & F.col("k").isNotNull() & finite("x") & finite("y"))
        .withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    )
    tiles = ["g", "tx", "ty"]
    crowded = p.groupBy(*tiles).agg(F.ceil(F.count("*") / F.lit(tile_points)).cast("int").alias("parts")).filter("parts > 1")
    p = p.join(crowded, tiles, "left").withColumn("part", F.pmod(F.xxhash64("k"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    tri = tri.join(crowded, tiles, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def locate(pts: pd.DataFrame, tris: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(tris):
            return pd.DataFrame({"k": pd.Series([], dtype=object), "s": pd.Series([], dtype="int64")})
        t = np.array([np.asarray(v, float) for v in tris["t"]]).reshape(-1, 3, 2)
        owner = tris["s"].to_numpy()
        best = np.full(len(pts), np.iinfo(np.int64).max)
        for i, j in TriangleBVH(t).hits(pts["x"].to_numpy(), pts["y"].to_numpy()):
            np.minimum.at(best, i, owner[j])
        hit = best < np.iinfo(np.int64).max
        return pd.DataFrame({"k": pts["k"].to_numpy()[hit], "s": best[hit]})

    kind = p.schema["k"].dataType.simpleString()
    found = p.groupBy(*tiles, "part").cogroup(tri.groupBy(*tiles, "part")).applyInPandas(locate, f"k {kind}, s long")
    return found.select(F.col("k").alias(key), F.col("s").alias(shape))
