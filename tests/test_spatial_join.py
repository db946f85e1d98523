import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators.spatial_join import TriangleBVH, ear_clip, near_pairs, points_in_outlines


def crossing(px, py, xs, ys):
    """Even-odd rule."""
    inside, n = False, len(xs)
    for i in range(n):
        x1, y1, x2, y2 = xs[i], ys[i], xs[(i + 1) % n], ys[(i + 1) % n]
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def star(seed, n):
    rng = np.random.default_rng(seed)
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    while (np.diff(np.r_[a, a[0] + 2 * np.pi]) > 2.5).any():
        a = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(5, 50, n)
    return r * np.cos(a), r * np.sin(a)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(5, 40), st.booleans(), st.booleans())
def test_triangles_cover_the_outline(seed, n, back, closed):
    xs, ys = star(seed, n)
    area = abs((xs * np.roll(ys, -1) - np.roll(xs, -1) * ys).sum()) / 2
    if back:
        xs, ys = xs[::-1], ys[::-1]
    if closed:
        xs, ys = np.r_[xs, xs[0]], np.r_[ys, ys[0]]
    t = ear_clip(xs, ys)
    u, v = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    assert math.isclose(np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2, area, rel_tol=1e-9)
    p = np.random.default_rng(seed).uniform(-50, 50, (50, 2))
    hit = np.zeros(50, bool)
    for i, _ in TriangleBVH(t).hits(p[:, 0], p[:, 1]):
        hit[i] = True
    assert hit.tolist() == [crossing(x, y, xs, ys) for x, y in p]


def test_outlines_without_area():
    assert len(ear_clip([], [])) == 0
    assert len(ear_clip([1, 2], [1, 2])) == 0
    assert len(ear_clip([0, 1, 2, 0], [0, 0, 0, 0])) == 0
    assert len(ear_clip([0, float("nan"), 1, 1], [0, 5, 0, 1])) == 1


CELLS = "sample_id string, cell_id string, x double, y double, group string, k string"


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 2}", f"c{i:03}", float(x), float(y), "clash", "clash") for i, (x, y) in enumerate(rng.uniform(-40, 40, (300, 2)).round(0))]
    rows += [("s0", "nan", float("nan"), 0.0, "", ""), ("s0", "null", None, 0.0, "", ""), ("s0", "inf", 0.0, float("inf"), "", ""), (None, "nos", 0.0, 0.0, "", ""), ("s0", None, 0.0, 0.0, "", "")]
    got = {(r.key_a, r.key_b) for r in near_pairs(spark.createDataFrame(rows, CELLS), 5.0).collect()}
    ok = [r for r in rows[:300]]
    want = {(a[1], b[1]) for i, a in enumerate(ok) for b in ok[i + 1 :] if a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 25}
    assert got == want and len(want) > 50
    assert near_pairs(spark.createDataFrame([], CELLS), 5.0).count() == 0


def test_points_in_outlines(spark):
    shapes = [("s", 7, [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0]), ("s", 3, [10.0, 20.0, 20.0, 10.0], [0.0, 0.0, 10.0, 10.0]), ("t", 9, [0.0, 10.0, 10.0], [0.0, 0.0, 10.0]), ("s", 11, [1.0], [1.0]), ("s", 12, None, None)]
    s = spark.createDataFrame(shapes, "sample_id string, shape_id long, xs array<double>, ys array<double>")
    pts = [("s", "in7", 5.0, 5.0), ("s", "edge", 10.0, 5.0), ("s", "in3", 15.0, 5.0), ("s", "out", 30.0, 5.0), ("t", "tri", 8.0, 2.0), ("t", "tri_out", 2.0, 8.0), ("s", "nan", float("nan"), 1.0), ("u", "none", 5.0, 5.0)]
    p = spark.createDataFrame(pts, "sample_id string, cell_id string, x double, y double")
    for tile, most in ((2048.0, 50_000), (4.0, 1)):  # small tiles and crowded ones give the same
        got = {(r.cell_id, r.shape_id) for r in points_in_outlines(p, s, tile=tile, tile_points=most).collect()}
        assert got == {("in7", 7), ("edge", 3), ("in3", 3), ("tri", 9)}
    assert points_in_outlines(p.limit(0), s).count() == 0 and points_in_outlines(p, s.limit(0)).count() == 0
