"""A third of all rows in one place: results stay whole and exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import birch, linked_split, similar, top_n
from tessella.llm.sparse import packed_vectors

VEC = "cell_id string, gene string, value double"


def vectors(spark, rows):
    return packed_vectors(spark.createDataFrame(rows, VEC), "cell_id", F.col("gene"), F.col("value")).cache()


def test_copies_are_a_third(spark):
    rows = [(f"copy{i:03}", f"F{f}", 5.0) for i in range(300) for f in (1, 2, 3)]
    rows += [(f"c{i:03}", f"G{i}_{f}", 3.0 + f) for i in range(600) for f in range(3)]
    v = vectors(spark, rows)
    for block in (4096, 16):  # at 16 the copies are a large component, folded by weight
        got = birch.tight_groups(birch.clusters(v), block=block).collect()
        assert {(r.cluster_first, r.k) for r in got} == {("copy000", f"copy{i:03}") for i in range(300)}
    near = similar.similar(v, 5, min_similarity=0.9)
    assert near.count() == 300 * 5 and near.filter("a = b").count() == 0
    # a crowd in one batch is dealt to tasks of the batch's own, and still one cluster
    leaves = birch.cf_leaves(v.withColumnRenamed("cell_id", "k"), crowd=50, chunk=64)
    assert leaves.agg(F.sum("n")).first()[0] == 900


def test_a_cell_delivered_again_and_again(spark):
    rows = [("hot", "A", 3.0), ("hot", "B", 4.0)] * 3000 + [(f"c{i}", "A", 1.0) for i in range(50)]
    v = vectors(spark, rows)
    assert v.count() == 51 and len(v.filter("cell_id = 'hot'").first().vec) == 24


def test_hot_group_and_hot_link(spark):
    rows = [("hot", f"i{i:05}", float(i % 100)) for i in range(6000)] + [(f"g{i}", f"i{j}", float(j)) for i in range(500) for j in range(4)]
    got = top_n.top_n_per_group(spark.createDataFrame(rows, "g string, item string, score double").repartition(7), ["g"], "score", "item", 2, run_rows=100)
    assert [r.item for r in got.filter("g = 'hot'").orderBy("rank").collect()] == ["i00099", "i00199"] and got.count() == 2 + 500 * 2
    recs = [(f"r{i}", "HOT" if i % 3 == 0 else f"S{i}", None) for i in range(900)]
    g = linked_split.linked_groups(spark.createDataFrame(recs, "id string, s string, p string"), "id", [linked_split.sample_key("s"), linked_split.path_key("p")])
    assert g.groupBy("group").count().agg(F.max("count")).first()[0] == 300
    s = {r.split: r["count"] for r in linked_split.assign_splits(g, "id", ["train", "validation", "test"], [0.8, 0.1, 0.1]).groupBy("split").count().collect()}
    assert s == {"train": 720, "validation": 90, "test": 90}


def cloud(groups=12, size=120, genes=18, seed=3):
    """Groups of cells that differ by noise alone, so that the nearest are hard to tell apart."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        own, base = rng.choice(200, genes, replace=False), rng.uniform(1, 6, genes)
        for i in range(size):
            rows += [(f"g{g}_{i}", f"F{f}", float(v)) for f, v in zip(own, base * rng.uniform(0.9, 1.1, genes), strict=True)]
    return rows


def exact(rows, k, least):
    cells, genes = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    ci, gi = ({x: i for i, x in enumerate(v)} for v in (cells, genes))
    x = np.zeros((len(cells), len(genes)))
    for c, g, v in rows:
        x[ci[c], gi[g]] = v
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(cells[i], cells[j]) for i in range(len(cells)) for j in best[i].tolist() if s[i, j] >= least}


@pytest.mark.parametrize("shard_rows", [16_000, 200, 40])
def test_recall_does_not_depend_on_the_size_of_shards(spark, shard_rows):
    """Shards of 40 rows force several further draws of every crowded feature."""
    rows = cloud()
    v, want = vectors(spark, rows), exact(rows, 5, 0.99)
    got = {(r.a, r.b) for r in similar.similar(v, 5, min_similarity=0.99, shard_rows=shard_rows).collect()}
    assert len(want) > 5000 and len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_crowded_buckets_are_divided(spark):
    """Tiny limits force further draws; close groups are still found and nothing else."""
    rows = [(f"g{g}_{i}", f"F{g}_{f}", 4.0 + 0.01 * ((i * 7 + f * 3) % 5)) for g in range(5) for i in range(40) for f in range(6)]
    v = vectors(spark, rows)
    links = birch.leaf_links(birch.cf_leaves(v.withColumnRenamed("cell_id", "k"), reach=0.99999), crowd=4)
    ends = links.select(F.split("a", "_")[0].alias("a"), F.split("b", "_")[0].alias("b"))
    every = {(f"g{g}_{i}", f"g{g}_{j}") for g in range(5) for i in range(40) for j in range(40)}
    assert {(r.cluster_first.split("_")[0], r.k) for r in birch.tight_groups(birch.clusters(v, reach=0.99999, crowd=4)).collect()} == {(f"g{g}", f"g{g}_{i}") for g in range(5) for i in range(40)}
    assert links.count() > 0 and {(r.a, r.b) for r in links.collect()} <= every and ends.filter("a <> b").count() == 0
    near = similar.similar(v, 3, min_similarity=0.9, shard_rows=8)
    ends = near.select(F.split("a", "_")[0].alias("a"), F.split("b", "_")[0].alias("b"))
    assert near.count() == 200 * 3 and ends.filter("a <> b").count() == 0


def test_crowded_buckets_lose_no_pair(spark):
    """The links are the same whether buckets are compared whole or in blocks."""
    v = vectors(spark, cloud(groups=4, size=100, genes=12))
    leaves = birch.cf_leaves(v.withColumnRenamed("cell_id", "k"), reach=0.99999).cache()
    want, got = ({(r.a, r.b): r for r in birch.leaf_links(leaves, crowd=crowd).collect()} for crowd in (4096, 5))
    assert len(want) > 5000 and got.keys() == want.keys()
    assert all(abs(got[k].s - want[k].s) < 1e-5 and (got[k].na, got[k].nb) == (want[k].na, want[k].nb) for k in want)
