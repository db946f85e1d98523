"""The most similar vectors of every vector: one small-world graph per shard, results merged.

Exact copies are represented by one of them.  The others are spread over shards by a feature
drawn by consistent weighted sampling, so similar vectors share a shard; a vector whose draw
changes under small noise also visits the shards of the changed draws.  Each shard builds a
graph with flat neighbour arrays (``hnsw``); candidates are compared exactly before merging.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.hnsw import FlatHNSW
from tessella.llm.sparse import Block, _mix, bucket_features, project
from tessella.session import materialise

HINT_DRAWS = 6


def _jitter(block: Block, noise: float, seed: int) -> Block:
    """The block with weights changed by about ``noise``, the same way for the same entry."""
    out = object.__new__(Block)
    out.__dict__ = dict(block.__dict__)
    with np.errstate(over="ignore"):
        h = _mix(block.feature.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + block.weight.view(np.uint32).astype(np.uint64))
    u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) * 2 - 1
    out.weight = (block.weight * (1 + 2 * noise * u)).astype(np.float32)
    return out


def hints(block: Block) -> np.ndarray:
    """Two hashes per vector, each of three drawn features, as entry points of the graph."""
    d = bucket_features(block, HINT_DRAWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        cols = [_mix(d[:, a] * np.uint64(3) + d[:, a + 1] * np.uint64(7) + d[:, a + 2] * np.uint64(11)) for a in range(0, HINT_DRAWS, 3)]
    return np.stack(cols, axis=1).astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values of ``x`` once each, ascending (by sorting, which is faster here than the hashing of ``np.unique``)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _close(block: Block, a: np.ndarray, b: np.ndarray, s: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs, their mirror images, and the neighbours of neighbours at least ``least`` similar."""
    n = len(block)
    code = _distinct(np.r_[a * n + b, b * n + a])
    x, y = code // n, code % n
    start, size = np.searchsorted(x, np.arange(n)), np.bincount(x, minlength=n)
    far = [code]
    for at in range(0, len(x), 20_000):
        u, v = x[at : at + 20_000], y[at : at + 20_000]
        m = size[v]
        third = y[np.repeat(start[v] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())]
        first = np.repeat(u, m)
        far.append(_distinct((first * n + third)[first != third]))
    code = _distinct(np.concatenate(far))
    x, y = code // n, code % n
    s = block.dots(x, y)
    good = s >= least - 1e-6
    return x[good], y[good], s[good]


DEEPEST = 6


def _plan(vectors: DataFrame, shard_rows: int) -> dict[int, tuple[int, int, int]]:
    """First shard, number of shards and further draws of every drawn feature.

    No more features than there are genes come to the driver.  A crowded feature is split by
    further draws, one more for every eightfold, so shards stay near ``shard_rows`` at any size.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f, n = np.unique(bucket_features(Block(batch["vec"]), 1)[:, 0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"f": pa.array(f), "n": pa.array(n)})

    counts = vectors.select("vec").mapInArrow(drawn, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "f").collect()
    plan, loads, total = {}, [], 0
    for r in counts:
        if r.n > 1.5 * shard_rows:  # a crowded feature has shards of its own
            splits = -(-r.n // shard_rows)
            plan[r.f] = (total, splits, min(DEEPEST - 1, math.ceil(math.log(splits, 8))))
            loads += [shard_rows] * splits
            total += splits
    small = [r for r in counts if r.f not in plan]
    bins = -(-sum(r.n for r in small) // shard_rows)
    level = [0] * bins
    for r in small:
        at = level.index(min(level))
        level[at] += r.n
        plan[r.f] = (total + at, 1, 0)
    return plan


def similar(
    vectors: DataFrame, k: int, *, key: str = "cell_id", queries: DataFrame | None = None, min_similarity: float = 0.0,
    shard_rows: int = 16_000, dims: int | None = 32, ef: int = 12, keep: int = 24, noise: float = 0.1, wobbles: int = 8,
) -> DataFrame:
    """The ``k`` vectors most similar to each: (a, b, similarity, rank), b named by its key.

    ``vectors`` has the columns key (unique, not null) and vec (packed).  Without ``queries``
    every vector asks its own shard and those its draw wobbles to, which finds neighbours that
    are close (see README for the recall by similarity); with ``queries`` (a DataFrame of keys)
    these ask every shard, near or far.  Pairs under ``min_similarity`` are left out.  Equal
    similarity goes to the smaller key; copies have similarity 1 and count as neighbours.
    """
    v = materialise(vectors.select(F.col(key).alias("k"), "vec", F.md5("vec").alias("m")))
    copies = materialise(v.groupBy("m").agg(F.min("k").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("m", "rep"))
    none = copies.isEmpty()
    v = v.select("k", "vec", F.col("k").alias("rep")) if none else materialise(v.join(copies, "m", "left").select("k", "vec", F.coalesce("rep", "k").alias("rep")))
    unique = v.filter("k = rep").select("k", "vec")
    plan = _plan(unique, shard_rows)
    shards = 1 + max((s + n - 1 for s, n, _ in plan.values()), default=0)
    draws = 1 + max((d for *_, d in plan.values()), default=0)
    everywhere = queries is not None
    asking = v.join(queries.select(F.col(key).alias("k")).distinct(), "k", "left_semi").select("rep").distinct().withColumnRenamed("rep", "k").join(unique, "k") if everywhere else None
    shared = v.sparkSession.sparkContext.broadcast(plan)

    def place(block: Block) -> np.ndarray:
        names, at = np.unique(bucket_features(block, 1)[:, 0], return_inverse=True)
        first, splits, depth = np.array([shared.value.get(f, (0, 1, 0)) for f in names.tolist()]).reshape(-1, 3)[at].T
        h = np.zeros(len(block), np.uint64)
        for i in range(1, draws):
            deep = np.flatnonzero(i <= depth)  # only vectors of crowded features draw again
            if len(deep):
                h[deep] = _mix(h[deep] + bucket_features(block.rows(deep), 1, i)[:, 0].astype(np.uint64))
        return first + (h % splits.astype(np.uint64)).astype(np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block(batch["vec"])
            home = place(block)
            rows, to, own = [np.arange(len(block))], [home], [np.ones(len(block), bool)]
            if not everywhere:
                other = np.stack([place(_jitter(block, noise, s + 1)) for s in range(wobbles)], axis=1)
                other = np.where(other == home[:, None], -1, other)
                for j in range(wobbles):
                    new = (other[:, j] >= 0) & ~(other[:, :j] == other[:, j : j + 1]).any(axis=1)
                    rows.append(np.flatnonzero(new))
                    to.append(other[new, j])
                    own.append(np.zeros(new.sum(), bool))
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to), pa.int32()), pa.array(np.concatenate(own)), batch["k"].take(pa.array(at)), batch["vec"].take(pa.array(at))], ["shard", "home", "k", "vec"])

    schema = "shard int, home boolean, k string, vec binary"
    routed = unique.select(F.col("k").cast("string").alias("k"), "vec").mapInArrow(route, schema)
    if everywhere:
        visits = asking.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(False).alias("home"), F.col("k").cast("string").alias("k"), "vec")
        routed = routed.union(visits)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf["vec"].tolist())
        names, home = pdf["k"].to_numpy(), pdf["home"].to_numpy()
        key = pd.factorize(names, sort=True)[0]  # keys as numbers, in their order
        own, guest = np.flatnonzero(home), np.flatnonzero(~home)
        if not len(own):
            return pd.DataFrame({"a": pd.Series([], dtype=object), "b": pd.Series([], dtype=object), "s": pd.Series([], dtype=float)})
        x = project(block, dims) if dims else block.dense()
        hint = hints(block)
        graph = FlatHNSW(x[own], ef=ef, keep=keep, hints=hint[own])
        a, b = [], []
        if not everywhere:
            near = graph.own()
            a.append(np.repeat(own, near.shape[1]))
            b.append(np.where(near >= 0, own[near], -1).ravel())
        if len(guest):
            near, _ = graph.search(x[guest], keep, 2 * ef, hint[guest])
            a.append(np.repeat(guest, near.shape[1]))
            b.append(np.where(near >= 0, own[near], -1).ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        good = (b >= 0) & (key[a] != key[np.maximum(b, 0)])
        a, b = a[good], b[good]
        if not everywhere and min_similarity > 0:  # a pair met from both sides is compared once
            code = _distinct(np.minimum(a, b) * len(block) + np.maximum(a, b))
            a, b = code // len(block), code % len(block)
        s = block.dots(a, b)
        good = s >= min_similarity - 1e-6
        a, b, s = a[good], b[good], s[good]
        if not everywhere and min_similarity > 0 and len(a):
            a, b, s = _close(block, a, b, s, min_similarity)
            good = key[a] != key[b]
            a, b, s = a[good], b[good], s[good]
        order = np.lexsort((key[b], -s, a)) if len(a) else np.empty(0, np.int64)
        a, b, s = a[order], b[order], s[order]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        place_ = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        top = place_ < k
        return pd.DataFrame({"a": names[a[top]], "b": names[b[top]], "s": s[top]})

    met = routed.groupBy("shard").applyInPandas(within, "a string, b string, s double")
    pairs = met.groupBy("a", "b").agg(F.max("s").alias("s"))
    best = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("s"), "b"))
    pairs = pairs.withColumn("n", best("a")).filter(F.col("n") <= k).select("a", "b", "s")
    if none:
        return pairs.filter(F.col("s") >= min_similarity).select("a", "b", F.col("s").alias("similarity"), best("a").alias("rank"))
    # copies: the k + 1 smallest keys of each set can be among the k best of anything
    named = v.select(F.col("k").cast("string").alias("k"), F.col("rep").cast("string").alias("rep"))
    if everywhere:
        wanted = named.join(queries.select(F.col(key).cast("string").alias("k")).distinct(), "k", "left_semi")
    else:
        wanted = named
    few = named.join(copies.select(F.col("rep").cast("string").alias("rep")), "rep", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("k"))).filter(F.col("n") <= k + 1).select("rep", F.col("k").alias("c"))
    lists = pairs.join(few.withColumnRenamed("rep", "b"), "b", "left").select("a", F.coalesce("c", "b").alias("b"), "s").union(few.select("rep", "c", F.lit(1.0)))
    lists = lists.withColumn("n", best("a")).filter(F.col("n") <= k + 1).select(F.col("a").alias("rep"), "b", "s")
    out = wanted.join(lists, "rep").filter("k <> b").select(F.col("k").alias("a"), "b", "s").withColumn("rank", best("a")).filter(F.col("rank") <= k)
    return out.filter(F.col("s") >= min_similarity).select("a", "b", F.col("s").alias("similarity"), "rank")
