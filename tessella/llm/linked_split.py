"""Splits that never part linked records.

Records are edges between the keys they name.  Every partition of edges is reduced to a
local union-find forest, forests are merged by ever fewer tasks, and what is too large for
one task is finished by star contraction, so nothing is collected to the driver.  Groups are
then dealt out largest first, each to the split furthest below its target; groups of one size
are interchangeable, so only the histogram of sizes is handled on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise


def sample_key(col: str) -> Column:
    """Sample ids agree regardless of case, outer blanks and ``-`` for ``_``; blank is null."""
    c = F.replace(F.upper(F.btrim(F.col(col), F.lit(" \t\r\n "))), F.lit("-"), F.lit("_"))
    return F.when(c != "", c)


def path_key(col: str, root: str = "/srv/omics", inner: str = "experiment.xenium") -> Column:
    """The directory a path leads to, absolute and without dot segments; blank is null."""
    c = F.btrim(F.col(col), F.lit(" \t\r\n "))
    is_url = F.lower(c).startswith("file:")
    bare = F.regexp_replace(c, "^(?i)file:(//localhost(?=/)|//)?", "")
    plus = F.replace(bare, F.lit("+"), F.lit("%2B"))  # a plus sign is no blank in a path
    c2 = F.when(is_url, F.coalesce(F.try_url_decode(plus), bare)).otherwise(c)
    c2 = F.replace(c2, F.lit("\\"), F.lit("/"))
    c2 = F.when(c2.startswith("/"), c2).otherwise(F.concat(F.lit(root + "/"), c2))
    parts = F.filter(F.split(c2, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(F.concat(F.array(F.lit("")), walked), -1)
    walked = F.when(last == inner, F.slice(walked, 1, F.size(walked) - 1)).otherwise(walked)
    return F.when(c != "", F.concat(F.lit("/"), F.array_join(walked, "/")))


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) of every node that is not itself the smallest."""
    nodes, idx = np.unique(np.r_[u, v], return_inverse=True)
    a, b = idx[: len(u)], idx[len(u) :]
    parent = np.arange(len(nodes))
    while True:  # vectorised union by smallest index with path halving
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def _local_forests(edges: DataFrame, parts: int, by: list[str]) -> DataFrame:
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held = [], [], 0
        for batch in batches:
            u.append(batch["u"].to_numpy())
            v.append(batch["v"].to_numpy())
            held += batch.num_rows
            if held > 2_000_000:  # keep no more than the forest so far
                a, b = _forest(np.concatenate(u), np.concatenate(v))
                u, v, held = [a], [b], 0
        if u:
            a, b = _forest(np.concatenate(u), np.concatenate(v))
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_pydict({"u": pa.array(a[at : at + 100_000]), "v": pa.array(b[at : at + 100_000])})

    return edges.repartition(parts, *by).mapInArrow(reduce, "u long, v long")


def components(edges: DataFrame, *, one_task: int = 4_000_000, fan_in: int = 8) -> DataFrame:
    """(u, v): every node with the smallest node of its component; smallest nodes have no row.

    ``edges`` has long columns u and v.  ``one_task`` is the most links the last task may hold;
    larger forests are contracted by alternating stars until nothing changes.
    """
    spark = edges.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    forest = materialise(_local_forests(edges.filter("u <> v"), parts, ["u"]))
    left = forest.count()
    while left > one_task and parts > max(1, left // one_task):
        parts = max(1, parts // fan_in, left // one_task)
        forest = materialise(_local_forests(forest, parts, ["v"]))
        left = forest.count()
    if left <= one_task:
        return materialise(_local_forests(forest, 1, ["v"])) if parts > 1 else forest
    while True:  # stars: link every neighbour of a node to the smallest one
        both = forest.union(forest.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.filter("v <= u").groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = materialise(small)
        same = small.exceptAll(forest).isEmpty() and forest.exceptAll(small).isEmpty()
        forest = small
        if same:
            return forest


def linked_groups(records: DataFrame, record: str, keys: list[Column]) -> DataFrame:
    """(record, group): the group of every record, a long that is equal for linked records.

    ``keys`` are string columns; records that share a value of one key are linked.  Null keys
    link nothing: a record without any key is a group of its own, named by a hash of its id.
    Repeated record ids count once per distinct keys; null record ids are dropped.
    """
    named = [F.xxhash64(F.lit(i), k) for i, k in enumerate(keys)]
    r = records.filter(F.col(record).isNotNull()).select(
        F.col(record).alias("r"), *[F.when(k.isNotNull(), n).alias(f"k{i}") for i, (k, n) in enumerate(zip(keys, named, strict=True))]
    ).distinct()
    own = F.xxhash64(F.lit("record"), F.col("r"))
    first = F.coalesce(*[F.col(f"k{i}") for i in range(len(keys))], own)
    r = materialise(r.withColumn("node", first))
    # several rows of one record tie their keys through a node of the record
    again = r.groupBy("r").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = r.select(F.col("node").alias("u"), F.explode(F.array(*[F.col(f"k{i}") for i in range(len(keys))])).alias("v")).filter("v is not null")
    edges = edges.union(r.join(again, "r", "left_semi").select(F.col("node").alias("u"), own.alias("v"))).distinct()
    root = components(edges)
    return r.select("r", "node").dropDuplicates(["r"]).join(root.withColumnRenamed("u", "node"), "node", "left").select(F.col("r").alias(record), F.coalesce("v", "node").alias("group"))


def deal(sizes: list[tuple[int, int]], shares: list[float]) -> list[tuple[int, list[int]]]:
    """For every (size, number of groups), largest size first, how many groups each split gets.

    Each group in turn goes to the split furthest below its target (ties: the first split).
    Long runs of equal groups are handed out in whole rounds, so the work does not grow with
    the number of groups.
    """
    total = sum(s * n for s, n in sizes)
    want = [p * total for p in shares]
    out = []
    for size, n in sorted(sizes, reverse=True):
        given = [0] * len(shares)
        if n > 64 * len(shares):
            # the level all deficits sink to, less a safe margin, is reached by any greedy order
            order = sorted(want, reverse=True)
            level = next(lv for m in range(len(order), 0, -1) if (lv := (sum(order[:m]) - n * size) / m) <= order[m - 1])
            for i, w in enumerate(want):
                given[i] = max(0, int((w - level) // size) - 2)
                want[i] -= given[i] * size
        heap = [(-w, i) for i, w in enumerate(want)]
        heapq.heapify(heap)
        for _ in range(n - sum(given)):
            w, i = heapq.heappop(heap)
            given[i] += 1
            heapq.heappush(heap, (w + size, i))
        want = [-w for w, _ in sorted(heap, key=lambda t: t[1])]
        out.append((size, given))
    return out


def assign_splits(groups: DataFrame, record: str, names: list[str], shares: list[float], *, lanes: int = 64) -> DataFrame:
    """(record, group, split): whole groups dealt to the splits, largest first.

    The histogram of group sizes is all the driver sees (fewer than sqrt(2 x records) rows).
    Within a size, groups are ordered by lane (a hash) and then by group; ranks are made per
    lane and shifted by the lanes before, so no task ranks all groups of one size.
    """
    spark = groups.sparkSession
    size = materialise(groups.groupBy("group").agg(F.count("*").alias("size")).withColumn("lane", F.pmod(F.xxhash64("group"), F.lit(lanes)).cast("int")))
    per_lane = size.groupBy("size", "lane").agg(F.count("*").alias("n")).orderBy(F.desc("size"), "lane").collect()
    if not per_lane:
        return groups.select(record, "group", F.lit(None).cast("string").alias("split"))
    hist: dict[int, int] = {}
    offsets = []
    for r in per_lane:
        offsets.append((r.size, r.lane, hist.get(r.size, 0)))
        hist[r.size] = hist.get(r.size, 0) + r.n
    cuts = []
    for s, given in deal(list(hist.items()), shares):
        at = 0
        for name, n in zip(names, given, strict=True):
            if n:
                cuts.append((s, at, at + n, name))
                at += n
    off = spark.createDataFrame(pd.DataFrame(offsets, columns=["size", "lane", "before"]), "size long, lane int, before long")
    cut = spark.createDataFrame(pd.DataFrame(cuts, columns=["size", "low", "high", "split"]), "size long, low long, high long, split string")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("size", "lane").orderBy("group")) - 1
    ranked = size.withColumn("rank", rank).join(off, ["size", "lane"]).withColumn("rank", F.col("rank") + F.col("before"))
    dealt = ranked.join(cut, "size").filter("rank >= low and rank < high").select("group", "split")
    return groups.join(dealt, "group").select(record, "group", "split")
