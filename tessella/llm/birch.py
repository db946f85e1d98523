"""Clusters of similar vectors: cluster-feature leaves, Ward agglomeration, one assignment pass.

Cells that draw the same feature meet in a batch, whose cluster-feature (CF) tree absorbs a
vector into the nearest leaf if it is near enough.  Leaf summaries (count, linear sum, members)
meet again under several draws; leaves with similar centroids are linked, linked leaves form
components, and within each component leaves are merged by Ward's criterion along the links.
A full pass then assigns every vector to the nearest centroid of its component.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.linked_split import components
from tessella.llm.sparse import Block, _mix, bucket_features, pack
from tessella.session import materialise, shuffle_partitions


def leaves_of(x: np.ndarray, reach: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(leaf of each row, linear sums of the leaves): a row joins the leaf whose centroid is most
    similar, if at least ``reach``; rows left over found leaves of their own, in order."""
    n = len(x)
    leaf = np.full(n, -1, np.int64)
    sums = np.zeros((0, x.shape[1]), np.float32)
    for s in range(0, n, step):
        part = x[s : s + step]
        got = np.full(len(part), -1, np.int64)
        if len(sums):
            sim = part @ (sums / np.linalg.norm(sums, axis=1, keepdims=True)).T
            best = sim.argmax(axis=1)
            ok = sim[np.arange(len(part)), best] >= reach
            got[ok] = best[ok]
        rest = np.flatnonzero(got < 0)
        if len(rest):
            left = part[rest]
            own = left @ left.T
            open_ = np.ones(len(rest), bool)
            new = []
            for i in range(len(rest)):
                if open_[i]:
                    take = open_ & (own[i] >= reach)
                    take[i] = True
                    got[rest[take]] = len(sums) + len(new)
                    open_ &= ~take
                    new.append(i)
            sums = np.concatenate([sums, np.zeros((len(new), x.shape[1]), np.float32)])
        row, col = np.nonzero(part)
        np.add.at(sums.reshape(-1), got[row] * x.shape[1] + col, part[row, col])
        leaf[s : s + step] = got
    return leaf, sums


def _packed(dense: np.ndarray, names: np.ndarray) -> list[bytes | None]:
    row, col = np.nonzero(dense)
    return pack(np.r_[0, np.cumsum(np.bincount(row, minlength=len(dense)))], names[col], dense[row, col])


def _ranks(names: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of every name among the distinct ones, these in ascending order)"""
    coded = names.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _chunks(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, boundaries): the groups of a sorted key in pieces of at most ``size`` rows, whatever the batches are."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        k = rows[key].to_numpy()
        cuts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
        cuts = np.concatenate([np.arange(a, b, size) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        if len(cuts) > 1:  # the last piece may go on in the next batch
            yield rows.slice(0, int(cuts[-1])), cuts
        held = rows.slice(int(cuts[-1]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def cf_leaves(vectors: DataFrame, *, reach: float = 0.88, chunk: int = 10_000, crowd: int = 50_000) -> DataFrame:
    """Leaves of the CF trees: (leaf, n, length, vec, cells, vecs).

    vec is the unit centroid, length the norm of the mean; cells and vecs are the members.  A
    tree holds ``chunk`` rows at most, in the order of their draws and keys, so leaves depend
    neither on Arrow batches nor on the number of tasks.  A pair of draws of more than ``crowd``
    rows (say, copies of one vector) is dealt by a hash of the key to trees of its own; the
    list of such pairs, all the driver sees, has fewer than rows / ``crowd`` entries.
    """

    spark = vectors.sparkSession

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = bucket_features(Block(batch["vec"]), 2)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), batch["k"], batch["vec"]], ["f", "g", "k", "vec"])

    drawn = materialise(vectors.mapInArrow(draw, "f long, g long, k string, vec binary"))
    full = drawn.groupBy("f", "g").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).collect()
    lane = F.lit(0)
    if full:
        lanes = spark.createDataFrame([(r.f, r.g, -(-r.n // crowd)) for r in full], "f long, g long, m int")
        drawn = drawn.join(F.broadcast(lanes), ["f", "g"], "left")  # fewer rows than rows / crowd
        lane = F.when(F.col("m").isNotNull(), 1 + F.pmod(F.xxhash64("k"), F.col("m"))).otherwise(0)
    # two draws deal a crowded feature to several trees
    drawn = drawn.select(F.xxhash64("f", F.pmod("g", F.lit(4)), lane).alias("tree"), "g", "k", "vec")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, start in _chunks(batches, "tree", chunk):
            rank = _ranks(lot["k"])[0]
            orders, sizes, lengths, vec = [], [], [], []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), lot.num_rows], strict=True):
                if a == b:
                    continue
                block = Block(lot["vec"].slice(a, b - a))
                leaf, sums = leaves_of(block.dense(), reach)
                n = np.bincount(leaf, minlength=len(sums))
                orders.append(a + np.lexsort((rank[a:b], leaf)))
                sizes.append(n)
                lengths.append(np.linalg.norm(sums, axis=1) / n)
                vec += _packed(sums, block.codes()[0])
            order, n = np.concatenate(orders), np.concatenate(sizes)
            ends = np.r_[0, np.cumsum(n)]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lot[c].take(pa.array(order))) for c in ("k", "vec")]
            yield pa.RecordBatch.from_arrays([lot["k"].take(pa.array(order[ends[:-1]])), pa.array(n), pa.array(np.concatenate(lengths)), pa.array(vec, pa.binary()), *lists], ["leaf", "n", "length", "vec", "cells", "vecs"])

    dealt = drawn.repartition(shuffle_partitions(spark), "tree").sortWithinPartitions("tree", "g", "k")
    return dealt.mapInArrow(grow, "leaf string, n long, length double, vec binary, cells array<string>, vecs array<binary>")


def leaf_links(leaves: DataFrame, *, link: float = 0.6, tables: int = 8, block_rows: int = 2048, crowd: int = 4096) -> DataFrame:
    """(a, b, s, na, nb, la, lb): leaves that meet under one of ``tables`` pairs of draws and whose centroids are at least ``link`` similar.

    All leaves of a bucket are compared.  A bucket of more than ``crowd`` leaves is cut into blocks by a hash, and every
    pair of blocks is a piece of work of its own (the list of such buckets has fewer than ``tables`` / ``crowd`` entries a leaf).
    """
    parts = shuffle_partitions(leaves.sparkSession)

    def keys(block: Block) -> Iterator[np.ndarray]:
        d = bucket_features(block, 2 * tables).astype(np.uint64)
        for t in range(tables):
            with np.errstate(over="ignore"):
                yield _mix(d[:, 2 * t] * np.uint64(5) + d[:, 2 * t + 1] * np.uint64(9) + np.uint64(t)).astype(np.int64)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, n = np.unique(np.concatenate(list(keys(Block(batch["vec"])))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    full = leaves.select("vec").mapInArrow(sizes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > crowd).collect()
    shared = leaves.sparkSession.sparkContext.broadcast({r.h: -(-r.n // crowd) for r in full})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block(batch["vec"])
            slim = block.slim()
            own = np.array([zlib.crc32(k.encode()) for k in batch["leaf"].to_pylist()], np.int64) if cut else None
            for h in keys(block):
                at, side = np.arange(len(h)), np.zeros(len(h), np.int8)  # 0: all pairs; of two blocks 1 and 2, pairs across
                if cut:
                    m = np.array([cut.get(x, 1) for x in h.tolist()])
                    at = np.repeat(at, m)
                    mine, other = own[at] % m[at], np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
                    low, high = np.minimum(mine, other).astype(np.uint64), np.maximum(mine, other).astype(np.uint64)
                    side = np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.int8)
                    h = np.where(m[at] == 1, h[at], _mix(_mix(h[at].astype(np.uint64) + low) + high).astype(np.int64))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(side), batch["leaf"].take(at), batch["n"].take(at), slim.take(at)], ["h", "side", "leaf", "n", "vec"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, start in _lots(batches, "h"):
            names, n, side = lot["leaf"], lot["n"].to_numpy(), lot["side"].to_numpy()
            for a, b, s in _gathered(_alike(Block(lot["vec"], slim=True), start, link, block_rows)):
                ok = (side[a] == 0) | (side[a] != side[b])
                a, b, s = a[ok], b[ok], s[ok]
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "s": pa.array(s), "na": pa.array(n[a]), "nb": pa.array(n[b])})

    dealt = leaves.select("leaf", "n", "vec").mapInArrow(deal, "h long, side byte, leaf string, n long, vec binary")
    met = dealt.repartition(4 * parts, "h").sortWithinPartitions("h", "leaf").mapInArrow(meet, "a string, b string, s double, na long, nb long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).dropDuplicates(["a", "b"])


def _lots(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, boundaries): whole groups of equal keys, many at a time, from batches sorted by the key."""
    held: list[pa.RecordBatch] = []

    def lot() -> tuple[pa.RecordBatch, np.ndarray]:
        rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        k = rows[key].to_numpy(zero_copy_only=False)
        return rows, np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch[key].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if not last and held and held[0][key][0].as_py() == k[0]:
            held.append(batch)  # the group of before goes on
            continue
        held += [batch.slice(0, last)] if last else []
        if held:
            yield lot()
        held = [batch.slice(last)]
    if held:
        yield lot()


def _alike(block: Block, start: np.ndarray, least: float, block_rows: int, few: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, similarity) of the pairs of each group that are at least ``least`` similar.

    The pairs of small groups are compared together, those of large groups by matrix products.
    """
    size = np.diff(start)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in np.unique(size[(size > 1) & (size <= few)]).tolist():
        i, j = np.triu_indices(m, 1)
        at = start[:-1][size == m][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    s = block.dots(a, b)
    good = s >= least
    yield a[good], b[good], s[good]
    for g in np.flatnonzero(size > few).tolist():
        own, at = block.rows(np.arange(start[g], start[g + 1])), start[g]  # over the features of the group alone
        for i in range(0, size[g], block_rows):
            x = own.dense(slice(i, i + block_rows))
            for j in range(i, size[g], block_rows):
                y = x if i == j else own.dense(slice(j, j + block_rows))
                s = x @ y.T
                p, q = np.nonzero(np.triu(s >= least, 1) if i == j else s >= least)
                yield p + i + at, q + j + at, s[p, q].astype(np.float64)


def _gathered(pairs: Iterator[tuple[np.ndarray, ...]], rows: int = 50_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The same pairs in the same order, many in one piece."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for piece in pairs:
        held.append(piece)
        count += len(piece[0])
        if count >= rows:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, count = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def ward(size: dict[str, int], links: list[tuple[str, str, float]], cut: float) -> dict[str, str]:
    """Cluster (its smallest leaf) of every leaf of one component.

    Linked clusters are merged in the order of Ward's increase na nb / (na + nb) * |ca - cb|^2,
    as long as their centroids are at least ``cut`` similar.  The similarity of a merged cluster
    to a neighbour is the mean of its parts', weighted by size (a missing link counts 0).
    """
    n = dict(size)
    near: dict[str, dict[str, float]] = {k: {} for k in n}
    for a, b, s in links:
        near[a][b] = near[b][a] = s
    cost = lambda a, b, s: n[a] * n[b] / (n[a] + n[b]) * 2 * (1 - s)
    heap = [(cost(a, b, s), a, b, n[a], n[b]) for a, b, s in links if s >= cut]
    heapq.heapify(heap)
    into: dict[str, str] = {}
    while heap:
        _, a, b, sa, sb = heapq.heappop(heap)
        if a in into or b in into or n[a] != sa or n[b] != sb:
            continue
        keep, gone = min(a, b), max(a, b)
        ka, kb = near[keep], near.pop(gone)
        merged = {}
        for c in (ka.keys() | kb.keys()) - {keep, gone}:
            s = (n[keep] * ka.get(c, 0.0) + n[gone] * kb.get(c, 0.0)) / (n[keep] + n[gone])
            merged[c] = s
            near[c].pop(gone, None)
            near[c][keep] = s
        n[keep] += n[gone]
        near[keep] = merged
        into[gone] = keep
        for c, s in merged.items():
            if s >= cut:
                heapq.heappush(heap, (cost(min(keep, c), max(keep, c), s), min(keep, c), max(keep, c), n[min(keep, c)], n[max(keep, c)]))
    out = {}
    for k in size:
        r = k
        while r in into:
            r = into[r]
        out[k] = r
    return out


def clusters(vectors: DataFrame, *, key: str = "cell_id", reach: float = 0.88, link: float = 0.6, cut: float = 0.8, tables: int = 10, chunk: int = 10_000, crowd: int = 4096) -> DataFrame:
    """(k, component, cluster, similarity, vec): every vector with its cluster and the similarity to its centroid.

    ``reach``: similarity to a leaf's centroid for joining it; ``link``: similarity of leaf
    centroids that are compared further; ``cut``: similarity of centroids of merged clusters.
    A cluster is named by a leaf, a component by a number.  Vectors of no other similar vector
    are clusters of one.  An empty input gives an empty result.
    """
    spark = vectors.sparkSession
    leaves = materialise(cf_leaves(vectors.select(F.col(key).cast("string").alias("k"), "vec"), reach=reach, chunk=chunk))
    links = materialise(leaf_links(leaves, link=link, tables=tables, crowd=crowd).withColumn("ua", F.xxhash64("a")).withColumn("ub", F.xxhash64("b")))
    root = components(links.select(F.col("ua").alias("u"), F.col("ub").alias("v")))
    placed = links.join(root, links.ua == root.u, "left").select("a", "b", "s", "na", "nb", F.coalesce("v", "ua").alias("component"))
    parts = shuffle_partitions(spark)

    def agglomerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, start in _lots(batches, "component"):
            a, b, s, na, nb, comp = (lot[c].to_pylist() for c in ("a", "b", "s", "na", "nb", "component"))
            out: tuple[list, list, list] = ([], [], [])
            for x, y in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                size = dict(zip(a[x:y], na[x:y], strict=True)) | dict(zip(b[x:y], nb[x:y], strict=True))
                got = ward(size, list(zip(a[x:y], b[x:y], s[x:y], strict=True)), cut)
                for column, values in zip(out, (got.keys(), got.values(), [comp[x]] * len(got)), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], ["leaf", "cluster", "component"])

    named = placed.repartition(parts, "component").sortWithinPartitions("component", "a", "b").mapInArrow(agglomerate, "leaf string, cluster string, component long")
    named = materialise(named)
    # a leaf without links is a component and a cluster of its own
    joined = leaves.join(named, "leaf")
    cents = joined.select("component", "cluster", "n", "length", "vec").repartition(parts, "component").sortWithinPartitions("component", "cluster").mapInArrow(_centroids, "component long, c array<struct<cluster: string, vec: binary>>")
    linked = joined.select("component", "cluster", "cells", "vecs").join(cents, "component")
    alone = leaves.join(named, "leaf", "left_anti").select(F.xxhash64("leaf").alias("component"), F.col("leaf").alias("cluster"), "cells", "vecs", F.array(F.struct(F.col("leaf").alias("cluster"), "vec")).alias("c"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                if not part.num_rows:
                    continue
                members = np.asarray(pa.compute.list_value_length(part["cells"]))
                cells, vecs, lists = part["cells"].flatten(), part["vecs"].flatten(), part["c"]
                flat, size = lists.flatten(), np.asarray(pa.compute.list_value_length(lists))
                names = flat.field("cluster").to_pylist()
                leaf = np.repeat(np.arange(part.num_rows), members)
                first = np.r_[0, np.cumsum(size)[:-1]]
                many = size[leaf]
                row = np.repeat(np.arange(len(leaf)), many)
                cent = np.repeat(first[leaf] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                block = Block(pa.concat_arrays([vecs, flat.field("vec")]))
                sim = block.dots(row, cent + len(vecs))
                order = np.lexsort((cent, -np.round(sim, 9), row))
                best = order[np.r_[True, row[order][1:] != row[order][:-1]]]
                comp = part["component"].take(pa.array(leaf))
                yield pa.RecordBatch.from_arrays([cells, comp, pa.array([names[i] for i in cent[best].tolist()]), pa.array(sim[best]), vecs], ["k", "component", "cluster", "similarity", "vec"])

    schema = "k string, component long, cluster string, similarity double, vec binary"
    return materialise(linked.unionByName(alone).mapInArrow(assign, schema))


def _centroids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The centroids of each component, from leaves sorted by component and cluster."""
    for lot, start in _lots(batches, "component"):
        block, rank = Block(lot["vec"]), _ranks(lot["cluster"])[0]
        weight = (lot["n"].to_numpy() * lot["length"].to_numpy()).astype(np.float32)
        new = np.r_[True, rank[1:] != rank[:-1]]
        new[start[:-1]] = True
        first, at, (names, code) = np.flatnonzero(new), np.cumsum(new) - 1, block.codes()
        entry, where = np.unique(at[block.row] * len(names) + code, return_inverse=True)  # of every cluster its features
        sums = np.zeros(len(entry), np.float32)
        np.add.at(sums, where, block.weight * weight[block.row])
        vec = pack(np.r_[0, np.cumsum(np.bincount(entry // len(names), minlength=len(first)))], names[entry % len(names)], sums)
        book = pa.StructArray.from_arrays([lot["cluster"].take(pa.array(first)), pa.array(vec, pa.binary())], ["cluster", "vec"])
        cuts = pa.array(np.searchsorted(first, start), pa.int32())
        yield pa.RecordBatch.from_arrays([lot["component"].take(pa.array(start[:-1])), pa.ListArray.from_arrays(cuts, book)], ["component", "c"])


def describe(assigned: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_first, size, rank, typical, similarity): every cluster with its smallest key, size and most typical members."""
    size = assigned.groupBy("cluster").agg(F.min("k").alias("cluster_first"), F.count("*").alias("size"))
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("similarity", 9)), "k")
    top = assigned.select("cluster", "k", "similarity").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= typical)
    return top.join(size, "cluster").select("cluster_first", "size", "rank", F.col("k").alias("typical"), "similarity")


def tight_groups(assigned: DataFrame, *, similarity: float = 0.8, least: int = 3, block: int = 4096) -> DataFrame:
    """(cluster_first, k): groups of ``least`` or more vectors in which every two are at least
    ``similarity`` alike and none is to a vector outside.

    An exact check of the assigned clusters, which also parts what was merged and joins what was
    parted within a component: each vector sums up the vectors at least ``similarity`` alike to
    it and itself (their number, smallest key and two sums of hashes).  A group is as many vectors
    as these numbers say that all have the same ones.  Components of more than ``block`` vectors count
    copies once, by weight, and are cut into blocks; every pair of blocks is a piece of work of its own.
    """
    spark = assigned.sparkSession
    size = assigned.groupBy("component").agg(F.count("*").alias("cells")).filter(F.col("cells") >= least)
    rows = assigned.select("component", "cluster", "vec", "k").join(size, "component")
    # in a large component, copies of a vector are one row with a weight
    few = rows.filter(F.col("cells") <= block).select("component", "vec", "k", F.lit(1).cast("long").alias("weight"), F.lit(1).alias("blocks"))
    many = materialise(rows.filter(F.col("cells") > block).groupBy("component", "cluster", "vec").agg(F.min("k").alias("k"), F.count("*").alias("weight")))
    cut = many.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows_ = few.unionByName(many.join(cut, "component").select("component", "vec", "k", "weight", "blocks"))
    rows_ = rows_.withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows_ = rows_.select("component", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("work"), (F.col("own") < F.col("other")).cast("int").alias("a"), (F.col("own") == F.col("other")).alias("same"), "k", F.xxhash64("k").alias("h"), "vec", "weight")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, start in _lots(batches, "work"):
            side, (rank, known) = lot["a"].to_numpy(), _ranks(lot["k"])
            whole, weight, h = lot["same"].to_numpy(zero_copy_only=False), lot["weight"].to_numpy(), lot["h"].to_numpy().astype(np.uint64)
            marks = [(h >> np.uint64(33)).astype(np.int64) * weight, ((h >> np.uint64(2)) & np.uint64(0x7FFFFFFF)).astype(np.int64) * weight]
            n, first = np.where(whole, weight, 0), np.where(whole, rank, len(known))
            sums = [np.where(whole, m, 0) for m in marks]
            for i, j, _ in _gathered(_alike(Block(lot["vec"]), start, similarity, 1024)):
                ok = whole[i] | (side[i] != side[j])  # of two blocks, only pairs across count here
                for at, to in ((i[ok], j[ok]), (j[ok], i[ok])):
                    np.add.at(n, at, weight[to])
                    np.minimum.at(first, at, rank[to])
                    for s, m in zip(sums, marks, strict=True):
                        np.add.at(s, at, m[to])
            yield pa.RecordBatch.from_pydict({"component": lot["component"], "k": lot["k"], "weight": lot["weight"], "n": pa.array(n), "first": known.take(pa.array(first, mask=first == len(known))), "x": pa.array(sums[0]), "y": pa.array(sums[1])})

    done = rows_.repartition(4 * shuffle_partitions(spark), "work").sortWithinPartitions("work", "k").mapInArrow(count, "component long, k string, weight long, n long, first string, x long, y long")
    per = materialise(done.groupBy("component", "k").agg(F.max("weight").alias("weight"), F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("x").alias("x"), F.sum("y").alias("y")).filter(F.col("n") >= least))
    same = ["component", "first", "n", "x", "y"]
    good = per.groupBy(*same).agg(F.sum("weight").alias("there")).filter("there = n").select(*same)
    found = per.join(good, same).select("component", "k", F.col("first").alias("cluster_first"))
    if many.isEmpty():
        return found.select("cluster_first", "k")
    copies = rows.filter(F.col("cells") > block).join(many.select("component", "cluster", "vec", F.col("k").alias("rep")), ["component", "cluster", "vec"]).select("k", "component", "rep")
    folded = copies.join(found.withColumnRenamed("k", "rep"), ["component", "rep"]).select("cluster_first", "k")
    return found.join(many.select("component", "k"), ["component", "k"], "left_anti").select("cluster_first", "k").union(folded)
