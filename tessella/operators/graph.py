"""Neighbour graphs of cells and the statistics on them.

Graphs are made per sample.  Radius edges come from a grid-bucketed equi join; nearest
neighbours from grid rings that widen only for the cells not settled yet.  Permutations come
from an md5 of seed, permutation and cell (or sample), so they are the same for any partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.identifiers import finite
from tessella.operators.spatial_join import near_pairs
from tessella.session import materialise, shuffle_partitions


def radius_edges(cells: DataFrame, radius: float) -> DataFrame:
    """(sample_id, src, dst, distance) in both directions. J5, J7."""
    p = near_pairs(cells, radius)
    return p.select(F.col("group").alias("sample_id"), F.col("key_a").alias("src"), F.col("key_b").alias("dst"), "distance").union(
        p.select(F.col("group"), F.col("key_b"), F.col("key_a"), "distance")
    )


def knn_edges(cells: DataFrame, k: int, *, targets: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """(sample_id, src, dst, d2, rank): the ``k`` nearest other cells of the sample. J6, J9.

    Ties go to the smaller id.  ``targets`` restricts what may be found.  Squares start at a side
    that holds a few cells on average; a cell is settled once its k-th neighbour is no farther
    than the squares looked through, else it asks again with doubled squares.  Samples with too
    few targets end once the squares hold the whole sample.  Exact.  Cells already settled are never
    broadcast: Spark judges them by the bytes of a written table, whose rows take many times that.
    Nor are those of the squares, which adaptive execution would broadcast up to the session's limit.
    """
    p = materialise(cells.filter(finite("x") & finite("y")).select("sample_id", "cell_id", "x", "y"))
    t = p if targets is None else materialise(targets.filter(finite("x") & finite("y")).select("sample_id", "cell_id", "x", "y"))
    both = p.select("sample_id", "x", "y").union(t.select("sample_id", "x", "y"))
    box = t.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    wide = both.groupBy("sample_id").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-6)).alias("span"))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-9))
    box = materialise(box.join(wide, "sample_id").select("sample_id", "span", F.least(F.col("span"), F.sqrt(area * (k + 2) / F.col("n"))).alias("h")))
    ask, out = p, None
    for i in range(rounds):
        side = F.greatest(F.col("h") * float(2**i), F.lit(1e-9))
        at = lambda df: df.join(box, "sample_id").withColumn("side", side).withColumn("sx", F.floor(F.col("x") / F.col("side"))).withColumn("sy", F.floor(F.col("y") / F.col("side")))
        steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        q = at(ask).withColumn("s", F.explode(steps)).select("sample_id", F.col("cell_id").alias("src"), F.col("x").alias("qx"), F.col("y").alias("qy"), "side", "span", (F.col("sx") + F.col("s.a")).alias("sx"), (F.col("sy") + F.col("s.b")).alias("sy"))
        d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
        met = q.join(at(t).select("sample_id", F.col("cell_id").alias("dst"), "x", "y", "sx", "sy").hint("merge"), ["sample_id", "sx", "sy"]).filter("src <> dst").withColumn("d2", d2)
        met = met.filter((F.col("d2") <= F.col("side") * F.col("side") * (1 + 1e-9)) | (F.col("side") >= F.col("span")))  # no farther one can settle a cell
        own = Window.partitionBy("sample_id", "src")
        top = met.withColumn("rank", F.row_number().over(own.orderBy("d2", "dst"))).filter(F.col("rank") <= k)
        settled = ((F.max("rank").over(own) == k) & (F.sqrt(F.max("d2").over(own)) <= F.col("side"))) | (F.col("side") >= F.col("span"))
        top = materialise(top.select("sample_id", "src", "dst", "d2", "rank", settled.alias("settled")))
        part = top.filter("settled").select("sample_id", "src", "dst", "d2", "rank")
        done = top.filter("settled and rank = 1").select("sample_id", F.col("src").alias("cell_id")).hint("merge")
        out = part if out is None else out.union(part)
        whole = box.filter(F.col("h") * float(2**i) >= F.col("span")).select("sample_id")
        ask = ask.join(done, ["sample_id", "cell_id"], "left_anti").join(whole, "sample_id", "left_anti").join(box.select("sample_id"), "sample_id", "left_semi")
        ask = materialise(ask)
        if ask.isEmpty():
            break
    return out


def nearest_group_distance(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Per sample the mean of the median distances a to b and b to a (within one label: to the next). J9."""
    one = cells.filter(F.col("cell_type") == a)
    two = cells.filter(F.col("cell_type") == b)
    med = lambda s, t, n: knn_edges(s, 1, targets=t).groupBy("sample_id").agg(F.percentile(F.sqrt("d2"), 0.5).alias(n))
    j = med(one, two, "ab").join(med(two, one, "ba"), "sample_id")
    return j.select("sample_id", F.bround((F.col("ab") + F.col("ba")) / 2, 4).alias("distance"))


def label_pairs(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(sample_id, a, b, n): edges by labels of both ends, a <= b, each direction counted. A16."""
    c = cells.filter("cell_type is not null").select("sample_id", "cell_id", "cell_type")
    j = edges.join(c.withColumnsRenamed({"cell_id": "src", "cell_type": "ls"}), ["sample_id", "src"]).join(c.withColumnsRenamed({"cell_id": "dst", "cell_type": "ld"}), ["sample_id", "dst"])
    return j.groupBy("sample_id", F.least("ls", "ld").alias("a"), F.greatest("ls", "ld").alias("b")).agg(F.count("*").alias("n"))


def _dealt(edges: DataFrame, cells: DataFrame, value: str, perms: int, part_cells: int) -> DataFrame:
    """(sample_id, block, blocks, i, cell_id, value, near): every cell with its place ``i`` in its sample by id and the places of its neighbours.

    Sorted by sample, block and place.  A block stands for the permutations ``block``, ``block`` + ``blocks``, ...: a sample
    of up to ``part_cells`` cells is one block, a larger one as many as it has such parts.  Neighbours without a
    value are left out.  The joins are never broadcast: a written table is much smaller than what its rows take.
    """
    lab = materialise(_numbered(cells.filter("sample_id is not null").select("sample_id", "cell_id", F.col(value).alias("value")), part_cells))
    to = lab.select("sample_id", F.col("cell_id").alias("dst"), F.col("i").alias("j")).hint("merge")
    near = edges.select("sample_id", "src", "dst").join(to, ["sample_id", "dst"]).groupBy("sample_id", F.col("src").alias("cell_id")).agg(F.array_sort(F.collect_list("j")).alias("near"))
    met = lab.join(near.hint("merge"), ["sample_id", "cell_id"], "left").withColumn("blocks", F.least("parts", F.lit(perms + 1)))
    met = met.select("sample_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", "i", "cell_id", "value", F.coalesce("near", F.array().cast("array<int>")).alias("near"))
    return met.repartition(4 * shuffle_partitions(cells.sparkSession), "sample_id", "block").sortWithinPartitions("sample_id", "block", "i")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, i, j) of each sample and block of ``_dealt``, with the edges as places; place 0 begins the next one."""

    def whole(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held)
        deg = np.concatenate([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in t["near"].chunks])
        return t, np.repeat(np.arange(t.num_rows), deg), np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["near"].chunks])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        for c in [*np.flatnonzero(batch["i"].to_numpy() == 0).tolist(), batch.num_rows]:
            if c > at:
                held.append(batch.slice(at, c - at))
            if c < batch.num_rows and held:
                yield whole(held)
                held = []
            at = c
    if held:
        yield whole(held)


def _md5_order(ids: pa.ChunkedArray, seed: str, perm: int) -> np.ndarray:
    """Places of cells sorted by id in the md5 order of a permutation; 0 leaves them as they are."""
    if not perm:
        return np.arange(len(ids))
    head, md5 = f"{seed}|{perm}|".encode(), hashlib.md5
    h = b"".join(b"".join([md5(head + k).digest() for k in c.cast(pa.binary()).to_pylist()]) for c in ids.chunks)
    h = np.frombuffer(h, ">u8").astype(np.uint64).reshape(-1, 2)
    return np.lexsort((h[:, 1], h[:, 0]))


def enrichment(edges: DataFrame, cells: DataFrame, *, perms: int = 20, seed: str = "0", part_cells: int = 50_000) -> DataFrame:
    """(sample_id, a, b, n, z): edges between labels against shuffled labels. P1, A19.

    Permutations deal the labels of a sample by an md5 order of its cells.  z = (observed - mean) / population sd
    over the permutations; pairs of sd 0 are left out.  A task holds one sample, its edges as numbers, and counts one
    permutation after the other; the permutations of samples of over ``part_cells`` cells are dealt to several tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, i, j in _units(batches):
            names, code = np.unique(np.array(t["value"].to_pylist(), object), return_inverse=True)
            k, seen = len(names), []
            for p in range(t["block"][0].as_py(), perms + 1, t["blocks"][0].as_py()):
                v = code[_md5_order(t["cell_id"], seed, p)]
                x, y = v[i], v[j]
                pair, n = np.unique(np.minimum(x, y) * k + np.maximum(x, y), return_counts=True)
                seen.append((pair, np.where(p == 0, n, 0), np.where(p > 0, n, 0)))
            pair, o, n = (np.concatenate(c) for c in zip(*seen, strict=True))
            pair, at = np.unique(pair, return_inverse=True)
            o, s, q = (np.bincount(at, w, len(pair)) for w in (o, n, n.astype(float) ** 2))
            yield pa.RecordBatch.from_pydict({"sample_id": pa.array(t["sample_id"][:1].to_pylist() * len(pair), pa.string()), "a": pa.array(names[pair // max(k, 1)].tolist(), pa.string()), "b": pa.array(names[pair % max(k, 1)].tolist(), pa.string()), "o": pa.array(o.astype(np.int64)), "s": pa.array(s.astype(float)), "q": pa.array(q.astype(float))})

    n = _dealt(edges, cells.filter("cell_type is not null"), "cell_type", perms, part_cells).mapInArrow(count, "sample_id string, a string, b string, o long, s double, q double")
    g = n.groupBy("sample_id", "a", "b").agg(F.sum("o").alias("o"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / perms
    var = F.col("q") / perms - mean * mean
    return g.filter(var > 1e-9).select("sample_id", "a", "b", F.col("o").alias("n"), F.bround((F.col("o") - mean) / F.sqrt(var), 6).alias("z"))


def permutation(n: int, seed: str, group: str, perm: int) -> np.ndarray:
    """Order of ``n`` rows under permutation ``perm`` of a group, drawn from an md5 of the three; 0 leaves them as they are."""
    if not perm:
        return np.arange(n)
    return np.random.default_rng(int(hashlib.md5(f"{seed}|{group}|{perm}".encode()).hexdigest(), 16)).permutation(n)


def _numbered(cells: DataFrame, part_cells: int) -> DataFrame:
    """Adds i, the cell's place in its sample by id, and parts, the tasks the sample is dealt to."""
    w = Window.partitionBy("sample_id")
    return cells.withColumn("i", F.row_number().over(w.orderBy("cell_id")) - 1).withColumn("parts", F.ceil(F.count("*").over(w) / F.lit(part_cells)).cast("int"))


def enrichment_settings(graphs: dict[str, DataFrame], cells: DataFrame, *, perms: int = 250, seed: str = "0", part_cells: int = 50_000) -> DataFrame:
    """(sample_id, setting, a, b, n, z): ``enrichment`` on several graphs under the same permutations.

    Edges travel as two numbers; a task holds the labels of one sample and the edges of at most
    ``part_cells`` of its cells, and counts one permutation after the other.
    """
    lab = materialise(_numbered(cells.filter("cell_type is not null and sample_id is not null").select("sample_id", "cell_id", "cell_type"), part_cells))
    edges = None
    for name, g in graphs.items():
        e = g.select("sample_id", "src", "dst", F.lit(name).alias("setting"))
        edges = e if edges is None else edges.union(e)
    ends = lambda end, n: lab.select("sample_id", F.col("cell_id").alias(end), F.col("i").alias(n), *(["parts"] if n == "i" else []))
    edges = edges.join(ends("src", "i"), ["sample_id", "src"]).join(ends("dst", "j"), ["sample_id", "dst"]).select("sample_id", F.expr("i % parts").alias("part"), "setting", "i", "j")
    every = lab.select("sample_id", "i", "cell_type", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    kind = "sample_id string, setting string, a string, b string, counts array<long>"

    def count(e: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(e):
            names, code = np.unique(c.sort_values("i")["cell_type"].to_numpy(dtype=object), return_inverse=True)
            k, sample = len(names), e["sample_id"].iloc[0]
            for setting, own in e.groupby("setting", sort=True):
                i, j = own["i"].to_numpy(), own["j"].to_numpy()
                n = np.empty((perms + 1, k * k), np.int64)
                for p in range(perms + 1):
                    v = code[permutation(len(code), seed, sample, p)]
                    n[p] = np.bincount(v[i] * k + v[j], minlength=k * k)
                n = n.reshape(-1, k, k)
                n = n + np.where(np.eye(k, dtype=bool), 0, n.transpose(0, 2, 1))
                out += [(sample, setting, names[a], names[b], n[:, a, b]) for a in range(k) for b in range(a, k) if n[:, a, b].any()]
        return pd.DataFrame(out, columns=["sample_id", "setting", "a", "b", "counts"])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (a, b), own in pdf.groupby(["a", "b"]):
            n = np.sum(np.stack(own["counts"].to_list()), axis=0)
            mean, var = n[1:].mean(), (n[1:].astype(float) ** 2).mean() - n[1:].mean() ** 2
            if var > 1e-9:
                out.append((pdf["sample_id"].iloc[0], pdf["setting"].iloc[0], a, b, int(n[0]), round(float((n[0] - mean) / np.sqrt(var)), 6)))
        return pd.DataFrame(out, columns=["sample_id", "setting", "a", "b", "n", "z"])

    n = edges.groupBy("sample_id", "part").cogroup(every.groupBy("sample_id", "part")).applyInPandas(count, kind)
    return n.groupBy("sample_id", "setting").applyInPandas(score, "sample_id string, setting string, a string, b string, n long, z double")


def distance_band(cells: DataFrame, nearest: DataFrame, *, times: float = 3.0) -> DataFrame:
    """(sample_id, src, dst): edges within ``times`` the sample's median nearest-neighbour distance. P2.

    ``nearest``: (sample_id, d2), one row a cell.  Samples whose median is 0 have no band.
    """
    r = nearest.groupBy("sample_id").agg((F.percentile(F.sqrt("d2"), 0.5) * times).alias("r")).filter("r > 0")
    c = cells.join(r, "sample_id").select("sample_id", "cell_id", (F.col("x") / F.col("r")).alias("x"), (F.col("y") / F.col("r")).alias("y"))
    return radius_edges(c, 1.0).select("sample_id", "src", "dst")


def robustness(scored: DataFrame, samples: DataFrame, knn: list[str], *, band: str = "band", top: int = 10) -> DataFrame:
    """Per sample, agreement of the settings' z with the first's. P2.

    ``scored``: (sample_id, setting, a, b, z); ``samples``: sample_id; ``knn``: the settings, the
    reference first.  A row for each later setting and for the band, and one, ``knn``, with the means
    over the neighbour settings and ``pairs``, the stability of the reference's ``top`` pairs by abs(z).
    Signs are compared over these pairs where the other setting has them.  A row is
    insufficient_settings where one of its settings has no pair (``knn``: fewer than two have).
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sample, out = pdf["sample_id"].iloc[0], []
        maps = {s: {(r.a, r.b): r.z for r in own.itertuples()} for s, own in pdf[pdf["setting"].notna()].groupby("setting")}
        best = {s: sorted(m, key=lambda p: (-abs(m[p]), p))[:top] for s, m in maps.items()}

        def compare(first: str, other: str) -> tuple[float, float]:
            met = [p for p in best[first] if p in maps[other]]
            both, either = set(best[first]) & set(best[other]), set(best[first]) | set(best[other])
            return sum((maps[first][p] > 0) == (maps[other][p] > 0) for p in met) / max(len(met), 1), len(both) / len(either)

        def row(setting: str, n: int, signs: list[tuple[float, float]], pairs: list[dict]) -> tuple:
            if not signs:
                return (sample, setting, "insufficient_settings", n, None, None, 0.0, [])
            sign, jaccard = (sum(v) / len(signs) for v in zip(*signs, strict=True))
            return (sample, setting, "computed", n, round(sign, 4), round(jaccard, 4), round(0.6 * sign + 0.4 * jaccard, 4), pairs)

        has = [s for s in knn if s in maps]
        first, pairs = has[0] if has else None, []
        for a, b in best[first] if first else []:
            z, met = maps[first][a, b], [maps[s][a, b] for s in has if (a, b) in maps[s]]
            pairs.append({"a": a, "b": b, "z": z, "settings": len(met), "sign": round(sum((z > 0) == (v > 0) for v in met) / len(met), 4), "presence": round(sum((a, b) in best[s] for s in has) / len(has), 4)})
        out.append(row("knn", len(has), [compare(first, s) for s in has[1:]], pairs))
        for s in [*knn[1:], band]:
            ok = first is not None and s in maps and s != first
            out.append(row(s, 1 + ok if first else int(s in maps), [compare(first, s)] if ok else [], []))
        return pd.DataFrame(out, columns=["sample_id", "setting", "status", "settings", "sign", "jaccard", "score", "pairs"])

    none = samples.select("sample_id", *[F.lit(None).cast(t).alias(c) for c, t in (("setting", "string"), ("a", "string"), ("b", "string"), ("z", "double"))])
    kind = "sample_id string, setting string, status string, settings int, sign double, jaccard double, score double, pairs array<struct<a: string, b: string, z: double, settings: int, sign: double, presence: double>>"
    return scored.select("sample_id", "setting", "a", "b", "z").union(none.distinct()).groupBy("sample_id").applyInPandas(one, kind)


def _morans(edges: DataFrame, values: DataFrame, cells: DataFrame, digits: int = 6) -> DataFrame:
    """I of sparse ``values`` (sample_id, cell_id, gene, value), missing = 0, weights row-standardised."""
    n = cells.groupBy("sample_id").agg(F.count("*").alias("cells"))
    deg = edges.groupBy("sample_id", "src").agg(F.count("*").alias("deg"))
    w = edges.join(deg, ["sample_id", "src"]).select("sample_id", "src", "dst", (1.0 / F.col("deg")).alias("w"))
    colw = w.groupBy("sample_id", F.col("dst").alias("cell_id")).agg(F.sum("w").alias("cw"))
    roww = deg.select("sample_id", F.col("src").alias("cell_id"), F.lit(1.0).alias("rw"))
    m = values.groupBy("sample_id", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(n, "sample_id").withColumn("mean", F.col("s") / F.col("cells"))
    # sum w (xi - m)(xj - m) = sum w xi xj - m (sum rw xi + sum cw xj) + m^2 W, over stored values only
    v = values.select("sample_id", "gene", "cell_id", "value")
    book = v.groupBy("sample_id", "cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("m"))
    met = w.join(book.withColumnsRenamed({"cell_id": "src", "m": "ms"}), ["sample_id", "src"]).join(book.withColumnsRenamed({"cell_id": "dst", "m": "md"}), ["sample_id", "dst"])
    met = met.select("sample_id", "w", "md", F.explode("ms").alias("gene", "a"))
    cross = met.groupBy("sample_id", "gene").agg(F.sum(F.col("w") * F.col("a") * F.try_element_at("md", F.col("gene"))).alias("cross"))
    side = v.join(roww, ["sample_id", "cell_id"], "left").join(colw, ["sample_id", "cell_id"], "left").groupBy("sample_id", "gene").agg(F.sum(F.col("value") * (F.coalesce("rw", F.lit(0.0)) + F.coalesce("cw", F.lit(0.0)))).alias("side"))
    total = deg.groupBy("sample_id").agg(F.count("*").cast("double").alias("W"))
    j = m.join(side, ["sample_id", "gene"]).join(total, "sample_id").join(cross, ["sample_id", "gene"], "left")
    num = F.coalesce("cross", F.lit(0.0)) - F.col("mean") * F.col("side") + F.col("mean") * F.col("mean") * F.col("W")
    den = F.col("q") - F.col("cells") * F.col("mean") * F.col("mean")
    return j.filter(den > 1e-9).select("sample_id", "gene", F.bround(F.col("cells") / F.col("W") * num / den, digits).alias("i"))


def morans_i(edges: DataFrame, expr: DataFrame, cells: DataFrame) -> DataFrame:
    """(sample_id, gene, i): Moran's I of every gene. P3."""
    v = expr.join(cells.select("sample_id", "cell_id"), ["sample_id", "cell_id"], "left_semi")
    return _morans(edges, v, cells)


def gene_screen(expr: DataFrame, cells: DataFrame, *, share: float = 0.01, least: int = 10) -> DataFrame:
    """(gene, detected, tested): detected in max(least, int(share n)) cells; all if fewer than two are. P4."""
    n = cells.agg(F.count("*").alias("cells"))
    g = expr.filter("value > 0").groupBy("gene").agg(F.count("*").alias("detected")).join(F.broadcast(n))  # one row
    ok = F.col("detected") >= F.greatest(F.lit(least), F.floor(F.col("cells") * share))
    g = g.withColumn("ok", ok)
    strict = g.agg(F.count_if("ok").alias("strict"))
    return g.join(F.broadcast(strict)).select("gene", "detected", (F.col("ok") | (F.col("strict") < 2)).alias("tested"))  # one row


def group_morans(edges: DataFrame, cells: DataFrame, *, least: int = 50, groups: int = 2) -> DataFrame:
    """(sample_id, label, i): Moran's I of each label's indicator, labels of ``least`` cells or more. P5.

    A sample with fewer than ``groups`` such labels has no row.
    """
    ok = cells.filter("cell_type is not null").groupBy("sample_id", "cell_type").agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    ok = ok.join(ok.groupBy("sample_id").agg(F.count("*").alias("groups")).filter(F.col("groups") >= groups), "sample_id")
    v = cells.join(ok, ["sample_id", "cell_type"]).select("sample_id", "cell_id", F.col("cell_type").alias("gene"), F.lit(1.0).alias("value"))
    return _morans(edges, v, cells).withColumnRenamed("gene", "label")


def _filled(cells: DataFrame, expr: DataFrame, gene: str) -> DataFrame:
    """(sample_id, cell_id, z): z-scores of one gene over all cells of the sample, missing = 0."""
    v = cells.select("sample_id", "cell_id").join(expr.filter(F.col("gene") == gene).select("cell_id", "value"), "cell_id", "left").fillna({"value": 0.0})
    s = v.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / F.col("n")
    s = s.select("sample_id", mean.alias("m"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd")).filter("sd > 1e-9")
    return v.join(s, "sample_id").select("sample_id", "cell_id", ((F.col("value") - F.col("m")) / F.col("sd")).alias("z"))


def _lag(edges: DataFrame, z: DataFrame) -> DataFrame:
    return edges.join(z.withColumnRenamed("cell_id", "dst"), ["sample_id", "dst"]).groupBy("sample_id", F.col("src").alias("cell_id")).agg(F.avg("z").alias("lag"))


def lisa(edges: DataFrame, cells: DataFrame, expr: DataFrame, gene: str, *, perms: int = 19, seed: str = "0", part_cells: int = 50_000) -> DataFrame:
    """(sample_id, cell_id, i, zscore, quadrant) of one gene: the z-scores of P6, without its test.

    ``lisa_classes`` is the whole of P6.  i = z * lag; the null keeps z and shuffles the values over positions; zscore is (i - mean) /
    sd over the permutations, 0 where sd is 0; quadrants use strict signs.  Samples in which
    the gene is constant are left out.  Permutations are dealt to tasks as in ``enrichment``.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, i, j in _units(batches):
            z = t["value"].to_numpy()
            deg = np.bincount(i, minlength=len(z))
            has = np.flatnonzero(deg)
            seen, s, q = None, np.zeros(len(has)), np.zeros(len(has))
            for p in range(t["block"][0].as_py(), perms + 1, t["blocks"][0].as_py()):
                lag = np.bincount(i, z[_md5_order(t["cell_id"], seed, p)][j], len(z))[has] / deg[has]
                x = z[has] * lag
                if p:
                    s += x
                    q += x * x
                else:
                    seen = lag
            none = pa.nulls(len(has), pa.float64())
            rows = t.select(["sample_id", "cell_id"]).take(pa.array(has)).combine_chunks()
            for c, v in (("z", pa.array(z[has])), ("lag", none if seen is None else pa.array(seen)), ("i", none if seen is None else pa.array(z[has] * seen)), ("s", pa.array(s)), ("q", pa.array(q))):
                rows = rows.append_column(c, v)
            yield from rows.to_batches(100_000)

    part = _dealt(edges, _filled(cells, expr, gene), "z", perms, part_cells).mapInArrow(score, "sample_id string, cell_id string, z double, lag double, i double, s double, q double")
    g = part.groupBy("sample_id", "cell_id").agg(F.max("z").alias("z"), F.max("lag").alias("lag"), F.max("i").alias("i"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / perms
    sd = F.sqrt(F.greatest(F.col("q") / perms - mean * mean, F.lit(0.0)))
    quad = F.when((F.col("z") > 0) & (F.col("lag") > 0), "high-high").when((F.col("z") < 0) & (F.col("lag") < 0), "low-low").when((F.col("z") > 0) & (F.col("lag") < 0), "high-low").when((F.col("z") < 0) & (F.col("lag") > 0), "low-high").otherwise("none")
    return g.select("sample_id", "cell_id", F.bround("i", 6).alias("i"), F.bround(F.when(sd > 1e-9, (F.col("i") - mean) / sd).otherwise(0.0), 4).alias("zscore"), quad.alias("quadrant"))


def lisa_classes(edges: DataFrame, cells: DataFrame, expr: DataFrame, genes: list[str], *, perms: int = 999, alpha: float = 0.05, seed: str = "0", part_cells: int = 50_000) -> DataFrame:
    """(sample_id, cell_id, gene, i, zscore, p, p_adj, class) of several genes. P6.

    i = z * lag; the null keeps a cell's z and shuffles the sample's values over positions, ``perms``
    times (99 at least), with the same permutations for every gene; p is that of the z-score, p_adj by sample and gene;
    class is the quadrant, or not-significant where p_adj is over ``alpha``.  Genes constant in a
    sample are left out there.  A task holds the values of one sample and the neighbours of at most ``part_cells`` of its cells.
    """
    perms = max(99, perms)
    spark = cells.sparkSession
    book = expr.filter(F.col("gene").isin(genes)).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("m"))
    c = cells.filter("sample_id is not null").select("sample_id", "cell_id").join(book, "cell_id", "left")
    c = c.select("sample_id", "cell_id", F.array(*[F.coalesce(F.try_element_at("m", F.lit(g)), F.lit(0.0)) for g in genes]).alias("v"))
    c = materialise(_numbered(c, part_cells))
    ends = lambda end, n: c.select("sample_id", F.col("cell_id").alias(end), F.col("i").alias(n))
    near = edges.select("sample_id", "src", "dst").join(ends("src", "i"), ["sample_id", "src"]).join(ends("dst", "j"), ["sample_id", "dst"]).groupBy("sample_id", "i").agg(F.array_sort(F.collect_list("j")).alias("near"))
    own = c.select("sample_id", F.expr("i % parts").alias("part"), "i", "cell_id").join(near, ["sample_id", "i"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
    every = c.select(F.col("sample_id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("i").alias("i"), "v")

    def score(o: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(e.sort_values("i")["v"].to_list())
        sample, n, sd = e["sample_id"].iloc[0], len(v), v.std(axis=0)
        used = np.flatnonzero(sd > 1e-9)
        z = np.vstack([(v[:, used] - v[:, used].mean(axis=0)) / sd[used], np.zeros(len(used))])  # the last row for missing neighbours
        at, deg = o["i"].to_numpy(), o["near"].map(len).to_numpy()
        hood = np.full((len(o), max(deg.max(), 1)), n)
        hood[np.arange(hood.shape[1]) < deg[:, None]] = np.concatenate(o["near"].to_list())
        hood, deg = np.ascontiguousarray(hood.T), np.maximum(deg, 1)[:, None]

        def lag(w: np.ndarray) -> np.ndarray:
            total = w[hood[0]]
            for h in hood[1:]:
                total += w[h]
            return total / deg

        seen, s, q = lag(z), np.zeros((len(o), len(used))), np.zeros((len(o), len(used)))
        for p in range(1, perms + 1):
            got = lag(z[np.r_[permutation(n, seed, sample, p), n]])
            s += got
            q += got * got
        mean, x = s / perms, z[at]
        spread = np.abs(x) * np.sqrt(np.maximum(q / perms - mean * mean, 0.0))
        score = np.where(spread > 1e-9, x * (seen - mean) / np.where(spread > 1e-9, spread, 1.0), 0.0)
        quad = np.where(x > 0, np.where(seen > 0, "high-high", "high-low"), np.where(seen > 0, "low-high", "low-low"))
        return pd.concat([pd.DataFrame({"sample_id": sample, "cell_id": o["cell_id"].to_numpy(), "gene": genes[g], "i": x[:, k] * seen[:, k], "zscore": score[:, k], "quadrant": quad[:, k]}) for k, g in enumerate(used)] or [pd.DataFrame(columns=["sample_id", "cell_id", "gene", "i", "zscore", "quadrant"])])

    by, parts = ["sample_id", "part"], shuffle_partitions(spark)
    g = own.repartition(parts, *by).groupBy(*by).cogroup(every.repartition(parts, *by).groupBy(*by)).applyInPandas(score, "sample_id string, cell_id string, gene string, i double, zscore double, quadrant string")
    g = benjamini_hochberg(materialise(g).withColumn("p", two_sided_p(F.col("zscore"))), by=["sample_id", "gene"], key="cell_id")
    kind = F.when(F.col("p_adj") <= alpha, F.col("quadrant")).otherwise("not-significant")
    return g.select("sample_id", "cell_id", "gene", F.bround("i", 6).alias("i"), F.bround("zscore", 4).alias("zscore"), "p", "p_adj", kind.alias("class"))


def lees_l(edges: DataFrame, cells: DataFrame, expr: DataFrame, a: str, b: str) -> DataFrame:
    """(sample_id, l, pearson, verdict) of two genes; verdict by 0.05. P7."""
    za, zb = _filled(cells, expr, a), _filled(cells, expr, b)
    n = cells.groupBy("sample_id").agg(F.count("*").alias("n"))
    lags = _lag(edges, za).join(_lag(edges, zb).withColumnRenamed("lag", "lb"), ["sample_id", "cell_id"]).groupBy("sample_id").agg(F.sum(F.col("lag") * F.col("lb")).alias("ll"))
    pear = za.join(zb.withColumnRenamed("z", "zb"), ["sample_id", "cell_id"]).groupBy("sample_id").agg(F.sum(F.col("z") * F.col("zb")).alias("zz"))
    j = lags.join(pear, "sample_id").join(n, "sample_id")
    l_ = F.col("ll") / F.col("n")
    return j.select("sample_id", F.bround(l_, 6).alias("l"), F.bround(F.col("zz") / F.col("n"), 6).alias("pearson"), F.when(l_ > 0.05, "together").when(l_ < -0.05, "apart").otherwise("independent").alias("verdict"))


def benjamini_hochberg(rows: DataFrame, p: str = "p", *, by: str | list[str] | None = None, key: str = "gene") -> DataFrame:
    """Adds ``p_adj``: p n / rank, least over the larger ones, at most 1. P15, W4.

    Without ``by`` all rows are one family and one window; families of that size (genes of a
    panel, cells of a sample) are meant.
    """
    fam = [F.lit(1)] if not by else [by] if isinstance(by, str) else by
    n = F.count("*").over(Window.partitionBy(*fam))
    r = F.row_number().over(Window.partitionBy(*fam).orderBy(p, key))
    q = rows.withColumn("__q", F.col(p) * n / r)
    low = F.min("__q").over(Window.partitionBy(*fam).orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0))
    return q.withColumn("p_adj", F.least(low, F.lit(1.0))).drop("__q")


def erfc(x: Column) -> Column:
    """Complementary error function, by Arrow batches (Spark has none)."""

    @F.pandas_udf("double")
    def f(v: pd.Series) -> pd.Series:
        return v.map(math.erfc, na_action="ignore")

    return f(x)


def two_sided_p(z: Column) -> Column:
    """p of a z-score. A17, P6, C4."""
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def hotspot_regions(classes: DataFrame, genes: list[str], *, least: int = 100) -> DataFrame:
    """(sample_id, cell_id, gene, hits): the first gene, in the given order, whose hotspot a cell is in. P18, P19.

    ``classes``: of ``lisa_classes``.  A sample's region of fewer than ``least`` cells is left out.
    """
    order = F.array_position(F.array(*[F.lit(g) for g in genes]), F.col("gene"))
    hot = classes.filter("class = 'high-high'").groupBy("sample_id", "cell_id").agg(F.min_by("gene", order).alias("gene"), F.count("*").alias("hits"))
    return hot.withColumn("n", F.count("*").over(Window.partitionBy("sample_id", "gene"))).filter(F.col("n") >= least).drop("n")


def region_overlap(cells: DataFrame) -> DataFrame:
    """(a, b, overlap): sum over regions of the lesser share, for every pair of labels, a < b. J12.

    The table of labels and regions is small; pairs are met through the region.
    """
    c = cells.filter("cell_type is not null and region is not null").groupBy("cell_type", "region").agg(F.count("*").alias("n"))
    c = c.select("cell_type", "region", (F.col("n") / F.sum("n").over(Window.partitionBy("cell_type"))).alias("f"))
    d = c.select(F.col("cell_type").alias("b"), "region", F.col("f").alias("fb"))
    return c.join(d, "region").filter("cell_type < b").groupBy(F.col("cell_type").alias("a"), "b").agg(F.bround(F.sum(F.least("f", "fb")), 4).alias("overlap"))


def evidence_status(z: Column, least: Column, score: Column, settings: Column, sign: Column, presence: Column) -> Column:
    """stable_*, *_sensitivity_limited or weak_or_indeterminate. P14."""
    way = F.when(z > 0, "enriched").when(z < 0, "depleted")
    firm = (F.abs(z) >= 2) & (least >= 20) & (score >= 0.6) & (settings >= 2) & (sign >= 0.8) & (presence >= 0.5)
    return F.when(firm & way.isNotNull(), F.concat(F.lit("stable_"), way)).when((F.abs(z) >= 2) & way.isNotNull(), F.concat(way, F.lit("_sensitivity_limited"))).otherwise("weak_or_indeterminate")
