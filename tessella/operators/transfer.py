"""Label transfer from reference cells by nearest neighbours in expression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise

# Bits of genes and values of genes that a block of references may take, and parts of a block with a bound of their own.
BITS, VALUES, PARTS = 1 << 29, 1 << 23, 64


def shared_panel(reference: DataFrame, target: DataFrame, *, least: int = 5) -> DataFrame:
    """Genes measured in both; raises if there are fewer than ``least``. J11."""
    g = reference.select("gene").distinct().intersect(target.select("gene").distinct())
    if g.limit(least).count() < least:
        raise ValueError(f"fewer than {least} shared genes")
    return g


class References:
    """Reference cells by bits of their genes, for exact searches; genes are numbers below ``genes``, those of a cell end at ``ends``.

    Cells lie in the order of what they have in squares without their five largest.  A pair that shares c genes is at
    least as far apart as the smallest squares of both sides but c; a part of the cells is searched down to the c that
    this allows.
    """

    def __init__(self, ends: np.ndarray, g: np.ndarray, v: np.ndarray, genes: int):
        n, size = len(ends), np.diff(ends, prepend=0)
        width = int(size.max(initial=1))
        row, col = np.repeat(np.arange(n, dtype=np.int32), size), np.arange(len(g), dtype=np.int32) - np.repeat((ends - size).astype(np.int32), size)
        sq = np.zeros((n, width))
        sq[row, col] = v * v
        norm = sq.sum(1)
        sq.sort(axis=1)
        self.n, self.order, words = n, np.argsort(sq[:, : max(1, width - 5)].sum(1), kind="stable"), -(-n // 64)
        self.step = -(-words // PARTS)  # words of a part
        parts = [self.order[a : a + 64 * self.step] for a in range(0, n, 64 * self.step)]
        self.least = np.array([np.cumsum(sq[i], axis=1).min(0)[::-1] for i in parts])
        del sq
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        row, self.norm = place[row], norm[self.order]
        self.g, self.v = np.full((n, width), genes, np.uint16 if genes < 1 << 16 else np.int32), np.zeros((n, width))
        self.g[row, col], self.v[row, col] = g, v
        del col
        row, to = row[np.argsort(g.astype(self.g.dtype), kind="stable")], np.cumsum(np.bincount(g, minlength=genes)).tolist()
        self.bits, own = np.zeros((genes, words), np.uint64), np.zeros(64 * words, np.uint8)
        for i, (a, b) in enumerate(zip([0, *to], to, strict=False)):
            own[row[a:b]] = 1
            self.bits[i] = np.packbits(own, bitorder="little").view(np.uint64)
            own[row[a:b]] = 0
        self.cells = np.diff(to, prepend=0)
        self.q, self.dense, self.last = np.zeros(genes + 1), None, (b"", [])

    def _planes(self, g: np.ndarray) -> list[np.ndarray]:
        """Binary digits, from the lowest, of the number of genes ``g`` that each cell has; kept for the next target."""
        key = g.tobytes()
        if self.last[0] == key:
            return self.last[1]
        planes, level = [], [self.bits[i] for i in g.tolist()] or [np.zeros(self.bits.shape[1], np.uint64)]
        while level:
            up = []
            while len(level) > 2:
                a, b, c = level[:3]
                u = a ^ b
                level = [*level[3:], u ^ c]
                u &= c
                u |= a & b
                up.append(u)
            if len(level) == 2:
                up.append(level[0] & level[1])
                level = [level[0] ^ level[1]]
            planes.append(level[0])
            level = up
        self.last = key, planes
        return planes

    def _places(self, bits: np.ndarray) -> np.ndarray:
        w = np.flatnonzero(bits != 0)
        i = np.flatnonzero(np.unpackbits(bits[w].view(np.uint8), bitorder="little").view(bool))
        i = (w[i >> 6] << 6) + (i & 63)
        return i if not len(i) or i[-1] < self.n else i[i < self.n]

    def _distances(self, i: np.ndarray, g: np.ndarray, v: np.ndarray) -> np.ndarray:
        """d2 to the cells ``i``; if they are many, by products with all cells."""
        if len(i) <= max(1024, self.n // 8):
            self.q[g] = v
            d = self.norm.take(i) + v @ v - 2 * np.einsum("ij,ij->i", self.q.take(self.g.take(i, 0)), self.v.take(i, 0))
            self.q[g] = 0
            return d
        if self.dense is None:  # of genes of over an eighth of the cells; lists of the others
            flat = self.g.ravel()
            by = np.argsort(flat, kind="stable")[: int(self.cells.sum())]
            self.row, self.val, self.ends = by // self.g.shape[1], 2 * self.v.ravel()[by], np.r_[0, np.cumsum(self.cells)]
            self.often = np.flatnonzero(self.cells > self.n / 8)
            self.column = np.full(len(self.q), -1)
            self.column[self.often] = np.arange(len(self.often))
            self.dense = np.zeros((self.n, len(self.often)))
            for j, x in enumerate(self.often.tolist()):
                self.dense[self.row[self.ends[x] : self.ends[x + 1]], j] = self.val[self.ends[x] : self.ends[x + 1]]
        at, w = self.column[g], np.zeros(len(self.often))
        w[at[at >= 0]] = v[at >= 0]
        d = self.norm + v @ v - self.dense @ w
        for x, y in zip(g[at < 0].tolist(), v[at < 0].tolist(), strict=True):
            d[self.row[self.ends[x] : self.ends[x + 1]]] -= self.val[self.ends[x] : self.ends[x + 1]] * y
        return d[i]

    def near(self, g: np.ndarray, v: np.ndarray, k: int, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(places, d2) of the ``k`` nearest of those at d2 of ``limit`` or less; ties (to 1e-9 of d2) go to the smaller place."""
        k, genes, off = min(k, self.n), len(g), 0
        if limit == np.inf:  # a bound from those that share most genes
            planes = self._planes(g)
            lo, hi = 0, genes
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if int(np.bitwise_count(_at_least(planes, mid)).sum(dtype=np.int64)) >= k else (lo, mid - 1)
            limit = np.partition(self._distances(self._places(_at_least(planes, lo)), g, v), k - 1)[k - 1]
        limit += 1e-8
        left = np.zeros(genes + 1)
        left[:genes] = np.cumsum(np.sort(v * v))[::-1]
        left = left[: self.least.shape[1]]
        need = (left + self.least[:, : len(left)] > limit + 1e-9 * self.norm[-1]).sum(1)  # genes that a cell of the part has to share
        use = genes - int(need.min()) + 5
        if 0 < use <= 2 * genes // 3:  # who shares all but so many genes shares some of the rarest
            off = genes - use
        planes = self._planes(g[np.argsort(self.cells[g], kind="stable")[:use]] if off else g)
        cut = [0, *(np.flatnonzero(need[1:] != need[:-1]) + 1).tolist(), len(need)]
        bits = [_at_least([x[a * self.step : b * self.step] for x in planes], int(need[a]) - off) for a, b in zip(cut, cut[1:], strict=False)]
        i = self._places(np.concatenate(bits))
        d2 = self._distances(i, g, v)
        i, d2 = self.order[i[d2 <= limit]], np.round(np.maximum(d2[d2 <= limit], 0), 9)
        best = np.lexsort((i, d2))[:k]
        return i[best], d2[best]


def _at_least(planes: list[np.ndarray], m: int) -> np.ndarray:
    """Bits of the cells whose number is ``m`` or more."""
    if m <= 0:
        return np.full_like(planes[0], ~np.uint64(0))
    if (m - 1) >> len(planes):
        return np.zeros_like(planes[0])
    more = None  # of the digits so far, none is above those of m - 1
    for i, x in enumerate(planes):
        if (m - 1) >> i & 1:
            more = more if more is None else x & more
        else:
            more = x if more is None else x | more
    return np.zeros_like(planes[0]) if more is None else more


def _nearest(targets: Iterator[tuple[np.ndarray, np.ndarray]], g: list[np.ndarray], v: list[np.ndarray], k: int, probe: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, d2) of the ``k`` nearest of the sparse vectors (g, v) to each target; ties (to 1e-9 of d2) go to the smaller place."""
    names, at = np.unique(np.concatenate(g), return_inverse=True)
    refs = References(np.cumsum([len(x) for x in g]), at, np.concatenate(v), len(names))
    for tg, tv in targets:
        i = np.minimum(np.searchsorted(names, tg), len(names) - 1)
        ok = names[i] == tg
        top, d2 = refs.near(i[ok], tv[ok], k)
        yield top, np.round(d2 + (tv[~ok] ** 2).sum(), 9)


def _has_arrays(expr: DataFrame) -> bool:
    return dict(expr.dtypes)["raw"].startswith("array")


def _packed(expr: DataFrame) -> DataFrame:
    """Cells with the arrays of their genes and counts, from (cell_id, gene, raw) or as they are."""
    if _has_arrays(expr):
        return expr
    e = expr.select("cell_id", F.struct("gene", F.col("raw").cast("double").alias("raw")).alias("e")).groupBy("cell_id").agg(F.collect_list("e").alias("e"))
    return e.select("cell_id", F.col("e.gene").alias("gene"), F.col("e.raw").alias("raw"))


def _numbered(cells: DataFrame, panel: list[str]) -> DataFrame:
    """Genes as their places in ``panel``, in order, those outside it left out; cells without counts fall."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(panel, pa.string())
        for b in batches:
            ends = np.cumsum(pc.list_value_length(b.column("gene")).to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            g = pc.fill_null(pc.index_in(b.column("gene").flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
            raw = b.column("raw").flatten().to_numpy(zero_copy_only=False)
            total = np.bincount(row[g >= 0], raw[g >= 0], len(ends))
            o = np.lexsort((g, row))
            o = o[(g[o] >= 0) & (total[row[o]] > 0)]
            kept = np.flatnonzero(total > 0)
            to = pa.array(np.r_[0, np.cumsum(np.bincount(row[o], minlength=len(ends))[kept])].astype(np.int32))
            lists = {"gene": pa.ListArray.from_arrays(to, pa.array(g[o].astype(np.int32))), "raw": pa.ListArray.from_arrays(to, pa.array(raw[o]))}
            yield pa.RecordBatch.from_pydict({c: lists[c] if c in lists else b.column(c).take(pa.array(kept)) for c in b.schema.names})

    return cells.mapInArrow(number, ", ".join(f"{c} {'array<int>' if c == 'gene' else t}" for c, t in cells.dtypes))


def _vectors(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, genes, ln(1 + raw / total * 1e4)) of numbered cells."""
    size = np.concatenate([pc.list_value_length(b.column("gene")).to_numpy(zero_copy_only=False) for b in batches])
    g, raw = (np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in batches]) for c in ("gene", "raw"))
    row = np.repeat(np.arange(len(size)), size)
    return np.cumsum(size), g, np.log1p(raw / np.bincount(row, raw, len(size))[row] * 1e4)


def _blocks(files: list[str], genes: int, wide: int) -> Iterator[References]:
    """Cells of the files in order, as many at once as a block may hold; one block is in memory at a time."""
    wide = max(1, min(wide, BITS // max(1, genes)))
    kept, cells, width = [], 0, 1
    for b in _batches(files, min(wide, 16_384), ["gene", "raw"]):
        most = pc.max(pc.list_value_length(b.column("gene"))).as_py()
        if kept and (cells + len(b) > wide or (cells + len(b)) * max(width, most) > VALUES):
            made, kept, cells, width = References(*_vectors(kept), genes), [], 0, 1
            yield made
            del made
        kept, cells, width = [*kept, b], cells + len(b), max(width, most)
    if kept:
        made, kept = References(*_vectors(kept), genes), []
        yield made


def _batches(files: list[str], rows: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    for f in files:
        fs, path = FileSystem.from_uri(f)
        with fs.open_input_file(path) as at:
            yield from (b for b in pq.ParquetFile(at).iter_batches(rows, columns=columns) if len(b))


def neighbours(reference: DataFrame, target: DataFrame, k: int, *, least: int = 5, block: int = 65_536, wide: int = 131_072) -> DataFrame:
    """(cell_id, ref, d2): a row for every target cell, with the arrays of its ``k`` nearest reference cells in order; also ``labels`` if the reference has them.

    Both are (cell_id, gene, raw), long, or a written table of a row for every cell with arrays.  The numbered references are written once, in the order of their
    ids; every task reads them, ``wide`` at a time, past its own targets (about ``block`` at a time), which keep the best
    so far.  No pair, and no copy of a cell for a block, is shuffled.
    """
    reference, target = (x if _has_arrays(x) else materialise(_packed(x)) for x in (reference, target))
    names = [materialise(x.select(F.explode("gene").alias("gene")).distinct()) for x in (reference, target)]
    panel = sorted(r.gene for r in shared_panel(*names, least=least).collect())  # a panel of genes, not cells
    written = materialise(_numbered(reference, panel).orderBy("cell_id"))
    files = sorted(written.inputFiles())
    extra = [c for c in written.columns if c not in ("gene", "raw", "cell_id")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            kept.append(b)
            if sum(map(len, kept)) >= block:
                yield from found(kept)
                kept = []
        if sum(map(len, kept)):
            yield from found(kept)

    def found(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, g, v = _vectors(kept)
        starts, ends = [0, *ends[:-1].tolist()], ends.tolist()
        turns = sorted(range(len(ends)), key=lambda t: g[starts[t] : ends[t]].tobytes())
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ends)
        first = 0
        for refs in _blocks(files, len(panel), wide):
            for t in turns:
                a, b, (at, d2) = starts[t], ends[t], best[t]
                new, d = refs.near(g[a:b], v[a:b], k, d2[-1] if len(d2) == k else np.inf)
                if len(new):
                    d2 = np.concatenate([d2, d])
                    o = np.argsort(d2, kind="stable")[:k]  # places of later blocks are larger
                    best[t] = np.concatenate([at, new + first])[o], d2[o]
            first += refs.n
            del refs  # before the next is made
        to = pa.array(np.r_[0, np.cumsum([len(x) for x, _ in best])].astype(np.int32))
        at = np.concatenate([x for x, _ in best])
        if not len(at):
            return
        o = np.argsort(at, kind="stable")
        back, bounds, took, first = np.empty(len(o), np.int64), at[o], [], 0
        back[o] = np.arange(len(o))
        for b in _batches(files, 16_384, ["cell_id", *extra]):
            i, j = np.searchsorted(bounds, [first, first + len(b)])
            took, first = took + [b.take(pa.array(bounds[i:j] - first))], first + len(b)
        took = pa.Table.from_batches(took).take(pa.array(back)).combine_chunks()
        of = lambda c: took.column(c).combine_chunks()
        ids = pa.concat_arrays([b.column("cell_id") for b in kept])
        d2 = pa.array(np.concatenate([d for _, d in best]))
        all_ = {"cell_id": ids, "ref": pa.ListArray.from_arrays(to, of("cell_id")), "d2": pa.ListArray.from_arrays(to, d2)} | {c: pa.ListArray.from_arrays(to, of(c)) for c in extra}
        out = pa.RecordBatch.from_pydict(all_)
        yield from (out.slice(i, 10_000) for i in range(0, len(out), 10_000))

    cells = _numbered(target.select("cell_id", "gene", "raw"), panel)
    cores = reference.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(2, -(-target.count() // (block * cores)))  # cells with the same genes meet and are searched one after the other
    kinds = dict(written.dtypes)
    return cells.repartition(parts, "gene").mapInArrow(search, "cell_id string, ref array<string>, d2 array<double>" + "".join(f", {c} array<{kinds[c]}>" for c in extra))


def nearest_references(reference: DataFrame, target: DataFrame, k: int, *, least: int = 5, block: int = 65_536, wide: int = 131_072) -> DataFrame:
    """(cell_id, ref, distance, rank): the ``k`` nearest reference cells of every target cell. J8.

    See ``neighbours``; ties (to 1e-9 of d2) go to the smaller id.
    """
    n = neighbours(reference, target, k, least=least, block=block, wide=wide)
    n = n.select("cell_id", F.posexplode(F.arrays_zip("ref", "d2")).alias("i", "n"))
    return n.select("cell_id", F.col("n.ref").alias("ref"), F.sqrt("n.d2").alias("distance"), (F.col("i") + 1).alias("rank"))


def transfer_labels(reference: DataFrame, labels: DataFrame, target: DataFrame, *, k: int = 15, prior_power: float = 0.0, low: float = 0.6, far: float = 0.9) -> DataFrame:
    """(cell_id, label, confidence, distance, low_confidence, distant). P20.

    Votes weigh 1 / distance; where a neighbour is at distance 0 only such vote.  With a prior
    power, shares are divided by the label's frequency to that power and scaled to 1.  Equal
    shares go to the smaller label.  ``distant``: mean distance above the ``far`` quantile of
    all targets.  Raises without two labels in the reference.
    """
    lab = labels.filter("label is not null")
    if lab.select("label").distinct().limit(2).count() < 2:
        raise ValueError("the reference has fewer than two labels")
    ref = materialise(_packed(reference).join(lab.groupBy("cell_id").agg(F.collect_list("label").alias("labels")), "cell_id"))
    n = materialise(neighbours(ref, target, k).select("cell_id", "labels", "d2"))
    each = lambda ls, d2: F.transform(ls, lambda x: F.struct(x.alias("label"), F.sqrt(d2).alias("d")))
    n = n.select("cell_id", F.flatten(F.zip_with("labels", "d2", each)).alias("n"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    n = n.select("cell_id", "n", F.array_sort(F.array_distinct("n.label")).alias("label"), F.exists("n", lambda x: x["d"] == 0).alias("zero"), (total(F.col("n.d")) / F.size("n")).alias("distance"))
    w = lambda x: F.when(F.col("zero"), (x["d"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), x["d"]))
    v = n.withColumn("s", F.transform("label", lambda y: total(F.transform(F.filter("n", lambda x: x["label"] == y), w))))
    if prior_power:
        f = lab.groupBy("label").agg(F.count("*").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("c"), F.sum("c").alias("all"))
        v = v.join(F.broadcast(f))  # one row
        v = v.withColumn("s", F.zip_with("s", "label", lambda s, y: s / F.pow(F.col("c")[y] / F.col("all"), F.lit(prior_power))))
    v = v.withColumn("t", total(F.col("s"))).withColumn("p", F.transform("s", lambda x: F.bround(x / F.col("t"), 9)))
    v = v.withColumn("r", F.array_position("p", F.array_max("p")).cast("int"))
    v = v.select("cell_id", F.element_at("label", F.col("r")).alias("label"), F.array_max("p").alias("p"), "distance")
    limit = n.agg(F.percentile("distance", far).alias("limit"))
    j = v.join(F.broadcast(limit))  # one row
    return j.select("cell_id", "label", F.bround("p", 4).alias("confidence"), F.bround("distance", 4).alias("distance"), (F.col("p") < low).alias("low_confidence"), (F.col("distance") > F.col("limit") + 1e-9).alias("distant"))
