"""Sparse non-negative vectors as packed rows, and their sampling into similarity buckets.

A packed vector is n feature hashes (int64, ascending) followed by n weights (float32) of unit
length in total.  ``bucket_features`` draws features by consistent weighted sampling: two
vectors draw the same feature with the probability of their weighted Jaccard similarity, so
similar vectors meet in the same bucket without any table of features or centres to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Block:
    """Packed vectors of a batch in CSR form."""

    def __init__(self, packed: list[bytes] | pa.Array, slim: bool = False):
        """``slim``: features of 32 and weights of 16 bits, as ``slim`` makes them (Arrow only)."""
        if isinstance(packed, pa.Array):
            n, unit = len(packed), np.dtype(np.uint16 if slim else np.uint32)  # a feature is two words, a weight one
            cut = np.frombuffer(packed.buffers()[1], np.int32, n + 1, 4 * packed.offset).astype(np.int64) // unit.itemsize if n else np.zeros(1, np.int64)
            words = np.frombuffer(packed.buffers()[2], unit, cut[-1]) if cut[-1] else np.empty(0, unit)
            self.start, self.row = (cut - cut[0]) // 3, np.repeat(np.arange(n), np.diff(cut) // 3)
            two, one = self._places(cut[:-1])
            self.feature = words[two].view(np.int32 if slim else np.int64).astype(np.int64, copy=False)
            self.weight = words[one].view(np.float16 if slim else np.float32).astype(np.float32, copy=False)
            return
        size = np.fromiter((len(p) // 12 for p in packed), np.int64, len(packed))
        self.start = np.r_[0, np.cumsum(size)]
        self.feature = np.frombuffer(b"".join([p[: 8 * n] for p, n in zip(packed, size.tolist(), strict=True)]), np.int64)
        self.weight = np.frombuffer(b"".join([p[8 * n :] for p, n in zip(packed, size.tolist(), strict=True)]), np.float32)
        self.row = np.repeat(np.arange(len(packed)), size)

    def __len__(self) -> int:
        return len(self.start) - 1

    def _places(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of features and of weights, where a vector's words begin at ``first``."""
        size, start = np.diff(self.start), self.start[:-1]
        two = np.repeat(first - 2 * start, 2 * size) + np.arange(2 * self.start[-1])
        return two, np.repeat(first + 2 * size - start, size) + np.arange(self.start[-1])

    def slim(self) -> pa.Array:
        """The vectors with 32-bit features and 16-bit weights, enough to find links (checked exactly later)."""
        words = np.empty(3 * self.start[-1], np.uint16)
        two, one = self._places(3 * self.start[:-1])
        words[two], words[one] = self.feature.astype(np.int32).view(np.uint16), self.weight.astype(np.float16).view(np.uint16)
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer((6 * self.start).astype(np.int32)), pa.py_buffer(words)])

    def rows(self, index: np.ndarray) -> Block:
        """The block of the vectors ``index``."""
        names, code = self.codes()
        size = self.start[index + 1] - self.start[index]
        out = object.__new__(Block)
        out.start = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.start[index] - out.start[:-1], size) + np.arange(out.start[-1])
        out.feature, out.weight, out.row = self.feature[at], self.weight[at], np.repeat(np.arange(len(index)), size)
        used = np.zeros(len(names), bool)
        used[code[at]] = True
        out._codes = names[used], (np.cumsum(used) - 1)[code[at]]
        return out

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features and the position of each entry's feature among them."""
        if not hasattr(self, "_codes"):
            self._codes = np.unique(self.feature, return_inverse=True)
        return self._codes

    def dense(self, rows: slice | np.ndarray | None = None) -> np.ndarray:
        """Dense float32 rows over the features of this block."""
        names, code = self.codes()
        if rows is None:
            out = np.zeros((len(self), len(names)), np.float32)
            out[self.row, code] = self.weight
            return out
        index = np.arange(len(self))[rows]
        out = np.zeros((len(index), len(names)), np.float32)
        size = self.start[index + 1] - self.start[index]
        at = np.repeat(self.start[index] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        out[np.repeat(np.arange(len(index)), size), code[at]] = self.weight[at]
        return out

    def dots(self, a: np.ndarray, b: np.ndarray, step: int = 50_000) -> np.ndarray:
        """Exact similarity of the vector pairs (a[i], b[i]); ``a`` is best sorted."""
        _, code = self.codes()
        out = np.empty(len(a))
        for s in range(0, len(a), step):
            x, y = a[s : s + step], b[s : s + step]
            run = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])  # pairs of one vector a
            for t in range(0, len(run), 512):
                first = run[t : t + 512]
                end = run[t + 512] if t + 512 < len(run) else len(x)
                own, to = x[first], y[first[0] : end]
                rows = self.dense(own)
                size = self.start[to + 1] - self.start[to]
                ends = np.cumsum(size)
                pair = np.repeat(np.arange(len(to)), size)
                e = (self.start[to] - ends + size).take(pair) + np.arange(len(pair))
                row = np.repeat(np.arange(len(own)) * rows.shape[1], np.diff(np.r_[first, end]))
                prod = np.multiply(rows.reshape(-1).take(row.take(pair) + code.take(e)), self.weight.take(e), dtype=np.float64)
                out[s + first[0] : s + end] = np.bincount(pair, prod, minlength=len(to))
        return out


def pack(offsets: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> list[bytes | None]:
    """Packed unit vectors of the rows cut by ``offsets``; a feature given twice counts once (its largest weight).

    Features of weight 0 or less are dropped; a row without any is None.
    """
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    good = (weight > 0) & np.isfinite(weight)
    row, feature, weight = row[good], feature[good], weight[good]
    order = np.argsort(feature)
    order = order[np.argsort(row[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]
    if ((np.diff(row[order]) == 0) & (np.diff(feature[order]) == 0)).any():  # only then weights matter
        order = np.lexsort((-weight, feature, row))
    row, feature, weight = row[order], feature[order], weight[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])] if len(row) else np.zeros(0, bool)
    row, feature, weight = row[first], feature[first], weight[first].astype(np.float64)
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=n))
    weight = (weight / norm[row]).astype(np.float32)
    cut = np.r_[0, np.cumsum(np.bincount(row, minlength=n))].tolist()
    f, w = feature.astype(np.int64).tobytes(), weight.tobytes()
    return [f[8 * a : 8 * b] + w[4 * a : 4 * b] if b > a else None for a, b in zip(cut[:-1], cut[1:], strict=True)]


def packed_vectors(entries: DataFrame, key: str, feature: Column, weight: Column) -> DataFrame:
    """(key, vec) of every key with at least one positive weight, from one row per key and feature.

    Repeated rows of a key and feature count once, and are folded before the shuffle, so a key
    delivered any number of times takes no more room.  A key's distinct features meet in one
    task, so they should fit there (here: the genes of a cell).
    """
    kind = entries.schema[key].dataType.simpleString()
    lists = entries.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.collect_set(F.struct(F.xxhash64(feature).alias("f"), weight.cast("float").alias("w"))).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch["e"]
            flat = e.flatten()
            offsets = np.r_[0, np.cumsum(np.asarray(pa.compute.list_value_length(e)))]
            vec = pack(offsets, flat.field("f").to_numpy(), flat.field("w").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(vec, pa.binary())], ["k", "vec"])

    return lists.mapInArrow(run, f"k {kind}, vec binary").filter("vec is not null").withColumnRenamed("k", key)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(feature: np.ndarray, draw: int, which: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64(draw * 8 + which + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = _mix(_mix(feature.astype(np.uint64) + seed) ^ seed)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def bucket_features(block: Block, draws: int, skip: int = 0) -> np.ndarray:
    """(rows, draws) features drawn by consistent weighted sampling, without the first ``skip`` draws."""
    names, code = block.codes()
    out = np.empty((len(block), draws), np.int64)
    log = np.log(block.weight.astype(np.float64))
    starts, size = block.start[:-1], np.diff(block.start)
    for d in range(draws):
        u = [_uniform(names, skip + d, i) for i in range(5)]
        r, c, beta = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
        rr, bb = r.take(code), beta.take(code)
        y = log / rr  # from here in place: rr * (floor(log / rr + bb) - bb)
        y += bb
        np.floor(y, out=y)
        y -= bb
        y *= rr
        a = np.log(c).take(code)
        a -= y
        a -= rr
        at = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), size))
        if len(at) > len(block):  # of equal ones the first
            at = at[np.r_[True, np.diff(block.row[at]) > 0]]
        out[:, d] = block.feature[at]
    return out


def project(block: Block, dims: int) -> np.ndarray:
    """Unit vectors after a Gaussian projection whose rows are seeded by the feature's hash."""
    names, code = block.codes()
    r = np.empty((len(names), dims), np.float32)
    for j in range(0, dims, 2):
        a, b = _uniform(names, 1000 + j, 0), _uniform(names, 1000 + j, 1)
        amp = np.sqrt(-2 * np.log(a))
        r[:, j] = amp * np.cos(2 * np.pi * b)
        if j + 1 < dims:
            r[:, j + 1] = amp * np.sin(2 * np.pi * b)
    out = np.concatenate([block.dense(slice(s, s + 4096)) @ r for s in range(0, len(block), 4096)]) if len(block) else np.empty((0, dims), np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
