"""Top N items within every group, by bucketed sorted runs and a loser-tree merge.

Each partition is sorted by (bucket, group, score descending, item) in the JVM and cut into
runs, one per bucket: of every group only its first N items can matter, so a run keeps no
more.  Runs travel as packed Arrow tables, and one task per bucket merges its runs with a
loser tree, passing on to the next group as soon as N items are out.  A group that fills a
third of all rows leaves at most N items per run, so no task sees it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.identifiers import finite
from tessella.session import shuffle_partitions


class LoserTree:
    """Merges sorted sequences; ``head`` is the smallest key left, ``advance`` replaces it."""

    def __init__(self, sequences: list[list[tuple]]):
        self.seqs, self.at = sequences, [0] * len(sequences)
        self.size = 1
        while self.size < max(1, len(sequences)):
            self.size *= 2
        self.keys = [s[0] if s else None for s in sequences] + [None] * (self.size - len(sequences))
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        return kb is None or (ka is not None and ka <= kb)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def head(self) -> tuple | None:
        return self.keys[self.winner]

    def place(self) -> tuple[int, int]:
        return self.winner, self.at[self.winner]

    def advance(self, to: int) -> None:
        """Moves the winning sequence to position ``to`` and replays its matches."""
        w, keys, losers = self.winner, self.keys, self.losers
        self.at[w] = to
        seq = self.seqs[w]
        mine = keys[w] = seq[to] if to < len(seq) else None
        node = (w + self.size) >> 1
        while node:
            other = losers[node]
            theirs = keys[other]
            if theirs is not None and (mine is None or theirs < mine):
                losers[node], w, mine = w, other, theirs
            node >>= 1
        self.winner = w


def merge_runs(runs: list[pa.Table], n: int) -> pa.Table:
    """The first ``n`` distinct items of every group over all runs, in order, with ``rank`` from 1.

    A run has the columns h (hash of the group), k (the group), score and item and is sorted by
    (h, k, -score, item); equal rows in several runs count once.
    """
    whole = pa.concat_tables(runs)
    starts = np.r_[0, np.cumsum([len(r) for r in runs])]
    h, k, item = whole["h"].to_pylist(), whole["k"].to_pylist(), whole["item"].to_pylist()
    minus = (-whole["score"].to_numpy()).tolist()
    rows = list(zip(h, k, minus, item, strict=True))
    # where the next group begins, for each row of each run
    ha = whole["h"].to_numpy()
    new = np.r_[True, ha[1:] != ha[:-1]] if len(ha) else np.zeros(0, bool)
    new |= np.r_[True, [a != b for a, b in zip(k[1:], k[:-1], strict=True)]] if len(k) else new
    new[starts[:-1][starts[:-1] < len(new)]] = True
    edges = np.r_[np.flatnonzero(new), len(ha)]
    beyond = np.minimum(edges[np.searchsorted(edges, np.arange(len(ha)), side="right").clip(max=len(edges) - 1)], len(ha)).tolist()
    tree = LoserTree([rows[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
    starts = starts.tolist()
    take, ranks, group, out, last = [], [], None, 0, None
    while (key := tree.head()) is not None:
        run, at = tree.place()
        if group is None or key[0] != group[0] or key[1] != group[1]:
            group, out, last = key, 0, None
        if out >= n:
            tree.advance(beyond[starts[run] + at] - starts[run])
            continue
        if key != last:
            take.append(starts[run] + at)
            out += 1
            ranks.append(out)
            last = key
        tree.advance(at + 1)
    return whole.take(pa.array(take, pa.int64())).append_column("rank", pa.array(ranks, pa.int32()))


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def top_n_per_group(df: DataFrame, groups: list[str], score: str, item: str, n: int, *, buckets: int | None = None, run_rows: int = 200_000) -> DataFrame:
    """The ``n`` items with the highest score of every group: (groups..., item, score, rank).

    * Equal scores are settled by the smaller item (by bytes); an item repeated with the same
      score counts once.
    * Rows with a null item or a null, NaN or infinite score take no part; a null in a group
      column is a group of its own.
    * Group columns are strings or numbers; other columns of ``df`` are not read.  No rows, or
      ``n`` below 1, give no rows.
    """
    spark = df.sparkSession
    buckets = buckets or 8 * shuffle_partitions(spark)
    types = {g: df.schema[g].dataType.simpleString() for g in groups}
    kind = df.schema[item].dataType.simpleString()
    key = F.to_json(F.struct(*[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)]))
    src = (
        df.select(key.alias("k"), F.col(score).cast("double").alias("score"), F.col(item).cast("string").alias("item"))
        .filter(F.col("item").isNotNull() & finite("score"))
        .withColumn("h", F.xxhash64("k")).withColumn("b", F.pmod("h", F.lit(buckets)).cast("int"))
        .sortWithinPartitions("b", "h", "k", F.desc("score"), "item")
    )
    schema = pa.schema([("h", pa.int64()), ("k", pa.string()), ("score", pa.float64()), ("item", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, size, tail, done = None, [], 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                yield pa.RecordBatch.from_pydict({"b": pa.array([bucket], pa.int32()), "run": pa.array([_pack(pa.Table.from_batches(parts).cast(schema))], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            h, k, score, item = (batch[c] for c in ("h", "k", "score", "item"))
            shift = lambda x: np.asarray(pc.equal(x.slice(1), x.slice(0, len(x) - 1)))
            same = np.r_[False, shift(h) & shift(k)]
            again = np.r_[False, shift(score) & shift(item)] & same
            now = tuple(x[0].as_py() for x in (h, k, score, item))
            same[0] = tail is not None and tail[:2] == now[:2]
            again[0] = tail == now
            tail = tuple(x[len(x) - 1].as_py() for x in (h, k, score, item))
            new = np.cumsum(~again)  # items of one group are counted without repeats
            first = np.flatnonzero(~same)
            base = np.zeros(len(same), np.int64)
            base[first] = new[first] - 1
            pos = new - 1 - np.maximum.accumulate(base)
            if same[0]:  # the group goes on from the batch before
                pos[: first[0] if len(first) else len(pos)] += done
            done = int(pos[-1]) + 1
            keep = (pos < n) & ~again
            b = batch["b"].to_numpy()
            slim = batch.select(["h", "k", "score", "item"])
            for at in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1):
                if b[at[0]] != bucket:
                    yield from flush()
                    bucket, parts, size = int(b[at[0]]), [], 0
                part = slim.slice(at[0], len(at)).filter(pa.array(keep[at[0] : at[-1] + 1]))
                parts.append(part)
                size += part.num_rows
                if size >= run_rows:
                    yield from flush()
                    parts, size = [], 0
        yield from flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [pa.ipc.open_stream(x).read_all() for x in pdf["run"]]
        top = merge_runs([r.combine_chunks() for r in runs], n)
        return pd.DataFrame({"k": top["k"].to_pandas(), "item": top["item"].to_pandas(), "score": top["score"].to_numpy(), "rank": top["rank"].to_numpy()})

    runs = src.mapInArrow(cut, "b int, run binary")
    top = runs.groupBy("b").applyInPandas(merge, "k string, item string, score double, rank int")
    named = F.from_json("k", ", ".join(f"g{i} string" for i in range(len(groups)))).alias("g")
    return top.select(named, "item", "score", "rank").select(
        *[F.col(f"g.g{i}").cast(types[g]).alias(g) for i, g in enumerate(groups)], F.col("item").cast(kind).alias(item), F.col("score").alias(score), "rank"
    )
