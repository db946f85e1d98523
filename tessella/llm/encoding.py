"""Token ids of whole texts under a public byte-level BPE vocabulary.

Speculate and verify: a word is cut greedily into its longest tokens, every adjacent pair of
tokens is checked for compatibility (do the two, merged by rank from their bytes, come out as
the same two?), and only words with a failing pair are merged exactly.  A cut of tokens that
each reproduce themselves and are pairwise compatible is the cut that merging by rank gives.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how the vocabulary's texts were cut into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteBPE:
    """Encoder over a rank file (base64 of the token's bytes, blank, rank = id)."""

    def __init__(self, vocabulary: str, *, cache: int = 200_000):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.words = regex.compile(WORDS)
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache = cache
        self.pairs = np.empty(0, np.int64)  # sorted codes of checked pairs
        self.fits = np.empty(0, bool)
        self.own: dict[int, bool] = {}
        self.counted = {"words": 0, "exact": 0}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, leftmost on ties."""
        n = len(word)
        if n == 1:
            return [self.ranks[word]]
        ranks = self.ranks
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is word[i:end[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, ranks = [], 0, len(word), self.ranks
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (r := ranks.get(word[i:j])) is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def _compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair (left * 2^20 + right) survives exact merging of its bytes."""
        asked = np.unique(codes)
        at = np.searchsorted(self.pairs, asked)
        new = asked[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != asked)] if len(self.pairs) else asked
        if len(new):
            ok = []
            for code in new.tolist():
                a, b = code >> 20, code & 0xFFFFF
                ok.append(self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b])
            pairs = np.r_[self.pairs, new]
            order = np.argsort(pairs)
            self.pairs, self.fits = pairs[order], np.r_[self.fits, np.array(ok, bool)][order]
        return self.fits[np.searchsorted(self.pairs, codes)]

    def _own(self, token: int) -> bool:
        if (ok := self.own.get(token)) is None:
            ok = self.own[token] = self.merge(self.bytes_of[token]) == [token]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encodes new words into the cache, all pairs of all words checked at once."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        cuts = [[self.ranks[r]] if r in self.ranks else self.guess(r) for r in raw]
        size = np.array([len(c) for c in cuts])
        flat = np.fromiter((t for c in cuts for t in c), np.int64, int(size.sum()))
        sound = np.fromiter((self._own(t) for t in flat.tolist()), bool, len(flat))
        word = np.repeat(np.arange(len(cuts)), size)
        bad = np.zeros(len(cuts), bool)
        bad[word[~sound]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(inner):
            fits = self._compatible((flat[inner] << 20) | flat[inner + 1])
            bad[word[inner[~fits]]] = True
        for i in np.flatnonzero(bad).tolist():
            cuts[i] = self.merge(raw[i])
        self.counted["words"] += len(cuts)
        self.counted["exact"] += int(bad.sum())
        self.known.update(zip(words, map(tuple, cuts), strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every text; empty for an empty and for a null text."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > self.cache:
            self.known.clear()
        if len(self.pairs) > 4 * self.cache:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        new = {w for words in cut for w in words if w not in self.known}
        if new:
            self.learn(list(new))
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", *, vocabulary: str | None = None, slice_chars: int = 4_000_000) -> DataFrame:
    """(key, ids) of every row, without special tokens; null and empty texts give an empty list.

    One pass, no shuffle.  Rows are taken in slices of about ``slice_chars`` characters, so very
    long texts do not pile up in a worker; each text is encoded whole.  Repeated and null keys
    are kept; other columns are not read.
    """
    path = vocabulary or default_vocabulary()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path)
        for batch in batches:
            size = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(batch["t"]), 0))
            lot = np.cumsum(size) // slice_chars
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(lot)) + 1):
                if not len(at):
                    continue
                part = batch.slice(at[0], len(at))
                ids = bpe.encode(part["t"].to_pylist())
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([part["k"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["k", "ids"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)
