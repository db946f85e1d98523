"""Evaluation texts inside training texts, by greedy string tiling.

The items are a stated query set, read in blocks of a fixed number.  Documents are scanned
once per block where they lie: k-word seeds of the items are met by Karp-Rabin hashes, then
the longest non-overlapping common runs of a document and an item are marked, longest first;
runs that follow each other with few words between them form stretches, and the share of the
item's words in long enough stretches decides.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ґ": "r",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "ϲ": "c", "ϳ": "j", "ı": "i", "ɡ": "g", "ɑ": "a", "ǀ": "l", "ո": "n", "ս": "u", "օ": "o", "ѡ": "w",
}
_TABLE = str.maketrans(_LOOKALIKES)
_ALIKE = re.compile("[" + "".join(_LOOKALIKES) + "]")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrt\"'/\\]")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_BROKEN = re.compile(r"[-‐‑¬=](?<=\w.)[ \t]*\r?\n[ \t]*(?:(?:>|//|#|\*|\|)[ \t]*)*(?=\w)")
_HYPHEN = re.compile(r"['’ʼ`‐‑-](?<=[^\W\d_].)(?=[^\W\d_])")
_WORD = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]|[^\W_぀-ヿ㐀-䶿一-鿿豈-﫿]+")


def _escaped(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    return chr(int(code, 16)) if code else " "


def _percent(m: re.Match) -> str:
    from urllib.parse import unquote

    return unquote(m.group(0), errors="replace")


def _without_comments(text: str) -> str:
    """The text without markup comments of any length; one that is never closed stays."""
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (stop := text.find("-->", start + 4)) >= 0:
        out.append(text[at:start])
        at = stop + 3
    return "".join([*out, text[at:]])


def plain_words(text: str | None) -> list[str]:
    """Words of a text without case, punctuation, markup, escapes, accents, invisible and look-alike characters.

    Words joined by a hyphen or apostrophe, or broken at a line end, are one word; Han and kana
    characters are a word each.  Null gives no words.
    """
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(_escaped, text)
    if "%" in text:
        text = _PERCENT.sub(_percent, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _without_comments(text)
        text = _TAG.sub(lambda m: " " if m.group(0)[1:2].lower() == "p" or m.group(0)[1:3].lower() in ("br", "/p", "di", "li") else "", text)
    if not text.isascii():
        if _ALIKE.search(text):
            text = text.translate(_TABLE)
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
        if _ALIKE.search(text):
            text = text.translate(_TABLE)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(_HYPHEN.sub("", text).casefold())


_BASE = np.uint64(1_000_003)


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``k`` ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _BASE + ids[i : i + n].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
    return h


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc position, item position, length) of the marked runs.

    Runs of ``least`` words are met by their hash, joined along diagonals to maximal runs, and
    marked longest first; a run that overlaps a mark is cut back and queued again.  Ids below 0
    match nothing.
    """
    hd, hi = gram_hashes(doc, least), gram_hashes(item, least)
    where = defaultdict(list)
    for j, h in enumerate(hi.tolist()):
        where[h].append(j)
    pos = np.flatnonzero(np.isin(hd, hi))
    diagonals = defaultdict(list)
    for i in pos.tolist():
        for j in where[int(hd[i])]:
            if (doc[i : i + least] == item[j : j + least]).all() and doc[i] >= 0:
                diagonals[i - j].append(i)
    heap = []
    for d, starts in diagonals.items():
        s = starts[0]
        for a, b in zip(starts, [*starts[1:], None], strict=True):
            if b != a + 1:
                heap.append((-(a + least - s), s, s - d))
                s = b
    heapq.heapify(heap)
    used_d, used_i, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        size, i, j = heapq.heappop(heap)
        size = -size
        free = ~(used_d[i : i + size] | used_i[j : j + size])
        if free.all():
            used_d[i : i + size] = True
            used_i[j : j + size] = True
            out.append((i, j, size))
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def covered(marks: list[tuple[int, int, int]], *, stretch: int, gap: int, clean: float) -> set[int]:
    """Item positions in stretches: runs at most ``gap`` words apart on both sides, of ``stretch``
    words or more, of which at least the share ``clean`` is matched."""
    marks = sorted(marks, key=lambda t: t[1])
    left, out = list(marks), set()
    while left:
        chain = [left.pop(0)]
        rest = []
        for t in left:
            i, j, n = chain[-1]
            if 0 <= t[1] - (j + n) <= gap and 0 <= t[0] - (i + n) <= gap:
                chain.append(t)
            else:
                rest.append(t)
        left = rest
        # give up ragged ends that make the stretch too dirty
        while chain:
            matched = sum(n for _, _, n in chain)
            span = max(chain[-1][1] + chain[-1][2] - chain[0][1], chain[-1][0] + chain[-1][2] - chain[0][0])
            if matched >= clean * span:
                break
            chain.pop(0 if chain[0][2] <= chain[-1][2] else -1)
        if chain and span >= stretch:
            out |= {p for _, j, n in chain for p in range(j, j + n)}
    return out


class ItemIndex:
    """Seeds and words of a block of distinct item texts, as held by every worker.

    ``items``: (name, words, positions that stand in an instruction).  An item with ``stretch``
    or more words of its own is met by the seeds among these; one that is instruction
    nearly throughout (a text that many items repeat with small changes) is met by all its seeds.
    """

    def __init__(self, items: list[tuple[int, list[str], list[int]]], *, seed: int, least: int, stretch: int):
        self.seed, self.least = seed, least
        self.ids = {w: n for n, w in enumerate(sorted({w for _, ws, _ in items for w in ws}))}
        self.items, self.own, keys, owner = [], [], [], []
        for n, (name, ws, shared) in enumerate(items):
            x, own = np.array([self.ids[w] for w in ws], np.int64), np.ones(len(ws), bool)
            own[shared] = False
            if own.sum() < stretch:
                own[:] = True
            self.items.append((name, x))
            self.own.append(own)
            h = gram_hashes(x, seed)
            h = np.unique(h[[own[p : p + seed].any() for p in range(len(h))]]) if len(h) else h
            keys.append(h)
            owner.append(np.full(len(h), n))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        order = np.lexsort((self.owner, self.keys))
        self.keys, self.owner = self.keys[order], self.owner[order]

    def leaks(self, words: list[list[str]], *, share: float, stretch: int, gap: int, clean: float) -> Iterator[tuple[int, int, float]]:
        """(text number, item name, share of the item's words held) of each leak in the texts."""
        ids = self.ids
        size = np.array([len(w) for w in words])
        flat = np.fromiter((ids.get(w, -1) for ws in words for w in ws), np.int64, int(size.sum()))
        text = np.repeat(np.arange(len(words)), size)
        begin = np.r_[0, np.cumsum(size)]
        h = gram_hashes(flat, self.seed)
        at = np.flatnonzero(np.isin(h, self.keys)) if len(self.keys) else np.empty(0, np.int64)
        at = at[text[at] == text[at + self.seed - 1]] if len(at) else at
        if not len(at):
            return
        low, high = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        n = high - low
        met = np.repeat(text[at], n), self.owner[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        for code in np.unique(met[0] * len(self.items) + met[1]).tolist():
            t, i = divmod(code, len(self.items))
            name, item = self.items[i]
            doc = flat[begin[t] : begin[t + 1]]
            if np.isin(item, doc).sum() < share * len(item):  # the text lacks the words, whatever their order
                continue
            got = covered(tiles(doc, item, self.least), stretch=stretch, gap=gap, clean=clean)
            own = self.own[i]
            held = len(got) / len(item)
            if held >= share and sum(1 for p in got if own[p]) >= min(stretch, own.sum()):
                yield t, name, held


def item_texts(items: DataFrame, *, item: str, text: str, seed: int, common: int) -> tuple[DataFrame, DataFrame]:
    """The distinct word sequences of the items, (h, words, shared), and the items of each, (h, item).

    ``shared`` are the positions under a run of ``seed`` words that more than ``common`` distinct
    texts hold.  Runs are counted over all items; no list of them leaves the executors.
    """
    kind = items.schema[item].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["i"], pa.array([plain_words(x) for x in batch["t"].to_pylist()], pa.list_(pa.string()))], ["i", "words"])

    rows = items.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null").mapInArrow(split, f"i {kind}, words array<string>")
    rows = materialise(rows.filter(F.size("words") >= seed).withColumn("h", F.md5(F.concat_ws(" ", "words"))))
    texts = rows.groupBy("h").agg(F.first("words").alias("words"))
    grams = texts.select("h", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - seed + 1), lambda p: F.xxhash64(F.slice("words", p, seed)))).alias("p", "g"))
    often = grams.groupBy("g").agg(F.count_distinct("h").alias("n")).filter(F.col("n") > common).select("g")
    marks = grams.join(often, "g").groupBy("h").agg(F.flatten(F.collect_set(F.sequence(F.col("p"), F.col("p") + seed - 1))).alias("shared"))
    texts = texts.join(marks, "h", "left").select("h", "words", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))
    return materialise(texts), rows.select("h", "i").distinct()


def leaked_items(
    documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text",
    share: float = 0.5, stretch: int = 8, gap: int = 2, clean: float = 0.75, seed: int = 4, least: int = 3, common: int = 5, block: int = 20_000,
) -> DataFrame:
    """(doc, item, held): the documents that hold at least ``share`` of an item's words in stretches.

    ``stretch``: words a stretch has at least; ``gap``: words that may differ between two exact
    runs of a stretch; ``clean``: matched share of a stretch; ``seed``/``least``: words of a seed
    and of the shortest run.  A seed in more than ``common`` different item texts is an
    instruction: of an item with words of its own, ``stretch`` of these have to be held too.  An
    item that is nearly all instruction, as one of a family of alike questions, needs its share
    alone; equal items are searched once and all named.  Item texts are taken ``block`` at a
    time, each block with one scan of the documents; the result is the same for any block.
    Null, empty and very short items (under ``seed`` words) are never found; null and empty
    documents hold nothing; documents are read whole, whatever their length.
    """
    kind = documents.schema[doc].dataType.simpleString()
    texts, names = item_texts(items, item=item, text=text, seed=seed, common=common)
    blocks = max(1, -(-texts.count() // block))
    src = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).filter("t is not null and t <> ''")
    found = None
    for b in range(blocks):
        held = [tuple(r) for r in texts.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).orderBy("h").collect()]
        shared = documents.sparkSession.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, seed=seed, least=least, stretch=stretch)
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    keys = part["d"].to_pylist()
                    hits = list(index.leaks([plain_words(x) for x in part["t"].to_pylist()], share=share, stretch=stretch, gap=gap, clean=clean))
                    if hits:
                        yield pa.RecordBatch.from_pydict({"d": pa.array([keys[t] for t, _, _ in hits], batch.schema.field("d").type), "h": pa.array([i for _, i, _ in hits]), "held": pa.array([h for *_, h in hits], pa.float64())})

        part = src.mapInArrow(scan, f"d {kind}, h string, held double")
        found = part if found is None else found.union(part)
    return found.join(names, "h").groupBy(F.col("d").alias(doc), F.col("i").alias(item)).agg(F.max("held").alias("held"))
