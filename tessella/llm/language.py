"""Languages of texts and their segments, by prediction by partial matching (PPM).

Per language, byte contexts of up to five bytes within a word are counted in a tree with
escape probabilities; the statistics are learnt once from a bounded sample of labelled rows,
cleaned of wrong labels in a few rounds, and then frozen.  The code length of a word under
every language is exact and remembered, so a repeated word costs one lookup.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-letter code, three-letter codes and English name of languages.
LANGUAGES = {
    "en": "eng english", "de": "deu ger german", "fr": "fra fre french", "es": "spa spanish", "pt": "por portuguese",
    "it": "ita italian", "nl": "nld dut dutch", "ru": "rus russian", "zh": "zho chi chinese cmn mandarin", "ja": "jpn japanese",
    "sv": "swe swedish", "da": "dan danish", "no": "nor norwegian", "fi": "fin finnish", "pl": "pol polish", "cs": "ces cze czech",
    "hu": "hun hungarian", "ro": "ron rum romanian", "el": "ell gre greek", "tr": "tur turkish", "ar": "ara arabic", "he": "heb hebrew",
    "hi": "hin hindi", "ko": "kor korean", "uk": "ukr ukrainian", "vi": "vie vietnamese", "th": "tha thai", "ca": "cat catalan",
}
_NAMES = {w: code for code, words in LANGUAGES.items() for w in [code, *words.split()]}


def language_code(label: Column) -> Column:
    """Two-letter code of a label in any notation (code with region, three letters, English name, any case); else null."""
    head = F.split(F.lower(F.btrim(label, F.lit(" \t\r\n"))), "[-_]")[0]
    return F.element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), head)


_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_END = re.compile(rf"(?<=[.!?])[\"'»”’)\]]*\s+|(?<=[。！？])|\n\s*\n")
_CODE = re.compile(r"(?<!\S)[^\s\d_=@<>{}|\\/#]*[\d_=@<>{}|\\/#]\S*")
_KEEP_CJK = re.compile(rf"[A-Za-z0-9_=.,]+")
_RUN = re.compile(rf"[{_CJK}]+|[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)*")
_CJK_ONE = re.compile(f"[{_CJK}]")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&[a-z]{2,6};|\\\\[nrt]")
_BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?:>[ \t]*)*(?=\w)")
_CAPITALS = re.compile("[A-ZÀ-ÞΑ-ΩА-Я]{2}")
_LATIN, _OTHER = re.compile("[a-zA-Z]"), re.compile("[Ͱ-ӿ]")
_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿]")


def segments(text: str) -> Iterator[tuple[int, int, list[str], bool]]:
    """(start, end, words, sentence) of every segment of a text.

    A segment ends at the end of a sentence or at a blank line.  Words hold letters only: tokens
    with digits and upper-case codes belong to no language.  ``sentence``: it closes with an
    end mark (an ellipsis is none) and has at least 4 words and 15 letters, or 8 Han or kana characters.
    """
    at = 0
    cuts = [(m.start(), m.end()) for m in _END.finditer(text)] + [(len(text), len(text))]
    for stop, nxt in cuts:
        part = text[at:stop]
        if part.strip():
            words, letters, marks = words_of(part)
            tail = part.rstrip("\"'»”’)] \t\r\n")[-1:]
            closed = tail != "" and tail in ".!?。！？"
            yield at, stop, words, closed and ((len(words) >= 4 and letters >= 15) or marks >= 8)
        at = nxt


def words_of(part: str) -> tuple[list[str], int, int]:
    """Lower-case words of a text (markup, codes and words of mixed scripts left out), the number of their letters, and of Han and kana characters."""
    if not part.isascii():
        part = unicodedata.normalize("NFKC", _INVISIBLE.sub("", part))
    if "<" in part or "&" in part or "\\" in part:
        part = _MARKUP.sub(" ", part)
    part = _BROKEN.sub("", part)
    marks = len(_CJK_ONE.findall(part)) if not part.isascii() else 0
    part = _KEEP_CJK.sub(" ", part) if marks >= 8 else _CODE.sub(" ", part)
    if _CAPITALS.search(part):
        words = _RUN.findall(part)
        shouted = sum(map(len, words)) < 2 * sum(len(w) for w in words if w.isupper())
        words = [w.lower() for w in words if shouted or not (len(w) > 1 and w.isascii() and w.isupper())]
    else:
        words = _RUN.findall(part.lower())
    if not part.isascii() and _OTHER.search(part) and _LATIN.search(part):
        words = [w for w in words if not (_LATIN.search(w) and _OTHER.search(w))]
    return words, sum(map(len, words)), marks


class PPM:
    """Frozen byte-context statistics of several languages."""

    ORDER = 5

    def __init__(self, languages: list[str], counts: list[Counter], temper: float = 4.0):
        """``counts``: per language, how often each word stands in the sample; ``temper``: what code
        lengths are divided by for a confidence, as words of a text are not independent."""
        self.languages, self.temper = languages, temper
        keys, which, weight = [], [], []
        for n, words in enumerate(counts):
            if not words:
                continue
            total = np.array(list(words.values()), float)
            k, w = self._keys(list(words))
            keys.append(k.ravel())
            which.append(np.full(k.size, n))
            weight.append(np.repeat(total[w], self.ORDER + 1))
        k, n, x = (np.concatenate(v) if v else np.empty(0, t) for v, t in ((keys, np.uint64), (which, np.int64), (weight, float)))
        self.keys, at = np.unique(k, return_inverse=True)
        self.count = np.zeros((len(self.keys), len(languages)), np.float32)
        np.add.at(self.count, (at, n), x)
        # totals and distinct symbols of every context
        ctx, inv = np.unique(self.keys >> np.uint64(8), return_inverse=True)
        self.contexts = ctx
        self.total = np.zeros((len(ctx), len(languages)), np.float32)
        self.kinds = np.zeros_like(self.total)
        np.add.at(self.total, inv, self.count)
        np.add.at(self.kinds, inv, (self.count > 0).astype(np.float32))
        self.known: dict[str, np.ndarray] = {}

    def _keys(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Context-and-symbol keys (positions, orders) of all bytes of the words, and each position's word."""
        raw = [b" " + w.encode() + b" " for w in words]
        size = np.array([len(r) - 1 for r in raw])
        pad = b"\0" * self.ORDER
        flat = np.frombuffer(b"".join(pad + r for r in raw), np.uint8).astype(np.uint64)
        start = np.r_[0, np.cumsum(size + 1 + self.ORDER)[:-1]] + self.ORDER + 1
        word = np.repeat(np.arange(len(raw)), size)
        pos = np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size) + start[word]
        out = np.empty((len(pos), self.ORDER + 1), np.uint64)
        ctx = np.zeros(len(pos), np.uint64)
        for order in range(self.ORDER + 1):
            if order:
                ctx = ctx | (flat[pos - order] << np.uint64(8 * (order - 1)))
            # the order stands in the top bits, so contexts of different length differ
            out[:, order] = (np.uint64(order) << np.uint64(56)) | (ctx << np.uint64(8)) | flat[pos]
        return out, word

    def bits(self, words: list[str]) -> np.ndarray:
        """Code length in bits of each word (rows) under each language (columns)."""
        keys, word = self._keys(words)
        length = np.zeros((len(words), len(self.languages)))
        p = np.zeros((len(keys), len(self.languages)), np.float32)
        open_ = np.ones_like(p, bool)
        for order in range(self.ORDER, -1, -1):
            k = keys[:, order]
            at = np.minimum(np.searchsorted(self.keys, k), max(0, len(self.keys) - 1))
            hit = self.keys[at] == k
            c = np.minimum(np.searchsorted(self.contexts, k >> np.uint64(8)), max(0, len(self.contexts) - 1))
            seen = self.contexts[c] == k >> np.uint64(8)
            count = np.where(hit[:, None], self.count[at], 0)
            total = np.where(seen[:, None], self.total[c], 0)
            kinds = np.where(seen[:, None], self.kinds[c], 0)
            base = np.maximum(total + kinds, 1e-9)
            got = open_ & (count > 0)
            p[got] += np.log2(count[got] / base[got])
            miss = open_ & (count == 0) & (total > 0)
            p[miss] += np.log2(kinds[miss] / base[miss])
            open_ &= ~got
        p[open_] -= 8
        np.add.at(length, word, -p)
        return length

    def score(self, lists: list[list[str]], cache: int = 300_000) -> np.ndarray:
        """Code length in bits of each list of words under each language."""
        if not len(self.keys):  # nothing learnt: no language says anything
            return np.zeros((len(lists), len(self.languages)))
        if len(self.known) > cache:
            self.known.clear()
        new = list({w for ws in lists for w in ws if w not in self.known})
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            self.known.update(zip(part, self.bits(part), strict=True))
        out = np.zeros((len(lists), len(self.languages)))
        size = [len(ws) for ws in lists]
        if sum(size):
            flat = np.array([self.known[w] for ws in lists for w in ws])
            np.add.at(out, np.repeat(np.arange(len(lists)), size), flat)
        return out

    def follow(self, bits: np.ndarray, switch: float = 24.0) -> tuple[np.ndarray, np.ndarray]:
        """Languages of the segments of one text: the cheapest path, a change of language costing ``switch`` bits."""
        n, k = bits.shape
        cost, back = bits[0].copy(), np.zeros((n, k), int)
        for i in range(1, n):
            best = int(cost.argmin())
            stay = cost <= cost[best] + switch
            back[i] = np.where(stay, np.arange(k), best)
            cost = np.where(stay, cost, cost[best] + switch) + bits[i]
        path = np.empty(n, int)
        path[-1] = int(cost.argmin())
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path, self._sure(bits, path)

    def _sure(self, bits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        own = bits[np.arange(len(bits)), chosen][:, None]
        return 1 / np.exp2(np.clip((own - bits) / self.temper, -400, 400)).sum(axis=1)

    def judge(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Best language (index) and confidence of each list of words.

        The confidence is the posterior of the best language under equal priors, with code
        lengths divided by ``temper``, which ``learn`` settles on held-out rows.
        """
        bits = self.score(lists)
        best = bits.argmin(axis=1)
        return best, self._sure(bits, best)


def _fit(names: list[str], lists: list[list[str]], owner: np.ndarray, use: np.ndarray, rounds: int) -> PPM:
    """Statistics of the sentences in ``use``; after each round only those judged as their label says are kept."""
    keep = use
    for n in range(rounds):
        counts = [Counter() for _ in names]
        for at in np.flatnonzero(keep).tolist():
            counts[owner[at]].update(lists[at])
        model = PPM(names, counts)
        if n < rounds - 1 and keep.any():
            at = np.flatnonzero(use)
            keep = np.zeros(len(lists), bool)
            keep[at] = model.judge([lists[i] for i in at])[0] == owner[at]
    return model


def _temper(model: PPM, lists: list[list[str]], owner: np.ndarray, row: np.ndarray) -> float:
    """The divisor of code lengths under which the confidences of held-out sentences fit best.

    Sentences of rows whose whole text is judged as its label says count, by log loss.
    """
    if not len(lists):
        return 4.0
    bits = model.score(lists)
    _, at = np.unique(row, return_inverse=True)
    whole = np.zeros((at.max() + 1, bits.shape[1]))
    np.add.at(whole, at, bits)
    ok = whole.argmin(axis=1)[at] == owner
    if not ok.any():
        return 4.0
    gap = bits[ok] - bits[ok].min(axis=1, keepdims=True)
    own = gap[np.arange(len(gap)), owner[ok]]
    loss = [float((own / d + np.log2(np.exp2(-gap / d).sum(axis=1))).mean()) for d in TEMPERS]
    return TEMPERS[int(np.argmin(loss))]


TEMPERS = [1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0]


def learn(labelled: DataFrame, *, text: str = "text", label: str = "lang", per_language: int = 1500, sentences: int = 8000, rounds: int = 3, least: int = 3, strange: float = 1.3) -> PPM:
    """Statistics from at most ``per_language`` different labelled texts of each language, whole, and at
    most ``sentences`` sentences of these; texts and sentences are picked by a hash.

    Labels may be wrong: after each round only sentences whose language agrees with their row's
    label are kept.  A language of fewer than ``least`` texts is learnt only if the others do not
    explain its sentences: if these take more than ``strange`` times the bits a letter that
    sentences usually take.  Every fifth text is held out first to settle the confidences.
    Without a usable label nothing is learnt, and no text gets a language.
    """
    rows = labelled.select(language_code(F.col(label)).alias("c"), F.col(text).alias("t")).filter("c is not null and t is not null and length(t) >= 20").withColumn("h", F.xxhash64("t"))
    order = Window.partitionBy("c").orderBy("h")
    picked = rows.select("c", "h").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("c", "h")
    # no more rows than per_language for each language there is a code for
    texts = rows.join(F.broadcast(picked), ["c", "h"]).dropDuplicates(["c", "h"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(n, words) for n, t in enumerate(batch["t"].to_pylist()) for *_, words, sentence in segments(t) if sentence]
            at = pa.array([n for n, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["c"].take(at), batch["h"].take(at), pa.array([w for _, w in got], pa.list_(pa.string()))], ["c", "h", "words"])

    said = texts.select("c", "h", "t").mapInArrow(split, "c string, h long, words array<string>")
    order = Window.partitionBy("c").orderBy(F.xxhash64("h", "words"), "h")
    lot = said.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sentences).select("c", "h", "words").collect()
    lot.sort(key=lambda r: (r.c, r.h, r.words))
    names = sorted({r.c for r in lot})
    lists, owner, row = [r.words for r in lot], np.array([names.index(r.c) for r in lot], int), np.array([r.h for r in lot], np.int64)
    few = {n for n in range(len(names)) if len(np.unique(row[owner == n])) < least}
    if few and len(few) < len(names):
        names, lists, owner, row = _without(names, lists, owner, row, few, strange)
    use = row % 5 != 0
    trial = _fit(names, lists, owner, use if use.any() else ~use, rounds)
    held = np.flatnonzero(~use)
    temper = _temper(trial, [lists[i] for i in held], owner[held], row[held])
    model = _fit(names, lists, owner, np.ones(len(lists), bool), rounds)
    model.temper = temper
    model.known.clear()
    return model


def _without(names: list[str], lists: list[list[str]], owner: np.ndarray, row: np.ndarray, few: set[int], strange: float) -> tuple[list[str], list[list[str]], np.ndarray, np.ndarray]:
    """The sentences without those of rare languages that the other languages explain."""
    rare = np.isin(owner, list(few))
    common = [n for n in range(len(names)) if n not in few]
    model = _fit([names[n] for n in common], lists, np.array([common.index(n) if n in common else 0 for n in owner.tolist()]), ~rare, 2)
    rate = model.score(lists).min(axis=1) / np.array([sum(map(len, ws)) or 1 for ws in lists])
    usual = float(np.median(rate[~rare]))
    gone = {n for n in few if float(np.median(rate[owner == n])) <= strange * usual}
    ok = ~np.isin(owner, list(gone))
    left = [n for n in range(len(names)) if n not in gone]
    return [names[n] for n in left], [ws for ws, k in zip(lists, ok.tolist(), strict=True) if k], np.array([left.index(n) for n in owner[ok].tolist()], int), row[ok]


_SEGMENTS = "d {kind}, segment int, start int, stop int, lang string, confidence double, sentence boolean"


def segment_languages(documents: DataFrame, model: PPM, *, doc: str = "doc_id", text: str = "text", slice_chars: int = 500_000) -> DataFrame:
    """Language and confidence of every segment: (doc, segment, start, stop, lang, confidence, sentence).

    A segment takes another language than its neighbours only for a gain of 24 bits, so names and
    scraps do not count as a change.  Neighbouring segments of one language are joined; start and stop are character positions.
    Segments without words (numbers, codes, blanks) and null or empty texts have no row; neither
    has any text if the model knows no language.  Texts are read whole.
    """
    kind = documents.schema[doc].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in batches if ppm.languages else ():
            size = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(batch["t"]), 0))
            lot = np.cumsum(size) // slice_chars
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(lot)) + 1):
                keys = batch["d"].slice(at[0], len(at)).to_pylist() if len(at) else []
                rows = [(n, *s) for n, t in enumerate(batch["t"].slice(at[0], len(at)).to_pylist() if len(at) else []) if t for s in segments(t) if s[2]]
                if not rows:
                    continue
                bits = ppm.score([r[3] for r in rows])
                best = bits.argmin(axis=1)
                sure = ppm._sure(bits, best)
                own = np.array([r[0] for r in rows])
                edge = np.r_[np.flatnonzero(np.diff(own, prepend=-1)), len(own)]
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if (best[a:b] != best[a]).any():
                        best[a:b], sure[a:b] = ppm.follow(bits[a:b])
                out: list[list] = []
                for r, b, c in zip(rows, best.tolist(), sure.tolist(), strict=True):
                    n, start, stop, words, sentence = r
                    weight = len(words)
                    if out and out[-1][0] == n and out[-1][3] == b:
                        last = out[-1]
                        last[2], last[4], last[5], last[6] = stop, last[4] + c * weight, last[5] or sentence, last[6] + weight
                    else:
                        out.append([n, start, stop, b, c * weight, sentence, weight])
                number, prev = [], None
                for o in out:
                    number.append(0 if o[0] != prev else number[-1] + 1)
                    prev = o[0]
                yield pa.RecordBatch.from_pydict({
                    "d": pa.array([keys[o[0]] for o in out], batch.schema.field("d").type), "segment": pa.array(number, pa.int32()),
                    "start": pa.array([o[1] for o in out], pa.int32()), "stop": pa.array([o[2] for o in out], pa.int32()),
                    "lang": pa.array([ppm.languages[o[3]] for o in out]), "confidence": pa.array([o[4] / o[6] for o in out], pa.float64()),
                    "sentence": pa.array([o[5] for o in out]),
                })

    out = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).filter("t is not null and t <> ''").mapInArrow(run, _SEGMENTS.format(kind=kind))
    return out.withColumnRenamed("d", doc)


def document_languages(segs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, lang, share, confidence): languages with a full sentence, their share of the text's segments by length."""
    size = F.sum((F.col("stop") - F.col("start")).cast("double"))
    per = segs.groupBy(doc, "lang").agg(size.alias("n"), F.bool_or("sentence").alias("full"), (F.sum(F.col("confidence") * (F.col("stop") - F.col("start"))) / size).alias("confidence"))
    whole = F.sum("n").over(Window.partitionBy(doc))
    return per.withColumn("share", F.col("n") / whole).filter("full").select(doc, "lang", "share", "confidence")


def corrected_labels(documents: DataFrame, found: DataFrame, *, doc: str = "doc_id", label: str = "lang") -> DataFrame:
    """Rows of ``found`` (doc, lang, ...) of documents whose label is missing, wrong or whose text is mixed, with a ``reason``."""
    labels = documents.select(doc, language_code(F.col(label)).alias("__label"))
    used = found.groupBy(doc).agg(F.collect_set("lang").alias("__used"))
    why = F.when(F.size("__used") > 1, "mixed").when(F.col("__label").isNull(), "missing").when(~F.array_contains("__used", F.col("__label")), "wrong")
    return found.join(labels.join(used, doc).withColumn("reason", why).filter("reason is not null").select(doc, "reason"), doc)
