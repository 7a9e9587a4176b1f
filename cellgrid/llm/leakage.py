"""Evaluation texts inside training text, by q-gram filtration and banded alignment.

A case is a run of at least WINDOW words of an item with at most one edit: a word replaced,
left out or put in between. Both sides are folded alike: look-alike form, lower case,
punctuation dropped, words broken at a line end joined, one blank between words; a sign
that stands as a word of its own (a parted per cent sign) stays a word.

Filtration. One edit leaves, on one of its sides, at least half of the other words of the
window untouched. So a true region holds an unbroken stretch of as many shared character
q-grams as the shortest such half has places (the bound of the edit budget; it is at least
4 for q = 8, whatever the words). Stretches below the bound are dropped; what remains is
counted per item in overlapping diagonal bands, and bands below the item's own bound are
dropped too.

Verification. Each word diagonal of a surviving band is aligned with itself (a replaced
word) and with the diagonals next to it (a word left out or put in), which is the whole
band that a budget of one edit can reach.

The items are a stated query set, taken in blocks of BLOCK characters, so what is sent with
the tasks has a fixed size. Where they need more than one block, the corpus is still read
once: a bitmap of the q-grams of all items keeps the stretches that can hold a case, with
WINDOW words on either side, and the blocks are searched over these. The corpus is never
shuffled, only the found pairs are. Everything runs on arrays of a batch of texts.

Defined results: null and empty texts leak nothing; an item with fewer than WINDOW words
on a side finds nothing by that side; an item that a document holds twice is one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .endings import bitmap
from .lookalike import Folder, slices

WINDOW, Q, BAND, BLOCK = 12, 8, 64, 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GONE = 0x110000
#: What a sign becomes that may stand as a word of its own.
_SIGN, _SIGNS = 0x110001, "%‰°§$€£¥№"
_BROKEN = re.compile(r"(?<=[^\W_])[-‐‑¬\u00ad][ \t]*[\r\n]\s*(?=[^\W_])")


@cache
def folded_letters() -> tuple[Folder, np.ndarray]:
    """The folder and the letter table of this process."""
    return Folder({}), _letters()


def _letters() -> np.ndarray:
    """code point -> lower-case code point, a blank, or gone (neither letter, digit nor mark)."""
    step = np.full(0x110000, _GONE, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalnum() or 0x300 <= k < 0x370:
            low = c.lower()
            step[k] = ord(low) if len(low) == 1 else k
        elif c.isspace():
            step[k] = 32
    for c in _SIGNS:
        step[ord(c)] = _SIGN
    return step


class Words:
    """A batch of folded texts as one stream of code points, and its words."""

    def __init__(self, texts: list[str]) -> None:
        folder, letters = folded_letters()
        forms = folder.forms([_BROKEN.sub("", t) if "\n" in t or "\r" in t else t for t in texts])
        blank = np.array([32], np.uint32)
        sizes = np.array([len(f) + 1 for f in forms], np.int64)
        raw = np.concatenate([x for f in forms for x in (f, blank)]) if forms else blank[:0]
        codes = letters[raw]
        sign = np.nonzero(codes == _SIGN)[0]
        if len(sign):  # a token of signs alone stays a word
            blanks = np.nonzero(codes == 32)[0]
            letter = np.concatenate([[0], np.cumsum(codes < _GONE) - np.cumsum(codes == 32)])
            at = np.searchsorted(blanks, sign)
            lo, hi = np.where(at > 0, blanks[at - 1] + 1, 0), blanks[at]
            codes[sign] = np.where(letter[hi] > letter[lo], _GONE, ord("%"))
        text = np.repeat(np.arange(len(forms)), sizes)
        keep = codes != _GONE
        codes, text = codes[keep], text[keep]
        solid = codes != 32
        keep = solid | np.concatenate([[False], solid[:-1]])
        self.codes, self.text = codes[keep], text[keep]
        solid = self.codes != 32
        self.start = np.nonzero(solid & ~np.concatenate([[False], solid[:-1]]))[0]
        self.word_text = self.text[self.start]
        self.end = np.nonzero(~solid)[0] if len(self.start) else self.start
        place = np.arange(len(self.codes)) - np.repeat(self.start, np.diff(np.concatenate([self.start, [len(self.codes)]]))) if len(self.start) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _BASE, np.uint64))
            mixed = self.codes.astype(np.uint64) * power[place]
            self.words = np.add.reduceat(mixed, self.start) if len(self.start) else np.zeros(0, np.uint64)

    def grams(self) -> np.ndarray:
        """Hash of the q-gram at each place."""
        n = len(self.codes) - Q + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        wide = self.codes.astype(np.uint64)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(Q):
                h *= np.uint64(1099511628211)
                h += wide[i : i + n]
            h *= _BASE
        return h ^ (h >> np.uint64(29))


class Index:
    """The q-grams of a block of item texts."""

    def __init__(self, keys: list[int], texts: list[str]) -> None:
        self.keys = np.array(keys)
        self.w = w = Words(texts)
        first = np.searchsorted(w.word_text, np.arange(len(texts)), "left")
        last = np.searchsorted(w.word_text, np.arange(len(texts)), "right")
        self.first, self.last = first, last
        half = WINDOW // 2
        bound = np.full(len(texts), 1 << 30)
        for t, (a, b) in enumerate(zip(first, last)):
            if b - a >= WINDOW:
                bound[t] = (w.end[a + half - 1 : b] - w.start[a : b - half + 1]).min() - Q + 1
        self.bound = np.maximum(bound, 1)
        self.least = int(self.bound.min(initial=1 << 30))
        g = w.grams()
        at = np.arange(len(g))
        inside = (w.text[at] == w.text[at + Q - 1]) & (self.bound[w.text[at]] < 1 << 30) if len(g) else at > 0
        g, at = g[inside], at[inside]
        order = np.argsort(g, kind="stable")
        self.grams, self.at = g[order], at[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.grams & np.uint64((1 << 22) - 1)] = True

    def search(self, d: Words) -> list[tuple[int, int]]:
        """(text of d, text of the index) pairs that are cases."""
        g = d.grams()
        if not len(g) or not len(self.grams):
            return []
        hit = self.seen[g & np.uint64((1 << 22) - 1)]
        at = np.nonzero(hit)[0]
        lo = np.searchsorted(self.grams, g[at], "left")
        known = lo < len(self.grams)
        known[known] = self.grams[lo[known]] == g[at[known]]
        at, lo = at[known], lo[known]
        if not len(at):
            return []
        long = _stretches(at, self.least)
        at, lo = at[long], lo[long]
        hi = np.searchsorted(self.grams, g[at], "right")
        n = hi - lo
        if not n.sum():
            return []
        place = np.repeat(at, n)
        item_at = self.at[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        doc, item = d.text[place], self.w.text[item_at]
        diagonal = place - item_at
        found = np.zeros(len(place), bool)
        for shift in (0, BAND // 2):
            band = (diagonal + shift) // BAND
            band -= band.min()
            pair = (doc * len(self.first) + item) * (int(band.max()) + 1) + band
            _, inv, count = np.unique(pair, return_inverse=True, return_counts=True)
            found |= count[inv] >= self.bound[item]
        place, item_at, doc, item = place[found], item_at[found], doc[found], item[found]
        wd = np.searchsorted(d.start, place, "right") - np.searchsorted(self.w.start, item_at, "right")
        out = set()
        for t, k, s in {*zip(doc.tolist(), item.tolist(), wd.tolist())}:
            if (t, k) not in out and self._aligned(d, t, k, s):
                out.add((t, k))
        return sorted(out)

    def _aligned(self, d: Words, t: int, k: int, s: int) -> bool:
        """Whether text t and item k agree in some window but for one edit, by the diagonal s and those next to it."""
        a, b = np.searchsorted(d.word_text, [t, t + 1])
        first, last = self.first[k], self.last[k]
        item, n = self.w.words[first:last], last - first

        def diagonal(s: int) -> np.ndarray:
            """Which words of the item stand in the text, shifted by s."""
            same = np.zeros(n, bool)
            at = s + first
            lo, hi = max(a, at), min(b, at + n)
            if lo < hi:
                same[lo - at : hi - at] = d.words[lo:hi] == item[lo - at : hi - at]
            return same

        own = diagonal(s)
        here = _runs(own)
        if here.max(initial=0) < WINDOW // 2:
            return False  # the half without the edit stands on this diagonal, unbroken
        lo, hi = max(a, first + s) - first - s, min(b, last + s) - first - s
        if hi - lo >= WINDOW:
            total = np.concatenate([[0], np.cumsum(own[lo:hi])])
            if (total[WINDOW:] - total[:-WINDOW] >= WINDOW - 1).any():
                return True
        same = (diagonal(s - 1), own, diagonal(s + 1))
        upto = [_runs(x) for x in same]  # equal words that end at, start at an item word
        since = [_runs(x[::-1])[::-1] for x in same]
        for x, y in ((1, 0), (2, 1)):  # a word of the item left out: the diagonal falls
            u, v = upto[x][: n - 2], since[y][2:]
            if n > 2 and ((u > 0) & (v > 0) & (u + v + 1 >= WINDOW)).any():
                return True
        for x, y in ((1, 2), (0, 1)):  # a word put in: the diagonal rises
            u, v = upto[x][: n - 1], since[y][1:]
            if n > 1 and ((u > 0) & (v > 0) & (u + v >= WINDOW)).any():
                return True
        return False


def _runs(same: np.ndarray) -> np.ndarray:
    """The number of places in a row, up to each place, where same holds."""
    n = np.arange(1, len(same) + 1)
    return n - np.maximum.accumulate(np.where(same, 0, n)) if len(same) else n


def _stretches(at: np.ndarray, least: int) -> np.ndarray:
    """Which of the rising places stand in an unbroken stretch of at least so many."""
    run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
    return np.bincount(run)[run] >= least


_INDEXES: dict[bytes, Index] = {}


def _index(part: list[tuple[int, str]]) -> Index:
    """The index of a block; a process keeps the last ones."""
    name = xxhash.xxh3_128_digest(repr(part).encode("utf-8", "surrogatepass"))
    if name not in _INDEXES:
        while len(_INDEXES) >= 2:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[name] = Index([i for i, _ in part], [t for _, t in part])
    return _INDEXES[name]


def regions(docs: DataFrame, stated: DataFrame) -> DataFrame:
    """k, t: the stretches of the texts of docs (k, t) that can hold a case of any stated item (i, t), with WINDOW words on either side."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ts = pdf["t"].tolist()
            for a, b in slices(ts):
                x = Index(list(range(b - a)), ts[a:b])
                yield pd.DataFrame({"gram": np.unique(x.grams).view(np.int64), "least": x.least})

    told = cut_lineage(stated.select("t").mapInPandas(grams, "gram long, least long").groupBy("gram").agg(F.min("least").alias("least")))
    least = told.agg(F.min("least")).first()[0] or 1
    mark, bits = bitmap(told.select(F.col("gram").alias("key")))
    shared = docs.sparkSession.sparkContext.broadcast(mark)
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for pdf in batches:
            texts, keys = pdf["t"].fillna("").tolist(), pdf["k"].tolist()
            out: list[tuple] = []
            for a, b in slices(texts):
                d = Words(texts[a:b])
                h = d.grams() & np.uint64((1 << bits) - 1)
                at = np.nonzero(table[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1)[0]
                if not len(at):
                    continue
                at = at[_stretches(at, least)]
                if not len(at):
                    continue
                w = np.unique(np.concatenate([np.searchsorted(d.start, at, "right") - 1, np.searchsorted(d.start, at + Q - 1, "right") - 1]))
                lo = np.maximum(w - WINDOW, np.searchsorted(d.word_text, d.word_text[w], "left"))
                hi = np.minimum(w + WINDOW + 1, np.searchsorted(d.word_text, d.word_text[w], "right"))
                new = np.concatenate([[True], (lo[1:] > hi[:-1]) | (d.word_text[w[1:]] != d.word_text[w[:-1]])])
                first = np.nonzero(new)[0]
                for x, y in zip(lo[first], np.maximum.reduceat(hi, first)):
                    t = d.codes[d.start[x] : d.end[y - 1]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                    out.append((keys[a + d.word_text[x]], t))
            yield pd.DataFrame(out, columns=["k", "t"])

    return docs.mapInPandas(run, f"k {kind}, t string")


def leaked(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    sides: tuple[tuple[str, ...], ...] = (("passage",), ("question", "answer")), block: int = BLOCK,
) -> DataFrame:
    """key, item: documents and the items they hold; each side of an item is searched by itself."""
    kind = docs.schema[key].dataType.simpleString()
    side = F.explode(F.array(*[F.concat_ws(" ", *[F.col(f"`{c}`") for c in s]) for s in sides]))
    stated = items.filter(F.col(item).isNotNull()).select(F.col(item).alias("i"), side.alias("t")).filter("t <> ''")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).filter("k is not null")

    def scan(part: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index(shared.value)
            for pdf in batches:
                texts, keys = pdf["t"].fillna("").tolist(), pdf["k"].to_numpy()
                pairs = [(a + p, q) for a, b in slices(texts) for p, q in index.search(Words(texts[a:b]))]
                at = np.array([p for p, _ in pairs], np.int64)
                yield pd.DataFrame({key: keys[at], item: index.keys[np.array([q for _, q in pairs], np.int64)]})

        return rows.mapInPandas(run, f"`{key}` {kind}, `{item}` long")

    if (stated.agg(F.sum(F.length("t"))).first()[0] or 0) > block:
        rows = cut_lineage(regions(rows, stated))
    blocks: list[DataFrame] = []
    batch: list[tuple[int, str]] = []
    size = 0
    for r in stated.toLocalIterator():
        if batch and size + len(r.t) > block:
            blocks.append(scan(batch))
            batch, size = [], 0
        batch.append((r.i, r.t))
        size += len(r.t)
    blocks.append(scan(batch))
    return reduce(DataFrame.unionByName, blocks).distinct()
