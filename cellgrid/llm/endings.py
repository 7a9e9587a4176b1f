"""Text cut off by field limits.

A backward character n-gram model is trained on all values of a column: for the last
characters of a text (contexts of several lengths, names and numbers reduced to one symbol)
it counts how often the text ended there and how often it went on. A second family of
contexts holds the last word from its start and counts how often the word went on. The
value for each text comes from its longest context with enough support, its own ending
left out; a text is cut when the odds of going on against ending exceed the threshold of its
language and column, or when the open word all but always goes on.

The model is a table on the cluster and has no bound that depends on the corpus: texts that
end alike share one tail (a hash of the longest context and the open word); the contexts of
all tails are marked in a bitmap, all places of all texts with a marked context are counted
(vectorised, combined per batch and again before the shuffle), the counts are joined to the
tails by key, and the odds of a tail to its texts. The bitmap only saves work: what it lets
through in vain is dropped by the join. A context needs LEAST places (an open word
WORD_LEAST), whatever the size of the corpus. No text is shuffled.

Thresholds. For each language the histogram of the log-odds is taken over all texts
without a closing mark; the threshold is its emptiest place between the two modes. Where a
column with the number of units of each text is given (tokens, characters), texts whose
number is much more frequent than its neighbours are likely to have met a limit there: their
odds are raised by up to LIFT.

Defined results: null texts, and texts without a letter or digit, are never cut and do not
count as rows with text; a closing mark ends a text; a lone answer label at the end is not
a cut; repeated rows are scored alike; unknown endings count as cut only by their
shorter contexts; a null number of units raises nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .languages import Languages, sampled
from .lookalike import slices

KS = (24, 16, 12, 9, 7, 5, 4, 3, 2)
#: Least places of a context and of an open word: what a share can be told from.
LEAST, WORD_LEAST = 30, 6
#: Log-odds over which a text that is one context as a whole, and a text that ends in a decimal point, are cut; share of open words that go on.
WHOLE, FIGURE, GO = 2.3, 2.0, 0.95
#: Most that meeting a limit adds to the log-odds; how much more frequent than its neighbours a number of units must be.
LIFT, SPIKE = 0.5, 4.0
#: Bits of the bitmap of contexts: sixteen a context, within these bounds.
BITS = (16, 27)
_NUM = re.compile(r"\d[\d.,]*\d|\d")
_NAME = re.compile(r"[^\W\d_a-zà-öø-ÿα-ωά-ώа-я぀-鿿][^\W\d_]*(?:[-'’][^\W\d_]+)*")
_TAIL = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\xad\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u200e\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_CLOSED = re.compile(r"(?:[.!?。！？…]|[.!?。]?[)\]\"”»’']|```)[)\]\"”»’'*_`]*$")
_LABEL = re.compile(r"(?:^|\n)\s*\**(?:final )?answer\s*:?\**\s*[\"']*$", re.IGNORECASE)
_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def visible(text: str | None) -> bool:
    return bool(text) and any(c.isalnum() for c in text)


def trimmed(text: str) -> str:
    """Without trailing blanks, the hyphen of an open word and a lone answer label; a text in capitals in lower case."""
    t = text.rstrip(_TAIL)
    if t[-1:] in "-‐‑" and t[-2:-1].isalpha():
        t = t[:-1]  # a word that stops at its hyphen goes on
    if "answer" in t[-30:].lower():
        t = _LABEL.sub("", t).rstrip(_TAIL)
    return t.capitalize() if len(t) > 20 and t.isupper() else t


def shape(text: str) -> str:
    """Numbers and capitalised words reduced to one symbol each."""
    return _NAME.sub("N", _NUM.sub("0", text))


class Contexts:
    """Hashes of the contexts of a batch of texts."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        pad = "^" * KS[0]
        shaped = [pad + shape(t) for t in texts]
        self._shape(shaped)
        self._word(texts)

    @staticmethod
    def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes)

    def _shape(self, shaped: list[str]) -> None:
        codes, self.ends = self._codes(shaped)
        n = len(codes)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(n + 1, _B, np.uint64))
            self.down = np.cumprod(np.full(n + 1, _BI, np.uint64))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n])])
        sizes = np.fromiter(map(len, shaped), np.int64, len(shaped))
        self.lengths = sizes - KS[0]  # of the reduced texts
        starts = self.ends - sizes
        inside = np.ones(n + 1, bool)
        for k in range(KS[0]):  # places within the padding
            inside[starts + k] = False
        inside[0] = False
        # a context ends before place i; the text ends there, or with one closing mark more
        self.places = np.nonzero(inside)[0]
        over = np.zeros(n + 1, bool)
        over[self.ends] = True
        near = self.ends - 1
        closing = np.isin(codes[near], [ord(c) for c in ".!?。！？"]) if n else np.zeros(0, bool)
        over[near[closing]] = True
        # the place after the last character of one text is the start of the next one's padding
        self.places = np.unique(np.concatenate([self.places, self.ends]))
        self.over = over[self.places]

    def key(self, k: int, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[at] - self.sums[at - k]) * self.down[at - k]
            return _mix(h, k)

    def _word(self, texts: list[str]) -> None:
        codes, ends = self._codes([t + "\n" for t in texts])
        self.word_keys, self.word_open = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.last_word = np.zeros(len(texts), np.uint64)
        n = len(codes)
        if not n:
            return
        solid = _SOLID[codes]
        start = solid & ~np.concatenate([[False], solid[:-1]])
        at = np.nonzero(solid)[0]
        first = np.maximum.accumulate(np.where(start, np.arange(n), 0))[at]
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(n + 1, _B, np.uint64))
            down = np.cumprod(np.full(n + 1, _BI, np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n])])
            self.word_keys = _mix((sums[at + 1] - sums[first]) * down[first], 99)
        self.word_open = solid[np.minimum(at + 1, n - 1)]
        last = ends - 2  # the character before the added newline
        ok = (last >= np.concatenate([[0], ends[:-1]])) & solid[np.maximum(last, 0)]
        ok &= ~_DIGIT[codes[np.maximum(last, 0)]]  # an open number tells nothing
        where = np.searchsorted(at, last)
        self.last_word = np.where(ok, self.word_keys[np.minimum(where, len(at) - 1)], 0).astype(np.uint64) if len(at) else self.last_word

    def finals(self) -> np.ndarray:
        """One row of keys per text: the shape contexts, then the open word."""
        return np.stack([self.key(k, self.ends) for k in KS] + [self.last_word], axis=1)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(k * 0x51_7C_C1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))) & ~np.uint64(1)  # the lowest bit is free for a flag


_SOLID = np.zeros(0x110000, bool)
_DIGIT = np.zeros(0x110000, bool)
for _k in range(0x3000):
    _SOLID[_k], _DIGIT[_k] = chr(_k).isalnum(), chr(_k).isdigit()


N = len(KS)


def odds_of(n: np.ndarray, over: np.ndarray, wn: np.ndarray, won: np.ndarray, word: np.ndarray, length: np.ndarray, figure: np.ndarray, closed: np.ndarray) -> pd.DataFrame:
    """odds, go, whole of tails. n, over, closed: counts by context; wn, won: those of the open word, where there is one."""
    rows = np.arange(len(n))
    n, over = n - 1, over - 1  # without the text itself
    good = n >= LEAST
    some = good.any(axis=1)
    good[:, -1] |= ~some
    pick = good.argmax(axis=1)
    a, b = np.maximum(n[rows, pick], 0), np.maximum(over[rows, pick], 0)
    odds = np.log10((a - b + 0.5) / (b + 0.05))
    # a point after a digit: whether a sentence closes there
    c = np.maximum(np.maximum(closed, over + 1)[rows, pick] - 1, 0)
    point = np.where(some, np.log10(np.maximum(a - c, 0) + 0.5) - np.log10(c + 0.05), 0.0)
    go = np.where(word & (wn - 1 >= WORD_LEAST), 1 - won / np.maximum(wn - 1, 1), 0.0)
    return pd.DataFrame({"odds": np.where(figure, point, odds), "go": go, "whole": length < np.array(KS)[pick]})


def _prepare(texts: pd.Series) -> list[str]:
    return [t for t in (trimmed(t) for t in texts if visible(t)) if visible(t)]


#: Keys of a tail: its shape contexts, its open word, its length up to the longest context, and for decimal points the contexts with the point.
KEYS = 2 * N + 2


def describe(raw: list[str | None], lang: Languages, told: tuple[list[str], np.ndarray, np.ndarray] | None = None) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(has_text, closed, figure, lang, tail of each text, tails, their keys). Closed texts have no tail. told: the languages, where they are known."""
    has = np.array([visible(t) for t in raw], bool)
    ts = [trimmed(t) if v else "" for t, v in zip(raw, has)]
    figure = np.array([t[-1:] == "." and t[-2:-1].isdigit() for t in ts], bool)
    closed = np.array([not t or bool(_CLOSED.search(t[-16:])) or not visible(t) for t in ts], bool) & ~figure
    full = ["" if t is None else t for t in raw]
    langs = told[0] if told else [x for a, b in slices(full) for x in lang.judge(full[a:b])[0]]
    d = pd.DataFrame({"has_text": has, "closed": closed, "figure": figure, "lang": pd.Series(langs, dtype=object)})
    at = np.nonzero(~closed)[0]
    if not len(at):
        return d.assign(tail=pd.array([None] * len(d), "Int64")), np.zeros(0, np.uint64), np.zeros((0, KEYS), np.uint64)
    made = []
    for a, b in slices([ts[i] for i in at]):
        own = [ts[i] for i in at[a:b]]
        fig = figure[at[a:b]]
        c = Contexts([t[:-1] if f else t for t, f in zip(own, fig)])
        keys = np.zeros((len(own), KEYS), np.uint64)
        keys[:, : N + 1] = c.finals()
        keys[:, N + 1] = np.minimum(c.lengths, KS[0])
        if fig.any():
            keys[fig, N + 2 :] = Contexts([t for t, f in zip(own, fig) if f]).finals()[:, :N]
        made.append(keys)
    keys = np.concatenate(made)
    with np.errstate(over="ignore"):
        name = _mix(keys[:, 0] + _mix(keys[:, N], 7) + _mix(keys[:, N + 2], 9), 5)
    tail = np.full(len(d), 0, np.int64)
    tail[at] = name.view(np.int64)
    names, first = np.unique(name, return_index=True)
    return d.assign(tail=pd.array(np.where(closed, None, tail.astype(object)), "Int64")), names, keys[first]


TAIL = "tail long, " + ", ".join(f"k{i} long" for i in range(KEYS))


def _tail_frame(names: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"tail": names.view(np.int64)} | {f"k{i}": keys[:, i].view(np.int64) for i in range(KEYS)})


def described(df: DataFrame, text: str, keep: list[str], lang: Languages) -> DataFrame:
    """keep.., has_text, closed, figure, lang, tail, keys (of the first row of each tail in a batch)."""
    shared = df.sparkSession.sparkContext.broadcast(lang)
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d, names, keys = describe(pdf["__text"].tolist(), shared.value)
            first = ~d["tail"].duplicated() & d["tail"].notna()
            held = pd.Series([None] * len(d), dtype=object)
            by = dict(zip(names.view(np.int64).tolist(), keys.view(np.int64)))
            at = np.nonzero(first.to_numpy(bool))[0]
            held[at] = pd.Series([by[t] for t in d["tail"][at]], index=at, dtype=object)
            yield pd.concat([pdf[keep].reset_index(drop=True), d.assign(keys=held)], axis=1)

    return df.select(*keep, F.col(f"`{text}`").cast("string").alias("__text")).mapInPandas(
        run, f"{kinds}has_text boolean, closed boolean, figure boolean, lang string, tail long, keys array<long>"
    )


def bitmap(keys: DataFrame) -> tuple[np.ndarray, int]:
    """(bytes, bits) that mark the column key of keys; its size is bounded, whatever the number of keys."""
    keys = cut_lineage(keys.distinct())
    bits = min(max(int(np.ceil(np.log2(max(keys.count(), 1) * 16))), BITS[0]), BITS[1])
    place = f"(key & {(1 << bits) - 1}L) + 1"
    pieces = keys.groupBy(F.expr(f"bitmap_bucket_number({place})").alias("b")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({place}))").alias("m")).collect()
    mark = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces:
        mark[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return mark, bits


def context_counts(texts: DataFrame, text: str, complete: DataFrame | None, keys: DataFrame) -> DataFrame:
    """key, n, over: how often each context with a key in keys occurs, and ends a text, over all texts."""
    rows = texts.select(F.col(f"`{text}`").cast("string").alias("t"))
    if complete is not None:
        whole = complete.select(F.regexp_replace(F.trim(complete.columns[0]), r"[.?!。？]+$", "").alias("t"))
        rows = rows.unionByName(whole)
    rows = rows.filter("t is not null")
    mark, bits = bitmap(keys)
    shared = texts.sparkSession.sparkContext.broadcast(mark)
    low = np.uint64((1 << bits) - 1)

    def marked(h: np.ndarray) -> np.ndarray:
        slot = h & low
        return (shared.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ts = _prepare(pdf["t"])
            for a, b in slices(ts, 500_000):
                c = Contexts(ts[a:b])
                keys, over = [], []
                for k in KS:
                    h = c.key(k, c.places)
                    keep = marked(h)
                    keys.append(h[keep])
                    over.append(c.over[keep])
                keep = marked(c.word_keys)
                keys.append(c.word_keys[keep])
                over.append(~c.word_open[keep])
                # one sort of keys that carry their flag in the lowest bit
                k = np.concatenate(keys) | np.concatenate(over).astype(np.uint64)
                k.sort()
                first = np.nonzero(np.concatenate([[True], k[1:] >> np.uint64(1) != k[:-1] >> np.uint64(1)]))[0] if len(k) else np.zeros(0, np.int64)
                ended = np.add.reduceat(k & np.uint64(1), first) if len(k) else k
                n = np.diff(np.concatenate([first, [len(k)]]))
                yield pd.DataFrame({"key": (k[first] & ~np.uint64(1)).view(np.int64), "n": n.astype(np.int64), "over": ended.astype(np.int64)})

    return rows.mapInPandas(count, "key long, n long, over long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("over").alias("over"))


def tail_odds(tails: DataFrame, counts: DataFrame) -> DataFrame:
    """tail, odds, go, whole: the counts joined to the keys of each tail."""
    places = [i for i in range(KEYS) if i != N + 1]
    keyed = tails.select("tail", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("key")) for i in places])).alias("e")).select("tail", "e.i", "e.key").filter("key <> 0")
    found = keyed.join(counts, "key").groupBy("tail").agg(
        *[F.max(F.when(F.col("i") == i, F.col("n"))).alias(f"n{i}") for i in [*range(N + 1), *range(N + 2, KEYS)]],
        *[F.max(F.when(F.col("i") == i, F.col("over"))).alias(f"o{i}") for i in range(N + 1)],
    )
    told = tails.select("tail", F.col(f"k{N + 1}").alias("length"), (F.col(f"k{N}") != 0).alias("word"), (F.col(f"k{N + 2}") != 0).alias("figure"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf.fillna(0)
            pick = lambda c, r: x[[f"{c}{i}" for i in r]].to_numpy(np.int64)
            o = odds_of(pick("n", range(N)), pick("o", range(N)), x[f"n{N}"].to_numpy(np.int64), x[f"o{N}"].to_numpy(np.int64), x["word"].to_numpy(bool),
                        x["length"].to_numpy(np.int64), x["figure"].to_numpy(bool), pick("n", range(N + 2, KEYS)))
            yield pd.concat([pdf[["tail"]].reset_index(drop=True), o], axis=1)

    return told.join(found, "tail", "left").mapInPandas(run, "tail long, odds double, go double, whole boolean")


def prepare(df: DataFrame, text: str, keep: list[str], complete: DataFrame | None = None, lang: Languages | None = None, values: DataFrame | None = None,
            extra: list[str] = ()) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """(the described rows of df, the odds of every tail, the scored texts of extra).

    values: the table whose texts are counted (default: df); complete: one column of texts
    that are whole also without their closing mark; extra: a bounded list.
    """
    lang = lang or sampled()
    spark = df.sparkSession
    rows = cut_lineage(described(df, text, keep, lang))
    more, names, keys = describe(list(extra), lang)
    tails = rows.filter("keys is not null").select("tail", *[F.col("keys")[i].alias(f"k{i}") for i in range(KEYS)])
    tails = tails.unionByName(spark.createDataFrame(_tail_frame(names, keys), TAIL))
    tails = cut_lineage(tails.groupBy("tail").agg(*[F.min(f"k{i}").alias(f"k{i}") for i in range(KEYS)]))
    marks = tails.select(F.explode(F.array(*[F.col(f"k{i}") for i in range(KEYS) if i != N + 1])).alias("key")).filter("key <> 0")
    odds = cut_lineage(tail_odds(tails, context_counts(df if values is None else values, text, complete, marks)))
    more = more.assign(odds=-3.0, go=0.0, whole=False)
    if len(names):
        asked = spark.createDataFrame(pd.DataFrame({"tail": names.view(np.int64)}), "tail long")
        own = odds.join(broadcast_if_small(asked, len(names)), "tail", "left_semi").toPandas().set_index("tail")
        at = np.nonzero(more["tail"].notna())[0]
        got = own.loc[more["tail"][at].astype(np.int64)]
        for c in ("odds", "go", "whole"):
            more.loc[at, c] = got[c].to_numpy()
    return rows.drop("keys"), odds, more.drop(columns="tail")


def attach(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """rows with odds, go and whole by their tail; those without a tail can only end there."""
    scored = rows.join(broadcast_if_small(odds, odds.count()), "tail", "left").drop("tail")
    return scored.withColumn("odds", F.coalesce("odds", F.lit(-3.0))).withColumn("go", F.coalesce("go", F.lit(0.0))).withColumn("whole", F.coalesce("whole", F.lit(False)))


DEFAULT = 1.0


def thresholds(scored: DataFrame) -> dict[str, float]:
    """Per language the emptiest place of the histogram of log-odds between its modes."""
    b = F.floor(F.col("odds") * 5).cast("int").alias("b")
    rows = scored.filter("has_text and not closed and not whole and not figure").groupBy("lang", b).count().collect()
    out: dict[str, float] = {}
    for lang in {r["lang"] for r in rows}:
        h = {r["b"]: r["count"] for r in rows if r["lang"] == lang}
        if sum(h.values()) < 200:
            continue
        spots = range(3, 8)  # 0.6 to 1.6
        out[lang] = min(spots, key=lambda k: (h.get(k, 0) + h.get(k - 1, 0), abs(k - 5))) / 5
    return out


def is_cut(limits: dict[str, float]) -> Column:
    """The verdict over a scored row."""
    limit = F.lit(DEFAULT)
    for lang, t in limits.items():
        limit = F.when(F.col("lang") == lang, t).otherwise(limit)
    by_context = F.when(F.col("whole"), F.col("odds") > WHOLE).otherwise(F.col("odds") > limit)
    open_end = by_context | (F.col("go") > GO)
    return F.col("has_text") & ~F.col("closed") & F.when(F.col("figure"), ~F.col("whole") & (F.col("odds") > FIGURE)).otherwise(open_end)


def cut_flags(d: pd.DataFrame, limits: dict[str, float]) -> np.ndarray:
    """The same over a described batch."""
    limit = d["lang"].map(limits).fillna(DEFAULT).to_numpy(float)
    odds, whole = d["odds"].to_numpy(), d["whole"].to_numpy(bool)
    open_end = np.where(whole, odds > WHOLE, odds > limit) | (d["go"].to_numpy() > GO)
    return d["has_text"].to_numpy(bool) & ~d["closed"].to_numpy(bool) & np.where(d["figure"].to_numpy(bool), ~whole & (odds > FIGURE), open_end)


def limit_lift(scored: DataFrame, units: str) -> DataFrame:
    """units, lift: numbers of units at which far more open texts end than at the neighbouring ones."""
    n = scored.filter(f"has_text and not closed and `{units}` is not null").groupBy(F.col(f"`{units}`").cast("long").alias("u")).agg(F.count(F.lit(1)).alias("c"))
    around = n.select(F.explode(F.array(*[F.col("u") + d for d in (-3, -2, -1, 1, 2, 3)])).alias("u"), "c").groupBy("u").agg((F.sum("c") / 6).alias("near"))
    ratio = F.col("c") / F.greatest(F.coalesce("near", F.lit(0.0)), F.lit(1.0))
    lift = F.least(F.log10(ratio), F.lit(1.0)) * LIFT
    return n.join(around, "u", "left").filter((ratio >= SPIKE) & (F.col("c") >= LEAST)).select("u", lift.alias("lift"))


def find_cut(df: DataFrame, text: str, keep: list[str], complete: DataFrame | None = None, units: str | None = None, lang: Languages | None = None) -> DataFrame:
    """keep.., has_text, lang, odds, cut."""
    held = [*keep, units] if units and units not in keep else keep
    rows, known, _ = prepare(df, text, held, complete, lang)
    scored = cut_lineage(attach(rows, known))
    limits = thresholds(scored)
    if units:
        lifts = cut_lineage(limit_lift(scored, units))
        scored = scored.join(broadcast_if_small(lifts, lifts.count()), F.col(f"`{units}`").cast("long") == F.col("u"), "left")
        scored = scored.withColumn("odds", F.col("odds") + F.coalesce("lift", F.lit(0.0))).select(*keep, "has_text", "closed", "figure", "lang", "odds", "go", "whole")
    return scored.withColumn("cut", is_cut(limits))


def rates(found: DataFrame, source: str) -> DataFrame:
    """source, with_text, cut, share: how often each source's texts are cut."""
    n = found.filter("has_text").groupBy(source).agg(F.count(F.lit(1)).alias("with_text"), F.sum(F.col("cut").cast("long")).alias("cut"))
    return n.withColumn("share", F.col("cut") / F.col("with_text"))
