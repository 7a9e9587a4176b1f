"""Visually identical text in one consistent form.

Look-alike classes are computed by union-find over strings: single code points, their
decompositions, and hand-listed cross-script letters. The relation is transitive, so a
full-width Cyrillic-looking letter, its plain form and its Latin twin land in one class.
Of each class the member that is most frequent in the corpus is the representative (ties:
ASCII first, then the lower code point); only the class of blanks always takes the plain
one. Text is rewritten by a multi-pattern automaton, greedily, the longest pattern at each
place, then composed (NFC), and rewritten again while that changes it.

What a reader can tell apart stays apart: letter case, digits against letters, accents,
raised, lowered, circled and stacked forms are never joined.

`frequencies` counts code points over all texts in one scan (vectorised, at most one row
per code point and task is shuffled). `Folder` is built on the driver from these counts;
its size is bounded by Unicode, not by the data. A process builds the automaton of a
folder once and keeps it for its later tasks.

`lookalike_classes` compares fixed-size digests of the forms: one row per document that has
a twin, with its class and the number of its links. `lookalike_pairs` expands the classes.
Exact copies form one group each, and the rows of a form are spread over salts before they
meet the mixed forms, so a form that a third of all rows share costs no more than its result.

Defined results: null text gives a null form and no pair; a text without a visible
character gives an empty form and no pair; a row repeated with the same id is one
document; ties in frequency are decided by code point.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from hashlib import md5

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Letters of other scripts that are drawn like a Latin letter.
CROSS_SCRIPT = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫͿ", "K": "КΚᏦK",
    "L": "Ꮮ", "M": "МΜᎷϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "S": "ЅᏚՏ", "T": "ТΤᎢ", "V": "ᏙѴ", "W": "ᎳԜ", "X": "ХΧ",
    "Y": "ҮΥ", "Z": "ΖᏃ", "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ",
    "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у", "å": "", "Å": "Å", "µ": "μ", "Ω": "Ω",
    "Г": "Γ", "П": "Π", "Ф": "Φ", "ə": "ә", "Ə": "Ә", "ʒ": "ӡ",
    # punctuation drawn alike
    "-": "‐‑﹣", "'": "＇", ";": ";", "·": "·‧", "|": "∣ǀ", ":": "։∶", "!": "ǃ", ",": "‚",
}
# Decomposition kinds of the Unicode data that keep the look.
_ALIKE_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Compatibility characters that look unlike their decomposition.
_UNLIKE = set("ſẛϐϑϒϓϔϕϖϰϱϲϴϵ϶")
# Characters without a look (format controls, joiners, fillers).
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f"
    "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061"
    "\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e"
    "\u206f\u3164\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09"
    "\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff\uffa0"
)
#: Line ends that look like a newline.
_BREAKS = ("\r\n", "\r", "\x0b", "\x0c", "\x85", " ", " ")


_GONE = 0x110000
_STRIP = (32, 10, 9)


class UnionFind:
    """Classes over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        self.up[self.find(b)] = self.find(a)


def _alike(c: str) -> str | None:
    """The string that Unicode says c is drawn like, or None."""
    d = unicodedata.decomposition(c)
    if not d:
        return None
    kind, codes = (d.split(" ", 1) + [""])[:2] if d[0] == "<" else ("", d)
    if kind and (kind not in _ALIKE_KINDS or c in _UNLIKE):
        return None
    s = "".join(chr(int(x, 16)) for x in codes.split())
    if kind == "<compat>" and (s[0] == " " and len(s) > 1 or s[0] == "("):
        return None  # spacing accents and parenthesised signs
    return s


#: The automata of this process, by the counts they were made for.
_MADE: dict[bytes, tuple] = {}
#: Parts that the rows of one form are spread over.
SALTS = 16


class Folder:
    """Rewrites text into the representative form. Picklable; the automaton is built once per process."""

    def __init__(self, counts: dict[str, int] | None = None) -> None:
        self.counts = counts or {}
        self.name = md5(repr(sorted(self.counts.items())).encode("utf-8", "surrogatepass")).digest()

    def classes(self) -> dict[str, str]:
        """pattern -> representative, for every pattern that is not its own."""
        uf = UnionFind()
        for k in range(0x80, sys.maxunicode + 1):
            if 0xAC00 <= k <= 0xD7A3 or 0xD800 <= k <= 0xDFFF:  # composed Hangul: NFC alone settles it
                continue
            c = chr(k)
            if (s := _alike(c)) is not None:
                uf.join(c, s)
            elif unicodedata.category(c) == "Zs":
                uf.join(" ", c)
        for c, twins in CROSS_SCRIPT.items():
            for t in twins:
                uf.join(c, t)
        groups: dict[str, list[str]] = {}
        for x in list(uf.up):
            groups.setdefault(uf.find(x), []).append(x)
        best: dict[str, str] = {}
        for members in groups.values():
            single = [m for m in members if len(m) == 1]
            # a string member (the letters of a ligature, a letter and its accent) is its parts' choice
            strings = sorted((m for m in members if len(m) > 1), key=lambda m: (not m.isascii(), len(m), m))
            ligature = next((m for m in strings if not any(unicodedata.combining(x) for x in m)), None)
            rep = ligature or max(single, key=lambda m: (m == " ", self.counts.get(m, 0), m.isascii(), -ord(m)))
            best |= {m: rep for m in members if m != rep}
        # transitive through the parts: decompose, rewrite each part, compose again, until it stands
        def settle(t: str) -> str:
            for _ in range(8):
                t = best.get(t, t)
                new = unicodedata.normalize("NFC", "".join(best.get(x, x) for x in unicodedata.normalize("NFD", t)))
                if new == t:
                    break
                t = new
            return t

        found = {x: settle(x) for x in uf.up}
        found |= dict.fromkeys(INVISIBLE, "") | dict.fromkeys(map(chr, range(0xE0000, 0xE0080)), "")
        found |= {chr(k): "" for k in [*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA0)] if chr(k) != "\x85"}
        found |= dict.fromkeys(_BREAKS, "\n")
        return {p: r for p, r in found.items() if p != r}

    def _machine(self) -> tuple:
        """The automaton; its transitions over single code points as a table; what needs the automaton itself."""
        if self.name not in _MADE:
            classes = self.classes()
            auto = ahocorasick.Automaton()
            step = np.arange(0x110000, dtype=np.uint32)
            hard = np.zeros(0x110000, np.uint8)
            for p, r in classes.items():
                auto.add_word(p, (len(p), r))
                if len(p) == 1 and len(r) <= 1:
                    step[ord(p)] = ord(r) if r else _GONE
                elif len(p) == 1:
                    hard[ord(p)] |= 1
            auto.make_automaton()
            for k in range(0x300, 0x110000):
                kind = unicodedata.category(chr(k))
                if kind[0] == "M" and step[k] != _GONE or 0x1100 <= k < 0x1200:
                    hard[k] |= 1
                elif kind in ("So", "Sk"):
                    hard[k] |= 4
            hard[0x200D] |= 2
            for c in "\r\x85\u2028\u2029\x0b\x0c":
                hard[ord(c)] |= 1
            while len(_MADE) >= 4:
                _MADE.pop(next(iter(_MADE)))
            _MADE[self.name] = auto, step, hard
        return _MADE[self.name]

    def rewrite(self, text: str) -> str:
        """One greedy pass of the automaton."""
        auto = self._machine()[0]
        out, at = [], 0
        for end, (n, rep) in auto.iter_long(text):
            start = end - n + 1
            if text[start] == "\u200d" and _symbol(text[start - 1 : start]) and _symbol(text[end + 1 : end + 2]):
                continue  # a joiner between pictographs changes the look
            out.append(text[at:start])
            out.append(rep)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def forms(self, texts: list[str]) -> list[np.ndarray]:
        """The forms of many texts as arrays of code points; most texts need only the table."""
        return [f for a, b in slices(texts) for f in self._forms(texts[a:b])]

    def _forms(self, texts: list[str]) -> list[np.ndarray]:
        _, step, hard = self._machine()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        flags = np.zeros(len(texts), np.uint8)
        full = np.nonzero(lengths)[0]
        if len(full):
            flags[full] = np.bitwise_or.reduceat(hard[codes], (ends - lengths)[full])
        new = step[codes]
        keep = new != _GONE
        stop = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
        new = new[keep]
        blank = (new == 32) | (new == 9)
        loose = np.nonzero(blank[:-1] & (new[1:] == 10))[0]
        rough = (flags & 1 > 0) | (flags & 6 == 6)
        rough[np.searchsorted(stop, loose, "right") - 1] = True
        out = []
        for i, text in enumerate(texts):
            if rough[i]:
                out.append(np.frombuffer(self.form(text).encode("utf-32-le", "surrogatepass"), np.uint32))
                continue
            a, b = stop[i], stop[i + 1]
            while a < b and new[a] in _STRIP:
                a += 1
            while a < b and new[b - 1] in _STRIP:
                b -= 1
            out.append(new[a:b])
        return out

    def form(self, text: str) -> str:
        """The consistent form; blanks that end a line or the text have no look."""
        for _ in range(4):
            new = self.rewrite(text)
            if not new.isascii():
                new = unicodedata.normalize("NFC", new)
            if new == text:
                break
            text = new
        if " \n" in text or "\t\n" in text:
            text = re.sub(r"[ \t]+\n", "\n", text)
        return text.strip(" \n\t")


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, so that the arrays of a batch stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _twins() -> dict[str, dict[str, str]]:
    """Script -> Latin letter -> that script's letter drawn alike."""
    out: dict[str, dict[str, str]] = {"CYRILLIC": {}, "GREEK": {}}
    for latin, twins in CROSS_SCRIPT.items():
        for t in twins:
            script = unicodedata.name(t, "").split(" ")[0]
            if script in out and latin.isalpha():
                out[script].setdefault(latin, t)
    return out


_TWINS = _twins()
_NATIVE = re.compile("[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
_WORD = re.compile(r"[^\W\d_]+")


def native(form: str) -> str:
    """A form with each word that is plainly Cyrillic or Greek in that script throughout.

    A word is plainly of a script when it has letters that only this script has and no
    letter that only Latin has. What is decided depends on the form alone, so equal forms
    stay equal and different ones different.
    """
    if form.isascii() or not _NATIVE.search(form):
        return form

    def word(m: re.Match) -> str:
        w = m[0]
        if not _NATIVE.search(w):
            return w
        parts = unicodedata.normalize("NFD", w)
        own = {unicodedata.name(c, "").split(" ")[0] for c in parts if _NATIVE.match(c)}
        if len(own) != 1 or (twins := _TWINS.get(own.pop())) is None:
            return w
        if any(c.isalpha() and not _NATIVE.match(c) and c not in twins for c in parts):
            return w
        return unicodedata.normalize("NFC", "".join(twins.get(c, c) for c in parts))

    return _WORD.sub(word, form)


def _symbol(c: str) -> bool:
    return bool(c) and unicodedata.category(c) in ("So", "Sk")


def frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """cp, n: how often each code point occurs, over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, np.int64)
        for pdf in batches:
            texts = [t for t in pdf["t"] if t is not None]
            for a, b in slices(texts):
                data = "".join(texts[a:b])
                plain = data.isascii()
                codes = np.frombuffer(data.encode("ascii"), np.uint8) if plain else np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
                n = np.bincount(codes)
                total[: len(n)] += n
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"cp": at.astype(np.int64), "n": total[at]})

    parts = df.select(F.col(f"`{text}`").alias("t")).mapInPandas(count, "cp long, n long")
    return parts.groupBy("cp").agg(F.sum("n").alias("n"))


def corpus_folder(df: DataFrame, text: str = "text") -> Folder:
    """A Folder whose representatives follow the corpus. At most one row per code point reaches the driver."""
    return Folder({chr(r.cp): r.n for r in frequencies(df, text).collect()})


def normalize(df: DataFrame, text: str = "text", out: str = "form", folder: Folder | None = None) -> DataFrame:
    """df with the column out: the consistent form of text (null for null), words of other scripts kept in them."""
    folder = folder or corpus_folder(df, text)

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        forms = folder.forms(["" if t is None else t for t in s])
        return pd.Series([None if t is None else native(f.tobytes().decode("utf-32-le", "surrogatepass")) for t, f in zip(s, forms)])

    return df.withColumn(out, form(F.col(f"`{text}`")))


def _mixed(df: DataFrame, key: str, text: str, folder: Folder | None) -> DataFrame:
    """form, copy, id of every document whose form another text shares."""
    folder = folder or corpus_folder(df, text)

    @F.pandas_udf("binary")
    def digest(s: pd.Series) -> pd.Series:
        forms = folder.forms(["" if t is None else t for t in s])
        return pd.Series([md5(f.tobytes()).digest() if len(f) else None for f in forms])

    docs = (
        df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t"))
        .select("id", F.unhex(F.md5("t")).alias("copy"), digest("t").alias("form"))
        .filter("id is not null and form is not null")
    )
    members = cut_lineage(docs)
    mixed = members.groupBy("form").agg(F.min("copy").alias("lo"), F.max("copy").alias("hi")).filter("lo <> hi")
    mixed = mixed.select("form", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(mixed, ["form", "salt"], "left_semi").select("form", "copy", "id").distinct()


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text", folder: Folder | None = None) -> DataFrame:
    """key, class_id, links: every document with a twin, its class, and how many documents look the same and differ in a character."""
    m = _mixed(df, key, text, folder)
    copies = m.groupBy("form", "copy").agg(F.count(F.lit(1)).alias("c"))
    whole = copies.groupBy("form").agg(F.sum("c").alias("n"))
    links = copies.join(whole, "form").select("form", "copy", (F.col("n") - F.col("c")).alias("links"))
    return m.join(links, ["form", "copy"]).select(F.col("id").alias(key), F.lower(F.hex("form")).alias("class_id"), "links")


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", folder: Folder | None = None) -> DataFrame:
    """<key>_a, <key>_b with a < b: texts of one form that differ in a character."""
    m = cut_lineage(_mixed(df, key, text, folder))
    copies = m.select("form", "copy").distinct()
    twins = copies.alias("x").join(copies.alias("y"), (F.col("x.form") == F.col("y.form")) & (F.col("x.copy") < F.col("y.copy")))
    twins = twins.select(F.col("x.copy").alias("cx"), F.col("y.copy").alias("cy"), F.col("x.form").alias("form"))
    pairs = twins.join(m.alias("a"), (F.col("cx") == F.col("a.copy")) & (twins["form"] == F.col("a.form"))).select(
        "cy", twins["form"].alias("f"), F.col("a.id").alias("p")
    ).join(m.alias("b"), (F.col("cy") == F.col("b.copy")) & (F.col("f") == F.col("b.form"))).select("p", F.col("b.id").alias("q"))
    pairs = pairs.filter("p <> q")
    return pairs.select(F.least("p", "q").alias(f"{key}_a"), F.greatest("p", "q").alias(f"{key}_b"))
