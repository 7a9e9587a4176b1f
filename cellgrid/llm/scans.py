"""Noise in text from scanned pages: found per line, and repaired into running paragraphs.

Lexicon. Words, hyphenated compounds and pairs of neighbouring plain words are counted over
all pages (broken words at line ends left out) and stay a table on the cluster. Words of
LEAST occurrences are lexicon words, whatever the size of the corpus.

Misread words. Every confusion pair keeps a word's strokes (a d is a c and an l, an m an r
and an n), so a word and its misreadings have the same stroke form, however many characters
were misread. The symmetric-delete index holds the stroke form of every word and what is
left of it without one stroke; words and lexicon words that share an entry are joined, and
the weighted edit distance, which charges little for the confusion pairs, keeps a candidate
that is much more frequent; the shorter the word and the more confusions, the more. A lost
or doubled thin stroke is accepted in long unknown words. Among several candidates of one
distance the bigram context picks.

Running heads. The first and last lines of a page are keyed by their letters with the
confusions undone; a key on two pages of a document is a head. The first line of the
first page is its title and stays. A line that only numbers the page is recognised by its
form, or by a number that keeps the same distance to page_index on two pages.

Broken words. A body line that ends in a break mark and whose next body line starts in
lower case is joined, unless the corpus knows the word (by its strokes) with its mark better.

One pass over the pages, with a bitmap of the misread words, keeps of each line only the
tokens that can matter; what is shuffled are these, the keys of the outer lines and the
look-ups of each page, equi-joined. The text of a page is read again, and joined last, only
where the repaired text is asked for. Pages are linked to their neighbours by equi-joins on
(document, page), heads by counts per (document, key), salted: no task gets a whole document.

Defined results: null or empty text_spans give no noise and the empty text; null and blank
spans count as places but hold nothing; missing bbox or image_path change nothing; a
repeated (doc_id, page_index) is processed as often as it occurs; pages of documents
without a row that calls them scanned are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import xxhash

from ..session import broadcast_if_small, cut_lineage
from .endings import bitmap

#: Occurrences of a lexicon word.
LEAST = 4
#: Lines at either end of a page that may be heads or page numbers; parts that the pages of a document are spread over.
OUTER, SALTS = 2, 16
# What scanners make of a character (written, read).
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("a", "@"), ("o", "0"), ("t", "f"), ("f", "t"), ("s", "5"), ("i", "l"), ("l", "i"), ("l", "1"), ("i", "1"),
    ("g", "9"), ("b", "6"), ("b", "8"), ("h", "b"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("w", "vv"),
    ("li", "h"), ("ri", "n"), ("n", "ri"), ("z", "2"), ("q", "9"),
)
_COST = 0.3
_MARK = re.compile(r"([^\W_][^\s]*?)[-‐‑¬­]\s*$")
_WORD = re.compile(r"[^\W_@](?:[\w@]*[^\W_@]|[\w@]*@)?|@[\w@]*", re.UNICODE)
_CODE = re.compile(r"^[A-Z]{1,3}\d[\d\-]*$|^[\d.,%\-]+$|^\d+[A-Z]{1,2}$|^[A-Z]\d[A-Z]$")
_ROMAN = re.compile(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
# The strokes that make up a character.
_STROKES = str.maketrans({
    "e": "c", "@": "a", "0": "o", "f": "t", "5": "s", "i": "l", "1": "l", "|": "l", "9": "g", "q": "g", "2": "z",
    "6": "ll", "8": "ll", "b": "ll", "h": "ll", "u": "ll", "d": "cl", "n": "rl", "m": "rrl", "w": "vv",
})
_FOLD_ONE = str.maketrans({"1": "l", "i": "l", "|": "l", "0": "o", "e": "c", "t": "f", "5": "s", "9": "g", "@": "a", "6": "u", "h": "u", "b": "u", "8": "u"})
_FOLD = (("rn", "m"), ("cl", "d"), ("ll", "u"), ("vv", "w"), ("rl", "n"))  # of folded letters
_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "i": "1", "o": "0", "O": "0", "S": "5", "s": "5", "B": "8", "b": "6", "g": "9", "q": "9", "Z": "2", "z": "2"})
_FIGURES = r"[\dlIoOSsBbgi|]{1,6}|[ivxlcdm]{1,9}|[IVXLCDM]{1,9}"
_NUMBER = tuple(re.compile(rf"^[\W_]*{word}(?P<n>{_FIGURES})(?P<of>\s+[\w@]{{1,4}}\s+[\dlIoOSsBbg|]{{1,6}}|\s*/\s*\d+)?[\W_]*$")
                for word in (r"(?P<word>)", r"(?P<word>[^\W\d_][\w@]*)\.?[\W_]*"))
_PAGE_WORDS = {"page", "p", "pp", "pg", "seite", "s", "página", "pagina", "pág", "feuille", "blatt"}


def fold(word: str) -> str:
    """The word with every confusion undone in one direction; confusable words fold alike."""
    w = word.casefold().translate(_FOLD_ONE)
    for a, b in _FOLD:
        w = w.replace(a, b)
    return w


def strokes(word: str) -> str:
    """The word's strokes; a word and any of its misreadings have the same."""
    return word.lower().translate(_STROKES)


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_PAGE_FOLDS = {fold(w) for w in _PAGE_WORDS}


def head_key(line: str) -> str | None:
    """The key of a possible running head: its words of letters, folded; page numbers dropped."""
    line = line.strip()
    if not line or re.search(r"[.,;\-‐¬­]$", line) and not re.search(r"\d\W*$", line):
        return None
    words = [w for w in re.findall(r"[\w@]+", line) if re.search(r"[^\W\d_]", w) and not re.fullmatch(r"[\dlIoO|]+", w)]
    if sum(len(w) for w in words) < 6 or not re.match(r"[\W\d_]*[^\W\d_]", line):
        return None
    first = next(c for c in line if c.isalpha())
    if first.islower() and not re.match(r"^\W*\d", line):
        return None
    return fold("".join(words))


def page_number(line: str) -> tuple[int, bool] | None:
    """(number, whether the form alone says that it numbers a page)."""
    m = _NUMBER[0].match(line) or _NUMBER[1].match(line)
    if not m:
        return None
    word, n = m["word"], m["n"]
    if word and fold(word) not in _PAGE_FOLDS:
        return None
    roman = n.lower()
    if _ROMAN.match(roman) and not n.isdigit() and (len(n) > 1 or word or n in "ivxIVX"):
        value, at = 0, dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)
        for a, b in zip(roman, roman[1:] + " "):
            value += -at[a] if at[a] < at.get(b, 0) else at[a]
        return value, bool(word)
    d = n.translate(_DIGITS)
    if not d.isdigit() or not re.search(r"\d", n) and not word:
        return None
    framed = bool(re.match(r"^\s*([-–—\[(<|])\s*\S+\s*[-–—\])>|]\s*$", line))
    if re.search(r"[%.,]\s*$", line) and not word:
        return None
    return int(d), bool(word or m["of"] or framed)


def line_words(lines: list[str]) -> Iterator[list[str]]:
    """The whole words of each line: broken ends and their continuations left out."""
    broken = False
    for t in lines:
        if not t.strip():
            continue
        words = t.split()
        if broken:
            words = words[1:]
        broken = bool(_MARK.search(t))
        if broken:
            words = words[:-1]
        yield words


def parts(token: str) -> list[str]:
    """The words within a token, without punctuation; codes and numbers have none."""
    core = token.strip(".,;:!?()[]{}\"'“”«»„|")
    if not core or _CODE.match(core):
        return []
    return [p for p in _WORD.findall(core.replace("¬", "").replace("­", "")) if any(c.isalpha() or c == "@" for c in p)]


def index_keys(word: str) -> set[int]:
    """Entries of the symmetric-delete index: the stroke form, and without one stroke."""
    t = strokes(word)
    return {_key(t)} | {_key(t[:i] + t[i + 1 :]) for i in range(len(t))}


def distance(written: str, read: str, limit: float = 1.0) -> float:
    """Weighted edit distance: confusion pairs cost little, any other edit 1."""
    n, m = len(written), len(read)
    rows = [[math.inf] * (m + 1) for _ in range(n + 1)]
    rows[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            v = rows[i][j]
            if v > limit:
                continue
            if i < n and j < m:
                step = v + (written[i] != read[j])
                if step < rows[i + 1][j + 1]:
                    rows[i + 1][j + 1] = step
            if i < n and v + 1 < rows[i + 1][j]:
                rows[i + 1][j] = v + 1
            if j < m and v + 1 < rows[i][j + 1]:
                rows[i][j + 1] = v + 1
            for a, b in CONFUSIONS:
                if written.startswith(a, i) and read.startswith(b, j):
                    x, y = i + len(a), j + len(b)
                    if v + _COST < rows[x][y]:
                        rows[x][y] = v + _COST
    return rows[n][m]


def accepted(word: str, n: int, candidate: str, f: int) -> float | None:
    """The distance of a lexicon word that this word is a misreading of, or None."""
    if candidate == word or f < 3 * max(n, 1) or len(word) < 2 or not any(c.isalpha() or c == "@" for c in word):
        return None
    strange = bool(re.search(r"[\d@]", word))
    size = len(word)
    ratio = 3 if strange else 4 if size > 3 else 8 if size == 3 else 20
    a, b = strokes(word), strokes(candidate)
    if a != b:  # a thin stroke lost or doubled
        long, short = sorted((a, b), key=len, reverse=True)
        at = next((i for i, (x, y) in enumerate(zip(long, short)) if x != y), len(short))
        if len(long) - len(short) != 1 or long[at] != "l" or long[:at] + long[at + 1 :] != short or at == len(short) or size < 9 or n >= LEAST or f < 50 * max(n, 1):
            return None
        return 0.95
    d = distance(candidate, word, 4 * _COST + 0.01)
    if d > 4 * _COST + 0.01:
        return None
    m = round(d / _COST)
    if m > 1 and not strange and size <= 6 or m > 2:
        ratio = 20
    if m > 1 and size < 4 and not strange or m > 2 and size < 8 or f < ratio * max(n, 1):
        return None
    return d


@dataclass
class Lexicon:
    """What the words of one page were looked up for."""

    fixes: dict[tuple[str, str], str] = field(default_factory=dict)
    joins: dict[tuple[str, str], bool] = field(default_factory=dict)
    known: set[str] = field(default_factory=set)

    def repair(self, word: str, before: str = "") -> str | None:
        """The lower-case word that was misread as this one; None where it stands."""
        w = word.lower()
        if w == "@":
            return "a"
        found = self.fixes.get((w, before))
        if found is not None:
            return found
        if odd(w) and w not in self.known:
            back = w.translate(str.maketrans("0159@6", "olsgab"))
            return back if sum(c.isdigit() or c == "@" for c in w) == 1 and len(w) >= 4 else None
        return None

    def joined(self, left: str, right: str) -> bool:
        """Whether a word broken into left and right is one word without its mark."""
        return self.joins.get(broken(left, right), True)


def odd(w: str) -> bool:
    """Whether a word is plainly a misreading by its form: letters around a digit or sign."""
    return bool(re.search(r"[\d@]", w) and re.fullmatch(r"[^\W\d_]*[^\W\d_]{2}[0159@6]?[^\W\d_]*|[^\W\d_]+[0159@6][^\W\d_]{2,}|[0159@6][^\W\d_]{3,}", w) and re.search(r"[^\W\d_]{2}", w))


def broken(left: str, right: str) -> tuple[str, str]:
    """The parts next to a break, as they are looked up."""
    return re.split(r"[-‐‑]", left.lower())[-1], re.split(r"[^\w@]", right.lower())[0]


def _lines(pages: DataFrame, spans: str, *keys: str) -> DataFrame:
    text = F.transform(F.coalesce(F.col(spans), F.array()), lambda s: F.coalesce(s["text"], F.lit("")))
    return pages.select(*keys, text.alias("lines"))


def word_counts(pages: DataFrame, spans: str = "text_spans") -> DataFrame:
    """w, n: words, compounds (x-y) and pairs of neighbouring plain words (x y) over all pages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        known: dict[str, list[str]] = {}  # tokens repeat
        for pdf in batches:
            if len(known) > 300_000:
                known.clear()
            for lines in pdf["lines"]:
                for words in line_words(list(lines)):
                    before = ""
                    for t in words:
                        ps = known.get(t)
                        if ps is None:
                            ps = known[t] = [p.lower() for p in parts(t)]
                        for p in ps:
                            n[p] += 1
                        if len(ps) > 1 and "-" in t:
                            n["-".join(ps)] += 1
                        if ps and before and t.isalpha() and t.islower():
                            n[f"{before} {ps[-1]}"] += 1
                        before = ps[-1] if ps and t.isalpha() else ""
            if len(n) > 200_000:
                yield pd.DataFrame({"w": list(n), "n": list(n.values())})
                n.clear()
        if n:
            yield pd.DataFrame({"w": list(n), "n": list(n.values())})

    return _lines(pages, spans).mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def corrections(counted: DataFrame) -> DataFrame:
    """w, key, c, d, f: the lexicon words (of frequency f, at distance d) that each word may be a misreading of."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [index_keys(w) for w in pdf["w"]]
            sizes = [len(k) for k in keys]
            yield pd.DataFrame({"e": [x for k in keys for x in k], "w": np.repeat(pdf["w"].to_numpy(), sizes), "n": np.repeat(pdf["n"].to_numpy(), sizes)})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [accepted(w, n, c, f) for w, n, c, f in zip(pdf["w"], pdf["n"], pdf["c"], pdf["f"])]
            out = pdf[["w", "c", "f"]].assign(d=d, key=[_key(w) for w in pdf["w"]])
            yield out[out["d"].notna()]

    words = counted.filter((F.length("w") > 1) & ~F.col("w").contains("-") & ~F.col("w").contains(" "))
    entries = cut_lineage(words.mapInPandas(index, "e long, w string, n long"))
    sound = entries.filter(F.col("n") >= LEAST).select("e", F.col("w").alias("c"), F.col("n").alias("f"))
    pairs = entries.join(sound, "e").filter((F.col("w") != F.col("c")) & (F.col("f") >= 3 * F.col("n"))).select("w", "n", "c", "f").distinct()
    return cut_lineage(pairs.mapInPandas(verify, "w string, key long, c string, d double, f long"))


def stroke_counts(counted: DataFrame) -> DataFrame:
    """s, m: how often words and compounds of each stroke form occur."""

    @F.pandas_udf("long")
    def key(w: pd.Series) -> pd.Series:
        return w.map(lambda x: _key(strokes(x)))

    return counted.filter(~F.col("w").contains(" ")).select(key("w").alias("s"), "n").groupBy("s").agg(F.sum("n").alias("m"))


EDGE = "array<struct<no:int,text:string,head:string,num:int,sure:boolean>>"


def _ends(line: str) -> str:
    """The first and the last token of a line: what its neighbours need of it."""
    t = line.split()
    return t[0] if len(t) == 1 else f"{t[0]} {t[-1]}" if t else ""


def edges(lines: list[str], outer: int = OUTER) -> list[tuple]:
    """(place, ends, head key, number, whether the form alone numbers a page) of the outer lines and as many more."""
    full = [i for i, t in enumerate(lines) if t.strip()]
    row = []
    for i in sorted({*full[: 2 * outer], *full[-2 * outer :]}):
        near = i in full[:outer] or i in full[-outer:]
        num = page_number(lines[i]) if near else None
        head = head_key(lines[i]) if near and num is None else None
        row.append((i, _ends(lines[i]), head, num and num[0], num and num[1]))
    return row


def compact(lines: list[str], matters) -> list[str]:
    """The lines with a full stop for every token that has no part in a finding. matters: a cached test of a token."""
    out = []
    broke = False
    for t in lines:
        tokens = t.split()
        if not tokens:
            out.append("")
            continue
        mark = bool(_MARK.search(t))
        keep = [matters(x) for x in tokens]
        row = [x if keep[j] or j + 1 < len(tokens) and keep[j + 1] and x.isalpha() or j == 0 and broke or j == len(tokens) - 1 and mark else "." for j, x in enumerate(tokens)]
        out.append(" ".join(row) if any(x != "." for x in row) else ".")
        broke = mark
    return out


def _reduced(p: DataFrame, fixes: DataFrame) -> DataFrame:
    """doc_id, page_index, edges, lines: what of each page can matter."""
    mark, bits = bitmap(fixes.select("key"))
    shared = p.sparkSession.sparkContext.broadcast(mark)
    low = (1 << bits) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        seen: dict[str, bool] = {}

        def word(w: str) -> bool:
            k = _key(w) & low
            return bool(table[k >> 3] >> (k & 7) & 1) or w == "@" or odd(w)

        def matters(t: str) -> bool:
            found = seen.get(t)
            if found is None:
                if len(seen) > 300_000:
                    seen.clear()
                found = seen[t] = any(word(x.lower()) for x in parts(t))
            return found

        for pdf in batches:
            lines = [list(x) for x in pdf["lines"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page_index": pdf["page_index"], "edges": [edges(x) for x in lines], "lines": [compact(x, matters) for x in lines]})

    return p.mapInPandas(run, f"doc_id string, page_index int, edges {EDGE}, lines array<string>")


def _recurring(rows: DataFrame, key: str) -> DataFrame:
    """rows whose key stands on two pages of their document; hot documents are spread over salts."""
    twice = rows.select("doc_id", "page_index", key).distinct().groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("c")).filter("c >= 2")
    twice = twice.select("doc_id", key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod("page_index", F.lit(SALTS)).cast("int")).join(twice, ["doc_id", key, "salt"], "left_semi").drop("salt")


def _marked(reduced: DataFrame) -> DataFrame:
    """doc, page, heads, numbers, first, last: the places of running heads and page numbers, the ends of the first and last body line."""
    top = F.get(F.col("edges"), F.lit(0))["no"].alias("top")
    e = reduced.select("doc_id", "page_index", top, F.explode("edges").alias("e")).select("doc_id", "page_index", "top", "e.*")
    title = (F.col("page_index") == 0) & (F.col("no") == F.col("top"))
    found = _recurring(e.filter("head is not null").select("doc_id", "page_index", "no", "head", title.alias("title")), "head").filter("not title")
    n = e.filter("num is not null").withColumn("off", F.col("num") - F.col("page_index")).select("doc_id", "page_index", "no", "off", "sure")
    place = lambda df, k: df.select("doc_id", "page_index", "no", F.lit(k).alias("k"))
    marks = place(found, "h").unionByName(place(_recurring(n, "off"), "n")).unionByName(place(n.filter("sure"), "n")).groupBy("doc_id", "page_index").agg(
        F.collect_set(F.when(F.col("k") == "h", F.col("no"))).alias("heads"), F.collect_set(F.when(F.col("k") == "n", F.col("no"))).alias("numbers"))
    none = F.array().cast("array<int>")
    m = reduced.select("doc_id", "page_index", "edges").join(marks, ["doc_id", "page_index"], "left")
    body = F.filter("edges", lambda x: ~F.array_contains(F.coalesce("heads", none), x["no"]) & ~F.array_contains(F.coalesce("numbers", none), x["no"]))
    m = m.select("doc_id", "page_index", F.coalesce("heads", none).alias("heads"), F.coalesce("numbers", none).alias("numbers"), body.alias("b"))
    first, last = F.get(F.col("b"), F.lit(0))["text"], F.get(F.col("b"), F.size("b") - 1)["text"]
    m = cut_lineage(m.select("doc_id", "page_index", "heads", "numbers", first.alias("first"), last.alias("last")))
    one = lambda c, d: m.select("doc_id", (F.col("page_index") + d).alias("page_index"), F.col(c).alias("x" + c)).groupBy("doc_id", "page_index").agg(F.min("x" + c).alias("x" + c))
    m = m.join(one("first", -1), ["doc_id", "page_index"], "left").join(one("last", 1), ["doc_id", "page_index"], "left")
    return m.groupBy("doc_id", "page_index").agg(*[F.min(c).alias(c) for c in ("heads", "numbers", "xfirst", "xlast")])


class Wanted(Lexicon):
    """A lexicon that knows nothing and notes what it is asked for, under either answer to every question of a break."""

    def __init__(self) -> None:
        super().__init__()
        self.words: set[tuple[str, str]] = set()
        self.breaks: set[tuple[str, str]] = set()

    def repair(self, word: str, before: str = "") -> str | None:
        self.words.add((word.lower(), before))
        return None

    def joined(self, left: str, right: str) -> bool:
        self.breaks.add(broken(left, right))
        for w in (*parts(left + right), *parts(f"{left}-{right}")):
            self.words |= {(w.lower(), ""), (w.lower(), self.before)}
        return True

    before = ""


def _lookups(small: DataFrame, counted: DataFrame, fixes: DataFrame) -> DataFrame:
    """doc, page, told: per page (kind, x, y, z): misread words x after y with their repair z, breaks x and y that stay parted, known odd words x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                w = Wanted()
                page(w, list(r.lines), r.heads, r.numbers, r.xfirst, r.xlast)
                rows += [(r.doc_id, r.page_index, "w", x, y, 0, 0) for x, y in w.words]
                rows += [(r.doc_id, r.page_index, "j", x, y, _key(strokes(f"{x}-{y}")), _key(strokes(x + y))) for x, y in w.breaks]
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "k", "x", "y", "a", "b"])

    wanted = cut_lineage(small.mapInPandas(run, "doc_id string, page_index int, k string, x string, y string, a long, b long"))
    at = ["doc_id", "page_index"]
    words = wanted.filter("k = 'w'").select(*at, "x", "y")
    pairs = counted.filter(F.col("w").contains(" ")).select(F.col("w").alias("pair"), F.col("n").alias("m"))
    near = words.join(fixes, words["x"] == fixes["w"]).select(*at, "x", "y", "c", "d", "f")
    near = near.join(pairs, F.concat_ws(" ", "y", "c") == F.col("pair"), "left")
    best = F.min(F.struct(F.round("d", 3).alias("d"), (-F.ln("f") - F.log1p(F.coalesce("m", F.lit(0)))).alias("s"), "c")).alias("z")
    repaired = near.groupBy(*at, "x", "y").agg(best).select(*at, F.lit("w").alias("k"), "x", "y", F.col("z.c").alias("z"))
    rare = counted.filter((F.col("n") >= LEAST) & F.col("w").rlike("[0-9@]")).select(F.col("w").alias("x"))
    none = F.lit(None).cast("string")
    known = words.select(*at, "x").distinct().join(rare, "x", "left_semi").select(*at, F.lit("k").alias("k"), "x", none.alias("y"), none.alias("z"))
    s = stroke_counts(counted)
    asked = wanted.filter("k = 'j'").select(*at, "x", "y", F.explode(F.array(F.struct(F.lit(1).alias("w"), F.col("a").alias("s")), F.struct(F.lit(0).alias("w"), F.col("b").alias("s")))).alias("e")).select(*at, "x", "y", "e.w", "e.s")
    told = asked.join(s, "s").groupBy(*at, "x", "y").agg(F.sum(F.when(F.col("w") == 1, F.col("m")).otherwise(-F.col("m"))).alias("more"))
    parted = told.filter("more > 0").select(*at, F.lit("j").alias("k"), "x", "y", none.alias("z"))
    return repaired.unionByName(known).unionByName(parted).groupBy(*at).agg(F.collect_list(F.struct("k", "x", "y", "z")).alias("told"))


def _lexicon(told) -> Lexicon:
    lex = Lexicon()
    for r in () if told is None else told:
        if r["k"] == "w":
            lex.fixes[r["x"], r["y"]] = r["z"]
        elif r["k"] == "j":
            lex.joins[r["x"], r["y"]] = False
        else:
            lex.known.add(r["x"])
    return lex


RESULT = "doc_id string, page_index int, span_no array<int>, noise array<string>, text string"


def examine(pages: DataFrame, scanned: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, page_index, span_no, noise (arrays of one entry per finding), text (the repaired page, where asked for)."""
    counted = cut_lineage(word_counts(pages))
    fixes = corrections(counted)
    labelled = cut_lineage(scanned.select("doc_id").filter("doc_id is not null").distinct())
    p = _lines(pages, "text_spans", "doc_id", "page_index").join(broadcast_if_small(labelled, labelled.count()), "doc_id", "left_semi")
    reduced = cut_lineage(_reduced(p, fixes))
    at = ["doc_id", "page_index"]
    marked = cut_lineage(_marked(reduced))
    small = reduced.select(*at, "lines").join(marked, at, "left")
    told = _lookups(small, counted, fixes)
    whole = (p.join(marked, at, "left") if text else small).join(told, at, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [page(_lexicon(r.told), list(r.lines), r.heads, r.numbers, r.xfirst, r.xlast, r.page_index == 0) for r in pdf.itertuples()]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page_index": pdf["page_index"], "span_no": [[n for n, _ in f] for f, _ in rows],
                                "noise": [[k for _, k in f] for f, _ in rows], "text": [t if text else None for _, t in rows]})

    return whole.mapInPandas(run, RESULT)


def page(lex: Lexicon, lines: list[str], heads, numbers, after: str | None, before: str | None, first: bool = False) -> tuple[list[tuple[int, str]], str]:
    """Findings of one page and its running text. after: the next page's first body line; before: the last body line of the page before.

    A paragraph ends at a blank span, around a heading, after the title of the first page, and at a
    line that closes a sentence well before the width of the page's lines.
    """
    heads = set() if heads is None else {int(x) for x in heads}
    numbers = (set() if numbers is None else {int(x) for x in numbers}) - heads
    found = [(i, "header") for i in heads] + [(i, "page_number") for i in numbers]
    body = [i for i, t in enumerate(lines) if t.strip() and i not in heads and i not in numbers]
    out: list[list[str]] = [[]]
    cut = _breaks(lex, before, lines[body[0]]) if before and body else None
    held: tuple[str, str] | None = None if cut is None else (cut[0], "")  # a broken word still open
    skip = cut is not None and cut[2]
    last_place = -1
    width = max((len(lines[i]) for i in body), default=0)
    for k, i in enumerate(body):
        tokens = lines[i].split()
        if last_place >= 0 and held is None:
            above = lines[last_place].rstrip()
            gap = any(not lines[j].strip() for j in range(last_place + 1, i))
            title = first and k == 1 and above[-1].isalnum() and not lines[i].lstrip()[0].islower()
            if gap or title or _heading(lines[i]) or _heading(above) or above[-1] in ".!?" and len(above) < 0.8 * width:
                out.append([])
        last_place = i
        nxt = lines[body[k + 1]] if k + 1 < len(body) else after
        cut = _breaks(lex, lines[i], nxt) if nxt else None
        prev = ""
        bad = False
        for j, t in enumerate(tokens):
            if j == 0 and held is not None:  # the rest of a broken word
                left, start = held[0], held[0]
                whole, wrong = _fix(lex, left + t if skip else left + "-" + t, "")
                if wrong:
                    a = left.lower()
                    at = next((x for x, (c, d) in enumerate(zip(whole.lower(), (left + t).lower())) if c != d), len(a))
                    if at >= len(a):
                        bad = True
                if held[1] == "":  # opened on the page before: the word was given there
                    pass
                else:
                    out[-1].append(whole)
                held = None
                continue
            if j == len(tokens) - 1 and _MARK.search(lines[i]) and nxt and cut is not None:
                left, right, join = cut
                whole, wrong = _fix(lex, left + right if join else left + "-" + right, prev)
                if wrong:
                    flat = left + right if join else left + "-" + right
                    at = next((x for x, (c, d) in enumerate(zip(whole.lower(), flat.lower())) if c != d), 0)
                    bad = bad or at < len(left)
                if join:
                    found.append((i, "hyphen"))
                if k + 1 < len(body):
                    held, skip = (left, "open"), join
                else:
                    out[-1].append(whole)
                continue
            fixed, wrong = _fix(lex, t, prev)
            bad = bad or wrong
            out[-1].append(fixed)
            prev = t.lower() if t.isalpha() else ""  # as written: what is looked up does not depend on what is found
        if bad:
            found.append((i, "misread"))
    text = "\n\n".join(" ".join(p) for p in out if p)
    return sorted(found), text


def _heading(line: str) -> bool:
    return bool(re.match(r"^\d+(\.\d+)+\s+\S.{0,60}$", line.strip())) and not line.rstrip().endswith(".")


def _breaks(lex: Lexicon, line: str | None, nxt: str) -> tuple[str, str, bool] | None:
    """(left, right, joined without the mark) where line ends inside a word or a compound that nxt goes on with."""
    m = _MARK.search(line) if line else None
    if not m:
        return None
    left = line.rstrip()[:-1].split()[-1]
    first = nxt.split()[0] if nxt.split() else ""
    if not first:
        return None
    low = first[0].islower() or first[0] in "01569@" and len(first) > 1 and first[1].islower()
    soft = line.rstrip()[-1] in "¬­"
    join = bool(low and left and (left[-1].isalpha() or left[-1] in "01569@") and (soft or lex.joined(left, first)))
    if _CODE.match(left.strip("(")) and not soft:
        join = False
    return left, first, join


def _fix(lex: Lexicon, token: str, before: str) -> tuple[str, bool]:
    """The token with its misread words repaired, and whether there were any."""
    wrong = False
    for w in parts(token):
        r = lex.repair(w, before)
        if r is not None:
            shaped = r.upper() if w.isupper() and len(w) > 1 else r.capitalize() if w[0].isupper() else r
            token, wrong = token.replace(w, shaped, 1), True
    return token, wrong
