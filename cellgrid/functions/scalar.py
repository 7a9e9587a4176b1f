"""Column expressions for single values: labels, conditions, answers, tokens, sizes."""

from __future__ import annotations

import json
import random
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The study's vocabulary.
RUNGS = ("T", "TL", "TLV", "TLVi", "V")
MODES = ("none", "generic", "grounded", "targeted", "abstain", "abstain_balanced", "cot", "extract_cot")
MODE_RANK = {"none": 0, "generic": 1, "grounded": 1, "targeted": 2, "abstain": 2, "abstain_balanced": 3, "cot": 4, "extract_cot": 5}
RESOLUTIONS = ("low", "med", "high")
QUANTS = ("4bit", "8bit", "16bit")
BINS = ("text-dominant", "mixed-modality", "visual-dominant")
DOC_TYPES = (
    "Academic paper", "Administration/Industry file", "Brochure", "Financial report", "Guidebook",
    "Research report / Introduction", "Tutorial/Workshop",
)
UNKNOWN = "(unknown)"
# Forms that count as abstention.
ABSTENTIONS = (
    "not answerable", "cannot be answered", "can not be answered", "cannot answer", "unanswerable", "insufficient information",
    "not enough information", "no answer", "unknown from the document", "not mentioned", "not provided",
)
PIXEL_CAPS = {"high": 960 * 28 * 28, "med": 640 * 28 * 28, "low": 400 * 28 * 28}
_SPACES = r"[\s\p{Z}]+"


def rank_of(c: Column, order: Sequence[str], other: int = 99) -> Column:
    """The place of a value in a fixed order."""
    out = F.lit(other)
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, i).otherwise(out)
    return out


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def blank_to(c: Column, other: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)


def clean(c: Column) -> Column:
    """NaN as null."""
    return F.when(F.isnan(c), None).otherwise(c)


# -- lists and pages ------------------------------------------------------------------


def parse_list(c: Column) -> Column:
    """array<string> of a dirty list field: a list in brackets (JSON or literals), one scalar, or nothing.

    None and null members are null; True and False keep their names; numbers stay as written.
    """
    t = F.trim(c)
    bits = F.regexp_extract_all(t, F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+|['"]"""), F.lit(0))
    # names of literals outside quotes
    plain = lambda b: F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"\bNone\b", "null"), r"\b(True|False)\b", '"$1"'), r",\s*\]$", "]")
    told = F.array_join(F.transform(bits, lambda b: F.when((F.length(b) > 1) & b.rlike("^['\"]"), b).otherwise(plain(b))), "")
    items = F.from_json(told, "array<string>", {"allowSingleQuotes": "true"})
    none = c.isNull() | F.lower(t).isin("", "none", "nan", "null")
    whole = F.when(t.startswith("[") & items.isNotNull(), items).otherwise(F.array(t))
    return F.when(none, F.array().cast("array<string>")).otherwise(whole)


def zero_based_pages(c: Column, first: int = 1) -> Column:
    """array<int> of page indices from page numbers that count from `first`; first occurrences, no bad items."""
    numbers = F.transform(parse_list(c), lambda x: F.trim(x).try_cast("int"))
    return F.array_distinct(F.transform(F.filter(numbers, lambda x: x.isNotNull()), lambda x: F.greatest(x - first, F.lit(0))))


def hop_of(pages: Column) -> Column:
    n = F.size(F.coalesce(pages, F.array()))
    return F.when(n == 0, "none").when(n == 1, "single").otherwise("multi")


def page_count_required(pages: Column) -> Column:
    return F.coalesce(F.array_max(pages), F.lit(-1)) + 1


def is_not_answerable(answer: Column) -> Column:
    return F.coalesce(casefold(F.trim(answer)) == "not answerable", F.lit(False))


# -- conditions -----------------------------------------------------------------------


def base_condition(c: Column) -> Column:
    return F.get(F.split(c, "__", 2), F.lit(0))


def prompt_mode(c: Column) -> Column:
    return F.coalesce(F.get(F.split(c, "__", 2), F.lit(1)), F.lit(""))


def mode_or_condition(c: Column) -> Column:
    return F.when(prompt_mode(c) == "", c).otherwise(prompt_mode(c))


RETRIEVED = r"^(retrieved|similarity)_(text|vision|joint|bm25|bge|colqwen\w*)_k(\d+)"


def retrieval_parts(c: Column) -> tuple[Column, Column]:
    """(modality, k) of a retrieval condition; ('', null) for others."""
    token = F.regexp_extract(c, RETRIEVED, 2)
    modality = F.when(token.isin("text", "bm25", "bge"), "text").when(token == "joint", "joint").when(token == "", "").otherwise("vision")
    k = F.regexp_extract(c, RETRIEVED, 3)
    return modality, F.when(k == "", None).otherwise(k.cast("int"))


PAGESET = r"^pageset:r=([A-Za-z0-9.\-]+):g=(all|(?:keep|drop)_(?:top|bottom)-\d+):d=(\d+)(?::p=([xk][px][xo]))?$"


def pageset_parts(base: Column) -> dict[str, Column]:
    """ranker, gold_mode, gold_count, distractors, policies of a page-set rule; nulls for other bases."""
    ok = base.rlike(PAGESET)
    gold = F.regexp_extract(base, PAGESET, 2)
    policies = F.regexp_extract(base, PAGESET, 4)
    pick = lambda v: F.when(ok, v)
    return {
        "ranker": pick(F.regexp_extract(base, PAGESET, 1)),
        "gold_mode": pick(F.when(gold == "all", "all").otherwise(F.regexp_extract(gold, r"^(.*)-\d+$", 1))),
        "gold_count": pick(F.when(gold == "all", 0).otherwise(F.regexp_extract(gold, r"-(\d+)$", 1).try_cast("int"))),
        "distractors": pick(F.regexp_extract(base, PAGESET, 3).try_cast("int")),
        "policies": pick(F.when(policies == "", "xpx").otherwise(policies)),
    }


def encode_pageset(ranker: Column, mode: Column, count: Column, distractors: Column, policies: Column) -> Column:
    gold = F.when(mode == "all", "all").otherwise(F.concat_ws("-", mode, count.cast("string")))
    tail = F.when(policies == "xpx", "").otherwise(F.concat(F.lit(":p="), policies))
    return F.concat(F.lit("pageset:r="), ranker, F.lit(":g="), gold, F.lit(":d="), distractors.cast("string"), tail)


def pageset_skip_reason(parts: dict[str, Column], gold: Column) -> Column:
    """Why a (rule, question) pair makes no cell; null where it does."""
    mode, count, pol = parts["gold_mode"], parts["gold_count"], parts["policies"]
    strict = (gold > 0) & (mode != "all") & (F.substring(pol, 1, 1) == "x")
    return (
        F.when((gold == 0) & (F.substring(pol, 3, 1) == "x"), "no gold")
        .when(strict & mode.startswith("keep_") & (gold < count), "too few to keep")
        .when(strict & mode.startswith("drop_") & (gold <= count), "too few to drop")
    )


def quant_of(spec: Column) -> Column:
    return F.when(spec.endswith("-4bit"), "4bit").when(spec.endswith("-8bit"), "8bit").otherwise("16bit")


def base_spec(spec: Column) -> Column:
    return F.regexp_replace(spec, "-(4|8)bit$", "")


def spec_parts(spec: Column) -> dict[str, Column]:
    """family, size, backend, quant of a model spec."""
    p = r"^([^-]+)-([^-]+)-([^-]+)(?:-(4bit|8bit))?$"
    return {n: F.regexp_extract(spec, p, i + 1) for i, n in enumerate(("family", "size", "backend", "quant"))}


def pages_bucket(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")


def gold_bucket(n: Column) -> Column:
    return F.when(n <= 0, "").when(n <= 3, n.cast("string")).when(n <= 5, "4-5").otherwise("6+")


def gold_bucket3(n: Column) -> Column:
    return F.when(n <= 0, "").when(n <= 2, n.cast("string")).otherwise("3+")


# -- answers --------------------------------------------------------------------------


def is_abstention(text: Column) -> Column:
    flat = F.regexp_replace(F.trim(casefold(F.coalesce(text, F.lit("")))), _SPACES, " ")
    out = F.lit(False)
    for form in ABSTENTIONS:
        out = out | flat.contains(form)
    return out


def final_answer(text: Column, delimiter: str = "Answer:") -> Column:
    return F.when(text.contains(delimiter), F.trim(F.regexp_replace(F.substring_index(text, delimiter, -1), r"^\s+|\s+$", ""))).otherwise(text)


def stub_correct(text: Column, gold: Column, unanswerable: Column, abstained: Column) -> Column:
    g = casefold(F.trim(F.coalesce(gold, F.lit(""))))
    hit = (g != "") & casefold(F.coalesce(text, F.lit(""))).contains(g) & ~abstained
    return F.when(F.coalesce(unanswerable, F.lit(False)), abstained).otherwise(hit)


def verdict(response: Column, unanswerable: Column, text: Column) -> Column:
    """struct(abstained, correct, score) of a judge's answer that holds one JSON object."""
    body = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    v = F.from_json(body, "correct boolean, abstained boolean, score double")
    abstained = F.coalesce(v["abstained"], F.lit(False)) | is_abstention(text)
    correct = F.when(unanswerable & abstained, True).otherwise(F.coalesce(v["correct"], F.lit(False)))
    return F.struct(abstained.alias("abstained"), correct.alias("correct"), F.coalesce(v["score"], correct.cast("double")).alias("score"))


def agreement_label(c: Column) -> Column:
    """correct, incorrect or abstained of a free label; null for an unknown one."""
    k = F.trim(F.regexp_replace(F.replace(casefold(F.trim(c)), F.lit("_"), F.lit(" ")), r"\s+", " "))
    return (
        F.when(k.isin("correct", "right", "yes"), "correct").when(k.isin("incorrect", "wrong", "no"), "incorrect")
        .when(k.isin("abstained", "abstain", "refusal"), "abstained")
    )


def parse_bin(answer: Column, fallback: str = "mixed-modality") -> Column:
    """struct(bin, confidence): exact 1, contained .8, alias .6, else the fallback with 0."""
    k = F.trim(casefold(answer))
    out = F.struct(F.lit(fallback).alias("bin"), F.lit(0.0).alias("confidence"))
    for words, label in reversed((("text", BINS[0]), ("mixed", BINS[1]), ("visual", BINS[2]))):
        out = F.when(k.contains(words), F.struct(F.lit(label).alias("bin"), F.lit(0.6).alias("confidence"))).otherwise(out)
    for label in reversed(BINS):
        out = F.when(k.contains(label), F.struct(F.lit(label).alias("bin"), F.lit(0.8).alias("confidence"))).otherwise(out)
    for label in reversed(BINS):
        out = F.when(k == label, F.struct(F.lit(label).alias("bin"), F.lit(1.0).alias("confidence"))).otherwise(out)
    return out


def failure_kind(message: Column) -> Column:
    return F.when(F.lower(message).contains("out of memory"), "oom").otherwise("error")


def reason_line(message: Column, chars: int = 100) -> Column:
    return F.substring(F.trim(F.substring_index(message, "\n", 1)), 1, chars)


def preview(text: Column, chars: int = 160) -> Column:
    t = F.trim(F.regexp_replace(text, _SPACES, " "))
    return F.when(F.length(t) > chars, F.concat(F.rtrim(F.substring(t, 1, chars - 1)), F.lit("…"))).otherwise(t)


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


def leading_number(cell: Column) -> Column:
    return F.regexp_extract(F.trim(cell), r"^[+-]?\d+(\.\d+)?", 0).try_cast("double")


# -- keys -----------------------------------------------------------------------------


def python_json(pairs: list[tuple[str, Column]]) -> Column:
    """The text of a JSON object with ', ' and ': ', keys in the given order; ASCII string values."""
    bits: list[Column] = []
    for i, (k, v) in enumerate(pairs):
        bits += [F.lit(("{" if i == 0 else ", ") + json.dumps(k) + ": "), v]
    return F.concat(*bits, F.lit("}"))


def _quoted(c: Column) -> Column:
    escaped = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def prediction_key(condition: Column, doc: Column, spec: Column, pages: Column, question: Column, rung: Column, resolution: Column, judge: Column | None = None) -> Column:
    """SHA-256 of the identity, the keys sorted."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "), F.lit("]"))
    pairs = [("condition", _quoted(condition)), ("doc_id", _quoted(doc))]
    pairs += [("judge_spec", _quoted(judge))] if judge is not None else []
    pairs += [("model_spec", _quoted(spec)), ("page_indices", listed), ("question_id", _quoted(question)), ("representation", _quoted(rung)), ("visual_resolution", _quoted(resolution))]
    return F.sha2(python_json(pairs), 256)


# -- tokens, images, scheduler values ---------------------------------------------------


def visual_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    return F.greatest(F.ceil(width / patch) * F.ceil(height / patch), F.lit(1)).cast("long")


def cap_tokens(pixels: int, patch: int = 28) -> int:
    """Tokens of a square image with so many pixels."""
    side = -(-int(pixels**0.5) // patch)
    return max(side * side, 1)


def capped_size(width: Column, height: Column, cap: int, patch: int = 28) -> Column:
    """struct(width, height): the size in whole patches that an image is shown at under a pixel cap; null for sizes that are not positive.

    Both sides are scaled alike, never up, and cut to whole patches, one at least. Only where
    a side was lifted to one patch can the cap be passed; the other side then takes what the
    budget of patches leaves.
    """
    if cap < patch * patch:
        raise ValueError(f"the cap must allow one patch of {patch * patch} pixels")
    budget = cap // (patch * patch)
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(cap)) / (width * height)))
    side = lambda x: F.greatest(F.floor(x * scale / patch), F.lit(1)).cast("long")
    fit = lambda a, b: F.least(a, F.greatest(F.floor(F.lit(budget) / b), F.lit(1)).cast("long"))
    w, h = side(width), side(height)
    size = F.struct((F.when(w >= h, fit(w, h)).otherwise(w) * patch).alias("width"), (F.when(h > w, fit(h, w)).otherwise(h) * patch).alias("height"))
    return F.when((width > 0) & (height > 0), size)


def grid_tokens(grid: Column) -> Column:
    """Sum over image grids of t*h*w."""
    each = F.transform(grid, lambda g: g[0] * g[1] * g[2])
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)


def text_tokens(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.greatest(F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))), F.lit(1))


def memory_mib(c: Column) -> Column:
    """MiB of a size such as 4000M, 16G, 1T; plain numbers are MiB."""
    n = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(c, r"([KMGTPkmgtp])", 1))
    return n * F.when(unit == "K", 1 / 1024).when(unit == "G", 1024.0).when(unit == "T", 1024.0**2).when(unit == "P", 1024.0**3).otherwise(1.0)


def gres_count(c: Column) -> Column:
    """Number of devices of gpu:type:n or gpu:n."""
    parts = F.split(F.regexp_replace(c, r"\(.*\)$", ""), ":")
    return F.coalesce(F.element_at(parts, -1).try_cast("int"), F.lit(0))


def wait_text(seconds: Column) -> Column:
    """1d 02:03:04, days only where there are any; less than nothing counts as nothing, null stays null."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    clock = F.format_string("%02d:%02d:%02d", F.floor(s % 86400 / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(seconds.isNotNull(), F.when(s >= 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d "), clock)).otherwise(clock))


def gres_kind(c: Column) -> Column:
    """The device type of gpu:type:n, in lower case; null where none is named or n is no number."""
    parts = F.split(c, ":")
    return F.when((F.size(parts) >= 3) & F.element_at(parts, -1).try_cast("int").isNotNull(), F.lower(parts[1]))


def offset_minutes(c: Column) -> Column:
    """Minutes east of UTC of an offset such as +0800; null for others."""
    p = r"^\s*([+-])(\d{2})(\d{2})\s*$"
    part = lambda i: F.regexp_extract(c, p, i).try_cast("int")
    return F.when(c.rlike(p), F.when(F.regexp_extract(c, p, 1) == "-", -1).otherwise(1) * (part(2) * 60 + part(3)))


def arm_and_k(base: Column, arms: Sequence[str] = ("text", "vision", "joint")) -> tuple[Column, Column]:
    """(arm, k) of a retrieved_<arm>_k<k> condition; '' and 0 where there is none."""
    arm = F.lit("")
    for a in reversed(arms):
        arm = F.when(base.startswith(f"retrieved_{a}_"), a).otherwise(arm)
    k = F.regexp_extract(base, r"_k(\d+)$", 1)
    return arm, F.coalesce(k.try_cast("int"), F.lit(0))


# -- seeded draws -----------------------------------------------------------------------


def draws(n: int, rounds: int, seed: int) -> Iterator[np.ndarray]:
    """The n * rounds places that Python's seeded choice() draws from n places, in order, in pieces of about a million.

    choice() takes the upper bits of successive 32-bit outputs and skips those out of range;
    the same stream is read here as arrays.
    """
    _, state, _ = random.Random(seed).getstate()
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint64), "pos": state[-1]}}
    shift, left = np.uint64(32 - n.bit_length()), n * rounds
    while left:
        raw = words.random_raw(min(1 << 20, max(1024, int(left * 1.2)))) >> shift
        raw = raw[raw < n][:left].astype(np.int64)
        left -= len(raw)
        if len(raw):
            yield raw


def draw_counts(n: int, rounds: int, seed: int) -> np.ndarray:
    """rounds x n: how often each of n places is drawn in each round of n draws by Python's seeded choice()."""
    places = np.concatenate(list(draws(n, rounds, seed)))
    return np.bincount(np.repeat(np.arange(rounds), n) * n + places, minlength=n * rounds).reshape(rounds, n)


def shuffle_order(n: int, seed: int) -> list[int]:
    """The place that each of n items takes after a seeded shuffle."""
    items = list(range(n))
    random.Random(seed).shuffle(items)
    place = [0] * n
    for p, i in enumerate(items):
        place[i] = p
    return place


def shuffled_first(n: int, seed: int, k: int) -> array:
    """The items at the first k places of n items after a seeded shuffle."""
    items = array("i", range(n))
    random.Random(seed).shuffle(items)
    return items[: max(k, 0)]
