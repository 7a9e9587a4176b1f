"""Broken prompt and response pairs.

A multi-label linear classifier over hashed word n-grams of the response and dense features
of the pair: the share of the question repeated, content that the question lacks, the
languages of both sides (see languages), and how the response ends (see endings). It is
trained on responses that finished and hold an answer, and on defects made from them: cut
at a random place inside a sentence, replaced by the question, paired with a question of
another language, replaced by a refusal (the responses without content to questions known
to be unanswerable, and a small grammar). The threshold of each label is the one of the
best F1 on held-out rows; a question and all that was made from its responses stand on one
side of that split.

The training rows are a bounded sample: about TRAIN rows, those under a bound of a hash of
their key; the classifier, whose size is fixed, is sent with the tasks. The model of
endings and the one of languages are trained on all rows. Prediction is one join of the
responses with the questions and one vectorised pass; what the linear classifier makes of
the ending is added after the join with the odds of its tail, so no text is written or
shuffled again.

Defined results: rows whose status is neither ok nor null are left out; a null question (or
none) can only give the defects that need no question; empty comes before all other
defects, then copy, truncated, refusal, other_language; one row per response at most;
repeated responses are judged alike; refusals of unanswerable questions are no defect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .endings import attach, cut_flags, describe, is_cut, prepare, thresholds, visible
from .languages import NAMES, SAMPLES, Languages, sampled
from .lookalike import slices

#: Labelled rows that the classifier is fitted on, about.
TRAIN = 20_000
DIM = 1 << 16
LABELS = ("copy", "truncated", "refusal", "other_language")
#: A label before a response: up to five words and a colon.
_LEAD = re.compile(r"^\W*(?:[^\W_]+[ \t]?){1,5}:\s*")
_LABELS = re.compile(r"(?m)^[^\w\n]*(?:[^\W_]+[ \t]?){1,3}:")
_QUOTED = re.compile(r'["“«„»][^"”»“«]{0,200}["”»“«]')
_TOKEN = re.compile(r"\d[\d.,]*|[぀-ヿ一-鿿]|[^\W\d_぀-ヿ一-鿿]+(?:['’][^\W\d_]+)*|[^\W_]")
_POINTS = str.maketrans("", "", ".,'’")

# A small grammar of refusals in each language: openings, closings, whole phrases.
REFUSALS = {
    "en": (["I cannot say", "We are unable to answer", "I can't determine it", "It is impossible to tell"], ["from what is shown", "with this material", "because nothing is said about it", ""],
           ["No answer", "There is no such information", "The pages are silent on this point", "Sorry, I have to decline", "Not stated", "I don't know"]),
    "de": (["Ich kann das nicht sagen", "Wir wissen es nicht", "Das ist nicht zu ermitteln"], ["mit diesem Material", "weil nichts dazu dasteht", ""], ["Keine Antwort möglich", "Darüber steht nichts im Text", "Ich muss leider ablehnen"]),
    "fr": (["Je ne sais pas", "Nous ne pouvons pas le dire", "Il est impossible de le savoir"], ["avec ces éléments", "car rien n'est dit à ce sujet", ""], ["Aucune réponse", "Le texte n'en parle pas", "Je dois refuser"]),
    "es": (["No lo sé", "No podemos decirlo", "Es imposible saberlo"], ["con este material", "porque no se dice nada al respecto", ""], ["Ninguna respuesta", "El texto no habla de ello", "Debo negarme"]),
    "it": (["Non lo so", "Non possiamo dirlo", "È impossibile saperlo"], ["con questo materiale", ""], ["Nessuna risposta", "Il testo non ne parla"]),
    "pt": (["Não sei dizer", "Não podemos responder", "É impossível saber"], ["com este material", ""], ["Nenhuma resposta", "O texto não fala disso"]),
    "nl": (["Ik kan dat niet zeggen", "Wij weten het niet", "Dat is niet te bepalen"], ["met dit materiaal", ""], ["Geen antwoord", "De tekst zegt er niets over"]),
    "pl": (["Nie wiem", "Nie możemy tego powiedzieć"], ["na podstawie tego materiału", ""], ["Brak odpowiedzi", "Tekst o tym nie mówi"]),
    "ru": (["Я не знаю", "Мы не можем этого сказать", "Это невозможно установить"], ["по этим материалам", ""], ["Ответа нет", "В тексте об этом ничего нет", "Вынужден отказаться"]),
    "el": (["Δεν ξέρω", "Δεν μπορούμε να το πούμε"], ["με αυτό το υλικό", ""], ["Καμία απάντηση", "Το κείμενο δεν λέει τίποτα για αυτό"]),
    "ja": (["これは分かりません", "お答えできません"], ["この資料では", ""], ["該当する情報はありません", "答えは示されていません"]),
    "zh": (["无法回答", "我不知道"], [""], ["没有相关信息", "文中没有提到"]),
}


def refusal(rnd: np.random.Generator, lang: str) -> str:
    heads, places, whole = REFUSALS.get(lang) or REFUSALS["en"]
    pick = lambda xs: xs[int(rnd.integers(len(xs)))]
    t = pick(whole) if rnd.random() < 0.4 else f"{pick(heads)} {pick(places)}".strip()
    return pick(["", "", "", "Answer: "]) + t + pick([".", ".", "", "!"])


def restated(rnd: np.random.Generator, question: str, lead: str = "") -> str:
    """A response that only repeats the question, after words that answer nothing."""
    pick = lambda xs: xs[int(rnd.integers(len(xs)))]
    q = question.strip()
    q = pick([q, q, q.upper(), q.lower(), q.rstrip("?.") + pick(["", ".", "!"]), q.replace(" ", "  "), re.sub(r"[^\w\s]", "", q), f"{q} {q}", f'"{q}"'])
    return (lead and lead + pick([": ", ". ", ", "])) + q + pick(["", "", "\nAnswer:", "\n", "..."])


def _flat(text: str) -> list[str]:
    return [w if w.isalpha() else w.translate(_POINTS) for w in _TOKEN.findall(text.lower())]


def said(text: str) -> str:
    """The response as its language is judged: labels and quoted titles left out."""
    return _LABELS.sub(" ", _QUOTED.sub(" ", text))


#: Dense features; the last AFTER of them are those of the ending: cut, closed, odds.
DENSE, AFTER = 23, 3


class Features:
    """Hashed n-grams and dense features of pairs, but for those of the ending."""

    def __init__(self, lang: Languages) -> None:
        self.lang = lang
        self.ids: dict[str, tuple[str, bool, bool, int]] = {}

    def _token(self, raw: str) -> tuple[str, bool, bool, int]:
        """word, whether it is a figure, whether it is capitalised, id."""
        t = self.ids.get(raw)
        if t is None:
            if len(self.ids) > 300_000:
                self.ids.clear()
            w = raw.lower() if raw.isalpha() else raw.lower().translate(_POINTS)
            figure = w[:1].isdigit()
            t = self.ids[raw] = w, figure, raw[0].isupper(), xxhash.xxh64_intdigest("#" if figure else w) & 0x7FFFFFFFFFFFFFFF
        return t

    def __call__(self, questions: list[str], texts: list[str], told: tuple[list[str], np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashed ids, their offsets, dense matrix). told: what the texts were judged as, where that is known."""
        n = len(texts)
        rows, ids, sizes = [], [], []
        one, seen = self._token, self.ids.get
        distinct = [*dict.fromkeys(questions)]
        qlang, qscore, _ = self.lang.judge(distinct)
        asked = {q: (frozenset(_flat(q)), l, k) for q, l, k in zip(distinct, qlang, qscore.argmax(axis=1).tolist())}
        tlang, tscore, letters = told or self.lang.judge(texts)
        tlang, tscore, letters = list(tlang), tscore.copy(), letters.copy()
        other = [i for i, (q, l) in enumerate(zip(questions, tlang)) if l and l != asked[q][1]]
        if other:  # without labels and titles
            again, scores, left = self.lang.judge([said(texts[i]) for i in other])
            tscore[other], letters[other] = scores, left
            for i, l in zip(other, again):
                tlang[i] = l
        top = tscore.max(axis=1) if n else np.zeros(0)
        for i, (q, t) in enumerate(zip(questions, texts)):
            aset, lq, kq = asked[q]
            lt = tlang[i]
            head = t[:60]
            body = _LEAD.sub("", t, 1) if ":" in head else t
            ids.append(2)
            words = []
            numbers = names = novel = 0
            shows = False
            for r in _TOKEN.findall(body):
                w, figure, upper, h = seen(r) or one(r)
                words.append(w)
                if w:
                    ids.append(h)
                shows |= figure
                if w not in aset:
                    novel += 1
                    numbers += figure
                    names += upper
            ids.append(3)
            if names and body.isupper():
                names = 0
            tset = set(words)
            cover = len(aset & tset) / len(aset) if aset else 0.0
            differ = bool(lq and lt and lq != lt)
            gap = min((top[i] - tscore[i, kq]) / (letters[i] + 10), 1.0) if lq else 0.0
            k = len(words)
            rows.append((1.0, cover, novel, min(numbers, 3) / 3, min(names, 5) / 5, novel / max(k, 1), differ, bool(lt), shows, k, cover >= 0.95,
                         cover >= 0.95 and not numbers and names <= 2, numbers > 0, k == 0, k <= 3, k > 40, differ and k > 3, gap, gap * differ, differ and letters[i] >= 30))
            sizes.append(len(ids))
        d = np.zeros((n, DENSE))
        if n:
            m = np.array(rows, float)
            d[:, : DENSE - AFTER] = m
            d[:, 2], d[:, 9] = np.minimum(np.log1p(m[:, 2]), 5) / 5, np.minimum(np.log1p(m[:, 9]), 5) / 5
        a = np.array(ids, np.uint64)
        stops = np.concatenate([[0], sizes]).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(stops))
        with np.errstate(over="ignore"):
            two = a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:]
            three = two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + a[2:]
        in2, in3 = row[:-1] == row[1:], row[:-2] == row[2:]
        h = np.concatenate([a * np.uint64(3), two[in2], three[in3]])
        at = np.concatenate([row, row[:-1][in2], row[:-2][in3]])
        order = np.argsort(at, kind="stable")
        h = h[order]
        flat = ((h ^ (h >> np.uint64(31))) % np.uint64(DIM)).astype(np.int64)
        return flat, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int64), d


@dataclass
class Classifier:
    """One weight vector per label; probabilities over thresholds are findings."""

    hashed: np.ndarray
    dense: np.ndarray
    limits: np.ndarray
    held_out: dict[str, float] = field(default_factory=dict)

    def values(self, flat: np.ndarray, stops: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The linear value of each label; what the ending adds comes on top where it is not in dense."""
        n = np.maximum(np.diff(stops), 1)
        out = np.zeros((len(dense), len(LABELS)))
        for k in range(len(LABELS)):
            sums = np.concatenate([[0.0], np.cumsum(self.hashed[k][flat])])
            out[:, k] = (sums[stops[1:]] - sums[stops[:-1]]) / np.sqrt(n) + dense @ self.dense[k]
        return out

    def bound(self, k: int) -> float:
        """The linear value that the threshold of a label stands for."""
        return float(np.log(self.limits[k] / (1 - self.limits[k])))


def fit(flat: np.ndarray, stops: np.ndarray, dense: np.ndarray, y: np.ndarray, groups: np.ndarray, seed: int = 1, rounds: int = 20) -> Classifier:
    """Logistic regression per label (adaptive gradient steps on mini-batches), thresholds by F1 on the fifth of the groups that is held out."""
    rnd = np.random.default_rng(seed)
    n = len(dense)
    order = rnd.permutation(n)
    names = np.unique(groups)
    out = np.isin(groups[order], rnd.permutation(names)[: len(names) // 5])
    held, train = order[out], order[~out]
    K = len(LABELS)
    wh, wd = np.zeros((K, DIM)), np.zeros((K, DENSE))
    gh, gd = np.full((K, DIM), 1e-4), np.full((K, DENSE), 1e-4)
    size = np.maximum(np.diff(stops), 1)
    # the batches keep their rows, so what each of them touches is worked out once
    batches = []
    for b in range(0, len(train), 512):
        at = train[b : b + 512]
        slots, inv = np.unique(np.concatenate([flat[stops[i] : stops[i + 1]] for i in at]), return_inverse=True)
        row = np.repeat(np.arange(len(at)), np.diff(stops)[at])
        batches.append((at, slots, inv, row, 1 / np.sqrt(size[at])))
    for _ in range(rounds):
        for b in rnd.permutation(len(batches)):
            at, slots, inv, row, scale = batches[b]
            for k in range(K):
                z = np.bincount(row, wh[k][slots][inv], minlength=len(at)) * scale + dense[at] @ wd[k]
                e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at, k]
                g = np.bincount(inv, (e * scale)[row], minlength=len(slots)) / len(at)
                gh[k][slots] += g**2
                wh[k][slots] -= 0.15 * g / np.sqrt(gh[k][slots])
                d = dense[at].T @ e / len(at) + 1e-5 * wd[k]
                gd[k] += d**2
                wd[k] -= 0.15 * d / np.sqrt(gd[k])
    c = Classifier(wh, wd, np.full(K, 0.5))
    fl = np.concatenate([flat[stops[i] : stops[i + 1]] for i in held]) if len(held) else flat[:0]
    st = np.concatenate([[0], np.cumsum(np.diff(stops)[held])])
    p = 1 / (1 + np.exp(-np.clip(c.values(fl, st, dense[held]), -30, 30)))
    for k, name in enumerate(LABELS):
        best = max(np.linspace(0.1, 0.95, 18), key=lambda t: (_f1(p[:, k] >= t, y[held, k] > 0), -abs(t - 0.5)))
        c.limits[k] = best
        c.held_out[name] = float(_f1(p[:, k] >= best, y[held, k] > 0))
    return c


def _f1(got: np.ndarray, want: np.ndarray) -> float:
    hit = int((got & want).sum())
    return 2 * hit / max(int(got.sum() + want.sum()), 1)


def _inside(t: str, end: int) -> bool:
    """Whether a text that ends before this place ends inside a sentence."""
    return t[end - 1] not in ".!?。！？\n" and t[end - 1 : end + 1].strip() != "" and t[end] not in ".!?。！？\n" and t[:end].rstrip()[-1:] not in ".!?:\n"


def training_rows(sample: pd.DataFrame, lang: Languages, seed: int = 1) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(questions, responses, labels, the number of the question that each was made from) from rows question, text, is_unanswerable."""
    rnd = np.random.default_rng(seed)
    s = sample[np.array([isinstance(q, str) and visible(t) for q, t in zip(sample["question"], sample["text"])], bool)].reset_index(drop=True)
    langs = lang.judge(s["question"].tolist())[0]
    spoken = lang.judge([said(t) for t in s["text"]])[0]
    numbers = {q: i for i, q in enumerate(dict.fromkeys(s["question"]))}
    by: dict[str, list[int]] = {}
    for i, l in enumerate(langs):
        by.setdefault(l, []).append(i)
    # words that answer nothing, to stand before a repeated question
    idle = [w for t in s["text"][:2000] for w in t.split() if w.isalpha() and w.islower()] or ["so"]
    pick = lambda xs: xs[int(rnd.integers(len(xs)))]
    qs, ts, ys, groups = [], [], [], []

    def add(i: int, q: str, t: str, *labels: str) -> None:
        qs.append(q)
        ts.append(t)
        ys.append([float(k in labels) for k in LABELS])
        groups.append(numbers[s["question"][i]])

    for i, (q, t, u) in enumerate(zip(s["question"], s["text"], s["is_unanswerable"])):
        l, lt = langs[i], spoken[i]
        digits = any(c.isdigit() for c in t)
        flat, asked = set(_flat(t)), set(_flat(q))
        repeats = sum(w in flat for w in asked) > 0.9 * len(asked)
        differs = bool(l and lt and l != lt)
        if u is True:
            plain = any(w.islower() for w in t.split()[1:]) or t.isupper() or not any(w[:1].isupper() for w in t.split()[1:])
            if not digits and not repeats and len(t) < 220 and len(flat) > 1 and plain:
                add(i, q, t, "refusal", *(["other_language"] if differs else []))
            continue
        if not (digits or len(flat) <= 3) or repeats or differs:
            continue
        add(i, q, t)
        a = rnd.random()
        if a < 0.2 and len(t) > 80:
            end = int(rnd.integers(40, len(t) - 10))
            if _inside(t, end):
                add(i, q, t[:end], "truncated")
        elif a < 0.4:
            at = int(rnd.integers(len(idle)))
            lead = " ".join(idle[at : at + int(rnd.integers(1, 7))]).capitalize() if rnd.random() < 0.6 else ""
            add(i, q, restated(rnd, q, lead), "copy")
        elif a < 0.5:
            add(i, q, f"{q} {t}")  # repeats the question and answers it
        elif a < 0.65:
            k = l if l in REFUSALS and rnd.random() < 0.7 else pick([*REFUSALS])
            add(i, q, refusal(rnd, k), "refusal", *(["other_language"] if l and k != l else []))
        elif a < 0.75:
            add(i, q, f"{t} {refusal(rnd, l)}")  # an answer with a caveat
        elif a < 0.9:
            others = [k for k in by if k and k != lt]
            if lt and others:
                add(i, s["question"][pick(by[pick(others)])], t, "other_language")
        elif l:
            k = pick([x for x in NAMES if x != l])
            say = pick([x for x in re.split(r"(?<=[.。?])\s*", SAMPLES[k]) if x])
            add(i, q, f"{say} {pick(t.split())}" if digits else say, "other_language")
    return qs, ts, np.array(ys).reshape(-1, len(LABELS)), np.array(groups, np.int64)


def train(rows: tuple[list[str], list[str], np.ndarray, np.ndarray], ends: pd.DataFrame, limits: dict[str, float], lang: Languages) -> Classifier:
    """The classifier from its training rows and how they end."""
    qs, ts, y, groups = rows
    cut = cut_flags(ends, limits)
    # what the ending model calls cut among sound responses is not known to be sound: it has no label and is left out
    keep = np.nonzero((y.sum(axis=1) > 0) | ~cut)[0]
    flat, stops, dense = Features(lang)([qs[i] for i in keep], [ts[i] for i in keep])
    dense[:, DENSE - AFTER :] = np.stack([cut, ends["closed"], np.clip(ends["odds"].astype(float), -3, 3) / 3], axis=1)[keep]
    return fit(flat, stops, dense, y[keep], groups[keep])


EMPTY_LABEL = re.compile(r"^\W*(?:final )?answer\W*$", re.IGNORECASE)


def find_defects(
    rows: DataFrame, asked: DataFrame, link: str = "question_id", key: str = "seq", values: DataFrame | None = None, complete: DataFrame | None = None,
    lang: Languages | None = None, train_rows: int = TRAIN,
) -> DataFrame:
    """key, defect. rows: key, link, text, is_unanswerable of finished rows; asked: link (unique), question.

    values: the table whose texts the ending model counts (default: rows); complete: see endings.
    """
    lang = lang or sampled()
    spark = rows.sparkSession
    asked = cut_lineage(asked.select(link, "question"))
    told = broadcast_if_small(asked, asked.count())
    part = min(1.0, train_rows / max(rows.count(), 1))
    chosen = rows.filter(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < int(part * (1 << 30))).filter("text is not null")
    chosen = chosen.join(told, link).filter("question is not null").select(key, "question", "text", "is_unanswerable")
    # the bound of the sample; a hash gives more than twice what was asked for only where keys repeat
    sample = chosen.limit(2 * train_rows).toPandas().sort_values(key, kind="stable").reset_index(drop=True)
    sample["is_unanswerable"] = [x is True or x is np.True_ for x in sample["is_unanswerable"]]
    made = training_rows(sample, lang)
    first, odds, ends = prepare(rows, "text", [], complete, lang, values, made[1])
    limits = thresholds(attach(first, odds))
    c = train(made, ends, limits, lang)
    shared = spark.sparkContext.broadcast((c, lang))
    kind = rows.schema[key].dataType.simpleString()
    z = [f"z{k}" for k in range(len(LABELS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, speech = shared.value
        f = Features(speech)
        for pdf in batches:
            ts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            qs = [q if isinstance(q, str) else "" for q in pdf["question"]]
            for a, b in slices(ts):
                told = speech.judge(ts[a:b])
                d, _, _ = describe(ts[a:b], speech, told)
                v = model.values(*f(qs[a:b], ts[a:b], told))
                empty = [not visible(t) or bool(EMPTY_LABEL.match(t)) for t in ts[a:b]]
                part = pd.DataFrame({key: pdf[key].iloc[a:b].to_numpy(), "known": [bool(q) for q in qs[a:b]], "right": [x is True or x is np.True_ for x in pdf["is_unanswerable"].iloc[a:b]], "empty": empty})
                yield pd.concat([part, d, pd.DataFrame(v, columns=z)], axis=1)

    judged = rows.select(key, link, "text", "is_unanswerable").join(told, link, "left").mapInPandas(
        run, f"`{key}` {kind}, known boolean, right boolean, empty boolean, has_text boolean, closed boolean, figure boolean, lang string, tail long, " + ", ".join(f"{x} double" for x in z)
    )
    judged = attach(judged, odds).withColumn("cut", is_cut(limits))
    ending = (F.col("cut").cast("double"), F.col("closed").cast("double"), F.least(F.greatest("odds", F.lit(-3.0)), F.lit(3.0)) / 3)
    is_ = [F.col(z[k]) + sum(float(w) * e for w, e in zip(c.dense[k][DENSE - AFTER :], ending)) >= c.bound(k) for k in range(len(LABELS))]
    defect = (
        F.when(F.col("empty"), "empty").when(is_[0] & F.col("known"), "copy").when(is_[1], "truncated")
        .when(is_[2], F.when(~F.col("right"), "refusal")).when(is_[3] & F.col("known"), "other_language")
    )
    return judged.select(key, defect.alias("defect")).filter("defect is not null")
