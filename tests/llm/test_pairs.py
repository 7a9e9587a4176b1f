import numpy as np
import pandas as pd
import pytest

from cellgrid.llm.languages import SAMPLES, sampled
from cellgrid.llm.pairs import AFTER, DENSE, LABELS, REFUSALS, Features, find_defects, fit, refusal, restated, training_rows

rnd = np.random.default_rng(3)
NAMES = ["Kaltor", "Vimpesk", "Dranlu", "Peskvim", "Torkal", "Ludran"]
pick = lambda xs: xs[int(rnd.integers(len(xs)))]


def question(lang):
    n, y = pick(NAMES), int(rnd.integers(1990, 2020))
    return {"en": f"What was the output reported by {n} Works in {y} according to the table?", "de": f"Welchen Wert nennt {n} laut Tabelle im Jahr {y} für die Menge?",
            "fr": f"Quelle valeur {n} a-t-elle relevée pour la récolte en {y}?"}[lang]


def answer(lang):
    n, v = pick(NAMES), int(rnd.integers(1, 999))
    return {"en": pick([f"{v} litres", f"According to the report, the output of {n} came to {v} litres.", f"The committee at {n} approved the budget of {v} crowns in March.\nAnswer: {v} litres"]),
            "de": f"Laut Seite 3 betrug die Menge von {n} genau {v} Liter.", "fr": f"Selon la page 3, la récolte de {n} était de {v} litres."}[lang]


def committees():
    return " ".join(f"The committee at {pick(NAMES)} approved the budget of {int(rnd.integers(999))} crowns in March." for _ in range(4))


def rows(n):
    out = []
    for i in range(n):
        l = pick(["en", "en", "en", "de", "fr"])
        q, kind = question(l), pick([None] * 6 + ["empty", "refusal", "copy", "other_language", "right"] + ["truncated"] * (i % 4 == 0))
        t, u = answer(l), False
        if kind is None and l == "en":
            t = committees() + "\n" + t
        if kind == "empty":
            t = pick([None, "", " ", "...", "Answer:"])
        elif kind == "refusal":
            t = refusal(rnd, l)
        elif kind == "copy":
            t = restated(rnd, q)
        elif kind == "other_language":
            t = answer("fr" if l != "fr" else "en")
            if not sampled().language(t):
                kind = None
                t = answer(l)
        elif kind == "truncated":
            t = committees()
            t = t[: int(rnd.integers(100, len(t) - 30))]
            t = t[: t.rindex(".")] + ". The committee at" if t[-1] in ". " else t
            q, l = question("en"), "en"
        elif kind == "right":
            t, u, kind = refusal(rnd, l), True, None
        out.append((i, q, t, u, kind))
    return out


def found(spark, data, **kw):
    df = spark.createDataFrame([(r[0], f"q{r[0]}", *r[1:4], 1) for r in data], "seq long, question_id string, question string, text string, is_unanswerable boolean, defect int")
    asked = df.select("question_id", "question").distinct()
    whole = df.select("question").filter("question is not null")
    return {r.seq: r.defect for r in find_defects(df.drop("question"), asked, complete=whole, **kw).collect()}


def test_held_out_f1(spark):
    data = rows(3000)
    extra = [(90000, None, None, None, "empty"), (90001, None, "5 litres", None, None), (90002, question("en"), answer("en") * 2000, False, None)]
    # languages that the training rows do not hold
    said = {"it": "Secondo la pagina 3 il raccolto di mele di quella zona era di 45 tonnellate.", "pt": "Segundo a página 3 a colheita de maçãs daquela zona foi de 45 toneladas.",
            "nl": "Volgens bladzijde 3 was de oogst van appels in die streek gelijk aan 45 ton.", "zh": "根据第3页，那个地区的苹果收成是45吨。"}
    asks = {"it": "Quale era secondo la tabella il valore del raccolto di mele in questa zona?", "zh": "根据表格，这个地区的苹果收成是多少？"}
    for i, (k, t) in enumerate(said.items()):
        extra.append((91000 + i, question("en"), t, False, "other_language"))
        if k in asks:
            extra += [(92000 + i, asks[k], t, False, None), (93000 + i, asks[k], answer("en") + " The committee at Kaltor approved the budget in March.", False, "other_language")]
    got = found(spark, data + extra, train_rows=2000)
    want = {r[0]: r[4] for r in data + extra if r[4]}
    for k in ("empty", "copy", "refusal", "other_language", "truncated"):
        a, b = {s for s, d in got.items() if d == k}, {s for s, d in want.items() if d == k}
        assert 2 * len(a & b) / (len(a) + len(b)) > 0.9, (k, len(a), len(b), len(a & b))
    assert got[90000] == "empty" and 90001 not in got
    assert [(r[0], got.get(r[0])) for r in extra if r[0] >= 91000 and got.get(r[0]) != r[4]] == []


def test_empty_and_repeated(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, "What is it?", None, None), (1, "What is it?", "", True), (2, "What is it?", "42", None)]) == {1: "empty"}


def test_training_makes_every_defect():
    s = pd.DataFrame([(r[1], r[2], r[3]) for r in rows(800)], columns=["question", "text", "is_unanswerable"])
    _, ts, y, groups = training_rows(s, sampled())
    assert set(np.nonzero(y.sum(axis=0))[0]) == {0, 1, 2, 3} and len(groups) == len(y) == len(ts)
    assert all(t[-1] not in ".!?" for t, x in zip(ts, y) if x[LABELS.index("truncated")])
    assert all(refusal(rnd, l) for l in REFUSALS) and set(REFUSALS) <= set(SAMPLES)


def test_classifier_learns_a_rule():
    ts = [("blue " if i % 3 == 0 else "red ") * 3 + str(i) for i in range(900)]
    flat, stops, dense = Features(sampled())(["what"] * 900, ts)
    assert len(stops) == 901 and stops[-1] == len(flat) and not dense[:, DENSE - AFTER :].any()
    y = np.zeros((900, len(LABELS)))
    y[::3, 0] = 1
    c = fit(flat, stops, dense, y, np.arange(900), rounds=5)
    assert c.held_out["copy"] == pytest.approx(1.0)
