import random
from collections import Counter

import numpy as np
import pytest


from cellgrid.llm.endings import KS, Contexts, bitmap, find_cut, rates, shape, trimmed, visible


def test_shape_and_trim():
    assert shape("In 2,013.5 Kíl-Væx rose 7%") == "N 0 N rose 0%"
    assert trimmed("x 5.\nAnswer: ") == "x 5." and trimmed(" ​") == "" and trimmed("ABCDEFGHIJ KLMNOPQRSTU") == "Abcdefghij klmnopqrstu"
    assert not visible("...") and not visible(None) and visible("7")


def test_context_counts_against_brute_force():
    texts = ["The cat sat on 12 mats.", "A cat", "", "x", "The cat sat on 7"]
    c = Contexts(texts)
    for j, k in enumerate(KS):
        want = Counter()
        for t in texts:
            s = "^" * KS[0] + shape(t)
            for i in range(KS[0], len(s) + 1):
                want[s[i - k : i]] += 1
        keys, n = np.unique(c.key(k, c.places), return_counts=True)
        assert sorted(n) == sorted(want.values())
        by = dict(zip(keys.tolist(), n.tolist()))
        for t, f in zip(texts, c.finals()[:, j].tolist()):
            assert by[f] == want[("^" * KS[0] + shape(t))[-k:]]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    name = lambda: "".join(rnd.choice(["Kal", "tor", "vim", "pesk", "dran", "lu"]) for _ in range(2)).capitalize() + rnd.choice(["", " Labs", " Trust"])
    mids = [lambda: f"The committee at {name()} approved {rnd.randrange(999)} crowns for storage racks.",
            lambda: f"Visitors to {name()} pay {rnd.randrange(999)} crowns from March to June.", lambda: f"After an early frost, {name()} was left with {rnd.randrange(99)} units of idle pumps."]
    tails = [lambda: f"Answer: {rnd.randrange(999)} litres", lambda: f"In {rnd.randrange(1990, 2020)}, output came to {rnd.randrange(999)} litres.", lambda: f"- {name()}\n- {rnd.randrange(99)} units"]
    rows = []
    for i in range(4000):
        t = " ".join(rnd.choice(mids)() for _ in range(rnd.randrange(0, 4)))
        t = (t + "\n" + rnd.choice(tails)()).strip()
        if i % 10 == 0 and len(t) > 120:
            end = rnd.randrange(60, len(t) - 40)
            if t[end - 1] in ".\n " or t[end] in ".\n":
                end += 7
            rows.append((i, t[:end], "a" if i % 20 else "b", True))
        else:
            rows.append((i, t, "a", False))
    return rows


def test_held_out_accuracy(spark, corpus):
    extra = [(-1, None, "c", False), (-2, "", "c", False), (-3, " ... ", "c", False), (-4, corpus[0][1] * 3000, "c", False), (-4, corpus[1][1], "c", False)]
    df = spark.createDataFrame([(s, t, m, 1) for s, t, m, _ in corpus + extra], "seq long, text string, model_spec string, cut int")
    found = find_cut(df.drop("cut"), "text", ["seq", "model_spec"])
    got = {r.seq for r in found.filter("cut").collect()}
    want = {s for s, _, _, c in corpus if c}
    assert len(got & want) >= 0.93 * len(want) and len(got - want - {-4}) <= 0.03 * len(got)
    by = {r.model_spec: r for r in rates(found, "model_spec").collect()}
    assert by["a"].with_text + by["b"].with_text == len(corpus) and by["b"].share > by["a"].share and by["c"].with_text == 2


def test_limit_of_units_raises_the_odds(spark, corpus):
    rows = [(s, t, 64 if c else len(t) // 6) for s, t, _, c in corpus] + [(-1, "x y", None)]
    df = spark.createDataFrame(rows, "seq long, text string, units long")
    a = {r.seq: r for r in find_cut(df, "text", ["seq"]).collect()}
    b = {r.seq: r for r in find_cut(df, "text", ["seq"], units="units").collect()}
    assert set(a) == set(b) and sorted(b[0].asDict()) == sorted(a[0].asDict())
    assert {s for s, r in a.items() if r.cut} <= {s for s, r in b.items() if r.cut}


def test_bitmap_marks_every_key(spark):
    keys = [(i * 0x9E3779B97F4A7C15) % (1 << 63) for i in range(5000)]
    mark, bits = bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert all(mark[(k & ((1 << bits) - 1)) >> 3] >> (k & 7) & 1 for k in keys) and np.unpackbits(mark).sum() <= 5000


def test_empty(spark):
    df = spark.createDataFrame([], "seq long, text string")
    assert find_cut(df, "text", ["seq"]).count() == 0
