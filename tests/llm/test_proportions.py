import math
import random
from collections import Counter

from cellgrid.llm.proportions import draw

TARGETS = [("A b", "x-y", 50, 2, 20), ("C", "x-y", 30, 2, 20), ("D", "z", 20, 2, 20), ("E", "z", 0, 3, 20), ("F", "z", 0, 1, 20)]
KIND = "doc_type string, bin_label string, target_pct int, min_rows int, sample_rows long"


def rows(n):
    out = [(f"q{i}", "  a B ", "X y", f"d{i % 5}", i) for i in range(n)]
    out += [(f"q{i}", "a b", "xy", "later", i + 10**6) for i in range(n)]  # delivered again
    out += [(f"c{i}", "c", "x-y", "d", i) for i in range(4)] + [(f"e{i}", "E", "Z", "d", i) for i in range(9)]
    return out + [(f"d{i}", "D", "z", "d", i) for i in range(30)] + [("n1", None, "z", "d", 1), ("n2", "D", " ", "d", 1), (None, "D", "z", "d", 1)]


def brute(have):
    """Seats by the divisor method, one at a time."""
    cats = [(a.lower().replace(" ", "").replace("-", ""), b.replace("-", ""), p, m) for a, b, p, m, _ in TARGETS]
    seats = {c[:2]: min(c[3], have[c[:2]]) for c in cats}
    rest = sorted(((k - 0.5) / p, a, b) for a, b, p, m in cats if p for k in range(m + 1, have[a, b] + 1))
    for _, a, b in rest[: max(0, 20 - sum(seats.values()))]:
        seats[a, b] += 1
    return seats


def test_draw(spark):
    q = spark.createDataFrame(rows(40), "question_id string, doc_type string, bin_label string, doc_id string, t long")
    t = spark.createDataFrame(TARGETS, KIND)
    sample, report = draw(q, t, "question_id", "t", ["doc_type", "bin_label"], ["doc_id"], slices=4)
    got = sample.collect()
    have = Counter({("ab", "xy"): 40, ("c", "xy"): 4, ("d", "z"): 30, ("e", "z"): 9, ("f", "z"): 0})
    want = brute(have)
    assert Counter((r.doc_type, r.bin_label) for r in got) == Counter({(a, b): want[a.lower().replace(" ", ""), b.replace("-", "")] for a, b, *_ in TARGETS if want[a.lower().replace(" ", ""), b.replace("-", "")]})
    assert len({r.question_id for r in got}) == len(got) and all(r.doc_id != "later" for r in got)
    for c in {r.doc_type for r in got}:
        assert sorted(r.place for r in got if r.doc_type == c) == list(range(1, 1 + sum(r.doc_type == c for r in got)))
    rep = {r.doc_type: r for r in report.collect()}
    assert (rep["C"].available, rep["C"].seats, rep["C"].short) == (4, 4, 2) and rep["F"].short == 1 and rep["A b"].short == 0
    assert rep["A b"].wanted == max(2, math.ceil(0.5 * 20))


def test_seats_against_listing_every_row(spark):
    rnd = random.Random(1)
    for total, minima in ((17, (0, 2, 1, 5)), (60, (3, 0, 0, 0)), (3, (2, 2, 2, 2)), (1000, (0, 0, 0, 1)), (24, (0, 0, 0, 0))):
        cats = [(f"c{i}", w, m, a) for i, (w, m, a) in enumerate(zip((10, 20, 20, 50), minima, (40, 3, 30, 12)))]
        q = spark.createDataFrame([(f"{n}-{k}", n, "z", "d", rnd.randrange(9)) for n, _, _, a in cats for k in range(a)], "question_id string, doc_type string, bin_label string, doc_id string, t long")
        t = spark.createDataFrame([(n, "z", w, m, total) for n, w, m, _ in cats], KIND)
        sample, report = draw(q, t, "question_id", "t", ["doc_type", "bin_label"], ["doc_id", "t"], slices=3)
        want = {n: min(m, a) for n, _, m, a in cats}
        rest = sorted(((k - 0.5) / w, n) for n, w, m, a in cats for k in range(min(m, a) + 1, a + 1))
        for _, n in rest[: max(0, total - sum(want.values()))]:
            want[n] += 1
        got = sample.collect()
        assert Counter(r.doc_type for r in got) == Counter(want) == Counter({r.doc_type: r.seats for r in report.collect()}), (total, minima)
        assert all(r.priority == (r.place - 0.5) / dict((n, w) for n, w, _, _ in cats)[r.doc_type] for r in got)


def test_empty_tables(spark):
    q = spark.createDataFrame([], "question_id string, doc_type string, bin_label string, doc_id string, t long")
    t = spark.createDataFrame(TARGETS, KIND)
    sample, report = draw(q, t, "question_id", "t", ["doc_type", "bin_label"], ["doc_id"])
    assert sample.count() == 0 and report.filter("available = 0 and seats = 0").count() == 5
    sample, report = draw(q, t.limit(0), "question_id", "t", ["doc_type", "bin_label"], ["doc_id"])
    assert sample.count() == 0 and report.count() == 0
