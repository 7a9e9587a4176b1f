import math
import random

from cellgrid.operators.percentiles import exact_percentiles, merged_percentiles, summarize

QS = (0.5, 0.9, 0.99)


def brute(values, q):
    s = sorted(values)
    return s[max(1, math.ceil(round(q * 1000) * len(s) / 1000)) - 1]


def rows():
    rnd = random.Random(3)
    out = [("a", "d%d" % (i % 3), rnd.lognormvariate(0, 3)) for i in range(3000)]
    out += [(None, "d0", 5.0)] * 7 + [("b", "d1", 1e300), ("b", "d1", 1e-300), ("b", "d2", 1.0), ("b", "d2", 1.0)]
    out += [("a", "d0", None), ("a", "d0", float("nan")), ("a", "d0", float("inf")), ("a", "d0", -1.0), ("c", "d0", 0.0)]
    return out


def good(v):
    return v is not None and 0 < v < math.inf


def test_exact_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "g string, day string, x double")
    got = {r.g: r for r in exact_percentiles(df, ["g"], ["x"], QS, parts=16).collect()}
    by = {}
    for g, _, v in rows():
        if good(v):
            by.setdefault(g, []).append(v)
    assert set(got) == set(by)
    for g, v in by.items():
        assert (got[g].n, got[g].p50, got[g].p90, got[g].p99) == (len(v), *[brute(v, q) for q in QS])


def test_merged_within_the_error(spark):
    df = spark.createDataFrame(rows(), "g string, day string, x double")
    s = summarize(df, "day", ["g"], ["x"], error=0.01)
    for days in (["d0"], ["d0", "d2"], ["d0", "d1", "d2"]):
        got = {r.g: r for r in merged_percentiles(s.filter(s.day.isin(days)), ["g"], QS, error=0.01).collect()}
        v = [x for g, d, x in rows() if g == "a" and d in days and good(x)]
        for q, name in zip(QS, ("p50", "p90", "p99")):
            assert abs(math.log(got["a"][name] / brute(v, q))) <= math.log1p(0.01) + 1e-9


def test_many_magnitudes_end_soon(spark):
    rows = [("g", 10.0**k) for k in range(-300, 300, 3)] + [("g", 5e-324), ("g", 1.7e308)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = exact_percentiles(df, ["g"], ["x"], QS).first()
    assert (got.p50, got.p99) == (brute([v for _, v in rows], 0.5), brute([v for _, v in rows], 0.99))


def test_empty(spark):
    df = spark.createDataFrame([], "g string, day string, x double")
    assert exact_percentiles(df, ["g"], ["x"]).count() == 0
    assert merged_percentiles(summarize(df, "day", ["g"], ["x"]), ["g"]).count() == 0
