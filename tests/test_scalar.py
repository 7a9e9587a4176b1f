import hashlib
import math
import json
import random

import pytest
from pyspark.sql import functions as F

from cellgrid.functions import scalar as S


def one(spark, expr, **cols):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<int>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in cols.items()) or "x int"
    return spark.createDataFrame([tuple(cols.values()) or (1,)], schema).select(expr.alias("r")).first().r


LISTS = [(None, []), ("", []), ("nan", []), ("None", []), ("[]", []), ("[5]", ["5"]), ("['1', '3']", ["1", "3"]), ('["a"]', ["a"]), ("Chart", ["Chart"]), ("[broken", ["[broken"])]


def test_lists_and_pages(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LISTS)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", S.parse_list(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(LISTS))] == [w for _, w in LISTS]
    pages = S.zero_based_pages(F.col("t"))
    assert one(spark, pages, t="[5, 1, 5, 'x', 0]") == [4, 0] and one(spark, S.zero_based_pages(F.col("t"), 0), t="[5, 0]") == [5, 0]
    assert [one(spark, S.hop_of(F.col("p")), p=p) for p in ([], [1], [1, 2])] == ["none", "single", "multi"]
    assert one(spark, S.page_count_required(F.col("p")), p=[3, 7]) == 8


def test_conditions(spark):
    c = F.col("c")
    assert one(spark, S.base_condition(c), c="a__b__c") == "a" and one(spark, S.prompt_mode(c), c="a__b__c") == "b__c"
    assert one(spark, S.prompt_mode(c), c="plain") == "" and one(spark, S.mode_or_condition(c), c="plain") == "plain"
    m, k = S.retrieval_parts(c)
    for text, want in (("retrieved_bm25_k3", ("text", 3)), ("similarity_colqwen2_k12", ("vision", 12)), ("retrieved_joint_k1", ("joint", 1)), ("oracle", ("", None)), ("xretrieved_text_k1", ("", None))):
        assert (one(spark, m, c=text), one(spark, k, c=text)) == want


@pytest.mark.parametrize("base,want", [
    ("pageset:r=bm25:g=keep_top-1:d=0", ("bm25", "keep_top", 1, 0, "xpx")), ("pageset:r=bm25:g=all:d=3:p=xpo", ("bm25", "all", 0, 3, "xpo")),
    ("pageset:r=bm25:g=all", None), ("pageset:r=b m:g=all:d=1", None), ("pageset:r=x:g=keep_top:d=1", None), ("pageset:r=x:g=all:d=1:p=zzz", None), ("oracle", None)])
def test_pageset_codec(spark, base, want):
    p = S.pageset_parts(F.col("b"))
    r = spark.createDataFrame([(base,)], "b string").select(*[c.alias(k) for k, c in p.items()]).first()
    assert (tuple(r) if r.ranker else None) == want
    if want:
        again = S.encode_pageset(*[F.lit(x) for x in want])
        assert one(spark, again) == base


def test_skip_reasons(spark):
    p = S.pageset_parts(F.col("b"))
    for base, n, want in (("pageset:r=x:g=drop_top-1:d=0", 1, "too few to drop"), ("pageset:r=x:g=drop_top-1:d=0", 2, None), ("pageset:r=x:g=all:d=1", 0, "no gold"),
                          ("pageset:r=x:g=all:d=1:p=xpo", 0, None), ("pageset:r=x:g=keep_top-2:d=0", 1, "too few to keep"), ("pageset:r=x:g=keep_top-2:d=0:p=kpx", 1, None)):
        assert one(spark, S.pageset_skip_reason(p, F.col("n")), b=base, n=n) == want


def test_answers(spark):
    t = F.col("t")
    assert one(spark, S.is_abstention(t), t="It is  NOT\nanswerable.") is True and one(spark, S.is_abstention(t), t=None) is False
    assert one(spark, S.final_answer(t), t="Answer: draft\nmore\nAnswer: final ") == "final" and one(spark, S.final_answer(t), t="none") == "none"
    v = S.verdict(t, F.lit(False), F.lit("x"))
    assert one(spark, v["correct"], t='```{"correct": true}```') is True and one(spark, v["correct"], t="no json") is False
    assert one(spark, S.verdict(t, F.lit(True), F.lit("not answerable"))["correct"], t="{}") is True
    assert one(spark, S.agreement_label(t), t=" Right ") == "correct" and one(spark, S.agreement_label(t), t="maybe") is None
    b = S.parse_bin(t)
    assert [one(spark, b["confidence"], t=x) for x in ("text-dominant", "it is visual-dominant!", "mixed", "?")] == [1.0, 0.8, 0.6, 0.0]
    assert one(spark, S.preview(t, 10), t="a  b\n" + "c" * 20) == "a b ccccc…" and one(spark, S.leading_number(t), t="56.8 [50-60]") == 56.8


def test_key_is_python_json(spark):
    d = {"condition": "c__x", "doc_id": 'd"1', "model_spec": "m", "page_indices": [1, 22], "question_id": "q", "representation": "T", "visual_resolution": ""}
    want = hashlib.sha256(json.dumps(d, sort_keys=True).encode()).hexdigest()
    got = one(spark, S.prediction_key(F.lit("c__x"), F.lit('d"1'), F.lit("m"), F.col("p"), F.lit("q"), F.lit("T"), F.lit("")), p=[1, 22])
    assert got == want


def test_numbers(spark):
    t = F.col("t")
    assert [one(spark, S.memory_mib(t), t=x) for x in ("512", "4G", "1T", "2048K")] == [512.0, 4096.0, 1048576.0, 2.0]
    assert one(spark, S.gres_count(t), t="gpu:v100:2(S:0)") == 2 and one(spark, S.gres_count(t), t="none") == 0
    assert one(spark, S.wait_text(F.col("n")), n=93784) == "1d 02:03:04" and one(spark, S.wait_text(F.col("n")), n=59) == "00:00:59"
    assert one(spark, S.wait_text(F.col("n")), n=-5) == "00:00:00"
    assert S.cap_tokens(960 * 28 * 28) == 961 and one(spark, S.visual_tokens(F.lit(29), F.lit(28))) == 2


def best_sizes(width, height, cap):
    """Brute force: whole patches no larger than the scaled image; what one patch at least overdraws is taken from the other side."""
    f = min(1.0, math.sqrt(cap / (width * height)))
    a, b = max(1, math.floor(width * f / 28)), max(1, math.floor(height * f / 28))
    fits = [(x, y) for x in range(1, a + 1) for y in range(1, b + 1) if x * y * 784 <= cap and (x == a or y == b)]
    x, y = max(fits, key=lambda s: s[0] * s[1])
    return x * 28, y * 28


def test_capped_size_against_brute_force(spark):
    rnd = random.Random(4)
    cases = [(1200, 1800, 250880), (56, 56, 10**6), (237, 3198, 5000), (4981, 22, 5000), (3, 4, 784), (20000, 10, 2352), (0, 5, 784), (-3, 9, 784)]
    cases += [(rnd.randrange(1, 900), rnd.randrange(1, 900), rnd.choice([784, 1568, 5000, 60000, 10**6])) for _ in range(300)]
    df = spark.createDataFrame(cases, "w int, h int, cap int")
    for cap in {c for _, _, c in cases}:
        for r in df.filter(F.col("cap") == cap).select("w", "h", S.capped_size(F.col("w"), F.col("h"), cap).alias("s")).collect():
            if r.w <= 0 or r.h <= 0:
                assert r.s is None
            else:
                assert tuple(r.s) == best_sizes(r.w, r.h, cap) and r.s[0] * r.s[1] <= cap, (r, cap)
    w, h = one(spark, S.capped_size(F.lit(1200), F.lit(1800), 250880))
    assert abs(w / h - 2 / 3) < 0.05
    with pytest.raises(ValueError):
        S.capped_size(F.lit(1), F.lit(1), 783)


def test_lists_of_literals(spark):
    cases = {"['a', None]": ["a", None], "[1, 2.0, True]": ["1", "2.0", "True"], "['None', \"it's True\", null]": ["None", "it's True", None], "['a',]": ["a"], "[False]": ["False"], "['a', b": ["['a', b"], "[]": [], "None": []}
    for t, want in cases.items():
        assert one(spark, S.parse_list(F.col("t")), t=t) == want, t


def test_draws_follow_the_seeded_generator():
    for n, rounds, seed in ((5, 3, 0), (1, 2, 0), (135, 20, 0), (922, 3, 7), (1024, 2, 1)):
        rnd = random.Random(seed)
        want = [[0] * n for _ in range(rounds)]
        for b in range(rounds):
            for _ in range(n):
                want[b][rnd.choice(range(n))] += 1
        assert S.draw_counts(n, rounds, seed).tolist() == want
    items = list("abcdefg")
    random.Random(3).shuffle(items)
    order = S.shuffle_order(7, 3)
    assert [items[order[i]] for i in range(7)] == list("abcdefg")
