import random

from pyspark.sql import functions as F

from cellgrid.operators import facts, grid, pageset, profile, represent, retrieval, stats


def test_best_rows_and_statuses(spark):
    rows = [(1, "q", "error"), (2, "q", "ok"), (3, "q", "ok"), (4, "r", None), (5, "s", "oom"), (6, "s", "error")]
    df = spark.createDataFrame([(s, q, "d", "c", "T", "m", "", st) for s, q, st in rows], "seq long, question_id string, doc_id string, condition string, representation string, model_spec string, visual_resolution string, status string")
    assert sorted(r.seq for r in facts.ok_rows(df).collect()) == [2, 4]
    assert tuple(facts.status_counts(df, ["model_spec"]).first())[1:] == (3, 2, 1, 0)
    rep = facts.generation_report(df.withColumn("run_tag", F.lit("x")).withColumn("provenance", F.lit("y"))).collect()
    assert {(r.run_tag, r.cells) for r in rep} == {("x", 3), (None, 3)}
    assert facts.ok_rows(df.limit(0)).count() == 0


def test_merge_resume_primary_fallback(spark):
    a = spark.createDataFrame([("k1", "ok", 1), ("k2", "error", 2), ("k3", "oom", 3)], "prediction_key string, status string, seq int")
    b = spark.createDataFrame([("k1", "error", 9), ("k2", "ok", 8), ("k4", "ok", 7)], "prediction_key string, status string, seq int")
    assert sorted(map(tuple, facts.merge_failed(a, b).collect())) == [("k1", "ok", 1), ("k2", "ok", 8), ("k3", "oom", 3)]
    assert [r.prediction_key for r in facts.missing_cells(a, b).collect()] == ["k3"]
    s = spark.createDataFrame([(1, "x", "c"), (2, "y", "c"), (3, "y", "c")], "seq int, model_spec string, base string")
    assert facts.primary_spec(s, "zz").count() == 2 and facts.primary_spec(s, "x").count() == 1
    assert facts.for_base(s, "c").count() == 3 and facts.for_base(s, "none").count() == 3


def brute_bootstrap(docs, rounds, seed):
    rnd = random.Random(seed)
    ids, means = sorted(docs), []
    for _ in range(rounds):
        v = [x for _ in ids for x in docs[rnd.choice(ids)]]
        means.append(sum(v) / len(v))
    means.sort()

    def q(p):
        at = p * (len(means) - 1)
        lo = int(at)
        return means[lo] + (means[min(lo + 1, len(means) - 1)] - means[lo]) * (at - lo)

    return q(0.025), q(0.975)


def test_bootstrap_against_python(spark):
    rnd = random.Random(4)
    docs = {f"d{i:02d}": [float(rnd.random() < 0.6) for _ in range(rnd.randrange(1, 6))] for i in range(12)}
    rows = [("g", d, v == 1.0) for d, vs in docs.items() for v in vs] + [("solo", "d", True)]
    df = spark.createDataFrame(rows, "g string, doc_id string, correct boolean")
    got = {r.g: r for r in stats.bootstrap(df, ["g"], rounds=200).collect()}
    lo, hi = brute_bootstrap(docs, 200, 0)
    assert abs(got["g"].ci_low - lo) < 1e-12 and abs(got["g"].ci_high - hi) < 1e-12
    assert got["solo"].ci_low == got["solo"].accuracy == 1.0
    wide = {r.g: r for r in stats.bootstrap(df, ["g"], rounds=400, max_docs=5).collect()}["g"]
    assert abs(wide.ci_low - lo) < 0.12 and abs(wide.ci_high - hi) < 0.12


def test_bootstrap_takes_the_seeded_draws_at_any_size(spark):
    rnd = random.Random(5)
    docs = {f"d{i:05d}": [float(rnd.random() < 0.6) for _ in range(rnd.randrange(1, 4))] for i in range(2500)}
    df = spark.createDataFrame([(g, d, v == 1.0) for g in "gh" for d, vs in docs.items() for v in vs if g == "g" or d < "d00012"], "g string, doc_id string, correct boolean")
    for rounds, max_docs in ((30, 2000), (500, 5)):
        got = {r.g: r for r in stats.bootstrap(df, ["g"], rounds=rounds, max_docs=max_docs).collect()}
        for g, own in (("g", docs), ("h", {d: v for d, v in docs.items() if d < "d00012"})):
            lo, hi = brute_bootstrap(own, rounds, 0)
            assert abs(got[g].ci_low - lo) < 1e-12 and abs(got[g].ci_high - hi) < 1e-12


def test_frontier(spark):
    cells = [("g", "T", 0.5, 0.6), ("g", "TL", 0.58, 0.7), ("g", "TLV", 0.7, 0.75), ("g", "V", 0.72, 0.8), ("h", "T", 0.7, 0.71), ("h", "V", 0.71, 0.75)]
    df = spark.createDataFrame(cells, "g string, representation string, accuracy double, ci_high double")
    assert {r.g: r.rung for r in stats.frontier(df, ["g"]).collect()} == {"g": "TL", "h": "T"}


def test_kappa_and_transitions(spark):
    df = spark.createDataFrame([("a", "a")] * 4 + [("a", "b"), ("b", "b"), (None, "a")], "x string, y string")
    k = stats.kappa(df, "x", "y").first()
    assert k.n == 6 and abs(k.kappa - (5 / 6 - (5 * 4 + 1 * 2) / 36) / (1 - (5 * 4 + 1 * 2) / 36)) < 1e-12
    rows = [(1, "q1", "T", False, ["s"]), (2, "q1", "TL", True, ["s"]), (3, "q2", "T", True, []), (4, "q2", "TL", True, []), (5, "q2", "TL", False, [])]
    d = spark.createDataFrame(rows, "seq int, question_id string, representation string, correct boolean, evidence_sources array<string>")
    t = {(r.group): r for r in stats.transitions(d, (("T", "TL"),), explode="evidence_sources").collect()}
    assert t["s"].wrong_right == 1 and t["(none)"].right_wrong == 1 and t["(all)"].n == 2


def test_page_rules(spark):
    ranking, gold = [5, 1, 2, 0, 7, 3, 6, 4], [2, 5, 7]
    def rule(mode, count, d, pol="xpx", g=gold):
        out = pageset.by_rule(F.col("r"), F.col("g"), F.lit(mode), F.lit(count), F.lit(d), F.lit(pol))
        return spark.createDataFrame([(ranking, g)], "r array<int>, g array<int>").select(*[c.alias(k) for k, c in out.items()]).first()
    assert rule("keep_top", 1, 0).pages == [5] and rule("keep_bottom", 1, 0).pages == [7] and rule("drop_top", 1, 0).pages == [2, 7]
    assert rule("drop_bottom", 1, 0).pages == [2, 5] and rule("all", 0, 0).pages == [2, 5, 7] and rule("all", 0, 2).pages == [0, 1, 2, 5, 7]
    r = rule("all", 0, 6)
    assert r.pages == list(range(8)) and r.note == "d_actual=5"
    assert rule("all", 0, 3, "xpo", []).pages == [1, 2, 5] and rule("all", 0, 3, "xpx", []).status == "error"
    assert rule("drop_top", 3, 0).status == "error" and rule("drop_top", 3, 0, "kpx").pages == [2, 5, 7] and rule("all", 0, 6, "xxx").status == "error"


def test_page_scores_and_rankings(spark):
    def prf(a, b):
        c = retrieval.page_prf(F.col("a"), F.col("b"))
        return tuple(spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(*[v.alias(k) for k, v in c.items()]).first())
    assert prf([], []) == (1, 1, 1) and prf([], [1]) == (0, 0, 0) and prf([1], []) == (0, 0, 0) and prf([1, 2], [2, 3]) == (0.5, 0.5, 0.5)
    r = spark.createDataFrame([([3, 9, 1],)], "g array<int>").select(retrieval.oracle_ranking(F.col("g"), F.lit(5)).alias("r")).first().r
    assert r == [3, 1, 0, 2, 4]


def test_bm25_against_python(spark):
    import math
    import re

    pages = [("d", 0, "The crop yield of Wörk"), ("d", 1, "yield yield and CROP"), ("d", 2, ""), ("e", 0, "other")]
    q = [("q1", "d", "crop yield yield?"), ("q2", "e", "nothing")]
    p = spark.createDataFrame(pages, "doc_id string, page int, text string")
    got = {(r.query_id, r.page): (r.score, r.rank) for r in retrieval.ranked(retrieval.bm25(retrieval.postings(p), spark.createDataFrame(q, "query_id string, doc_id string, text string"))).collect()}
    toks = [re.findall("[a-z0-9]+", t.lower()) for d, _, t in pages if d == "d"]
    avg = sum(map(len, toks)) / 3
    for i, t in enumerate(toks):
        s = 0
        for w in ["crop", "yield", "yield"]:
            df, tf = sum(w in x for x in toks), t.count(w)
            s += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        assert abs(got["q1", i][0] - round(s, 6)) < 1e-6
    assert got["q1", 1][1] == 1 and got["q2", 0] == (0.0, 1)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0, 5.0], [], [[1.0, 0.0], [0.0, 1.0]], [[2.0, 3.0], [1.0, 4.0]])], "a array<double>, b array<double>, z array<double>, m array<array<double>>, n array<array<double>>")
    r = df.select(retrieval.cosine(F.col("a"), F.col("b")).alias("ab"), retrieval.cosine(F.col("a"), F.col("z")).alias("az"), retrieval.max_sim(F.col("m"), F.col("n")).alias("mn")).first()
    assert (r.ab, r.az, r.mn) == (1.0, 0.0, 6.0)
    s = spark.createDataFrame([("q", 0, 2.0), ("q", 1, float("nan")), ("q", 2, 4.0), ("c", 0, 3.0)], "query_id string, page int, score double")
    assert {(r.query_id, r.page): r.score for r in retrieval.normalized(s).collect()} == {("q", 0): 0.5, ("q", 1): 0.0, ("q", 2): 1.0, ("c", 0): 0.0}


def test_draw_is_whole_documents(spark):
    rows = [(f"q{i:02d}", f"d{i // 3}", "g" if i < 24 else "small") for i in range(27)]
    df = spark.createDataFrame(rows, "question_id string, doc_id string, grp string")
    got = grid.coherent_draw(df, "grp", 7).collect()
    big = [r for r in got if r.grp == "g"]
    assert len(big) == 9 and all(sum(r.doc_id == d for r in big) == 3 for d in {r.doc_id for r in big}) and sum(r.grp == "small" for r in got) == 3
    order = list(range(8))
    random.Random(0).shuffle(order)
    assert {r.doc_id for r in big} == {f"d{i}" for i in order[:3]}
    assert sum(r.grp == "g" for r in grid.coherent_draw(df, "grp", 7, cap=True).collect()) == 7
    hashed = [r for r in grid.coherent_draw(df.withColumn("grp", F.lit(None).cast("string")), "grp", 7, shuffled=2).collect()]
    assert len(hashed) == 9 and all(sum(r.doc_id == d for r in hashed) == 3 for d in {r.doc_id for r in hashed})


def test_representation(spark):
    df = spark.createDataFrame([(["a", " "], ["m1", "m2"], ["i1", "i2"], [0, 4])], "t array<string>, m array<string>, i array<string>, p array<int>")
    get = lambda rung: [tuple(x) for x in df.select(represent.payload(F.lit(rung), *map(F.col, "tmip")).alias("r")).first().r]
    assert get("T") == [("text", "[text]\na")] and get("V") == [("image", "i1"), ("image", "i2")]
    assert get("TLVi") == [("text", "[page 1]\nm1"), ("image", "i1"), ("text", "[page 5]\nm2"), ("image", "i2")] and len(get("TLV")) == 3


def test_profile(spark):
    q = spark.createDataFrame([("q1", "d", ["a", "a"]), ("q2", "d", []), ("q3", "e", ["a"])], "question_id string, doc_id string, v array<string>")
    assert {(r.c, r.questions, r.docs) for r in profile.class_breakdown(q, F.col("v"), "c").collect()} == {("a", 2, 2), ("(none)", 1, 1)}
    s = spark.createDataFrame([("x; y|z",), ("",)], "m string")
    assert profile.invalid_labels(s, "m", ("x", "y"), multi=True).select("bad").collect()[0].bad == "z"
    t = spark.createDataFrame([("m", "lin.weight", [4, 8]), ("m", "embed.weight", [4, 2]), ("m", "bias", [3])], "model string, name string, shape array<int>")
    assert profile.weight_bytes(t, 8).first().bytes == 32 + 16 + 6


def test_oracle_ranking_keeps_questions_of_many_pages(spark, tmp_path):
    from cellgrid.plans.operators_queries import QUERIES

    given = {"a": ("['3', '1', '3']", "d", ""), "b": ("[4]", "d", ""), "c": ("[]", "d", ""), "e": ("[9, 2, 0]", "d", "longdocurl"), "f": ("[1, 2]", "none", "")}
    rows = [(q, 1, d, p, s, *[None] * 7) for q, (p, d, s) in given.items()]
    rest = [c for c in grid.QUESTION if c not in ("question_id", "doc_id", "evidence_pages", "source_dataset", "evidence_sources")]
    kinds = ", ".join(f"{c} string" for c in rest) + ", evidence_sources string"
    spark.createDataFrame(rows, f"question_id string, ingested_at long, doc_id string, evidence_pages string, source_dataset string, {kinds}").write.parquet(f"{tmp_path}/questions.parquet")
    spark.createDataFrame([("d", i) for i in range(4)], "doc_id string, page int").write.parquet(f"{tmp_path}/doc_pages.parquet")
    got = {r.question_id: r.ranking for r in QUERIES["oracle_ranking"](spark, str(tmp_path)).collect()}
    assert got == {"a": "2,0,1,3", "b": "3,0,1,2", "c": "0,1,2,3", "e": "2,0,1,3"}


def test_nearest_in_blocks_against_python(spark, tmp_path):
    import math

    from cellgrid.plans.operators_queries import QUERIES

    rnd = random.Random(6)
    vecs = {i: [rnd.randrange(-3, 4) for _ in range(3 if i % 7 else 5)] for i in range(90)} | {90: [], 91: [0.0, 0.0], 92: None, 93: [1.0, None]}
    df = spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, i % 3) for i, v in vecs.items()], "vec_id long, embedding array<float>, label int").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")

    def cos(a, b):
        a, b = [[] if v is None or None in v else v for v in (a, b)]
        n = min(len(a), len(b))
        na, nb = (math.sqrt(sum(x * x for x in v[:n])) for v in (a, b))
        return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 6) if na and nb else 0.0

    def brute(q, k):
        s = sorted((-cos(vecs[q], v), i) for i, v in vecs.items() if i != q)
        return [(i, -x, r) for r, (x, i) in enumerate(s[:k], 1)]

    def listed(out):
        got = {}
        for r in sorted(out.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append((r.page, r.score, r["rank"]))
        return got

    assert listed(QUERIES["cosine_topk"](spark, str(tmp_path))) == {q: brute(q, 10) for q in range(0, 90, 20)}
    assert listed(retrieval.nearest(df, df, 4, block=8)) == {q: brute(q, 4) for q in vecs}
    assert listed(retrieval.nearest(df, df.filter("vec_id < 5"), 200)) == {q: brute(q, 200) for q in range(5)}


def test_draw_is_the_seeded_shuffle_at_any_size(spark):
    df = spark.createDataFrame([(f"q{i:02d}", f"d{i // 3}", g) for g in "gh" for i in range(24 if g == "g" else 60)], "question_id string, doc_id string, grp string")
    for shuffled in (2, 200_000):
        got = grid.coherent_draw(df, "grp", 7, seed=3, shuffled=shuffled).collect()
        for g, n in (("g", 8), ("h", 20)):
            firsts = sorted((min(f"q{i:02d}" for i in range(60) if i // 3 == d), f"d{d}") for d in range(n))
            random.Random(3).shuffle(firsts)
            assert {r.doc_id for r in got if r.grp == g} == {d for _, d in firsts[:3]}
