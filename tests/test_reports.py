import json
import random

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import facts, generate, grid, pageset, profile, represent, retrieval, stats
from cellgrid.session import materialized
from cellgrid.sources import specs


def one(spark, c, **kw):
    kind = ", ".join(f"{k} {t}" for k, (t, _) in kw.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in kw.values()) or (1,)], kind).select(c.alias("c")).first().c


def test_agreement_labels_and_gate(spark):
    df = spark.createDataFrame([("Right", "correct"), ("no", "wrong"), ("abstain", "Refusal"), ("yes", "incorrect")], "a string, b string")
    assert abs(stats.labelled_kappa(df, "a", "b").first().kappa - (0.75 - 5 / 16) / (1 - 5 / 16)) < 1e-12
    with pytest.raises(Exception, match="unknown agreement label"):
        stats.labelled_kappa(spark.createDataFrame([("maybe", "yes")], "a string, b string"), "a", "b").collect()
    with pytest.raises(ValueError):
        stats.labelled_kappa(df.limit(0), "a", "b")
    assert [one(spark, stats.agreement_passes(F.col("k")), k=("double", v)) for v in (0.75, 0.7499)] == [True, False]


def test_samples(spark):
    df = spark.createDataFrame([(f"q{i:03}", "ab"[i % 3 == 0]) for i in range(100)], "question_id string, g string").repartition(5)
    got = sorted(r.question_id for r in grid.uniform_sample(df, ["question_id"], 7, seed=4).collect())
    assert got == sorted(f"q{i:03}" for i in random.Random(4).sample(range(100), 7))
    assert grid.uniform_sample(df, ["question_id"], 100).count() == 100 and grid.uniform_sample(df.limit(0), ["question_id"], 3).count() == 0
    assert sorted(r.question_id for r in grid.cap_per_group(df, "g", 2).collect()) == ["q000", "q001", "q002", "q003"]


def test_sheets(spark):
    s = spark.createDataFrame([("a", "x", "p; q"), ("b", "", "p"), ("c", None, None), ("d", " x ", "q")], "doc_id string, one string, many string")
    assert {(r.column, r.value): r.docs for r in profile.distributions(s, ("one",), ("many",)).collect()} == {("one", "x"): 2, ("many", "p"): 2, ("many", "q"): 2}
    assert {r.doc_id: (r.one, r.many) for r in profile.blind_subset(s, ("one", "many"), 5).collect()} == {"a": ("", ""), "d": ("", "")}
    assert [one(spark, profile.page_count(F.col("t")), t=("string", v)) for v in ("7", " [1, 2, ] ", "[]", "x", None)] == [7, 2, 0, None, None]
    assert profile.resolve_key("MM-LongBench doc", ["longdocurl", "mmlongbench_doc"]) == "mmlongbench_doc" and one(spark, profile.plain_key(F.lit("A-b 1"))) == "ab1"
    with pytest.raises(ValueError):
        profile.resolve_key("zz", ["a"])
    q = spark.createDataFrame([("q1", "d", ["a", "b", "a"]), ("q2", "d", []), ("q3", "e", ["b"])], "question_id string, doc_id string, c array<string>")
    got = {r["class"]: (r.questions, r.docs, r.place) for r in profile.class_totals(q, F.col("c"), "class").collect()}
    assert got == {"b": (2, 2, 1), "a": (1, 1, 2), "(none)": (1, 1, 3), "(all)": (3, 2, 0)}


def test_run_reports(spark):
    rows = [("r", "q1", "d", "c", "T", "m", "", None, 1), ("r", "q2", "d", "c", "T", "m", "", "oom", 2), ("r", "q2", "d", "c", "T", "n", "", "error", 3)]
    df = spark.createDataFrame(rows, "run_tag string, question_id string, doc_id string, condition string, representation string, model_spec string, visual_resolution string, status string, seq int")
    r = facts.run_summary(df).first()
    assert (r.expected, r.done, r.ok, r.oom, r.error, r.done_pct, r.oom_pct) == (4, 3, 1, 1, 1, "75%", "33%")
    levels = spark.createDataFrame([("PASS",), ("WARN",), ("PASS",)], "level string")
    assert {(x.level, x.n, x.verdict) for x in facts.tally(levels).collect()} == {("PASS", 2, "WARN"), ("WARN", 1, "WARN")}
    base = df.select("question_id", "doc_id", "condition", "representation", "model_spec").distinct()
    assert sorted((x.question_id, x.model_spec) for x in facts.open_cells(base, df).collect()) == [("q1", "m"), ("q2", "n")]


def test_retrievers(spark):
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(["alpha", "beta gamma", "", "alpha beta", "x"])], "doc_id string, page int, text string")
    q = spark.createDataFrame([("q1", "d", "alpha beta"), ("q2", "d", "nothing"), ("q3", "zz", "alpha")], "query_id string, doc_id string, text string")
    p = retrieval.postings(pages)
    for k in (0, 1, 2, 4, 9):
        for name, full in (("bm25", retrieval.bm25(p, q)), ("lexical", retrieval.fallback_scores(pages, q))):
            want = {(r.query_id, r.page): (r.score, r.rank) for r in retrieval.ranked(full, k).collect()}
            assert {(r.query_id, r.page): (r.score, r.rank) for r in retrieval.build(name)(p, q, k).collect()} == want, (name, k)
    assert sorted((r.query_id, r.page) for r in retrieval.build(None)(p, q, 2).collect()) == [("q1", 0), ("q1", 1), ("q2", 0), ("q2", 1)]
    with pytest.raises(ValueError):
        retrieval.build("bm26")
    v = spark.createDataFrame([("d", 0, [1.0, 0.0]), ("d", 1, [0.0, 1.0]), ("d", 2, None)], "doc_id string, page int, vector array<double>")
    qv = spark.createDataFrame([("q1", "d", [0.0, 2.0]), ("q2", "d", None)], "query_id string, doc_id string, vector array<double>")
    got = {(r.query_id, r.rank): r.page for r in retrieval.dense(v, qv, p, q.filter("query_id <> 'q3'"), 2).collect()}
    assert got == {("q1", 1): 1, ("q1", 2): 0, ("q2", 1): 0, ("q2", 2): 1}
    with pytest.raises(ValueError):
        retrieval.dense(v, qv, p, q, 2, fallback=False)
    assert one(spark, retrieval.as_vectors(F.col("v"), False), v=("array<float>", None)) == [] and one(spark, retrieval.as_vectors(F.col("v"), False), v=("array<float>", [1.0])) == [[1.0]]
    assert one(spark, retrieval.first_pages(F.lit(2), 5)) == [0, 1] and one(spark, retrieval.first_pages(F.lit(2), 0)) == []
    assert one(spark, pageset.condition("full", {"page_count": F.lit(2)})) == [0, 1]
    with pytest.raises(ValueError):
        pageset.condition("x", {})


def test_tiles_and_messages(spark):
    def nearest(a, most=12):
        every = [(c, r) for c in range(1, most + 1) for r in range(1, most + 1) if c * r <= most]
        return min(every, key=lambda g: (abs(a - g[0] / g[1]), -g[0] * g[1]))

    for a in (0.2, 0.707, 1.0, 1.414, 3.0, 11.0):
        assert tuple(one(spark, represent.tile_grid(F.lit(a)))) == nearest(a)
    assert one(spark, represent.tile_count(represent.tile_grid(F.lit(12.0)))) == 13 and one(spark, represent.tile_count(F.struct(F.lit(1).alias("cols"), F.lit(1).alias("rows")))) == 1
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in (("text", 'say "x"'), ("image", "ÿ.png"))])
    m = one(spark, represent.chat_messages(parts))
    assert json.loads(m)[0]["role"] == "user" and [tuple(x) for x in one(spark, represent.chat_parts(F.col("m")), m=("string", m))] == [("text", 'say "x"'), ("image", "ÿ.png")]
    got = one(spark, represent.split_prompt(F.lit("a<image>b<image>"), F.array(F.lit("i"), F.lit("j"))))
    assert [tuple(x) for x in got] == [("text", "a"), ("image", "i"), ("text", "b"), ("image", "j")]
    with pytest.raises(Exception, match="differ in number"):
        one(spark, represent.split_prompt(F.lit("a<image>"), F.array().cast("array<string>")))


def test_cells_keep_every_failure(spark):
    def answer(row):
        if row["n"] == 1:
            raise MemoryError("CUDA out of memory")
        if row["n"] == 2:
            raise ValueError("bad page")
        return None if row["n"] == 3 else f"answer {row['n']}"

    df = spark.range(6).select(F.col("id").cast("int").alias("n"), F.lit("k").alias("text"))
    got = {r.n: (r.text, r.status, r.skipped_reason, r.oom_occurred) for r in generate.run_cells(df, answer, ["n"], ["n", "text"]).collect()}
    assert got[1] == (None, "oom", "CUDA out of memory", True) and got[2] == (None, "error", "bad page", False) and got[3][1] == "error" and got[0] == ("answer 0", "ok", "", False) and len(got) == 6
    assert generate.run_cells(df.limit(0), answer, ["n"], ["n"]).count() == 0


def test_retry_and_keys():
    class Busy(Exception):
        code = 429

    waits, calls = [], []

    def call(key):
        calls.append(key)
        if key == "a":
            raise generate.DailyQuota("used up")
        if len(calls) < 4:
            raise Busy("slow down")
        return key

    assert generate.with_retry(call, ["a", "b"], sleep=waits.append) == "b" and calls == ["a", "b", "b", "b"] and waits == [2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        generate.with_retry(lambda k: 1 / 0, ["a"], sleep=waits.append)
    with pytest.raises(Busy):
        generate.with_retry(lambda k: (_ for _ in ()).throw(Busy()), ["a"], attempts=2, sleep=waits.append)
    assert generate.verdict_of(RuntimeError("PerDay")) == "daily" and generate.verdict_of(TimeoutError()) == "wait"


def test_judge_request_and_reply(spark):
    r = one(spark, generate.judge_request(F.lit("q"), F.lit(None).cast("string"), F.lit(False), F.lit('a "b"')))
    assert json.loads(r) == {"gold_answer": None, "is_unanswerable": False, "model_answer": 'a "b"', "question": "q"} and list(json.loads(r)) == sorted(json.loads(r))
    for content in ("hello", [{"text": "hel"}, {"text": ""}, {"text": "lo"}]):
        t = one(spark, generate.reply_text(F.col("t")), t=("string", json.dumps({"choices": [{"message": {"content": content}}]})))
        assert t == ("hello" if isinstance(content, str) else "hel\nlo")
    cases = {'Sure {"x": 0}\n```json\n{"a": 1}\n```': {"a": 1}, 'so {"a": {"b": 2}} end': {"a": {"b": 2}}, "none": None, "{broken": None}
    for t, want in cases.items():
        got = one(spark, generate.reply_object(F.col("t")), t=("string", t))
        assert (None if got is None else json.loads(got)) == want
    assert one(spark, generate.backend_of(F.lit("a-8b-local-4bit"), ("local",))) == "local"
    with pytest.raises(Exception, match="unknown backend"):
        one(spark, generate.backend_of(F.lit("a-8b-cloud"), ("local",)))
    assert one(spark, generate.pool_for_task(F.lit("x"), ("x",))) == "unanswerable" and one(spark, generate.stub_answer(F.lit("q"))).endswith("q")
    assert one(spark, generate.thinking_prompt(F.lit("none"), F.lit("q"), F.lit(""), "End with a line.")).startswith("End with a line.")
    p = generate.as_prediction(spark.createDataFrame([("k", None, "t")], "prediction_key string, status string, text string")).first()
    assert (p.status, p.text, p.doc_id) == ("ok", "t", None)


def test_specs(spark, tmp_path):
    raw = {"task_name": "t", "dataset": ["a", "b"], "model_specs": ["m"], "quantization": ["bf16", "4bit"], "visual_resolutions": ["low", "high"], "representations": ["T", "V"],
           "decode_budget": {"default": 5, "cot": 9}, "corpus": {"hop": "multi"}, "page_set": {"ranking_source": ["bm25"], "gold": {"mode": "drop_top", "count": 1}, "distractor": {"count": [0, 2]}}}
    runs = specs.expand(raw)
    assert [r["run_tag"] for r in runs] == ["t-a", "t-b"] and runs[0]["model_specs"] == ["m", "m-4bit"] and runs[0]["rules"] == ["pageset:r=bm25:g=drop_top-1:d=0", "pageset:r=bm25:g=drop_top-1:d=2"]
    assert specs.spec_rows(spark, runs).count() == 2 * 2 * 2 * 2
    for change in ({"task_name": None}, {"zz": 1}, {"decode_budget": {"cot": 3}}, {"decode_budget": {"default": 0}}, {"prompt_modes": ["zz"]}, {"corpus": {"hop": "single"}}, {"page_set": {"gold": {"mode": "all"}}},
                   {"page_set": {"ranking_source": "bm25", "x": 1}}, {"page_set": {"ranking_source": "bm25", "gold": {"mode": "shake", "count": 2}}}, {"corpus": {"pool": "zz"}}):
        with pytest.raises(specs.SpecError):
            specs.expand(raw | change)
    for bad in ({"runs": []}, {"runs": [{"task_name": "a"}, {"task_name": "a"}]}, [1], {"runs": [3]}):
        with pytest.raises(specs.SpecError):
            specs.expand(bad)
    p = tmp_path / "s.yaml"
    p.write_text("runs:\n- task_name: a\n- task_name: b\n  run_tag: c\n")
    pytest.importorskip("yaml")
    assert [r["run_tag"] for r in specs.read_spec(str(p))] == ["a", "c"]


def test_env_candidates_and_registry(spark):
    assert specs.read_env("# c\nexport A='1'\nB = x=y\nA=2\n=3", {"B": "real"}) == {"A": "1", "B": "real"}
    names = ["README.json", "train.jsonl", "qa_test.json", "val.json", "pic.png", "qa_train.json"]
    assert specs.candidates(names, ("qa",), most=3) == ["qa_test.json", "qa_train.json", "val.json"]
    specs.corpus_loader("tiny")(lambda s, path: s.createDataFrame([(path,)], "p string"))
    assert specs.load_corpus(spark, "tiny", "x") is specs.load_corpus(spark, "tiny", "x")
    with pytest.raises(ValueError):
        specs.load_corpus(spark, "none", "x")


def test_materialized_once_until_the_source_changes(spark, tmp_path):
    src, calls = str(tmp_path / "t.parquet"), []

    def build():
        calls.append(1)
        return spark.read.parquet(src)

    spark.range(3).write.parquet(src)
    get = lambda: materialized(spark, "x", str(tmp_path), ("t",), build)
    assert get().count() == 3 and get().count() == 3 and len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(src)
    assert get().count() == 5 and len(calls) == 2


def test_scheduler_values(spark):
    from cellgrid.functions import scalar as S
    from cellgrid.sources import corpora

    t = F.col("t")
    assert [one(spark, S.gres_kind(t), t=("string", v)) for v in ("gpu:V100:2", "gpu:2", "gpu:a:b", None)] == ["v100", None, None, None]
    assert [one(spark, S.offset_minutes(t), t=("string", v)) for v in ("+0800", "-0330", "x", None)] == [480, -210, None, None]
    a, k = S.arm_and_k(t)
    assert [(one(spark, a, t=("string", v)), one(spark, k, t=("string", v))) for v in ("retrieved_vision_k5", "oracle", "retrieved_text_kx")] == [("vision", 5), ("", 0), ("text", 0)]
    jobs = spark.createDataFrame([("R", "2026-01-01T08:00:00", "2026-01-01T09:00:01"), ("PD", "2026-01-01T08:00:00", "N/A"), ("PD", "", "")], "state string, submit string, start string")
    got = corpora.queue_wait(jobs, F.lit("2026-01-02 00:30:00").cast("timestamp"), F.lit(480)).collect()
    assert [r.waited for r in got] == ["01:00:01", "1d 00:30:00", "unknown"]
    line = lambda job, state, end, part="gpu": "|".join([job, "n", "u", state, "1", "s", "b", end, part, "t"])
    lines = spark.createDataFrame([(x,) for x in (line("1", "COMPLETED", "2026-01-01"), line("2", "COMPLETED", "Unknown"), line("3", "FAILED", "2026-01-03"), line("4", "COMPLETED", "2026-01-02", "cpu"), "", "short|line")], "value string")
    assert [r.job for r in corpora.completed(lines).collect()] == ["4", "1", "2"] and [r.job for r in corpora.completed(lines, "gpu", 1).collect()] == ["1"]


def test_inspection_packets_and_listings(spark):
    rows = spark.createDataFrame([("q1", "T", "c", 2, True, False, None), ("q1", "T", "c", 1, False, True, "x"), ("q0", "V", "c", 3, False, False, " ")], "question_id string, representation string, condition string, seq int, correct boolean, abstained boolean, text string")
    seqs = lambda df: [r.seq for r in df.collect()]
    assert seqs(facts.inspect(rows)) == [3, 1, 2] and seqs(facts.inspect(rows, incorrect=True, representation="T")) == [1] and seqs(facts.inspect(rows, 1)) == [3] and seqs(facts.inspect(rows, 0)) == []
    assert rows.orderBy("seq").select(facts.packet(["seq", "text"]).alias("p")).first().p == "seq: 1\ntext: x" and rows.filter("seq = 3").select(facts.packet(["text"]).alias("p")).first().p == "text: -"
    a = spark.createDataFrame([("a", 1), ("b", 2)], "name string, size int")
    assert facts.same_files(a, a) and not facts.same_files(a, a.filter("size = 1"))
