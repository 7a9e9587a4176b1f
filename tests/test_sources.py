import json

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import facts
from cellgrid.plans.reconcile import gated, reconcile
from cellgrid.sources import corpora, rows, sinks
from cellgrid.streaming import upsert


def test_lines_skip_corrupt_ones(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"prediction_key": "a", "status": "ok"}\n\nnot json\n{"prediction_key": "b", "page_indices": [1, 2]}\n{"prediction_key": "c", "sta')
    got = rows.read_lines(spark, str(p), rows.PREDICTION)
    assert sorted(r.prediction_key for r in got.collect()) == ["a", "b"] and len(got.columns) == 32
    assert rows.read_lines(spark, str(tmp_path / "none.jsonl"), rows.RESULT).count() == 0


def test_append_absent_and_memo(spark, tmp_path):
    t = str(tmp_path / "t")
    a = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    assert rows.append_absent(a, t, "k") == 2 and rows.append_absent(a, t, "k") == 0
    s = spark.createDataFrame([("c", 7, 2), ("c", 9, 1), ("a", 5, 0)], "k string, v int, seq int")
    assert rows.append_absent(s, t + "2", "k") == 2 and {r.k: r.v for r in spark.read.parquet(t + "2").collect()} == {"c": 9, "a": 5}
    m = spark.createDataFrame([("q", 3, [2, 0, 1], None, None, None, "ok", "", "bm25", 0), ("r", 3, [], None, None, None, "oom", "x", "bm25", 0)], rows.MEMO + ", method string, dpi int")
    rows.write_memo(m, str(tmp_path / "memo"))
    assert rows.read_memo(spark, str(tmp_path / "memo"), "bm25", 0).count() == 1
    q = spark.createDataFrame([("q", 3), ("r", 3), ("s", 1)], "question_id string, page_count int")
    got = {r.question_id: (r.status, r.skipped_reason) for r in rows.memoized(q, m).collect()}
    assert got == {"q": ("ok", ""), "r": ("error", "x"), "s": ("error", "retrieval memo miss")}
    assert [r.v for r in rows.indexed(spark.createDataFrame([("a", 1), ("a", 5)], "k string, v int"), "k", "v").collect()] == [5]


def test_settings_guard(tmp_path):
    p = str(tmp_path / "s.json")
    rows.check_settings(p, {"a": 1})
    rows.check_settings(p, {"a": 1})
    with pytest.raises(ValueError):
        rows.check_settings(p, {"a": 2})


def test_squad_and_unwrap(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "x__Cat", "question": "q", "answers": [{"text": "a", "answer_start": 0}]}]}]}]}))
    assert tuple(corpora.squad(spark, str(p)).first()) == ("t", "c", "x__Cat", "q", ["a"], "Cat")
    assert corpora.unwrap(spark, str(p)).count() == 1
    p.write_text('{"k1": {"a": 1}, "k2": {"a": 2}}')
    got = {r.k: r.a for r in corpora.unwrap(spark, str(p)).select(F.try_variant_get("record", "$.key", "string").alias("k"), F.try_variant_get("record", "$.a", "int").alias("a")).collect()}
    assert got == {"k1": 1, "k2": 2}


def test_sheet_paths_and_numbers(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("doc_id,bin_label,scan_label\na,text-dominant,digital\nb,,\n")
    assert [r.doc_id for r in corpora.label_sheet(spark, str(p)).collect()] == ["a"]
    p.write_text("doc_id,bin_label,scan_label\na,nonsense,digital\n")
    with pytest.raises(ValueError):
        corpora.label_sheet(spark, str(p))
    docs = spark.createDataFrame([("x:12",), ("y.pdf",), ("z",)], "doc_id string")
    listing = spark.createDataFrame([("12.pdf", "/p/12.pdf"), ("y.pdf", "/p/y.pdf")], "name string, path string")
    assert {r.doc_id: r.path for r in corpora.resolve_paths(docs, listing).collect()} == {"x:12": "/p/12.pdf", "y.pdf": "/p/y.pdf", "z": None}
    n = corpora.numbered(spark.range(0, 25).repartition(4), "id")
    assert sorted((r.id, r.question_id) for r in n.collect())[24] == (24, "mmlongbench:000024")


def test_scheduler_text(spark):
    lines = spark.createDataFrame([("12|gpu|job|me|R|2026-01-01T00:00:00|2026-01-02T02:03:04|gpu:v100:2",), ("header",)], "value string")
    r = corpora.queue(lines).first()
    assert (r.job, r.wait, r.gpus) == ("12", "1d 02:03:04", 2)
    n = corpora.nodes(spark.createDataFrame([("NodeName=n1 CPUTot=8 RealMemory=4G Gres=gpu:2 State=IDLE",)], "value string"))
    assert tuple(n.first()) == ("n1", "IDLE", 8, 4096.0, 2) and corpora.node_totals(n).first().gpus == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5, -6.25), ("a|x", None, 6.25)], "k string, v double, d double")
    t = df.select("k", sinks.points(F.col("v")).alias("v"), sinks.signed(F.col("d")).alias("d"))
    cols, body = sinks.grid(t, ["k"])
    assert body == [["a|x", "-", "+6.2"], ["b", "50.0", "-6.2"]]
    sinks.write_csv(str(tmp_path / "o" / "t.csv"), cols, body, {"swept": "x"}, sinks.n_footer(cols, {"v": 2}))
    assert (tmp_path / "o" / "t.csv").read_text().splitlines() == ["# swept,x", "k,v,d", "a|x,-,+6.2", "b,50.0,-6.2", "n,2,"]
    assert "a\\|x" in sinks.markdown("T", cols, body) and sinks.markdown("T", ["a"], []).endswith("|  |\n")


def test_reconcile(spark):
    f = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "check string, value double")
    e = spark.createDataFrame([("a", "t1", 10.4, 0.5), ("b", "t2", 9.0, 1.0), ("c", "t3", 1.0, 1.0)], "check string, gate string, value double, tolerance double")
    r = reconcile(f, e)
    assert {x.check: x.status for x in r.collect()} == {"a": "pass", "b": "fail", "c": "skip"} and [x.gate for x in gated(r).collect()] == ["t2"]


def test_stream_upsert(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "seq long, k string, status string"
    for part in ([(1, "a", "error"), (2, "b", "ok")], [(3, "a", "ok"), (4, "b", "error"), (5, "c", None)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(src)
    upsert.run(spark, src, out, str(tmp_path / "cp"), spark.read.parquet(src).schema, ("k",))
    want = [("a", 3, "ok"), ("b", 2, "ok"), ("c", 5, "ok")]
    table = lambda: sorted((r.k, r.seq, r.status) for r in upsert.current(spark, out, ("k",)).collect())
    assert table() == want and upsert.current(spark, str(tmp_path / "none"), ("k",)) is None
    merge = upsert.upsert(out, ("k",), compact=3)
    late = spark.createDataFrame([(6, "d", "oom"), (7, "a", "error")], kind)
    for _ in range(2):  # a replayed batch changes nothing
        merge(late, 2)
        assert table() == [*want, ("d", 6, "oom")] and (tmp_path / "out" / "c=2" / "_SUCCESS").exists()
    merge(spark.createDataFrame([(8, "d", "ok")], kind), 3)
    assert table() == [*want, ("d", 8, "ok")]
