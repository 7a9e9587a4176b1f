import pytest
from pyspark.sql import functions as F

from cellgrid.operators import phases


def test_totality_raises(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    assert phases.require_total(a, a.withColumn("v", F.lit(1)), "k").count() == 2
    with pytest.raises(Exception, match="no k y"):
        phases.require_total(a, spark.createDataFrame([("x", 1)], "k string, v int"), "k").collect()


def test_small_ones(spark):
    assert phases.zip_methods(["a", "b"], ["c"]) == [("a", "c")]
    assert phases.closure({"a": ["b", "c"], "b": ["c"], "c": ["a"]}, ["a"]) == ["a", "b", "c"]
    q = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "question_id string")
    assert phases.pick(q, ["q3", "q1"], 1).first().question_id == "q1" and phases.pick(q, limit=-1).count() == 0
    p = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, page_index int")
    m = spark.createDataFrame([("d", 0, "# x")], "doc_id string, page_index int, markdown string")
    assert sorted(r.status for r in phases.with_markdown(p, m).collect()) == ["error", "ok"]
    j = spark.createDataFrame([("k", 2, 0.0), ("k", 1, 1.0)], "prediction_key string, result_seq int, score double")
    assert phases.first_judged(spark.createDataFrame([("k",), ("z",)], "prediction_key string"), j).filter("score = 1.0").count() == 1
