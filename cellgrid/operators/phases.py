"""Phases of a run: judge what is not yet judged, classify each document once, fill gaps, check totality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .facts import with_status

KEPT = ("source_dataset", "output_truncated", "max_new_tokens", "prompt_template_version", "quantization")


def kept_metadata(m: Column, names: tuple[str, ...] = KEPT) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(*names))


def require_total(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Inner join that raises where a row has no partner."""
    j = rows.join(dim.withColumn("__hit", F.lit(True)), key, "left")
    ok = F.when(F.col("__hit").isNull(), F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(True)
    return j.withColumn("__hit", ok).filter("__hit").drop("__hit")


def judge_phase(predictions: DataFrame, questions: DataFrame, judged: DataFrame, judge_spec: str = "stub") -> DataFrame:
    """Rows of predictions not judged yet: finished ones scored, failed ones passed through with score 0."""
    from .facts import gold_answers

    key = S.prediction_key(*[F.col(c) for c in ("condition", "doc_id", "model_spec", "page_indices", "question_id", "representation", "visual_resolution")], judge=F.lit(judge_spec))
    p = with_status(predictions).withColumn("result_key", key).join(judged.select("result_key").distinct(), "result_key", "left_anti")
    p = p.join(gold_answers(questions), "question_id", "left")
    ok = F.col("status") == "ok"
    abstained = ok & S.is_abstention(F.col("text"))
    correct = ok & S.stub_correct(F.col("text"), F.col("gold"), F.col("is_unanswerable"), abstained)
    return p.withColumn("judge_spec", F.lit(judge_spec)).withColumn("abstained", abstained).withColumn("correct", correct).withColumn("score", F.col("correct").cast("double")).drop("gold")


def select_failed(rows: DataFrame) -> DataFrame:
    return with_status(rows).filter("status <> 'ok'")


def classify_documents(questions: DataFrame, labels: DataFrame, answer: Column) -> DataFrame:
    """doc_id, gold_bin, predicted_bin, correct_bin, confidence: each distinct document once."""
    docs = questions.select("doc_id").distinct().join(labels, "doc_id")
    p = S.parse_bin(answer)
    return docs.select("doc_id", F.col("bin_label").alias("gold_bin"), p["bin"].alias("predicted_bin"), (F.col("bin_label") == p["bin"]).alias("correct_bin"), p["confidence"].alias("confidence"))


def first_judged(predictions: DataFrame, judged: DataFrame, key: str = "prediction_key") -> DataFrame:
    """Each prediction with its first judged row."""
    w = Window.partitionBy(key).orderBy("result_seq")
    one = judged.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return predictions.join(one, key, "left")


def zip_methods(text: list[str], vision: list[str]) -> list[tuple[str, str]]:
    """Joint methods pair tiers by position; the longer list's rest has no partner."""
    return list(zip(text, vision))


def gold_in_range(gold: Column, pages: Column) -> Column:
    return F.forall(F.coalesce(gold, F.array()), lambda p: (p >= 0) & (p < pages))


def pick(questions: DataFrame, ids: list[str] | None = None, limit: int | None = None, order: str = "question_id") -> DataFrame:
    """Named questions, then the first `limit` (0 at least) in order."""
    q = questions.filter(F.col("question_id").isin(*ids)) if ids is not None else questions
    return q if limit is None else q.orderBy(order).limit(max(limit, 0))


def with_markdown(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages with their parsed markdown; a miss is an error row."""
    j = pages.join(cache, ["doc_id", "page_index"], "left")
    return j.withColumn("status", F.when(F.col("markdown").isNull(), "error").otherwise("ok")).withColumn("skipped_reason", F.when(F.col("markdown").isNull(), "parser markdown miss").otherwise(""))


def backfill_doc_type(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Blank doc_type of retrieval rows from the document's first non-blank one."""
    named = F.trim(F.coalesce("doc_type", F.lit(""))) != ""
    first = questions.filter(named).groupBy("doc_id").agg(F.min_by("doc_type", "question_id").alias("__t"))
    blank = F.trim(F.coalesce("doc_type", F.lit(""))) == ""
    return rows.join(first, "doc_id", "left").withColumn("doc_type", F.when(blank, F.col("__t")).otherwise(F.col("doc_type"))).drop("__t")


def build_status(rows: DataFrame) -> DataFrame:
    """run_tag, rows, ok, with_text, oom: what a run has so far."""
    r = with_status(rows)
    return r.groupBy("run_tag").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "ok").alias("ok"),
                                   F.count_if(F.coalesce("text", F.lit("")).rlike(r"[\p{L}\p{N}]")).alias("with_text"), F.count_if(F.coalesce("oom_occurred", F.lit(False))).alias("oom"))


def documents_by_type(questions: DataFrame, order: str = "question_id") -> DataFrame:
    """doc_type, docs, conflicts: documents counted under their first type; how many carry another one, too."""
    d = questions.groupBy("doc_id").agg(F.min_by("doc_type", order).alias("doc_type"), F.countDistinct("doc_type").alias("types"))
    return d.groupBy("doc_type").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("types") > 1).alias("conflicts"))


def resolution_verdict(cells: DataFrame, caps: dict[str, int], room_mb: float = 16384) -> DataFrame:
    """Per model the highest resolution without failures, and the highest that fits the memory."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    r = with_status(cells).filter(F.col("visual_resolution").isin(*caps)).groupBy("model_spec", "visual_resolution").agg(
        F.count_if(F.col("status") == "oom").alias("oom"), F.max("peak_vram_bytes").alias("peak"))
    r = r.withColumn("cap", F.element_at(cap, F.col("visual_resolution")))
    fits = (F.col("oom") == 0) & (F.col("peak") / 1e6 < room_mb)
    return r.groupBy("model_spec").agg(F.max_by("visual_resolution", F.when(F.col("oom") == 0, F.col("cap"))).alias("highest_ok"),
                                      F.coalesce(F.max_by("visual_resolution", F.when(fits, F.col("cap"))), F.min_by("visual_resolution", "cap")).alias("highest_fitting"))


def closure(edges: dict[str, list[str]], roots: list[str]) -> list[str]:
    """Everything that the roots need, each once, needs after needers."""
    seen: dict[str, None] = {}
    todo = list(roots)
    while todo:
        x = todo.pop(0)
        if x not in seen:
            seen[x] = None
            todo += edges.get(x, [])
    return list(seen)
