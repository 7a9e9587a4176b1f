"""The fact rows: one per experiment cell, de-duplicated, judged, restricted, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .packed import first_delivery

IDENTITY = ("question_id", "doc_id", "condition", "representation", "model_spec", "visual_resolution")
DEFAULT_SPEC = "orlin-8b-local"


def with_status(rows: DataFrame) -> DataFrame:
    """Rows from before the status field existed had finished."""
    return rows.withColumn("status", F.coalesce("status", F.lit("ok")))


def best_rows(rows: DataFrame, identity: tuple[str, ...] = IDENTITY, order: str = "seq") -> DataFrame:
    """One row per cell: the first ok row, else the first row. The rank filter limits each partition before the shuffle."""
    w = Window.partitionBy(*identity).orderBy((F.col("status") != "ok").cast("int"), order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def ok_rows(rows: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    return best_rows(with_status(rows), identity).filter("status = 'ok'")


def gold_answers(questions: DataFrame) -> DataFrame:
    return first_delivery(questions, "question_id", "ingested_at", ["question_id", "answer"]).withColumnRenamed("answer", "gold")


def judged(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """ok cells with correct, abstained and score by the deterministic judge.

    The text is judged and dropped before the shuffle that picks one row per cell.
    """
    p = with_status(predictions).join(gold_answers(questions), "question_id", "left")
    abstained = S.is_abstention(F.col("text"))
    p = p.select(
        *[F.col(c) for c in ("seq", "question_id", "doc_id", "condition", "representation", "model_spec", "visual_resolution", "status", "hop",
                             "is_unanswerable", "evidence_sources", "provenance", "page_indices", "bin_label", "scan_label", "run_tag",
                             "total_text_tokens", "total_visual_tokens", "text_tokens_fed", "output_tokens", "peak_vram_bytes")],
        S.blank_to(F.col("doc_type"), S.UNKNOWN).alias("doc_type"),
        *[S.clean(F.col(c)).alias(c) for c in ("latency_s", "prefill_latency_s", "decode_latency_s")],
        F.col("metadata")["source_dataset"].alias("source_dataset"),
        (F.coalesce(F.col("metadata")["output_truncated"], F.lit("false")) == "true").alias("output_truncated"),
        S.base_condition(F.col("condition")).alias("base"), S.prompt_mode(F.col("condition")).alias("mode"),
        abstained.alias("abstained"),
        S.stub_correct(F.col("text"), F.col("gold"), F.col("is_unanswerable"), abstained).alias("correct"),
    )
    return best_rows(p).filter("status = 'ok'").withColumn("score", F.col("correct").cast("double"))


def primary_spec(rows: DataFrame, default: str = DEFAULT_SPEC) -> DataFrame:
    """Rows of one model: the default where it occurs, else the most frequent (ties: first seen)."""
    counts = rows.filter("model_spec is not null").groupBy("model_spec").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    keep = counts.orderBy((F.col("model_spec") != default).cast("int"), F.desc("n"), "first").select("model_spec").first()
    # settled once, so that every later use is a plain filter
    return rows.filter(F.col("model_spec") == (keep[0] if keep else default))


def or_all(rows: DataFrame, match: Column) -> DataFrame:
    """Matching rows; all of them where none matches."""
    found = rows.filter(match)
    return rows if found.isEmpty() else found


def for_base(rows: DataFrame, base: str) -> DataFrame:
    return or_all(rows, F.coalesce(F.col("base") == base, F.lit(False)))


def status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cells per group by their best status."""
    rank = F.when(F.col("status") == "ok", 2).when(F.col("status") == "oom", 1).otherwise(0)
    cell = with_status(rows).groupBy(*by, *[c for c in IDENTITY if c not in by]).agg(F.max(rank).alias("r"))
    return cell.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), *[F.sum((F.col("r") == k).cast("int")).alias(n) for k, n in ((2, "ok"), (1, "oom"), (0, "error"))]
    )


def generation_report(rows: DataFrame, a: str = "run_tag", b: str = "provenance") -> DataFrame:
    """Cells, ok, oom, error and OOM percent per (a, b), and a grand total."""
    rank = F.when(F.col("status") == "ok", 2).when(F.col("status") == "oom", 1).otherwise(0)
    cell = with_status(rows).groupBy(a, b, *IDENTITY).agg(F.max(rank).alias("r"))
    sums = [F.count(F.lit(1)).alias("cells"), *[F.sum((F.col("r") == k).cast("int")).alias(n) for k, n in ((2, "ok"), (1, "oom"), (0, "error"))]]
    out = cell.groupingSets([[F.col(a), F.col(b)], []], F.col(a), F.col(b)).agg(*sums)
    return out.withColumn("oom_pct", F.col("oom") * 100 / F.col("cells"))


def merge_failed(rows: DataFrame, rerun: DataFrame, key: str = "prediction_key") -> DataFrame:
    """Rows that failed are replaced by the rerun of the same key; ok rows stay; rerun-only rows drop."""
    cols = [c for c in rows.columns if c != key]
    r = rerun.select(key, F.struct(*cols).alias("__r"))
    j = rows.select(key, F.struct(*cols).alias("__o")).join(r, key, "left")
    pick = F.when((F.col("__o.status") != "ok") & F.col("__r").isNotNull(), F.col("__r")).otherwise(F.col("__o"))
    return j.select(key, pick.alias("__p")).select(key, *[F.col(f"__p.{c}").alias(c) for c in cols])


def missing_cells(wanted: DataFrame, cached: DataFrame, key: str = "prediction_key") -> DataFrame:
    """Resume: the cells that the cache does not hold yet."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


def open_cells(base: DataFrame, attempts: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Cells to keep: all but those that ran out of memory at every resolution they were tried at (no attempt there did better)."""
    key = [c for c in keys if c != "visual_resolution"]
    rank = F.when(F.col("status") == "ok", 2).when(F.col("status") == "oom", 1).otherwise(0)
    tried = with_status(attempts).groupBy(*key, "visual_resolution").agg(F.max(rank).alias("r"))
    dead = tried.groupBy(*key).agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo = 1 and hi = 1")
    return base.join(dead.select(*key), key, "left_anti")


def failure_reasons(rows: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent failure reasons (first line, 100 characters); ties: first seen."""
    bad = with_status(rows).filter("status <> 'ok'")
    kind = S.reason_line(F.col("skipped_reason"))
    counts = bad.groupBy("status", kind.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return counts.orderBy(F.desc("n"), "first_seq").limit(top)


def run_verdicts(rows: DataFrame, gate: float = 0.02) -> DataFrame:
    """OK, WARN or FAIL per run from its best statuses."""
    c = status_counts(rows, ["run_tag"])
    bad = F.col("oom") + F.col("error")
    v = F.when(F.col("cells") == 0, "FAIL").when(F.col("error") / F.col("cells") >= gate, "FAIL").when(bad > 0, "WARN").otherwise("OK")
    return c.withColumn("verdict", v)


def backfill(rows: DataFrame, labels: DataFrame, column: str, other: str) -> DataFrame:
    """Blank values of a column filled from a dimension by doc_id; `other` where it has none."""
    dim = labels.select("doc_id", F.col(column).alias("__b"))
    filled = F.when(F.coalesce(F.trim(column), F.lit("")) == "", F.col("__b")).otherwise(F.col(column))
    return rows.join(dim, "doc_id", "left").withColumn(column, S.blank_to(filled, other)).drop("__b")


def run_summary(rows: DataFrame) -> DataFrame:
    """Per run: rows that its grid asks for (cells x models x resolutions), done, ok, oom, error, and the shares, '-' where there is nothing to divide by."""
    grid = rows.groupBy("run_tag").agg((
        F.countDistinct("question_id", "condition", "representation") * F.countDistinct("model_spec")
        * F.greatest(F.countDistinct(F.when(F.col("visual_resolution") != "", F.col("visual_resolution"))), F.lit(1))).alias("expected"))
    c = status_counts(rows, ["run_tag"]).withColumnRenamed("cells", "done").join(grid, "run_tag")
    share = lambda a, b: F.when(b > 0, F.concat(F.bround(a * 100 / b, 0).cast("long").cast("string"), F.lit("%"))).otherwise("-")
    return c.select("run_tag", "expected", "done", "ok", "oom", "error", share(F.col("done"), F.col("expected")).alias("done_pct"), share(F.col("oom"), F.col("done")).alias("oom_pct"))


def tally(checks: DataFrame) -> DataFrame:
    """level, n of a preflight report's checks, and in every row the verdict of the whole: FAIL where any failed, else WARN where any warned, else PASS."""
    n = checks.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    worst = F.max(F.when(F.col("level") == "FAIL", 2).when(F.col("level") == "WARN", 1).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    return n.withColumn("verdict", F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), worst + 1))


def inspect(judged_rows: DataFrame, limit: int | None = None, incorrect: bool = False, abstained: bool = False, **equal: str | None) -> DataFrame:
    """Judged rows that meet all of the given conditions (question_id=, doc_id=, representation=, condition=), in order, the first `limit`."""
    rows = judged_rows
    for name, value in equal.items():
        rows = rows if value is None else rows.filter(F.col(name) == value)
    rows = rows.filter(~F.col("correct")) if incorrect else rows
    rows = rows.filter("abstained") if abstained else rows
    rows = rows.orderBy("question_id", "representation", "condition", "seq")
    return rows if limit is None else rows.limit(max(limit, 0))


def packet(fields: list[str]) -> Column:
    """All fields of a row as lines `name: value`; blanks and nulls as '-'."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", "-").otherwise(F.col(f).cast("string"))) for f in fields])


def same_files(a: DataFrame, b: DataFrame) -> bool:
    """Whether two listings (name, size) hold the same names with the same sizes."""
    x, y = a.select("name", "size"), b.select("name", "size")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
