"""Answers from a model that the caller brings: one row per cell, failures as data, retries; and a judge's request and reply.

`run_cells` hands batches of cells to a function on the executors (the way a model server or a
local model is reached); what it raises for a cell becomes that cell's status and reason, so
the result has exactly the cells' rows. Everything around the call is a column expression.

Defined results: a null answer is an error; a cell whose function raises has a null text; a
batch without cells gives none; repeated cells are answered alike.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

# Replies of a service that may pass, and words of a daily limit.
RETRYABLE = (429, 500, 502, 503, 504)
DAILY = ("per_model_per_day", "PerDay")


class DailyQuota(RuntimeError):
    """The key is used up for the day."""


def verdict_of(error: BaseException) -> str:
    """'daily' (another key is needed), 'wait' (may pass) or 'stop'."""
    text, code = str(error), next((c for n in ("code", "status_code") if isinstance(c := getattr(error, n, None), int)), None)
    if isinstance(error, DailyQuota) or any(w in text for w in DAILY):
        return "daily"
    passing = code in RETRYABLE or "RESOURCE_EXHAUSTED" in text or isinstance(error, (TimeoutError, ConnectionError))
    return "wait" if passing else "stop"


def with_retry(call: Callable[[object], object], keys: list[object], attempts: int = 6, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(key) by the first key that is not used up; a passing failure is tried again after a doubling pause."""
    last: BaseException | None = None
    for key in keys:
        for i in range(attempts):
            try:
                return call(key)
            except Exception as error:
                last = error
                kind = verdict_of(error)
                if kind == "daily":
                    break  # the next key
                if kind == "stop" or i == attempts - 1:
                    raise
                sleep(delay * 2**i)
    raise last or ValueError("no key to call with")


def run_cells(cells: DataFrame, answer: Callable[[dict], str | None], keep: list[str], reads: list[str]) -> DataFrame:
    """keep.., text, status, skipped_reason, oom_occurred, latency_s: one row per cell. answer gets the columns of reads."""
    kinds = "".join(f"`{c}` {cells.schema[c].dataType.simpleString()}, " for c in keep)
    both = list(dict.fromkeys([*keep, *reads]))

    def one(row: dict) -> tuple[str | None, str, str, float]:
        began = time.monotonic()
        try:
            text = answer(row)
            status, reason = ("ok", "") if text is not None else ("error", "no answer")
        except Exception as error:
            text, reason = None, str(error) or type(error).__name__
            status = "oom" if "out of memory" in reason.lower() else "error"
        return text, status, reason, time.monotonic() - began

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([one(r) for r in pdf[reads].to_dict("records")], columns=["text", "status", "skipped_reason", "latency_s"])
            got["oom_occurred"] = got["status"] == "oom"
            yield pd.concat([pdf[keep].reset_index(drop=True), got], axis=1)

    return cells.select(*both).mapInPandas(run, kinds + "text string, status string, skipped_reason string, latency_s double, oom_occurred boolean")


def stub_answer(question: Column) -> Column:
    return F.concat(F.lit("stub answer to: "), F.coalesce(question, F.lit("")))


def pool_for_task(task: Column, unanswerable: tuple[str, ...]) -> Column:
    return F.when(task.isin(*unanswerable), "unanswerable").otherwise("answerable")


def judge_request(question: Column, gold: Column, unanswerable: Column, text: Column) -> Column:
    """The JSON that a judge is asked with, keys sorted; missing values are null."""
    return F.to_json(F.struct(gold.alias("gold_answer"), unanswerable.alias("is_unanswerable"), text.alias("model_answer"), question.alias("question")), {"ignoreNullFields": "false"})


def reply_text(response: Column) -> Column:
    """The text of a chat reply: content as a string, or its parts one per line."""
    content = F.get_json_object(response, "$.choices[0].message.content")
    listed = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(listed, lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != ""), "\n")
    return F.when(content.startswith("[") & listed.isNotNull(), joined).otherwise(content)


def reply_object(text: Column) -> Column:
    """The JSON object of a reply: what a fence holds, else from the first brace to the last; null where there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def as_prediction(rows: DataFrame) -> DataFrame:
    """The prediction that a judged or stored row carries: identity, text, status and telemetry."""
    names = ("prediction_key", "question_id", "doc_id", "condition", "representation", "model_spec", "visual_resolution", "page_indices", "status", "text",
             "text_tokens_fed", "output_tokens", "latency_s", "peak_vram_bytes", "metadata")
    return rows.select(*[F.col(n) if n in rows.columns else F.lit(None).alias(n) for n in names]).withColumn("status", F.coalesce("status", F.lit("ok")))


def thinking_prompt(mode: Column, question: Column, body: Column, contract: str) -> Column:
    """The prompt of a model that thinks aloud: under every mode it must end with a line that holds the answer alone."""
    from .represent import prompt

    return F.concat_ws("\n\n", F.lit(contract), prompt(mode, question, body))


def backend_of(spec: Column, known: tuple[str, ...]) -> Column:
    """The backend that a model spec names; an unknown one raises and never becomes a stub."""
    b = S.spec_parts(spec)["backend"]
    return F.when(b.isin(*known), b).otherwise(F.raise_error(F.concat(F.lit("unknown backend in model spec: "), spec)).cast("string"))
