"""Fact rows as JSON lines or parquet: tolerant reads, append-if-absent, run guards."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION = (
    "prediction_key string, question_id string, doc_id string, doc_type string, bin_label string, scan_label string, hop string, is_unanswerable boolean, "
    "evidence_sources array<string>, condition string, provenance string, page_indices array<int>, representation string, model_spec string, machine string, "
    "status string, skipped_reason string, oom_occurred boolean, answer string, total_text_tokens long, total_visual_tokens long, text_tokens_fed long, "
    "output_tokens long, tokens_dropped long, truncation_occurred boolean, latency_s double, prefill_latency_s double, decode_latency_s double, "
    "peak_vram_bytes long, visual_resolution string, note string, metadata map<string,string>"
)
RESULT = PREDICTION + ", result_key string, judge_spec string, score double, correct boolean, abstained boolean"
MEMO = "question_id string, page_count int, ranking array<int>, seq_len_cap int, page_token_lens array<int>, truncated_pages int, status string, skipped_reason string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern, is there on its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; an absent path is empty; lines that do not parse are left out."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    wide = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def indexed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The later row of a repeated key wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def append_absent(rows: DataFrame, path: str, key: str, order: str = "seq") -> int:
    """Append the rows whose key the parquet table lacks, of a repeated key the first in order (without that column the least row); how many."""
    spark = rows.sparkSession
    by = [order] if order in rows.columns else [c for c, t in rows.dtypes if not t.startswith("map")]
    w = Window.partitionBy(key).orderBy(*by)
    new = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    from ..session import cut_lineage

    new = cut_lineage(new)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def union_tags(frames: list[DataFrame]) -> DataFrame:
    """Runs one below the other; columns that older ones lack are null; no de-duplication across runs."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_memo(rankings: DataFrame, path: str) -> None:
    """Rankings partitioned by method and dpi."""
    rankings.write.mode("append").partitionBy("method", "dpi").parquet(path)


def read_memo(spark: SparkSession, path: str, method: str, dpi: int) -> DataFrame:
    """Usable rankings of one method; failed rows and empty rankings are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], MEMO)
    m = spark.read.parquet(path).filter((F.col("method") == method) & (F.col("dpi") == dpi))
    return m.filter((F.coalesce("status", F.lit("ok")) == "ok") & (F.size("ranking") > 0))


def memoized(questions: DataFrame, memo: DataFrame) -> DataFrame:
    """Each question with its ranking; a miss is an error row with the reason of an earlier failure where there is one."""
    m = memo.select("question_id", "page_count", "ranking", F.col("skipped_reason").alias("__r"))
    j = questions.join(m, ["question_id", "page_count"], "left")
    miss = F.col("ranking").isNull() | (F.size("ranking") <= 0)
    return j.withColumn("status", F.when(miss, "error").otherwise("ok")).withColumn(
        "skipped_reason", F.when(miss, F.coalesce("__r", F.lit("retrieval memo miss"))).otherwise("")).drop("__r")


def check_settings(path: str, settings: dict) -> None:
    """Write a run's settings once; later ones must equal them."""
    if os.path.exists(path):
        with open(path) as f:
            known = json.load(f)
        changed = {k: (known.get(k), settings.get(k)) for k in {*known, *settings} if known.get(k) != settings.get(k)}
        if changed:
            raise ValueError(f"run settings changed: {changed}")
        return
    with open(path, "w") as f:
        json.dump(settings, f, sort_keys=True, indent=1)
