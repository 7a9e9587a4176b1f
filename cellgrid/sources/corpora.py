"""Question corpora, dimension sheets, nested JSON, scheduler text."""

from __future__ import annotations

import glob
import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def parquet_shards(spark: SparkSession, path: str, columns: list[str] | None = None, sample: int | None = None, order: str | None = None) -> DataFrame:
    """Shards with only the wanted columns; the first `sample` rows in the given order."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.orderBy(order).limit(sample) if sample is not None and order else df if sample is None else df.limit(sample)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (.jsonl) or one JSON document (.json)."""
    return spark.read.json(path, multiLine=not path.endswith(".jsonl"))


def numbered(df: DataFrame, order: str, dataset: str = "mmlongbench") -> DataFrame:
    """With question_id dataset:000000 in the given order (one range-partitioned pass gives each partition its offset)."""
    parts = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    local = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__b"))
    j = local.join(F.broadcast(offsets), "__p")
    n = (F.col("__i") + F.col("__b") - 1).cast("string")
    return j.withColumn("question_id", F.concat(F.lit(dataset + ":"), F.lpad(n, 6, "0"))).drop("__p", "__i", "__b")


def structured_answer(c: Column) -> Column:
    """A list or object answer as JSON text, a scalar as it is."""
    return F.when(c.rlike(r"^\s*[\[{]"), F.coalesce(F.to_json(F.parse_json(c)), c)).otherwise(c)


def squad(spark: SparkSession, path: str) -> DataFrame:
    """title, context, question, answers, category of a SQuAD file; category follows the last '__' of the id."""
    d = spark.read.option("multiLine", True).json(path).select(F.explode("data").alias("d"))
    p = d.select(F.col("d.title").alias("title"), F.explode("d.paragraphs").alias("p"))
    q = p.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return q.select("title", "context", F.col("q.id").alias("id"), F.col("q.question").alias("question"), F.col("q.answers.text").alias("answers"),
                    F.element_at(F.split(F.col("q.id"), "__"), -1).alias("category"))


def unzip(path: str, into: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        z.extractall(into)
    return sorted(glob.glob(os.path.join(into, "**", "*.json"), recursive=True))


def unwrap(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """record (variant) of a JSON container: a list, a list under a known key, or an object of objects, each with its key."""
    text = spark.read.text(path, wholetext=True)
    listed, named = F.from_json("value", "array<variant>"), F.from_json("value", "map<string,variant>")
    known = [key] if key else ["data", "questions", "samples", "annotations"]
    inner = F.coalesce(*[F.try_variant_get(F.element_at("m", F.lit(k)), "$", "array<variant>") for k in known])
    keyed = F.transform(F.filter(F.map_entries("m"), lambda e: F.schema_of_variant(e["value"]).startswith("OBJECT")), lambda e: F.parse_json(
        F.concat(F.lit('{"key":'), F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(","), F.to_json(e["value"]).substr(F.lit(2), F.length(F.to_json(e["value"]))))))
    both = text.select(listed.alias("l"), F.when(~F.trim("value").startswith("["), named).alias("m"))
    return both.select(F.explode(F.when(F.col("m").isNull(), F.col("l")).otherwise(F.coalesce(inner, keyed))).alias("record"))


def label_sheet(spark: SparkSession, path: str, required: tuple[str, ...] = ("doc_id", "bin_label", "scan_label")) -> DataFrame:
    """An annotation sheet; missing columns and unknown bins raise, rows without a bin are left out."""
    df = spark.read.option("header", True).csv(path)
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {lacking}")
    t = F.trim(F.coalesce("bin_label", F.lit("")))
    bad = df.filter((t != "") & ~t.isin(*S.BINS)).select("doc_id", "bin_label").limit(5).collect()
    if bad:
        raise ValueError(f"unknown bins: {bad}")
    return df.filter(t != "")


def fill_scan_labels(known: DataFrame, wanted: DataFrame, computed: DataFrame) -> DataFrame:
    """Known labels, and computed ones for the documents that lack one, sorted."""
    missing = wanted.select("doc_id").distinct().join(known, "doc_id", "left_anti").join(computed, "doc_id")
    return known.select("doc_id", "auto_scan").unionByName(missing.select("doc_id", "auto_scan")).orderBy("doc_id")


def candidates(doc: Column) -> Column:
    """File names under which a document may be stored, the most likely first."""
    stem = F.regexp_replace(doc, r"\.pdf$", "")
    return F.array_distinct(F.array(doc, F.concat(stem, F.lit(".pdf")), F.concat(S.safe_stem(stem), F.lit(".pdf")), F.concat(F.element_at(F.split(stem, ":"), -1), F.lit(".pdf"))))


def resolve_paths(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """doc_id with the path of its first candidate name that the listing has."""
    c = docs.select("doc_id", F.posexplode(candidates(F.col("doc_id"))).alias("rank", "name"))
    hit = c.join(listing, "name").groupBy("doc_id").agg(F.min_by("path", "rank").alias("path"))
    return docs.join(hit, "doc_id", "left")


def queue(lines: DataFrame) -> DataFrame:
    """Pipe-delimited queue lines: id, partition, name, user, state, submit, start, gres."""
    p = F.split("value", r"\|")
    names = ("job", "partition", "name", "user", "state", "submit", "start", "gres")
    df = lines.filter(F.col("value").contains("|")).select(*[F.trim(F.get(p, F.lit(i))).alias(n) for i, n in enumerate(names)])
    wait = F.unix_timestamp(F.try_to_timestamp("start", F.lit("yyyy-MM-dd'T'HH:mm:ss"))) - F.unix_timestamp(F.try_to_timestamp("submit", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return df.withColumn("wait", S.wait_text(wait)).withColumn("gpus", S.gres_count(F.col("gres")))


def queue_wait(jobs: DataFrame, now: Column, offset: Column) -> DataFrame:
    """jobs with waited: how long a running job stood in the queue, or a pending one stands by now; 'unknown' without a submit time. offset: minutes east of UTC of the scheduler's clock."""
    at = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss"))) - offset * 60
    until = F.coalesce(F.when(F.col("state") == "R", at(F.col("start"))), F.unix_timestamp(now))
    return jobs.withColumn("waited", F.coalesce(S.wait_text(until - at(F.col("submit"))), F.lit("unknown")))


# The fields of an accounting line.
ACCOUNT = ("job", "name", "user", "state", "elapsed", "submitted", "started", "ended", "partition", "tres")


def completed(lines: DataFrame, partition: str | None = None, limit: int = 10) -> DataFrame:
    """Completed jobs of pipe-delimited accounting lines, the newest end first; jobs without an end time last."""
    p = F.split("value", r"\|", len(ACCOUNT))
    df = lines.filter(F.size(p) == len(ACCOUNT)).select(*[F.trim(F.get(p, F.lit(i))).alias(n) for i, n in enumerate(ACCOUNT)])
    df = df.filter(F.split("state", r"\s+")[0] == "COMPLETED")
    df = df if partition is None else df.filter(F.col("partition") == partition)
    known = F.when(~F.col("ended").isin("", "Unknown"), F.col("ended"))
    return df.orderBy(F.desc_nulls_last(known), "job").limit(max(limit, 0))


def nodes(lines: DataFrame) -> DataFrame:
    """Blocks of key=value pairs: node, state, cpus, memory in MiB, devices."""
    m = F.str_to_map("value", F.lit(r"\s+"), F.lit("="))
    v = lines.filter(F.col("value").contains("NodeName=")).select(m.alias("m"))
    get = lambda k: F.element_at("m", F.lit(k))
    return v.select(get("NodeName").alias("node"), get("State").alias("state"), get("CPUTot").try_cast("int").alias("cpus"), S.memory_mib(get("RealMemory")).alias("mib"), S.gres_count(get("Gres")).alias("gpus"))


def node_totals(n: DataFrame) -> DataFrame:
    return n.agg(F.count(F.lit(1)).alias("nodes"), F.sum("cpus").alias("cpus"), F.sum("gpus").alias("gpus"), F.sum("mib").alias("mib"))


def rendered_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page_index, text of text documents read whole; form feeds part the pages (binary formats need a renderer as a UDF)."""
    b = spark.read.format("binaryFile").load(path)
    t = b.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("page_index", "text"))
    return t
