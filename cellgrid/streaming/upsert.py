"""Fact rows as a stream (beyond the batch engine): append-only files in, one best row per cell out.

Each micro-batch writes the best row of each of its cells, v=<batch>, and nothing else; the
table is read as the newest whole version, c=<batch>, and what came after it, merged by
status priority. Every COMPACT batches the merged table is written as a whole version. A
batch that is replayed after a failure overwrites its own folder, so it gives the same table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import best_rows, with_status

#: Batches between two whole versions.
COMPACT = 16


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _finished(spark: SparkSession, target: str) -> dict[str, list[int]]:
    """The finished folders of each kind, c and v, by batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{target}/*=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    out: dict[str, list[int]] = {"c": [], "v": []}
    for f in found:
        kind, _, n = f.getPath().getParent().getName().partition("=")
        if kind in out and n.isdigit():
            out[kind].append(int(n))
    return {k: sorted(v) for k, v in out.items()}


def current(spark: SparkSession, target: str, key: tuple[str, ...], order: str = "seq", upto: int | None = None) -> DataFrame | None:
    """The table after all finished batches (or those up to one)."""
    done = _finished(spark, target)
    known = lambda n: upto is None or n <= upto
    whole = max((n for n in done["c"] if upto is None or n < upto), default=None)  # never what is about to be overwritten
    parts = [f"{target}/c={whole}"] if whole is not None else []
    parts += [f"{target}/v={n}" for n in done["v"] if known(n) and (whole is None or n > whole)]
    if not parts:
        return None
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in parts])
    return best_rows(rows, key, order) if len(parts) > 1 else rows


def upsert(target: str, key: tuple[str, ...], order: str = "seq", compact: int = COMPACT):
    """A foreachBatch function that adds a batch to target."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        best_rows(with_status(batch), key, order).write.mode("overwrite").parquet(f"{target}/v={batch_id}")
        if batch_id % compact == compact - 1:
            current(spark, target, key, order, batch_id).write.mode("overwrite").parquet(f"{target}/c={batch_id}")

    return merge


def run(spark: SparkSession, source: str, target: str, checkpoint: str, schema, key: tuple[str, ...], order: str = "seq") -> None:
    """Process everything that is there, then stop."""
    q = read_stream(spark, source, schema).writeStream.foreachBatch(upsert(target, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def first_per_key(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_rates(stream: DataFrame, at: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Rows and failures per window and model (an extension)."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), "model_spec").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("status", F.lit("ok")) != "ok").alias("failed"))
