"""Expected figures against built tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(found: DataFrame, expected: DataFrame) -> DataFrame:
    """check, gate, expected, found, status (pass, fail, skip). found: check, value. expected: check, gate, value, tolerance."""
    j = expected.select("check", "gate", F.col("value").alias("expected"), "tolerance").join(found.select("check", F.col("value").alias("found")), "check", "left")
    status = F.when(F.col("found").isNull(), "skip").when(F.abs(F.col("found") - F.col("expected")) <= F.col("tolerance"), "pass").otherwise("fail")
    return j.withColumn("status", status)


def gated(results: DataFrame) -> DataFrame:
    """Tables withheld because a check of theirs failed."""
    return results.filter("status = 'fail'").select("gate").distinct()


def weighted_rate(rates: DataFrame, rate: str = "rate", n: str = "n") -> DataFrame:
    return rates.agg((F.sum(F.col(rate) * F.col(n)) / F.sum(n)).alias("rate"), F.sum(n).alias("n"))
