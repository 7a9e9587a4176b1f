"""Corpus filters, seeded document draws and the grid of experiment cells."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .packed import first_delivery

QUESTION = ["question_id", "doc_id", "doc_type", "question", "answer", "evidence_pages", "evidence_sources", "answer_format", "bin_label", "scan_label", "source_dataset"]


def corpus(questions: DataFrame) -> DataFrame:
    """Distinct questions with parsed pages, hop and is_unanswerable (never taken from the input)."""
    q = first_delivery(questions, "question_id", "ingested_at", QUESTION)
    pages = F.when(F.col("source_dataset") == "longdocurl", S.zero_based_pages(F.col("evidence_pages"), 0)).otherwise(S.zero_based_pages(F.col("evidence_pages"), 1))
    q = q.withColumn("pages", pages)
    return q.withColumn("hop", S.hop_of(F.col("pages"))).withColumn("is_unanswerable", S.is_not_answerable(F.col("answer")))


POOLS, HOPS = ("all", "answerable", "unanswerable"), ("any", "none", "single", "multi")


def in_pool(pool: str) -> Column:
    if pool not in POOLS:
        raise ValueError(f"unknown pool {pool!r}")
    return F.lit(True) if pool == "all" else F.col("is_unanswerable") == (pool == "unanswerable")


def in_hop(hop: str | int) -> Column:
    if isinstance(hop, int):
        return F.size("pages") == hop
    return F.lit(True) if hop == "any" else F.col("hop") == hop


def select(c: DataFrame, scan: str = "any", pool: str = "all", hop: str | int = "any", labels: DataFrame | None = None) -> DataFrame:
    """scan, then pool, then hop."""
    if scan != "any":
        label = F.lower(F.trim("scan_label"))
        if labels is not None:
            dim = labels.select("doc_id", F.col("auto_scan").alias("__s"))
            c = c.join(dim, "doc_id", "left")
            label = F.coalesce(F.when(label != "", label), F.col("__s"))
        c = c.filter(label == scan).drop("__s")
    return c.filter(in_pool(pool)).filter(in_hop(hop))


def coherent_draw(c: DataFrame, group: str, target: int, seed: int = 0, cap: bool = False, shuffled: int = 200_000) -> DataFrame:
    """Whole documents in a seeded shuffle per group until the target is reached; groups at or below it stay whole.

    The shuffle depends only on the seed and the number of documents, so a task makes it once for each such
    number (4 bytes a document) and it is joined by rank. The first `target` places suffice, as a document has a
    question at least. shuffled changes nothing; callers still name it.
    """
    key = lambda a, b: F.col(f"{a}.{group}").eqNullSafe(F.col(f"{b}.{group}"))
    docs = c.groupBy(group, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("question_id").alias("first"))
    totals = docs.groupBy(group).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    d = docs.alias("d").join(totals.alias("t"), key("d", "t")).select("d.*", "docs", "total")
    w = Window.partitionBy(group)
    some = d.filter(F.col("total") > target).withColumn("i", F.row_number().over(w.orderBy("first", "doc_id")) - 1)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n in pdf["docs"]:
                first = S.shuffled_first(int(n), seed, target)
                yield pd.DataFrame({"docs": n, "i": first, "place": range(len(first))})

    sizes = totals.filter(F.col("total") > target).select("docs").distinct()
    ordered = some.join(sizes.mapInPandas(places, "docs long, i int, place int"), ["docs", "i"]).select(group, "doc_id", "n", "place")
    before = F.coalesce(F.sum("n").over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = ordered.withColumn("before", before).filter(F.col("before") < target).select(group, "doc_id", "place")
    whole = d.filter(F.col("total") <= target).select(group, "doc_id", F.lit(0).alias("place"))
    kept = taken.unionByName(whole)
    out = c.alias("c").join(kept.alias("k"), key("c", "k") & (F.col("c.doc_id") == F.col("k.doc_id"))).select("c.*", F.col("k.place").alias("place"))
    if cap:
        out = out.withColumn("__n", F.row_number().over(w.orderBy("place", "question_id"))).filter(F.col("__n") <= target).drop("__n")
    return out.drop("place")


def literal(spark, name: str, values: list) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def cells(c: DataFrame, rungs: tuple[str, ...], modes: tuple[str, ...], bases: tuple[str, ...], specs: tuple[str, ...], resolutions: tuple[str, ...] = ("",)) -> DataFrame:
    """Every question x rung x mode x base x model x resolution, with its condition; the factors are literals, so the product is a projection with a generator."""
    s = lambda name, vs: F.explode(F.array(*[F.lit(v) for v in vs])).alias(name)
    out = c
    for name, vs in (("representation", rungs), ("mode", modes), ("base", bases), ("model_spec", specs), ("visual_resolution", resolutions)):
        out = out.select("*", s(name, vs))
    visual = F.col("representation").contains("V")
    out = out.filter(visual | (F.col("visual_resolution") == resolutions[0])).withColumn("visual_resolution", F.when(visual, F.col("visual_resolution")).otherwise(""))
    return out.withColumn("condition", F.concat_ws("__", "base", F.when(F.col("mode") != "", F.col("mode"))))


def pageset_cells(c: DataFrame, rules: tuple[str, ...], rungs: tuple[str, ...], modes: tuple[str, ...]) -> DataFrame:
    """Cells of page-set rules with `skip`: why a (rule, question) pair makes no cell, null where it does."""
    s = lambda name, vs: F.explode(F.array(*[F.lit(v) for v in vs])).alias(name)
    g = c.select("*", s("base", rules))
    g = g.withColumn("skip", S.pageset_skip_reason(S.pageset_parts(F.col("base")), F.size("pages")))
    return g.select("*", s("representation", rungs)).select("*", s("mode", modes))


def spec_product(spec: dict[str, object]) -> list[dict[str, object]]:
    """A run's settings: the cross product of those given as lists, in the given order."""
    from itertools import product

    keys = list(spec)
    return [dict(zip(keys, vs)) for vs in product(*[v if isinstance(v, list) else [v] for v in spec.values()])]


def cap_per_group(c: DataFrame, group: str, n: int, order: str = "question_id") -> DataFrame:
    """At most n questions of each group, in corpus order; the limit runs before the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return c.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def uniform_sample(rows: DataFrame, order: list[str], k: int, seed: int = 0) -> DataFrame:
    """The rows at the places that the seeded generator samples from all rows in order; all of them where there are no more than k.

    Places are counted per partition of a range-partitioned table, so no task numbers all rows.
    """
    from ..session import cut_lineage

    n = rows.count()
    if n <= k:
        return rows
    places = random.Random(seed).sample(range(n), k)
    ordered = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    part = ordered.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = {r["__p"]: r["c"] for r in part.groupBy("__p").agg(F.count(F.lit(1)).alias("c")).collect()}
    starts, at = {}, 0
    for p in sorted(sizes):
        starts[p] = at
        at += sizes[p]
    # one number per partition and k places
    wanted = []
    for x in places:
        p = max(q for q in starts if starts[q] <= x)
        wanted.append((p, x - starts[p]))
    chosen = rows.sparkSession.createDataFrame(wanted, "__p int, __i long")
    return part.join(F.broadcast(chosen), ["__p", "__i"], "left_semi").drop("__p", "__i")
