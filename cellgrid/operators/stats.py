"""Statistics over judged rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import RUNGS, draws, rank_of


def _share(flag: str | Column) -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.sum(c.cast("long")) / F.count(F.lit(1))


def accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, accuracy."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _share("correct").alias("accuracy"))


def accuracy_with_total(rows: DataFrame, detail: str, keys: list[str]) -> DataFrame:
    """accuracy per (keys, detail) and pooled over detail ('(all)')."""
    sets = [[F.col(k) for k in [*keys, detail]], [F.col(k) for k in keys]]
    out = rows.groupingSets(sets, *[F.col(k) for k in [*keys, detail]]).agg(
        F.count(F.lit(1)).alias("n"), _share("correct").alias("accuracy"), F.grouping(detail).alias("__g"))
    return out.withColumn(detail, F.when(F.col("__g") == 1, "(all)").otherwise(F.col(detail))).drop("__g")


def bootstrap(rows: DataFrame, keys: list[str], rounds: int = 1000, seed: int = 0, max_docs: int = 2000, cluster: str = "doc_id") -> DataFrame:
    """keys, n_docs, n, accuracy, ci_low, ci_high: document-level bootstrap.

    Every group takes the draws of the seeded generator itself, documents in sorted order,
    whatever its size. They are read a piece at a time beside two numbers a document, so a
    task holds 16 bytes for each document of one group; ids stay behind at the sort.
    max_docs changes nothing; callers still name it.
    """
    docs = rows.groupBy(*keys, cluster).agg(F.sum(F.col("correct").cast("long")).alias("s"), F.count(F.lit(1)).alias("c"))
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    docs = docs.select(F.xxhash64(group).alias("g"), group.alias("keys"), F.col(cluster).alias("doc"), "s", "c")
    total = docs.groupBy("g", "keys").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("accuracy"))

    def bounds(g: int, parts: list[np.ndarray]) -> pd.DataFrame:
        x = np.concatenate(parts, axis=1)
        n = x.shape[1]
        if n < 2:
            return pd.DataFrame({"g": [], "lo": [], "hi": []})
        sums, at = np.zeros((2, rounds)), 0
        for places in draws(n, rounds, seed):
            first = at // n
            starts = np.concatenate([[0], np.arange((first + 1) * n, at + len(places), n) - at])
            for i in (0, 1):
                sums[i, first : first + len(starts)] += np.add.reduceat(x[i][places], starts)
            at += len(places)
        lo, hi = np.quantile(sums[0] / sums[1], [0.025, 0.975])
        return pd.DataFrame({"g": [g], "lo": lo, "hi": hi})

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for pdf in batches:
            for g, part in pdf.groupby("g", sort=False):
                if g != now and parts:
                    yield bounds(now, parts)
                    parts = []
                now = g
                parts.append(part[["s", "c"]].to_numpy(np.int64).T)
        if parts:
            yield bounds(now, parts)

    if rounds:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = docs.select("g", "doc", "s", "c").repartition(tasks, "g").sortWithinPartitions("g", F.asc_nulls_last("doc")).select("g", "s", "c")
        total = total.join(ordered.mapInPandas(drawn, "g long, lo double, hi double"), "g", "left")
    else:
        total = total.withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double"))
    return total.select(*[F.col(f"keys.{k}").alias(k) for k in keys], "n_docs", "n", "accuracy", F.coalesce("lo", "accuracy").alias("ci_low"), F.coalesce("hi", "accuracy").alias("ci_high"))


def frontier(cells: DataFrame, keys: list[str], margin: float = 3.0) -> DataFrame:
    """keys, rung: the cheapest rung whose upper bound reaches the best accuracy less the margin."""
    m = margin / 100 if margin > 1 else margin
    known = cells.filter(F.col("representation").isin(*RUNGS)).withColumn("__r", rank_of(F.col("representation"), RUNGS))
    best = known.withColumn("__bar", F.max("accuracy").over(Window.partitionBy(*keys)) - m)
    enough = F.col("ci_high") >= F.col("__bar")
    return best.groupBy(*keys).agg(
        F.coalesce(F.min_by("representation", F.when(enough, F.col("__r"))), F.max_by("representation", "__r")).alias("rung"))


def kappa(rows: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, observed, expected, kappa of two label columns (rows with both)."""
    keys = keys or []
    r = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _share(F.col(a) == F.col(b)).alias("observed"))
    ca = r.groupBy(*keys, F.col(a).alias("label")).agg(F.count(F.lit(1)).alias("x"))
    cb = r.groupBy(*keys, F.col(b).alias("label")).agg(F.count(F.lit(1)).alias("y"))
    prod = ca.join(cb, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    j = both.join(prod, keys, "left") if keys else both.withColumn("__k", F.lit(1)).join(prod.withColumn("__k", F.lit(1)), "__k")
    expected = F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n"))
    j = j.withColumn("expected", expected)
    k = F.when(F.col("expected") == 1, (F.col("observed") == 1).cast("double")).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return j.filter("n > 0").select(*keys, "n", "observed", "expected", k.alias("kappa"))


def cost(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means of latencies, sums of tokens, peak memory."""
    total = F.coalesce("total_text_tokens", F.lit(0)) + F.coalesce("total_visual_tokens", F.lit(0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("latency_s", "prefill_latency_s", "decode_latency_s")],
        F.sum("total_text_tokens").alias("text_tokens"), F.sum("total_visual_tokens").alias("visual_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(total).alias("all_tokens"), F.max("peak_vram_bytes").alias("peak_vram_bytes"))


def transitions(rows: DataFrame, pairs: tuple[tuple[str, str], ...], by: str | None = None, explode: str | None = None) -> DataFrame:
    """pairing, group, n and the four rates between two rungs of the same question (last row per question and rung)."""
    cols = [c for c in (by, explode) if c]
    rungs = sorted({r for p in pairs for r in p})
    row = F.struct("correct", *cols)
    # one shuffle: the last row of each rung beside the others
    last = rows.filter(F.col("representation").isin(*rungs)).groupBy("question_id").agg(*[F.max_by(row, F.when(F.col("representation") == r, F.col("seq"))).alias(r) for r in rungs])
    met = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(f"{a}>{b}").alias("pairing"), F.col(a).alias("a"), F.col(b)["correct"].alias("y"))) for a, b in pairs]
    j = last.select("question_id", F.explode(F.filter(F.array(*met), lambda p: p.isNotNull())).alias("p"))
    j = j.select("p.pairing", "question_id", *[F.col(f"p.a.{c}").alias(c) for c in cols], F.col("p.a.correct").alias("x"), "p.y")
    rates = [F.count(F.lit(1)).alias("n"), *[
        _share((F.col("x") == a) & (F.col("y") == b)).alias(n)
        for n, a, b in (("wrong_right", False, True), ("right_wrong", True, False), ("right_right", True, True), ("wrong_wrong", False, False))]]
    pooled = j.groupBy("pairing").agg(*rates).withColumn("group", F.lit("(all)"))
    if explode:
        src = F.when(F.size(explode) > 0, F.col(explode)).otherwise(F.array(F.lit("(none)")))
        detail = j.withColumn("group", F.explode(src)).groupBy("pairing", "group").agg(*rates)
    elif by:
        detail = j.groupBy("pairing", F.col(by).alias("group")).agg(*rates)
    else:
        return pooled
    return detail.unionByName(pooled)


#: Agreement from which on two readers count as one.
GATE = 0.75


def agreement_passes(kappa_value: Column, gate: float = GATE) -> Column:
    return kappa_value >= gate


def labelled_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """kappa() over the fixed agreement labels, free spellings brought to them; unknown labels and empty tables raise."""
    from ..functions.scalar import agreement_label

    r = rows.select(*[F.when(F.col(c).isNotNull(), F.coalesce(agreement_label(F.col(c)), F.raise_error(F.concat(F.lit("unknown agreement label: "), F.col(c))).cast("string"))).alias(c) for c in (a, b)])
    out = kappa(r, a, b)
    if out.isEmpty():
        raise ValueError("at least one labelled item is required")
    return out
