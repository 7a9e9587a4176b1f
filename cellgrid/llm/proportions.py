"""A sample whose category shares match given target proportions.

Divisor method: the rows of a category are numbered in a random order (a seeded hash of the
key); the row of rank k has the priority (k - 1/2) / target. The rows of every category's
minimum come first, then the rows of the globally smallest priorities until the sample is
full. A category that has no rows left offers no priorities, so its seats go to the next
ones by themselves.

Ranks are row numbers within (category, slice of the hash), plus the counts of the slices
before: no task sorts a whole category, however large. The bound that the globally smallest
priorities end at is their exact order statistic, found by counting passes (see
percentiles); rows that tie at the bound, one per category at most, are taken by name.

Defined results: labels that differ in case, blanks or hyphens are one; null or blank
labels are no category; a key counts once (its first delivery, ties by the least labels);
null keys are left out; ties in the hash are broken by the key; categories without rows
are reported with what they lack; if the minima alone exceed the sample size, they are
all kept and the sample is larger; of a repeated category the least row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.percentiles import exact_percentiles
from ..session import broadcast_if_small, cut_lineage

#: Slices that a category's hash range is cut into; a slice is ordered by one task.
SLICES = 4096


def label_key(c: Column) -> Column:
    """Letter case, blanks and hyphens removed; null for what is blank."""
    k = F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{Pd}­​﻿]", "")
    return F.when(k == "", None).otherwise(k)


def categories(targets: DataFrame, labels: list[str]) -> DataFrame:
    """One row per category of the targets table, with its key columns __k0.. and wanted rows."""
    keys = [label_key(F.col(l)).alias(f"__k{i}") for i, l in enumerate(labels)]
    row = ["target_pct", "min_rows", "sample_rows", *labels]
    t = targets.select(*keys, F.struct(*row).alias("t")).groupBy(*[f"__k{i}" for i in range(len(labels))]).agg(F.min("t").alias("t"))
    t = t.select(*[f"__k{i}" for i in range(len(labels))], "t.*").select(*labels, "target_pct", "min_rows", "sample_rows", *[f"__k{i}" for i in range(len(labels))])
    share = F.ceil(F.col("target_pct") * F.col("sample_rows") / F.lit(100.0))
    return t.withColumn("wanted", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), share.cast("long")))


def _members(rows: DataFrame, key: str, order: str, labels: list[str], keep: list[str]) -> DataFrame:
    """key, __k0.., keep..: one row per distinct key that has all labels."""
    ks = [label_key(F.col(l)).alias(f"__k{i}") for i, l in enumerate(labels)]
    first = F.min(F.struct(F.col(order).alias("o"), *ks, *[F.col(c) for c in keep])).alias("f")
    one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(first)
    one = one.select(key, *[F.col(f"f.__k{i}").alias(f"__k{i}") for i in range(len(labels))], *[F.col(f"f.{c}").alias(c) for c in keep])
    return one.dropna(subset=[f"__k{i}" for i in range(len(labels))])


def _numbered(members: DataFrame, cats: DataFrame, n: int, ks: list[str], key: str) -> DataFrame:
    """members with place (the rank within the category), base (within the minimum) and priority."""
    per_slice = members.groupBy(*ks, "__s").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*ks).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    # categories x slices rows at most
    per_slice = cut_lineage(per_slice.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c"))
    rank = F.row_number().over(Window.partitionBy(*ks, "__s").orderBy("__h", key))
    ranked = members.withColumn("__r", rank).join(broadcast_if_small(per_slice, per_slice.count()), [*ks, "__s"])
    ranked = ranked.withColumn("place", (F.col("__r") + F.col("before")).cast("long")).drop("__r", "before", "__s")
    told = broadcast_if_small(cats.select(*ks, "target_pct", "min_rows"), n)
    priority = F.when(F.col("target_pct") > 0, (F.col("place") - 0.5) / F.col("target_pct"))
    base = F.col("place") <= F.coalesce("min_rows", F.lit(0))
    return ranked.join(told, ks).withColumn("base", base).withColumn("priority", priority).drop("target_pct", "min_rows")


def _kept(numbered: DataFrame, total: int, ks: list[str]) -> DataFrame:
    """The rows of the sample: minima, then the smallest priorities; ties by name."""
    least = numbered.filter("base")
    more = numbered.filter("not base and priority is not null")
    counted = numbered.agg(F.sum(F.col("base").cast("long")).alias("b"), F.sum((~F.col("base") & F.col("priority").isNotNull()).cast("long")).alias("m")).first()
    left = max(total - (counted.b or 0), 0)
    if left >= (counted.m or 0):
        return least.unionByName(more)
    if not left:
        return least
    bound = exact_percentiles(more, [], ["priority"], (0.5,), rank=lambda n, q: F.lit(left).cast("long")).first()["p50"]
    under = more.filter(F.col("priority") < bound)
    # a category has one row of a priority, so the tied rows are as few as the categories
    tied = more.filter(F.col("priority") == bound).withColumn("__t", F.row_number().over(Window.orderBy(*ks))).filter(F.col("__t") <= left - under.count()).drop("__t")
    return least.unionByName(under).unionByName(tied)


def draw(
    rows: DataFrame, targets: DataFrame, key: str, order: str, labels: list[str], keep: list[str], seed: int = 7, slices: int = SLICES
) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: key, keep.., labels.. as in targets, place, priority; report: labels.. and counts."""
    ks = [f"__k{i}" for i in range(len(labels))]
    cats = cut_lineage(categories(targets, labels))
    told = cats.agg(F.count(F.lit(1)).alias("n"), F.max("sample_rows").alias("total")).first()
    names = broadcast_if_small(cats.select(*ks), told.n)
    h = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    members = cut_lineage(
        _members(rows, key, order, labels, keep).join(names, ks, "left_semi")
        .withColumn("__h", h).withColumn("__s", F.pmod(F.shiftright("__h", 40), F.lit(slices)).cast("int"))
    )
    numbered = cut_lineage(_numbered(members, cats, told.n, ks, key))
    kept = cut_lineage(_kept(numbered, told.total or 0, ks))
    there = numbered.groupBy(*ks).agg(F.max("place").alias("available"))
    seats = kept.groupBy(*ks).agg(F.count(F.lit(1)).alias("seats"))
    # one row per category on either side
    zero = F.lit(0).cast("long")
    report = cats.join(there, ks, "left").join(seats, ks, "left").select(
        *labels, "target_pct", "min_rows", "sample_rows", "wanted", F.coalesce("available", zero).alias("available"), F.coalesce("seats", zero).alias("seats"),
        # short: its last rank is under what was wanted
        F.greatest(F.col("wanted") - F.coalesce("available", zero), zero).alias("short"),
    )
    clash = [c for c in keep if c not in labels]
    sample = kept.drop(*[l for l in labels if l in keep]).join(broadcast_if_small(cats.select(*ks, *labels), told.n), ks)
    return sample.select(key, *clash, *labels, "place", "priority"), report
