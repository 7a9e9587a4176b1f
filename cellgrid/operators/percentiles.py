"""Percentiles of very large numeric columns by exact bisection, and mergeable summaries.

`exact_percentiles` keeps one value interval per (group, measure, percentile). Each pass
counts, in one scan with map-side combination, the rows below each of the midpoints that
cut an interval into equal parts, then keeps the part that holds the target rank, shrunk
to the least and greatest value found in it. It ends when every interval holds a single
value, so the result is the order statistic itself: no error, whatever the distribution.
What is held is the interval table (groups x measures x percentiles rows); no group is
ever gathered or sorted. A pass cuts an interval into `parts` pieces, so doubles need few
passes.

`summarize` writes, per partition (a run, a day), counts of log-spaced value bins.
Summaries of any set of partitions are joined by adding counts; `merged_percentiles`
finds the bin of the target rank by the same narrowing over the cumulated counts. The
bin is that of the exact order statistic, so the value is off by a factor of at most
(1 + error).

Defined results: null, NaN, infinite and non-positive values are no measurements (failed
cells report zeros) and are left out; null group keys form a group of their own; a group
without measurements gives no row; ties and repeated rows count as often as they occur.
The percentile q of n values is the value of rank max(1, ceil(q * n)).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, broadcast_if_small, cut_lineage

#: Equal pieces that one pass cuts an interval into.
PARTS = 512
#: Passes before the search gives up; 7 suffice for any doubles at 512 pieces when values are spread evenly.
MAX_PASSES = 40


def _measurements(df: DataFrame, groups: list[str], measures: list[str]) -> DataFrame:
    """Rows (g0.., measure, value) of the usable measurements; null keys kept."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").cast("double").alias("value")) for m in measures]
    )
    keys = [F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(groups)]
    long = df.select(*keys, F.explode(pairs).alias("__m")).select(
        *[f"__g{i}" for i in range(len(groups))], "__m.measure", "__m.value"
    )
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0) & (F.col("value") < float("inf"))
    return long.filter(ok)


def _name(q: float) -> str:
    return "p" + f"{float(Fraction(str(q)) * 100):.12g}".replace(".", "_")


def _rank(n: Column, q: float) -> Column:
    """ceil(q * n), at least 1; exact: q as the fraction that its decimals say."""
    f = Fraction(str(q))
    wide = n.cast("decimal(38,0)")
    above = (wide * f.numerator + F.lit(f.denominator - 1)).cast("decimal(38,0)")
    return F.greatest(F.lit(1).cast("long"), F.call_function("div", above, F.lit(f.denominator).cast("decimal(20,0)")).cast("long"))


def nearest_even(n: Column, q: float) -> Column:
    """The other definition in use: place round(q * (n - 1)), halves to even, from 0."""
    return F.bround(F.lit(q) * (n - 1)).cast("long") + 1


def exact_percentiles(
    df: DataFrame, groups: list[str], measures: list[str], qs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), parts: int = PARTS,
    rank: Callable[[Column, float], Column] = _rank,
) -> DataFrame:
    """groups.., measure, n, one column per percentile (p50, p90, ...)."""
    rows = _measurements(df, groups, measures)
    keys = [f"__g{i}" for i in range(len(groups))] + ["measure"]
    start = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    targets = F.array(*[F.struct(F.lit(i).alias("q"), rank(F.col("n"), q).alias("rank")) for i, q in enumerate(qs)])
    live = cut_lineage(
        start.select(*keys, "n", "lo", "hi", F.explode(targets).alias("t")).select(
            *keys, "n", "lo", "hi", "t.q", "t.rank", F.lit(0).cast("long").alias("below")
        )
    )
    done: list[DataFrame] = []
    for _ in range(MAX_PASSES):
        done.append(live.filter("lo = hi").select(*keys, "n", "q", F.col("lo").alias("value")))
        live = live.filter("lo < hi")
        left = live.count()
        if not left:
            break
        live = cut_lineage(_narrow(rows, live, keys, parts, left))
    else:
        raise RuntimeError("the bisection did not end")
    found = reduce(DataFrame.unionByName, done)
    wide = found.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("q") == i, F.col("value"))).alias(_name(q)) for i, q in enumerate(qs)]
    )
    return wide.select(
        *[F.col(f"__g{i}").alias(g) for i, g in enumerate(groups)], "measure", "n", *[_name(q) for q in qs]
    )


def _narrow(rows: DataFrame, live: DataFrame, keys: list[str], parts: int, left: int) -> DataFrame:
    """One pass: count below the midpoints of every open interval, keep the piece with the rank."""
    # distinct intervals: percentiles that still share one are counted together
    spans = live.groupBy(*keys, "lo", "hi").agg(F.count(F.lit(1)).alias("__k")).drop("__k")
    cond = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    # midpoints by ratio while an interval spans magnitudes, else by difference: stalls cost no extra passes
    by_ratio = (F.ln("value") - F.ln("lo")) / (F.ln("hi") - F.ln("lo"))
    by_difference = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    share = F.when(F.col("hi") / F.col("lo") > 4, by_ratio).otherwise(by_difference)
    piece = F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int")
    if left <= BROADCAST_ROWS:
        joined = rows.alias("r").join(F.broadcast(spans).alias("s"), cond & inside)
    else:  # too many groups to broadcast: spread each key over salts by row, so that no task gets a hot group, or a hot value, whole
        salts = 32
        joined = (
            rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).alias("r").join(
                spans.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("s"),
                cond & (F.col("r.__salt") == F.col("s.__salt")) & inside,
            )
        )
    counts = (
        joined.select(*[F.col(f"r.{k}").alias(k) for k in keys], "lo", "hi", piece.alias("piece"), "value")
        .groupBy(*keys, "lo", "hi", "piece")
        .agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("a"), F.max("value").alias("b"))
    )
    w = Window.partitionBy(*keys, "lo", "hi").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    match = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, "lo", "hi"]])
    at = F.col("l.rank") - F.col("l.below")
    return (
        broadcast_if_small(live, left).alias("l").join(
            pieces.alias("p"), match & (at > F.col("p.before")) & (at <= F.col("p.before") + F.col("p.c"))
        )
        .select(
            *[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.n").alias("n"), F.col("p.a").alias("lo"),
            F.col("p.b").alias("hi"), F.col("l.q").alias("q"), F.col("l.rank").alias("rank"),
            (F.col("l.below") + F.col("p.before")).alias("below"),
        )
    )


def summarize(df: DataFrame, part: str, groups: list[str], measures: list[str], error: float = 0.005) -> DataFrame:
    """part, groups.., measure, bin, c: counts of bins of ratio (1 + error)^2. Summaries are joined by union."""
    rows = _measurements(df.withColumn("__part", F.col(f"`{part}`")), ["__part", *groups], measures)
    keys = [f"__g{i}" for i in range(len(groups) + 1)]
    width = 2 * math.log1p(error)
    counted = rows.groupBy(*keys, "measure", F.floor(F.ln("value") / F.lit(width)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("c")
    )
    return counted.select(*[F.col(k).alias(n) for k, n in zip(keys, [part, *groups])], "measure", "bin", "c")


def merged_percentiles(
    summary: DataFrame, groups: list[str], qs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), error: float = 0.005
) -> DataFrame:
    """Percentiles of the union of the given summaries: the middle of the bin that holds the rank."""
    width = 2 * math.log1p(error)
    keys = [f"`{g}`" for g in groups]
    bins = summary.groupBy(*keys, "measure", "bin").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys, "measure")
    cum = bins.withColumn("n", F.sum("c").over(w)).withColumn(
        "upto", F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    )
    middle = F.exp((F.col("bin") + 0.5) * F.lit(width))
    return cum.groupBy(*keys, "measure", "n").agg(
        *[F.min(F.when(F.col("upto") >= _rank(F.col("n"), q), middle)).alias(_name(q)) for q in qs]
    )
