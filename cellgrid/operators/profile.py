"""Profiles of a corpus: classes, lengths, documents, contingencies, annotation sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

# Name parts that tell what a column holds.
HINTS = {"question": ("question", "query"), "doc": ("doc_id", "document", "filename", "pdf"), "page": ("page",), "label": ("label", "type", "class", "format", "source")}


def find_columns(columns: list[str], kind: str) -> list[str]:
    return [c for c in columns if any(h in c.lower() for h in HINTS[kind])]


def class_breakdown(q: DataFrame, field: Column, name: str) -> DataFrame:
    """class, questions, docs of a list-valued or scalar field; each class once per question, '(none)' for no value."""
    vs = F.array_distinct(field)
    one = F.when(F.size(vs) == 0, F.array(F.lit("(none)"))).otherwise(vs)
    return q.select("question_id", "doc_id", F.explode(one).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("questions"), F.countDistinct("doc_id").alias("docs"))


def per_document(q: DataFrame, value: str, order: str) -> DataFrame:
    """The first non-null value of each document in row order, and its rows."""
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return q.groupBy("doc_id").agg(F.count(F.lit(1)).alias("questions"), first.alias(value))


def summarize(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, avg, min, max, median, rounded to one digit."""
    r = rows.filter(F.col(value).isNotNull())
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 1).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.median(value), 1).alias("median"))


def contingency(q: DataFrame, rows: str, cols: str, values: list[str]) -> DataFrame:
    """Counts of rows x cols with zeros; values names the columns."""
    out = q.groupBy(rows).pivot(cols, values).agg(F.count(F.lit(1)))
    return out.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])


def hop_histogram(q: DataFrame) -> DataFrame:
    """Questions and documents per number of gold pages."""
    n = F.size("pages")
    kind = F.when(n == 0, "zero (0 pages)").when(n == 1, "single (1 page)").otherwise(F.concat(F.lit("multi ("), n.cast("string"), F.lit(" pages)")))
    return q.withColumn("hop_class", kind).groupBy("hop_class").agg(F.count(F.lit(1)).alias("questions"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("doc_type").alias("doc_types"))


def heavy(c: Column, limit: int = 5000) -> Column:
    """A long string as its length only."""
    n = F.length(c)
    return F.struct(F.when(n > limit, F.lit(None)).otherwise(c).alias("value"), F.when(n > limit, n).alias("heavy_length"))


def text_length(c: Column) -> dict[str, Column]:
    return {"chars": F.length(c), "words": F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))}


def split_multi(c: Column, pattern: str = r"[,;|]") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def invalid_labels(sheet: DataFrame, column: str, allowed: tuple[str, ...], multi: bool = False) -> DataFrame:
    """Rows with a value outside the vocabulary; blanks are no values."""
    vs = split_multi(F.col(column)) if multi else F.filter(F.array(F.trim(F.coalesce(column, F.lit("")))), lambda x: x != "")
    bad = F.filter(vs, lambda x: ~x.isin(*allowed))
    return sheet.withColumn("bad", F.explode(bad))


def score_sheet(sheet: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, rows, filled, and the distinct values among the filled."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    one = sheet.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(filled(F.col(c))).alias(f"f_{c}") for c in columns],
                    *[F.countDistinct(F.when(filled(F.col(c)), F.trim(c))).alias(f"d_{c}") for c in columns])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"f_{c}").alias("filled"), F.col(f"d_{c}").alias("values")) for c in columns])
    return one.select(F.explode(items).alias("i")).select("i.*")


def fill_from_prior(sheet: DataFrame, column: str, prior: str, allowed: tuple[str, ...]) -> DataFrame:
    """Blank labels filled from a prior that is in the vocabulary."""
    take = (F.trim(F.coalesce(column, F.lit(""))) == "") & F.col(prior).isin(*allowed)
    return sheet.withColumn("was_filled", take).withColumn(column, F.when(take, F.col(prior)).otherwise(F.col(column)))


def seed_sheet(q: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per document with its first doc_type and scan estimate."""
    docs = q.groupBy("doc_id").agg(F.min_by("doc_type", "question_id").alias("doc_type"), F.count(F.lit(1)).alias("questions"))
    return docs.join(scans, "doc_id", "left")


def weight_bytes(tensors: DataFrame, bits: int) -> DataFrame:
    """model, bytes under a quantized layout: two-dimensional linear weights shrink, the rest stays."""
    linear = (F.size("shape") == 2) & ~F.col("name").rlike("(embed|lm_head|norm|bias)")
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    size = F.when(linear, n * bits / 8).otherwise(n * 2)
    return tensors.withColumn("b", size).groupBy("model").agg(F.sum("b").cast("long").alias("bytes"))


def doc_labels_checked(sheet: DataFrame) -> DataFrame:
    """The annotation dimension: rows with a bin label from the vocabulary."""
    return sheet.filter(F.trim(F.coalesce("bin_label", F.lit(""))).isin(*S.BINS))


def distributions(sheet: DataFrame, single: tuple[str, ...], multi: tuple[str, ...] = ()) -> DataFrame:
    """column, value, docs: how often each value occurs; blanks are no values."""
    vs = [F.struct(F.lit(c).alias("column"), F.array(F.trim(F.coalesce(c, F.lit("")))).alias("v")) for c in single]
    vs += [F.struct(F.lit(c).alias("column"), split_multi(F.col(c)).alias("v")) for c in multi]
    e = sheet.select(F.explode(F.array(*vs)).alias("e")).select("e.column", F.explode("e.v").alias("value"))
    return e.filter("value <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("docs"))


def is_complete(*columns: str) -> Column:
    """Whether every one of the columns is filled."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.trim(F.coalesce(c, F.lit(""))) != "")
    return out


def blind_subset(sheet: DataFrame, columns: tuple[str, ...], k: int, seed: int = 0) -> DataFrame:
    """A seeded sample of the fully labelled rows, their labels blanked."""
    from .grid import uniform_sample

    full = sheet.filter(is_complete(*columns))
    return uniform_sample(full, ["doc_id"], k, seed).withColumns({c: F.lit("") for c in columns})


def class_totals(q: DataFrame, classes: Column, name: str) -> DataFrame:
    """name, questions, docs, place: classes most frequent first (ties: first seen), and the totals, which count each question once."""
    some = F.when(F.size(F.array_distinct(classes)) > 0, F.array_distinct(classes)).otherwise(F.array(F.lit("(none)")))
    sums = [F.count(F.lit(1)).alias("questions"), F.countDistinct("doc_id").alias("docs")]
    each = q.select("question_id", "doc_id", F.explode(some).alias(name)).groupBy(name).agg(*sums, F.min("question_id").alias("first"))
    each = each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("questions"), "first", name))).drop("first")  # one row per class
    return each.unionByName(q.agg(*sums).select(F.lit("(all)").alias(name), "questions", "docs", F.lit(0).alias("place")))


def page_count(c: Column) -> Column:
    """A count from digits or from a list in brackets; null for others."""
    t = F.trim(c)
    items = F.filter(F.split(F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))), ","), lambda x: F.trim(x) != "")
    return F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(t.startswith("[") & t.endswith("]"), F.size(items))


def plain_key(c: Column) -> Column:
    """Letters and digits alone, in lower case: what keys are matched by."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def resolve_key(name: str, known: list[str]) -> str:
    """The known key that a free spelling stands for; raises where there is none."""
    flat = lambda x: "".join(c for c in x.lower() if c.isascii() and c.isalnum())
    found = [k for k in known if flat(k) == flat(name)]
    if not found:
        raise ValueError(f"unknown key {name!r}; known: {sorted(known)}")
    return found[0]
