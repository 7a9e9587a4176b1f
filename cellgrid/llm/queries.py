"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import first_delivery
from ..session import table
from . import endings, languages, leakage, lookalike, pairs, proportions, scans, tokenize


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and differ in a character."""
    return lookalike.lookalike_pairs(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a twin, its class and the number of its links."""
    return lookalike.lookalike_classes(table(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in the consistent form."""
    return lookalike.normalize(table(spark, sf_dir, "documents"), "text", "form").select("doc_id", "form")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokenize.encode_column(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage or question of the test material, with the item."""
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _pages(spark: SparkSession, sf_dir: str, text: bool) -> DataFrame:
    pages = table(spark, sf_dir, "doc_pages")
    q = table(spark, sf_dir, "questions").filter(proportions.label_key(F.col("scan_label")) == "scanned")
    return scans.examine(pages, q.select("doc_id"), text)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise of each line of scanned documents."""
    found = _pages(spark, sf_dir, False).select("doc_id", "page_index", F.explode(F.arrays_zip("span_no", "noise")).alias("f"))
    return found.select("doc_id", "page_index", "f.span_no", "f.noise")


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running text of each page of scanned documents."""
    return _pages(spark, sf_dir, True).select("doc_id", "page_index", "text")


def _cut(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    p, q = table(spark, sf_dir, "predictions"), table(spark, sf_dir, "questions")
    return endings.find_cut(p, "text", keep, q.select("question"), "output_tokens")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text was cut."""
    return _cut(spark, sf_dir, ["seq"]).filter("cut").select("seq")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model the share of its rows with text that are cut."""
    return endings.rates(_cut(spark, sf_dir, ["seq", "model_spec"]), "model_spec")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished rows with a defect, and its type."""
    p, q = table(spark, sf_dir, "predictions"), table(spark, sf_dir, "questions")
    done = p.filter("status is null or status = 'ok'").select("seq", "question_id", "text", "is_unanswerable")
    asked = first_delivery(q, "question_id", "ingested_at", ["question_id", "question"])
    lang = languages.learn(table(spark, sf_dir, "documents"))
    return pairs.find_defects(done, asked, values=p, complete=q.select("question"), lang=lang)


LABELS = ["doc_type", "bin_label"]


def _draw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, t = table(spark, sf_dir, "questions"), table(spark, sf_dir, "sample_targets")
    return proportions.draw(q, t, "question_id", "ingested_at", LABELS, ["doc_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with fewer questions than their share or minimum asks for."""
    return _draw(spark, sf_dir)[1].filter("short > 0").select(*LABELS)


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself."""
    return _draw(spark, sf_dir)[0]


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category what was asked for, there, drawn and missing."""
    return _draw(spark, sf_dir)[1]


_P4 = """
WITH q AS (SELECT question_id, min_by(doc_type, ingested_at) dt, min_by(bin_label, ingested_at) bl FROM questions
           WHERE question_id IS NOT NULL GROUP BY question_id),
     have AS (SELECT regexp_replace(lower(dt), '[\\s-]', '', 'g') a, regexp_replace(lower(bl), '[\\s-]', '', 'g') b, count(*) n
              FROM q GROUP BY ALL),
     want AS (SELECT doc_type, bin_label, target_pct, min_rows, sample_rows,
                     greatest(min_rows, CAST(ceil(target_pct * sample_rows / 100.0) AS BIGINT)) AS wanted,
                     coalesce(n, 0) AS available
              FROM sample_targets LEFT JOIN have ON a = regexp_replace(lower(doc_type), '[\\s-]', '', 'g')
                   AND b = regexp_replace(lower(bin_label), '[\\s-]', '', 'g'))
"""
_P4_REPORT = _P4 + """,
seat AS (SELECT doc_type, bin_label, target_pct, min_rows, sample_rows, k, k <= min_rows AS base,
                CASE WHEN target_pct > 0 THEN (k - 0.5) / target_pct END AS priority
         FROM (SELECT *, unnest(range(1, least(available, greatest(sample_rows, min_rows)) + 1)) AS k FROM want)),
placed AS (SELECT *, row_number() OVER (ORDER BY base DESC, priority ASC NULLS LAST, regexp_replace(lower(doc_type), '[\\s-]', '', 'g'),
                  regexp_replace(lower(bin_label), '[\\s-]', '', 'g'), k) AS place
           FROM seat WHERE target_pct > 0 OR base),
given AS (SELECT doc_type, bin_label, count(*) AS seats FROM placed WHERE base OR place <= sample_rows GROUP BY ALL)
SELECT w.doc_type, w.bin_label, target_pct, min_rows, sample_rows, wanted, available, coalesce(seats, 0) AS seats,
       greatest(wanted - available, 0) AS short
FROM want w LEFT JOIN given g ON w.doc_type = g.doc_type AND w.bin_label = g.bin_label
"""

QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_sample": p4_sample,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_pages": p5_pages,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_forms": p9_forms,
}
ORACLE: dict[str, str] = {
    "p4_found": _P4 + "SELECT doc_type, bin_label FROM want WHERE available < wanted",
    "p4_report": _P4_REPORT,
}
