"""Core queries p1 and p2 and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.packed import first_delivery, packed_values
from .operators.percentiles import exact_percentiles, merged_percentiles, summarize
from .session import table

GROUPS = ["model_spec", "representation"]
MEASURES = ["latency_s", "peak_vram_bytes"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per evidence label of each distinct question, with its position."""
    q = table(spark, sf_dir, "questions").select("question_id", "ingested_at", packed_values(F.col("evidence_sources")).alias("v"))
    # split where the file is read; what is shuffled are the members
    one = first_delivery(q, "question_id", "ingested_at", ["question_id", "v"])
    return one.select("question_id", F.posexplode("v").alias("pos", "evidence_source")).withColumn("pos", (F.col("pos") + 1).cast("int"))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of latency and memory per model and representation."""
    return exact_percentiles(table(spark, sf_dir, "predictions"), GROUPS, MEASURES)


def _rounded(df: DataFrame) -> DataFrame:
    """Far below the stated error, so that the last bits of exp do not show."""
    r = lambda c: F.when(F.col(c) >= 1e6, F.round(c, 0)).otherwise(F.round(c, 3)).alias(c)
    return df.select(*[r(c) if c.startswith("p") and c[1:].isdigit() else F.col(c) for c in df.columns])


def p2_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within 0.5 %, from summaries per day of recorded_at joined over all days."""
    p = table(spark, sf_dir, "predictions").withColumn("day", F.to_date("recorded_at"))
    return _rounded(merged_percentiles(summarize(p, "day", GROUPS, MEASURES), GROUPS))


def p2_merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from summaries per run_tag, joined."""
    return _rounded(merged_percentiles(summarize(table(spark, sf_dir, "predictions"), "run_tag", GROUPS, MEASURES), GROUPS))


_P2 = """
WITH long AS (
  SELECT model_spec, representation, 'latency_s' AS measure, latency_s AS v FROM predictions
  UNION ALL
  SELECT model_spec, representation, 'peak_vram_bytes', CAST(peak_vram_bytes AS DOUBLE) FROM predictions
), ok AS (SELECT * FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND v > 0 AND v < 'inf'::DOUBLE),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model_spec, representation, measure ORDER BY v) AS r,
         count(*) OVER (PARTITION BY model_spec, representation, measure) AS n FROM ok
)
"""
_PICK = ", ".join(
    f"max(CASE WHEN r = greatest(1, CAST((n * {m} + 999) // 1000 AS BIGINT)) THEN {{}} END) AS p{p}"
    for m, p in ((500, 50), (900, 90), (950, 95), (990, 99))
)
_P2_EXACT = _P2 + "SELECT model_spec, representation, measure, n, " + _PICK.format(*["v"] * 4) + " FROM ranked GROUP BY ALL"

_W = repr(2 * math.log1p(0.005))
_P2_MERGED = _P2.split(",\nranked")[0] + f""",
bins AS (SELECT model_spec, representation, measure, CAST(floor(ln(v) / {_W}) AS INT) AS bin, count(*) AS c FROM ok GROUP BY ALL),
cum AS (SELECT *, sum(c) OVER (PARTITION BY model_spec, representation, measure)::BIGINT AS n, sum(c) OVER (PARTITION BY model_spec, representation, measure ORDER BY bin) AS upto FROM bins)
SELECT model_spec, representation, measure, n, """ + ", ".join(
    f"CASE WHEN {_v} >= 1e6 THEN round({_v}, 0) ELSE round({_v}, 3) END AS p{p}" for m, p in ((500, 50), (900, 90), (950, 95), (990, 99))
    for _v in [f"min(CASE WHEN upto >= greatest(1, (n * {m} + 999) // 1000) THEN exp((bin + 0.5) * {_W}) END)"]) + " FROM cum GROUP BY ALL"

ORACLE = {"p2_percentiles": _P2_EXACT, "p2_merged_days": _P2_MERGED, "p2_merged_runs": _P2_MERGED}
QUERIES = {
    "p1_found": p1_found,
    "p2_percentiles": p2_percentiles,
    "p2_merged_days": p2_merged_days,
    "p2_merged_runs": p2_merged_runs,
}


# p1 as SQL: unwrap a list that was written as a string, mark ' / ', then take the members by one pattern
_D = r",;|\t\r\n\f、，；｜"
_QUOTED = r'"(?:[^"\\]|\\.|"")*"'
_SINGLE = r"'(?:[^'\\]|\\.|'\p{L})*'"
_PAREN = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_PLAIN = rf"[^{_D}\s\"“„«'(\x{{1F}}]"
_MEMBER = rf"(?:{_QUOTED}|“[^”]*”|«[^»]*»|{_SINGLE})|(?:{_PAREN}|{_PLAIN}['’]{_PLAIN}|{_PLAIN}|[ ]+{_PAREN}|[ ]+{_PLAIN})+"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_P1 = f"""
WITH q AS (SELECT question_id, arg_min(evidence_sources, ingested_at) AS f FROM questions WHERE question_id IS NOT NULL GROUP BY 1),
a AS (SELECT question_id, trim(f, E' \\t\\r\\n\\u00a0') AS t FROM q WHERE f IS NOT NULL),
b AS (SELECT question_id, t, CASE WHEN regexp_matches(t, '^"\\s*[\\[{{(].*[\\]}})]\\s*"$') AND contains(t, '\\"') THEN regexp_replace(t[2:-2], '\\\\(["\\\\/])', '\\1', 'g') ELSE t END AS u
      FROM a WHERE lower(t) NOT IN ('', 'none', 'nan', 'null') AND NOT regexp_matches(t, '^[\\[({{]\\s*[\\])}}]$')),
c AS (SELECT question_id, regexp_replace(regexp_replace(trim(u), '^[\\[{{](.*)[\\]}}]$', '\\1', 's'), '^\\(\\s*([''"“].*)\\)$', '\\1', 's') AS v FROM b),
d AS (SELECT question_id, regexp_extract_all(regexp_replace(v, '(\\s)/(\\s)', '\\1' || chr(31) || '\\2', 'g'), {_lit(_MEMBER)}) AS ms FROM c),
e AS (SELECT question_id, [CASE WHEN regexp_matches(m, '^".*"$') THEN replace(regexp_replace(m[2:-2], '\\\\(.)', '\\1', 'g'), '""', '"') WHEN regexp_matches(m, '^(''.*''|“.*”|«.*»)$') THEN regexp_replace(m[2:-2], '\\\\(.)', '\\1', 'g') ELSE m END
       for m in [trim(x) for x in ms]] AS ms FROM d),
g AS (SELECT question_id, [replace(x, chr(31), '/') for x in [trim(y) for y in ms] if x <> ''] AS ms FROM e)
SELECT question_id, generate_subscripts(ms, 1)::INT AS pos, unnest(ms) AS evidence_source FROM g
"""
ORACLE["p1_found"] = _P1
