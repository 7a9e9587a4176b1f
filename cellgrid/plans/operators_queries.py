"""Queries over single operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import facts, grid, pageset, profile, represent, retrieval, stats
from ..operators.packed import first_delivery
from ..session import cut_lineage, materialized, table
from ..sources.sinks import fixed
from . import sql
from .reconcile import reconcile, weighted_rate

IDENT = "question_id, doc_id, condition, representation, model_spec, visual_resolution"
ST = "coalesce(status, 'ok')"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def preds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions")


def judged(spark: SparkSession, d: str) -> DataFrame:
    """The judged rows: one table for all queries that read them."""
    return materialized(spark, "facts", d, ("predictions", "questions"), lambda: facts.judged(preds(spark, d), table(spark, d, "questions")))


# -- fact rows ------------------------------------------------------------------------

_BEST = f"""WITH r AS (SELECT *, {ST} AS st, row_number() OVER (PARTITION BY {IDENT} ORDER BY ({ST} <> 'ok'), seq) AS rn FROM predictions)"""


@query("best_status_dedupe", _BEST + " SELECT seq, question_id, representation, model_spec FROM r WHERE rn = 1 AND st = 'ok'")
def _dedupe(spark, d):
    cols = ["seq", "status", *facts.IDENTITY]
    return facts.ok_rows(preds(spark, d).select(*cols)).select("seq", "question_id", "representation", "model_spec")


_CELL = f"WITH c AS (SELECT {{k}} max(CASE {ST} WHEN 'ok' THEN 2 WHEN 'oom' THEN 1 ELSE 0 END) AS r FROM predictions GROUP BY {{g}} {IDENT})"
_SUMS = "count(*) AS cells, count(*) FILTER (r = 2) AS ok, count(*) FILTER (r = 1) AS oom, count(*) FILTER (r = 0) AS error"


@query("cell_status_counts", _CELL.format(k="run_tag,", g="run_tag,") + f" SELECT run_tag, {_SUMS} FROM c GROUP BY 1")
def _status(spark, d):
    return facts.status_counts(preds(spark, d), ["run_tag"])


@query("generation_report_rollup", _CELL.format(k="run_tag, provenance,", g="run_tag, provenance,")
       + f" SELECT run_tag, provenance, {_SUMS}, count(*) FILTER (r = 1) * 100 / count(*) AS oom_pct FROM c GROUP BY GROUPING SETS ((run_tag, provenance), ())")
def _report(spark, d):
    return facts.generation_report(preds(spark, d))


_FIRST_LAST = f"""WITH x AS (SELECT *, {ST} AS st, row_number() OVER (PARTITION BY prediction_key ORDER BY seq) AS a, row_number() OVER (PARTITION BY prediction_key ORDER BY seq DESC) AS z FROM predictions),
o AS (SELECT * FROM x WHERE a = 1), r AS (SELECT * FROM x WHERE z = 1 AND a > 1)
"""


@query("failed_upgrade_merge", _FIRST_LAST + "SELECT o.prediction_key, CASE WHEN o.st <> 'ok' AND r.seq IS NOT NULL THEN r.seq ELSE o.seq END AS seq, CASE WHEN o.st <> 'ok' AND r.seq IS NOT NULL THEN r.st ELSE o.st END AS status FROM o LEFT JOIN r USING (prediction_key)")
def _merge(spark, d):
    p = facts.with_status(preds(spark, d)).select("prediction_key", "seq", "status")
    first = p.groupBy("prediction_key").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.min_by("status", "seq").alias("a"), F.max_by("status", "seq").alias("z"))
    original = first.select("prediction_key", F.col("lo").alias("seq"), F.col("a").alias("status"))
    rerun = first.filter("hi > lo").select("prediction_key", F.col("hi").alias("seq"), F.col("z").alias("status"))
    return facts.merge_failed(original, rerun)


@query("resume_anti_join", f"SELECT prediction_key, model_spec FROM predictions p WHERE {ST} <> 'ok' AND NOT EXISTS (SELECT 1 FROM predictions q WHERE q.prediction_key = p.prediction_key AND coalesce(q.status, 'ok') = 'ok') GROUP BY 1, 2")
def _resume(spark, d):
    p = facts.with_status(preds(spark, d)).select("prediction_key", "model_spec", "status")
    return facts.missing_cells(p.filter("status <> 'ok'").select("prediction_key", "model_spec").distinct(), p.filter("status = 'ok'"))


@query("skip_oom_cells", f"""WITH t AS (SELECT question_id, doc_id, condition, representation, model_spec, visual_resolution, max(CASE {ST} WHEN 'ok' THEN 2 WHEN 'oom' THEN 1 ELSE 0 END) AS r FROM predictions GROUP BY ALL),
dead AS (SELECT question_id, doc_id, condition, representation, model_spec FROM t GROUP BY ALL HAVING min(r) = 1 AND max(r) = 1),
b AS (SELECT DISTINCT question_id, doc_id, condition, representation, model_spec FROM predictions) SELECT * FROM b ANTI JOIN dead USING (question_id, doc_id, condition, representation, model_spec)""")
def _skip(spark, d):
    p = preds(spark, d)
    key = [c for c in facts.IDENTITY if c != "visual_resolution"]
    return facts.open_cells(p.select(*key).distinct(), p)


@query("status_reason_topk", f"SELECT {ST} AS status, left(trim(split_part(skipped_reason, chr(10), 1)), 100) AS reason, count(*) AS n, min(seq) AS first_seq FROM predictions WHERE {ST} <> 'ok' GROUP BY ALL ORDER BY n DESC, first_seq LIMIT 5")
def _reasons(spark, d):
    return facts.failure_reasons(preds(spark, d))


@query("run_verdict", _CELL.format(k="run_tag,", g="run_tag,") + f", s AS (SELECT run_tag, {_SUMS} FROM c GROUP BY 1) SELECT *, CASE WHEN cells = 0 OR error / cells >= 0.02 THEN 'FAIL' WHEN oom + error > 0 THEN 'WARN' ELSE 'OK' END AS verdict FROM s")
def _verdict(spark, d):
    return facts.run_verdicts(preds(spark, d))


@query("failure_classes", "SELECT CASE WHEN contains(lower(skipped_reason), 'out of memory') THEN 'oom' ELSE 'error' END AS kind, count(*) AS n FROM predictions WHERE skipped_reason <> '' GROUP BY 1")
def _failures(spark, d):
    return preds(spark, d).filter("skipped_reason <> ''").groupBy(S.failure_kind(F.col("skipped_reason")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("expected_missing", f"""WITH e AS (SELECT run_tag, count(DISTINCT question_id) AS q, count(DISTINCT model_spec) AS s FROM predictions GROUP BY 1), g AS (SELECT run_tag, count(DISTINCT (question_id, model_spec)) AS got FROM predictions WHERE {ST} = 'ok' GROUP BY 1)
SELECT run_tag, q * s AS expected, coalesce(got, 0) AS present, q * s - coalesce(got, 0) AS missing FROM e LEFT JOIN g USING (run_tag)""")
def _expected(spark, d):
    p = facts.with_status(preds(spark, d))
    e = p.groupBy("run_tag").agg((F.countDistinct("question_id") * F.countDistinct("model_spec")).alias("expected"))
    g = p.filter("status = 'ok'").select("run_tag", "question_id", "model_spec").distinct().groupBy("run_tag").agg(F.count(F.lit(1)).alias("present"))
    j = e.join(g, "run_tag", "left").withColumn("present", F.coalesce("present", F.lit(0)))
    return j.withColumn("missing", F.col("expected") - F.col("present"))


# -- answers --------------------------------------------------------------------------

@query("abstention_detect", sql.facts("SELECT seq, abstained FROM p1"))
def _abst(spark, d):
    return preds(spark, d).select("seq", S.is_abstention(F.col("text")).alias("abstained"))


@query("final_answer_extract", r"""SELECT seq, CASE WHEN contains(text, 'Answer:') THEN regexp_replace(list_last(str_split(text, 'Answer:')), '^\s+|\s+$', '', 'g') ELSE text END AS final FROM predictions""")
def _final(spark, d):
    return preds(spark, d).select("seq", S.final_answer(F.col("text")).alias("final"))


@query("stub_judge", sql.facts("SELECT seq, abstained, correct, correct::INT::DOUBLE AS score FROM j"))
def _judge(spark, d):
    return judged(spark, d).select("seq", "abstained", "correct", "score")


@query("json_verdict", sql.facts(""", v AS (SELECT seq, coalesce(is_unanswerable, false) AS un, abstained AS det, (seq % 3 = 0) AS jc, (seq % 7 = 0) AS ja FROM p1)
SELECT seq, (ja OR det) AS abstained, CASE WHEN un AND (ja OR det) THEN true ELSE jc END AS correct FROM v"""))
def _jsonv(spark, d):
    """A judge's JSON in a fence, built from seq, mapped to a verdict."""
    body = F.concat(F.lit('Sure.\n```json\n{"correct": '), (F.col("seq") % 3 == 0).cast("string"), F.lit(', "abstained": '), (F.col("seq") % 7 == 0).cast("string"), F.lit("}\n```"))
    v = S.verdict(body, F.coalesce("is_unanswerable", F.lit(False)), F.col("text"))
    return preds(spark, d).select("seq", v.alias("v")).select("seq", "v.abstained", "v.correct")


@query("answer_preview", r"""WITH t AS (SELECT seq, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS x FROM predictions) SELECT seq, CASE WHEN length(x) > 160 THEN rtrim(left(x, 159)) || '…' ELSE x END AS preview FROM t""")
def _preview(spark, d):
    return preds(spark, d).select("seq", S.preview(F.col("text")).alias("preview"))


@query("latency_split", "SELECT seq, CASE WHEN prefill_latency_s > 0 THEN prefill_latency_s ELSE latency_s END AS prefill_s, greatest(0, latency_s - CASE WHEN prefill_latency_s > 0 THEN prefill_latency_s ELSE latency_s END) AS decode_s, coalesce(output_tokens >= try_cast(metadata['max_new_tokens'] AS BIGINT), false) AS at_limit FROM predictions WHERE latency_s IS NOT NULL AND NOT isnan(latency_s)")
def _split(spark, d):
    p = preds(spark, d).filter("latency_s is not null and not isnan(latency_s)")
    pre = F.when(F.col("prefill_latency_s") > 0, F.col("prefill_latency_s")).otherwise(F.col("latency_s"))
    at = F.coalesce(F.col("output_tokens") >= F.col("metadata")["max_new_tokens"].try_cast("long"), F.lit(False))
    return p.select("seq", pre.alias("prefill_s"), F.greatest(F.lit(0.0), F.col("latency_s") - pre).alias("decode_s"), at.alias("at_limit"))


# -- codecs ---------------------------------------------------------------------------

@query("condition_codec", f"""WITH c AS (SELECT DISTINCT condition FROM predictions), x AS (SELECT condition, split_part(condition, '__', 1) AS base, CASE WHEN contains(condition, '__') THEN substr(condition, strpos(condition, '__') + 2) ELSE '' END AS mode FROM c)
SELECT condition, base, mode, {sql.MODALITY} AS modality, {sql.K} AS k FROM x""")
def _codec(spark, d):
    m, k = S.retrieval_parts(F.col("base"))
    c = preds(spark, d).select("condition").distinct().withColumn("base", S.base_condition(F.col("condition"))).withColumn("mode", S.prompt_mode(F.col("condition")))
    return c.select("condition", "base", "mode", m.alias("modality"), k.alias("k"))


_PX = sql._PS


@query("pageset_codec", f"""WITH c AS (SELECT DISTINCT split_part(condition, '__', 1) AS base FROM predictions) SELECT base, regexp_extract(base, '{_PX}', 1) AS ranker, regexp_extract(base, '{_PX}', 2) AS gold, regexp_extract(base, '{_PX}', 3)::INT AS distractors, base AS again FROM c WHERE regexp_matches(base, '{_PX}')""")
def _pcodec(spark, d):
    c = preds(spark, d).select(S.base_condition(F.col("condition")).alias("base")).distinct()
    p = c.withColumns(S.pageset_parts(F.col("base"))).filter("ranker is not null")
    gold = F.when(F.col("gold_mode") == "all", "all").otherwise(F.concat_ws("-", "gold_mode", F.col("gold_count").cast("string")))
    again = S.encode_pageset(*[F.col(x) for x in ("ranker", "gold_mode", "gold_count", "distractors", "policies")])
    return p.select("base", "ranker", gold.alias("gold"), "distractors", again.alias("again"))


@query("spec_parse", "WITH s AS (SELECT DISTINCT model_spec FROM predictions) SELECT model_spec, regexp_extract(model_spec, '^([^-]+)-([^-]+)-([^-]+)(?:-(4bit|8bit))?$', 1) AS family, regexp_extract(model_spec, '^([^-]+)-([^-]+)-([^-]+)(?:-(4bit|8bit))?$', 2) AS size, regexp_extract(model_spec, '^([^-]+)-([^-]+)-([^-]+)(?:-(4bit|8bit))?$', 4) AS quant FROM s")
def _spec(spark, d):
    p = S.spec_parts(F.col("model_spec"))
    return preds(spark, d).select("model_spec").distinct().select("model_spec", *[p[k].alias(k) for k in ("family", "size", "quant")])


@query("prediction_key", """SELECT seq, sha256('{"condition": "' || condition || '", "doc_id": "' || doc_id || '", "model_spec": "' || model_spec || '", "page_indices": [' || array_to_string(page_indices, ', ') || '], "question_id": "' || question_id || '", "representation": "' || representation || '", "visual_resolution": "' || visual_resolution || '"}') AS key FROM predictions""")
def _key(spark, d):
    c = [F.col(x) for x in ("condition", "doc_id", "model_spec", "page_indices", "question_id", "representation", "visual_resolution")]
    return preds(spark, d).select("seq", S.prediction_key(*c).alias("key"))


@query("key_agreement", ORACLE["prediction_key"].replace("SELECT seq, sha256", "SELECT sha256").replace(" AS key FROM", " = prediction_key AS equal, count(*) AS n FROM") + " GROUP BY 1")
def _agree(spark, d):
    """How many recorded keys the computed ones equal."""
    c = [F.col(x) for x in ("condition", "doc_id", "model_spec", "page_indices", "question_id", "representation", "visual_resolution")]
    return preds(spark, d).groupBy((S.prediction_key(*c) == F.col("prediction_key")).alias("equal")).agg(F.count(F.lit(1)).alias("n"))


# -- questions ------------------------------------------------------------------------

_Q = f"WITH {sql.FACTS}{sql.GOLD}"
_QD = "q AS (SELECT question_id, arg_min(doc_id, ingested_at) AS doc_id, arg_min(doc_type, ingested_at) AS doc_type, arg_min(answer, ingested_at) AS answer, arg_min(evidence_pages, ingested_at) AS pages, arg_min(answer_format, ingested_at) AS answer_format, arg_min(scan_label, ingested_at) AS scan_label, arg_min(source_dataset, ingested_at) AS source_dataset, arg_min(question, ingested_at) AS question FROM questions WHERE question_id IS NOT NULL GROUP BY 1)"
_PG = """c AS (SELECT *, list_distinct([greatest(x - CASE WHEN source_dataset = 'longdocurl' THEN 0 ELSE 1 END, 0) for x in [try_cast(y AS INT) for y in CASE WHEN pages IS NULL OR lower(trim(pages)) IN ('', 'none', 'nan', 'null') THEN []
 ELSE str_split(regexp_replace(trim(pages), '[\\[\\]''"\\s]', '', 'g'), ',') END] if x IS NOT NULL]) AS pg, coalesce(replace(lower(trim(answer)), 'ß', 'ss') = 'not answerable', false) AS un FROM q)"""
_CORPUS = f"WITH {_QD}, {_PG}"


def corpus(spark, d):
    return grid.corpus(table(spark, d, "questions"))


@query("list_parse", _CORPUS + " SELECT question_id, len(pg) AS n_pages, array_to_string(list_sort(pg), ',') AS sorted_pages FROM c")
def _list(spark, d):
    return corpus(spark, d).select("question_id", F.size("pages").alias("n_pages"), F.array_join(F.sort_array("pages"), ",").alias("sorted_pages"))


@query("hop_derive", _CORPUS + " SELECT question_id, CASE len(pg) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'multi' END AS hop, un AS is_unanswerable, coalesce(list_max(pg), -1) + 1 AS pages_required FROM c")
def _hop(spark, d):
    return corpus(spark, d).select("question_id", "hop", "is_unanswerable", S.page_count_required(F.col("pages")).alias("pages_required"))


@query("question_filters", _CORPUS + " SELECT question_id FROM c LEFT JOIN doc_labels l USING (doc_id) WHERE coalesce(nullif(lower(trim(c.scan_label)), ''), l.auto_scan) = 'scanned' AND NOT un AND len(pg) > 1")
def _filters(spark, d):
    return grid.select(corpus(spark, d), "scanned", "answerable", "multi", table(spark, d, "doc_labels")).select("question_id")


@query("label_stamp", _CORPUS + " SELECT question_id, coalesce(l.bin_label, '') AS bin_label, l.doc_id IS NOT NULL AS matched FROM c LEFT JOIN doc_labels l USING (doc_id)")
def _stamp(spark, d):
    dim = table(spark, d, "doc_labels").select("doc_id", F.col("bin_label").alias("b"), F.lit(True).alias("m"))
    j = corpus(spark, d).join(dim, "doc_id", "left")
    return j.select("question_id", F.coalesce("b", F.lit("")).alias("bin_label"), F.coalesce("m", F.lit(False)).alias("matched"))


@query("class_breakdown", _CORPUS + ", x AS (SELECT question_id, doc_id, coalesce(nullif(trim(answer_format), ''), '(none)') AS answer_format FROM c) SELECT answer_format, count(*) AS questions, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1")
def _classes(spark, d):
    f = F.trim(F.coalesce("answer_format", F.lit("")))
    return profile.class_breakdown(corpus(spark, d).withColumn("f", F.filter(F.array(f), lambda x: x != "")), F.col("f"), "answer_format")


@query("per_doc_first", "SELECT doc_id, count(*) AS questions, arg_min(doc_type, ingested_at) FILTER (doc_type IS NOT NULL) AS doc_type FROM questions GROUP BY 1")
def _perdoc(spark, d):
    return profile.per_document(table(spark, d, "questions"), "doc_type", "ingested_at")


@query("contingency_pivot", _CORPUS + " SELECT answer_format, count(*) FILTER (source_dataset = 'mmlongbench') AS mmlongbench, count(*) FILTER (source_dataset = 'longdocurl') AS longdocurl FROM c GROUP BY 1")
def _cont(spark, d):
    return profile.contingency(corpus(spark, d), "answer_format", "source_dataset", ["mmlongbench", "longdocurl"])


@query("length_stats", _CORPUS + " SELECT source_dataset, count(*) AS n, round(avg(length(question)), 1) AS avg, min(length(question)) AS min, max(length(question)) AS max, round(median(length(question)), 1) AS median FROM c GROUP BY 1")
def _len(spark, d):
    return profile.summarize(corpus(spark, d).withColumn("n", F.length("question").cast("long")), "n", ["source_dataset"]).select("source_dataset", "n", "avg", "min", "max", "median")


@query("hop_histogram", _CORPUS + " SELECT CASE len(pg) WHEN 0 THEN 'zero (0 pages)' WHEN 1 THEN 'single (1 page)' ELSE 'multi (' || len(pg) || ' pages)' END AS hop_class, count(*) AS questions, count(DISTINCT doc_id) AS docs, count(DISTINCT doc_type) AS doc_types FROM c GROUP BY 1")
def _hops(spark, d):
    return profile.hop_histogram(corpus(spark, d))


@query("questions_per_document", _CORPUS + " SELECT doc_id, count(*) AS questions, count(*) FILTER (un) AS unanswerable FROM c GROUP BY 1")
def _qpd(spark, d):
    return corpus(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("questions"), F.count_if("is_unanswerable").alias("unanswerable"))


@query("doc_coherent_draw")
def _draw(spark, d):
    c = corpus(spark, d).withColumn("group", F.lower(F.trim("scan_label")))
    return grid.coherent_draw(c, "group", 40).groupBy("group", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("cell_grid", _CORPUS + """ SELECT rung AS representation, mode, res AS visual_resolution, count(*) AS cells FROM c CROSS JOIN (VALUES ('T'), ('TL'), ('TLV'), ('V')) r(rung) CROSS JOIN (VALUES ('none'), ('abstain')) m(mode)
CROSS JOIN (VALUES ('high'), ('low'), ('')) x(res) WHERE (contains(rung, 'V') AND res <> '') OR (NOT contains(rung, 'V') AND res = '') GROUP BY ALL""")
def _cells(spark, d):
    g = grid.cells(corpus(spark, d), ("T", "TL", "TLV", "V"), ("none", "abstain"), ("oracle",), (facts.DEFAULT_SPEC,), ("high", "low"))
    return g.groupBy("representation", "mode", "visual_resolution").agg(F.count(F.lit(1)).alias("cells"))


@query("pageset_exclusions", _CORPUS + """ SELECT rule AS base, CASE WHEN len(pg) = 0 THEN 'no gold' WHEN rule LIKE '%keep_top-2%' AND len(pg) < 2 THEN 'too few to keep' WHEN rule LIKE '%drop_top-1%' AND len(pg) <= 1 THEN 'too few to drop' END AS skip, count(*) AS n
FROM c CROSS JOIN (VALUES ('pageset:r=bm25:g=keep_top-2:d=0'), ('pageset:r=bm25:g=drop_top-1:d=0'), ('pageset:r=bm25:g=all:d=3')) r(rule) GROUP BY ALL""")
def _excl(spark, d):
    rules = ("pageset:r=bm25:g=keep_top-2:d=0", "pageset:r=bm25:g=drop_top-1:d=0", "pageset:r=bm25:g=all:d=3")
    return grid.pageset_cells(corpus(spark, d), rules, ("T",), ("none",)).groupBy("base", "skip").agg(F.count(F.lit(1)).alias("n"))


# -- annotation sheet -----------------------------------------------------------------

@query("kappa_two_raters", """WITH r AS (SELECT auto_scan AS a, scan_label AS b FROM doc_labels WHERE trim(coalesce(auto_scan, '')) <> '' AND trim(coalesce(scan_label, '')) <> ''), n AS (SELECT count(*) AS n, sum((a = b)::INT)::BIGINT / count(*) AS observed FROM r),
e AS (SELECT sum(x.c * y.c)::BIGINT AS xy FROM (SELECT a, count(*) AS c FROM r GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM r GROUP BY 1) y ON a = b)
SELECT n, observed, xy / (n * n) AS expected, round(CASE WHEN xy / (n * n) = 1 THEN (observed = 1)::INT ELSE (observed - xy / (n * n)) / (1 - xy / (n * n)) END, 9) AS kappa FROM n, e""")
def _kappa(spark, d):
    s = table(spark, d, "doc_labels")
    v = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c))
    return stats.kappa(s.select(v("auto_scan").alias("a"), v("scan_label").alias("b")), "a", "b").withColumn("kappa", F.round("kappa", 9))


@query("sheet_score", "SELECT unnest(['bin_label', 'scan_label', 'dominant_visual']) AS \"column\", count(*) AS rows, unnest([count(*) FILTER (trim(coalesce(bin_label, '')) <> ''), count(*) FILTER (trim(coalesce(scan_label, '')) <> ''), count(*) FILTER (trim(coalesce(dominant_visual, '')) <> '')]) AS filled, unnest([count(DISTINCT trim(bin_label)) FILTER (trim(bin_label) <> ''), count(DISTINCT trim(scan_label)) FILTER (trim(scan_label) <> ''), count(DISTINCT trim(dominant_visual)) FILTER (trim(dominant_visual) <> '')]) AS \"values\" FROM doc_labels")
def _sheet(spark, d):
    return profile.score_sheet(table(spark, d, "doc_labels"), ("bin_label", "scan_label", "dominant_visual"))


@query("multi_value_split", "SELECT v AS value, count(*) AS docs FROM (SELECT unnest([trim(x) for x in regexp_split_to_array(coalesce(dominant_visual, ''), '[,;|]') if trim(x) <> '']) AS v FROM doc_labels) GROUP BY 1")
def _multi(spark, d):
    return table(spark, d, "doc_labels").select(F.explode(profile.split_multi(F.col("dominant_visual"))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("docs"))


@query("label_fill", "SELECT doc_id, CASE WHEN trim(coalesce(scan_label, '')) = '' AND auto_scan IN ('scanned', 'digital') THEN auto_scan ELSE scan_label END AS scan_label, coalesce(trim(coalesce(scan_label, '')) = '' AND auto_scan IN ('scanned', 'digital'), false) AS was_filled FROM doc_labels")
def _fill(spark, d):
    f = profile.fill_from_prior(table(spark, d, "doc_labels"), "scan_label", "auto_scan", ("scanned", "digital"))
    return f.select("doc_id", "scan_label", F.coalesce("was_filled", F.lit(False)).alias("was_filled"))


@query("bin_parse", "SELECT doc_id, CASE WHEN a IN ('text-dominant', 'mixed-modality', 'visual-dominant') THEN a ELSE 'mixed-modality' END AS bin, CASE WHEN a IN ('text-dominant', 'mixed-modality', 'visual-dominant') THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT doc_id, trim(lower(coalesce(bin_label, ''))) AS a FROM doc_labels)")
def _bin(spark, d):
    p = S.parse_bin(F.coalesce("bin_label", F.lit("")))
    return table(spark, d, "doc_labels").select("doc_id", p["bin"].alias("bin"), p["confidence"].alias("confidence"))


@query("weights_dim", "SELECT model_spec, round_even(weights_bytes / 1e6, 0)::BIGINT::VARCHAR || CASE WHEN method <> 'exact' THEN '~' ELSE '' END AS weights_mb FROM model_weights")
def _weights(spark, d):
    mb = fixed(F.col("weights_bytes") / 1e6, "0")
    return table(spark, d, "model_weights").select("model_spec", F.concat(mb, F.when(F.col("method") != "exact", "~").otherwise("")).alias("weights_mb"))


# -- pages and retrieval --------------------------------------------------------------

_PT = "array_to_string([coalesce(s.text, '') for s in coalesce(text_spans, []) if trim(coalesce(s.text, '')) <> ''], chr(10))"
_TOKS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+')"


def pages(spark, d):
    p = table(spark, d, "doc_pages")
    return p.select("doc_id", F.col("page_index").alias("page"), retrieval.page_text(F.col("text_spans")).alias("text"))


def posted(spark, d):
    """The tokens of all pages: one table for all rankings."""
    return materialized(spark, "postings", d, ("doc_pages",), lambda: retrieval.postings(pages(spark, d)))


def page_questions(spark, d):
    q = first_delivery(table(spark, d, "questions"), "question_id", "ingested_at", ["question_id", "doc_id", "question"])
    docs = table(spark, d, "doc_pages").select("doc_id").distinct()
    return q.join(docs, "doc_id", "left_semi").select(F.col("question_id").alias("query_id"), "doc_id", F.col("question").alias("text"))


_BM = f"""WITH {_QD}, pg AS (SELECT doc_id, page_index AS page, {_TOKS.format(_PT)} AS toks FROM doc_pages), qq AS (SELECT q.question_id AS query_id, q.doc_id, {_TOKS.format("coalesce(question, '')")} AS toks FROM q WHERE doc_id IN (SELECT doc_id FROM doc_pages)),
st AS (SELECT doc_id, count(*) AS n, avg(len(toks)) AS avgdl FROM pg GROUP BY 1), tf AS (SELECT doc_id, page, len(toks0) AS dl, tok, count(*) AS tf FROM (SELECT doc_id, page, toks AS toks0, unnest(toks) AS tok FROM pg) GROUP BY ALL),
df AS (SELECT doc_id, tok, count(*) AS df FROM tf GROUP BY 1, 2), qt AS (SELECT query_id, doc_id, tok, count(*) AS qn FROM (SELECT query_id, doc_id, unnest(toks) AS tok FROM qq) GROUP BY ALL),
sc AS (SELECT query_id, tf.doc_id, page, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-9)))) AS s FROM qt JOIN df USING (doc_id, tok) JOIN tf USING (doc_id, tok) JOIN st USING (doc_id) GROUP BY ALL),
al AS (SELECT query_id, doc_id, page, round(coalesce(s, 0), 6) AS score FROM (SELECT query_id, qq.doc_id, page FROM qq JOIN pg USING (doc_id)) LEFT JOIN sc USING (query_id, doc_id, page)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM al)"""


@query("bm25_topk", _BM + " SELECT query_id, doc_id, page, score, rank FROM rk WHERE rank <= 5")
def _bm(spark, d):
    q = page_questions(spark, d)
    return retrieval.best_pages(retrieval.bm25_hits(posted(spark, d), q), posted(spark, d), q, 5)


_OK = _BM.replace("qt AS (SELECT query_id", "i0 AS (SELECT doc_id, tok, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df JOIN st USING (doc_id)), im AS (SELECT doc_id, avg(idf) AS mean FROM i0 GROUP BY 1), idf AS (SELECT doc_id, tok, CASE WHEN idf < 0 THEN mean * 0.25 ELSE idf END AS idf FROM i0 JOIN im USING (doc_id)), qt AS (SELECT query_id", 1).replace(
    "sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf", "sum(qn * idf * tf").replace("FROM qt JOIN df USING (doc_id, tok)", "FROM qt JOIN idf USING (doc_id, tok)")


@query("bm25_okapi", _OK + " SELECT query_id, doc_id, page, score, rank FROM rk WHERE rank <= 5")
def _okapi(spark, d):
    return retrieval.ranked(retrieval.bm25(posted(spark, d), page_questions(spark, d), okapi=True), 5)


_FB = f"""WITH {_QD}, pg AS (SELECT doc_id, page_index AS page, list_distinct({_TOKS.format(_PT)}) AS toks FROM doc_pages), qq AS (SELECT q.question_id AS query_id, q.doc_id, list_distinct({_TOKS.format("coalesce(question, '')")}) AS toks FROM q)
SELECT query_id, doc_id, page, round(len(list_intersect(qq.toks, pg.toks)) + 1 / (1 + page), 6) AS score FROM qq JOIN pg USING (doc_id)"""


@query("lexical_fallback", _FB)
def _fb(spark, d):
    return retrieval.fallback_scores(pages(spark, d), page_questions(spark, d))


def _gold(spark, d):
    return corpus(spark, d).select(F.col("question_id").alias("query_id"), F.col("pages").alias("gold"))


def _prf(spark, d):
    q, p = page_questions(spark, d), posted(spark, d)
    r = cut_lineage(retrieval.listed(retrieval.best_pages(retrieval.bm25_hits(p, q), p, q, 5)))
    f = cut_lineage(retrieval.listed(retrieval.best_pages(retrieval.lexical_hits(p, q), p, q, 5, 1 / (1 + F.col("page")))))
    u = r.join(f.withColumnRenamed("ranking", "other"), "query_id")
    ks = (1, 3, 5)
    out = retrieval.evaluate(r, _gold(spark, d), "bm25", ks).unionByName(retrieval.evaluate(f, _gold(spark, d), "lexical", ks))
    joint = u.join(_gold(spark, d), "query_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    joint = joint.withColumn("retrieved", F.expr("array_union(slice(ranking, 1, k), slice(other, 1, k))"))
    joint = joint.select("query_id", F.lit("joint").alias("retriever"), "k", "retrieved", "gold", *[c.alias(n) for n, c in retrieval.page_prf(F.col("retrieved"), F.col("gold")).items()])
    return out.unionByName(joint)


_PRF = _BM + f""", {_PG}, pgd AS (SELECT doc_id, page_index AS page, list_distinct({_TOKS.format(_PT)}) AS toks FROM doc_pages), qd AS (SELECT query_id, doc_id, list_distinct(toks) AS toks FROM qq),
fs AS (SELECT query_id, doc_id, page, round(len(list_intersect(qd.toks, pgd.toks)) + 1 / (1 + page), 6) AS score FROM qd JOIN pgd USING (doc_id)), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM fs),
ks(k) AS (VALUES (1), (3), (5)), hits AS (SELECT 'bm25' AS retriever, k, query_id, list_distinct(list(page)) AS got FROM rk, ks WHERE rank <= k GROUP BY ALL UNION ALL SELECT 'lexical', k, query_id, list_distinct(list(page)) FROM fr, ks WHERE rank <= k GROUP BY ALL),
hj AS (SELECT * FROM hits UNION ALL SELECT 'joint', a.k, a.query_id, list_distinct(list_concat(a.got, b.got)) FROM hits a JOIN hits b ON a.retriever = 'bm25' AND b.retriever = 'lexical' AND a.k = b.k AND a.query_id = b.query_id),
m AS (SELECT retriever, k, len(list_intersect(got, pg)) AS tp, len(got) AS n, len(pg) AS g FROM hj JOIN c ON c.question_id = hj.query_id),
e AS (SELECT retriever, k, CASE WHEN n = 0 AND g = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE tp / n END AS p, CASE WHEN n = 0 AND g = 0 THEN 1.0 WHEN n = 0 OR g = 0 THEN 0.0 ELSE tp / g END AS r FROM m),
s AS (SELECT retriever, k, count(*) AS n, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f1 FROM e GROUP BY 1, 2)"""


@query("retrieval_prf", _PRF + " SELECT * FROM s")
def _rprf(spark, d):
    return retrieval.summary(_prf(spark, d), ["retriever", "k"])


@query("retrieval_best_k", _PRF + ', b AS (SELECT *, row_number() OVER (PARTITION BY retriever ORDER BY f1 DESC, k) AS rn FROM s) SELECT retriever, k, n, "precision", recall, f1 FROM b WHERE rn = 1')
def _rbest(spark, d):
    return retrieval.best_k(retrieval.summary(_prf(spark, d), ["retriever", "k"]))


_BIN = _PRF.replace("m AS (SELECT retriever, k, len", "m AS (SELECT retriever, k, coalesce(l.bin_label, '') AS bin_label, len").replace("ON c.question_id = hj.query_id)", "ON c.question_id = hj.query_id LEFT JOIN doc_labels l ON l.doc_id = c.doc_id)").replace(
    "e AS (SELECT retriever, k,", "e AS (SELECT retriever, k, bin_label,").replace("s AS (SELECT retriever, k, count", "s AS (SELECT retriever, k, bin_label, count").replace("FROM e GROUP BY 1, 2)", "FROM e GROUP BY 1, 2, 3)")


@query("retrieval_by_bin", _BIN + " SELECT * FROM s")
def _rbin(spark, d):
    dim = table(spark, d, "doc_labels").select("doc_id", "bin_label")
    q = corpus(spark, d).select(F.col("question_id").alias("query_id"), "doc_id").join(dim, "doc_id", "left")
    return retrieval.summary(_prf(spark, d).join(q, "query_id").withColumn("bin_label", F.coalesce("bin_label", F.lit(""))), ["retriever", "k", "bin_label"])


_COS = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"


@query("cosine_topk", f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS page, round({_COS}, 6) AS score FROM q, embeddings v WHERE q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def _cos(spark, d):
    """Every vector whose id is divisible by 20 against all vectors."""
    v = table(spark, d, "embeddings")
    return retrieval.nearest(v, v.filter("vec_id % 20 = 0"), 10)


@query("late_interaction", """WITH m AS (SELECT vec_id, [embedding[1:16]::DOUBLE[], embedding[17:32]::DOUBLE[]] AS q, [embedding[33:48]::DOUBLE[], embedding[49:64]::DOUBLE[]] AS p FROM embeddings)
SELECT vec_id, round(greatest(list_dot_product(q[1], p[1]), list_dot_product(q[1], p[2])) + greatest(list_dot_product(q[2], p[1]), list_dot_product(q[2], p[2])), 6) AS score FROM m""")
def _late(spark, d):
    part = lambda a: F.slice("embedding", a, 16)
    s = retrieval.max_sim(F.array(part(1), part(17)), F.array(part(33), part(49)))
    return table(spark, d, "embeddings").select("vec_id", F.round(s, 6).alias("score"))


_NP = "np AS (SELECT doc_id, count(*) AS pages FROM doc_pages GROUP BY 1)"


# the pages in the order of the field, each where it stands first
_ORDERED = f"WITH {_QD}, {_PG.replace('list_distinct([', '([')}, o AS (SELECT *, list_filter(pg, lambda p, i: list_position(pg, p) = i) AS og FROM c)"


@query("oracle_ranking", _ORDERED + f""", {_NP}, x AS (SELECT question_id, pages AS n, o.og AS gold FROM o JOIN np ON np.doc_id = o.doc_id)
SELECT question_id, array_to_string(list_concat(list_filter(gold, lambda g: g < n), list_filter(range(0, n), lambda i: NOT list_contains(gold, i::INT))), ',') AS ranking FROM x""".replace("pages AS n", "np.pages AS n"))
def _oracle(spark, d):
    n = table(spark, d, "doc_pages").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    c = corpus(spark, d).join(n, "doc_id")
    return c.select("question_id", F.array_join(retrieval.oracle_ranking(F.col("pages"), F.col("n")), ",").alias("ranking"))


def _rule_query(rule: str, distractors: int):
    def run(spark, d):
        scores = retrieval.bm25(posted(spark, d), page_questions(spark, d))
        j = retrieval.rule_rankings(scores, _gold(spark, d), distractors).withColumn("base", F.lit(rule))
        p = S.pageset_parts(F.col("base"))
        out = pageset.by_rule(F.col("ranking"), F.col("gold"), p["gold_mode"], p["gold_count"], p["distractors"], p["policies"])
        return j.select("query_id", F.coalesce(F.array_join(out["pages"], ","), F.lit("")).alias("pages"), out["status"].alias("status"), out["reason"].alias("reason"))

    return run


_RULE = _BM + f""", {_PG}, rl AS (SELECT query_id, list(page ORDER BY rank) AS ranking FROM rk GROUP BY 1), z AS (SELECT query_id, list_filter(ranking, lambda p: list_contains(pg, p)) AS g, list_filter(ranking, lambda p: NOT list_contains(pg, p)) AS o FROM rl JOIN c ON c.question_id = rl.query_id)"""
QUERIES["pageset_drop_top"] = _rule_query("pageset:r=bm25:g=drop_top-1:d=0", 0)
ORACLE["pageset_drop_top"] = _RULE + " SELECT query_id, CASE WHEN len(g) > 1 THEN array_to_string(list_sort(g[2:]), ',') ELSE '' END AS pages, CASE WHEN len(g) > 1 THEN 'ok' ELSE 'error' END AS status, CASE WHEN len(g) = 0 THEN 'no gold pages' WHEN len(g) = 1 THEN 'gold pool too small' ELSE '' END AS reason FROM z"
QUERIES["pageset_distractors"] = _rule_query("pageset:r=bm25:g=all:d=3", 3)
ORACLE["pageset_distractors"] = _RULE + " SELECT query_id, CASE WHEN len(g) > 0 THEN array_to_string(list_sort(list_concat(g, o[1:3])), ',') ELSE '' END AS pages, CASE WHEN len(g) > 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN len(g) = 0 THEN 'no gold pages' ELSE '' END AS reason FROM z"


@query("page_conditioners", _CORPUS + f", {_NP} SELECT question_id, array_to_string(CASE WHEN len([p for p in c.pg if p < np.pages]) > 0 THEN list_sort([p for p in c.pg if p < np.pages]) ELSE [0] END, ',') AS oracle, np.pages AS full_pages FROM c JOIN np ON np.doc_id = c.doc_id")
def _conditioners(spark, d):
    n = table(spark, d, "doc_pages").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    c = corpus(spark, d).join(n, "doc_id")
    return c.select("question_id", F.array_join(pageset.oracle(F.col("pages"), F.col("n")), ",").alias("oracle"), F.size(pageset.full(F.col("n"))).cast("long").alias("full_pages"))


@query("scan_classify", f"""WITH p AS (SELECT doc_id, length(trim(regexp_replace({_PT}, '^\\s+|\\s+$', '', 'g'))) AS n FROM doc_pages WHERE page_index < 5), a AS (SELECT doc_id, count(*) AS pages, round(avg(n), 1) AS avg_chars, count(*) FILTER (n >= 20) AS texty FROM p GROUP BY 1)
SELECT doc_id, pages, avg_chars, CASE WHEN texty = 0 OR avg_chars < 20 THEN 'scanned' ELSE 'digital' END AS auto_scan FROM a""")
def _scan(spark, d):
    return represent.scan_class(table(spark, d, "doc_pages"))


@query("page_text", f"SELECT doc_id, page_index, length({_PT}) AS chars, md5({_PT}) AS digest FROM doc_pages")
def _ptext(spark, d):
    t = retrieval.page_text(F.col("text_spans"))
    return table(spark, d, "doc_pages").select("doc_id", "page_index", F.length(t).alias("chars"), F.md5(t).alias("digest"))


@query("representation_parts", f"""WITH p AS (SELECT page_index, {_PT} AS t FROM doc_pages), x AS (SELECT length(t) AS n, trim(t) <> '' AS has, length((page_index + 1)::VARCHAR) AS d FROM p), l AS (SELECT d, n, CASE WHEN has THEN 7 + n ELSE 0 END AS t, CASE WHEN has THEN 20 + 2 * n ELSE 11 + n END AS tl FROM x)
SELECT 'T' AS representation, count(*) AS pages, sum(t)::BIGINT AS chars, 0::BIGINT AS images FROM l UNION ALL SELECT 'TL', count(*), sum(tl)::BIGINT, 0 FROM l UNION ALL SELECT 'TLV', count(*), sum(tl + 9)::BIGINT, count(*) FROM l
UNION ALL SELECT 'TLVi', count(*), sum(19 + d + n)::BIGINT, count(*) FROM l UNION ALL SELECT 'V', count(*), 7 * count(*), count(*) FROM l""")
def _parts(spark, d):
    """Every page as each rung, the text length and images per rung."""
    p = table(spark, d, "doc_pages").withColumn("t", retrieval.page_text(F.col("text_spans")))
    g = p.select("doc_id", "page_index", F.array("t").alias("t"), F.array(F.concat(F.lit("# "), "t")).alias("m"), F.array(F.coalesce("image_path", F.lit(""))).alias("i"), F.explode(F.array(*[F.lit(r) for r in S.RUNGS])).alias("representation"))
    parts = represent.payload(F.col("representation"), F.col("t"), F.col("m"), F.col("i"), F.array("page_index"))
    g = g.withColumn("parts", parts)
    return g.groupBy("representation").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length(represent.prompt_text(F.col("parts")))).alias("chars"), F.sum(F.size(F.filter("parts", lambda x: x["kind"] == "image"))).alias("images"))


_MODES = ", ".join("({}, {})".format(*["'" + x.replace("'", "''") + "'" for x in (m, represent.INSTRUCTIONS[m])]) for m in S.MODES)


@query("prompt_assembly", _CORPUS + f", m(mode, lead) AS (VALUES {_MODES}) SELECT question_id, mode, CASE WHEN lead <> '' THEN lead || chr(10) || chr(10) ELSE '' END || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS prompt FROM c CROSS JOIN m")
def _prompts(spark, d):
    c = corpus(spark, d).select("question_id", F.col("question"), F.explode(F.array(*[F.lit(m) for m in S.MODES])).alias("mode"))
    return c.select("question_id", "mode", represent.prompt(F.col("mode"), F.col("question"), F.lit("")).alias("prompt"))


_SIZE = "SELECT doc_id, page_index, greatest(1, ceil(list_max([s.bbox[3] for s in text_spans if s.bbox IS NOT NULL])))::BIGINT AS w, greatest(1, ceil(list_max([s.bbox[4] for s in text_spans if s.bbox IS NOT NULL])))::BIGINT AS h FROM doc_pages"


def _page_sizes(spark, d):
    """Each page's width and height by the boxes of its lines."""
    far = lambda i: F.array_max(F.transform("text_spans", lambda s: F.get(s["bbox"], F.lit(i))))
    return table(spark, d, "doc_pages").select("doc_id", "page_index", *[F.greatest(F.lit(1), F.ceil(far(i))).cast("long").alias(n) for i, n in ((2, "w"), (3, "h"))]).filter("w is not null and h is not null")


@query("visual_token_estimate", f"SELECT doc_id, page_index, greatest(ceil(w / 28) * ceil(h / 28), 1)::BIGINT AS tokens FROM ({_SIZE}) WHERE w IS NOT NULL AND h IS NOT NULL")
def _vt(spark, d):
    return _page_sizes(spark, d).select("doc_id", "page_index", S.visual_tokens(F.col("w"), F.col("h")).alias("tokens"))


@query("capped_page_size", f"""WITH s AS (SELECT * FROM ({_SIZE}) WHERE w IS NOT NULL AND h IS NOT NULL), r AS (SELECT doc_id, page_index, name, cap, w, h, least(1.0, sqrt(cap::DOUBLE / (w * h))) AS f FROM s CROSS JOIN (VALUES ('low', 313600), ('med', 501760), ('high', 752640), ('tiny', 5000)) c(name, cap)),
t AS (SELECT *, greatest(floor(w * f / 28), 1)::BIGINT AS a, greatest(floor(h * f / 28), 1)::BIGINT AS b, cap // 784 AS k FROM r)
SELECT doc_id, page_index, name AS resolution, (28 * CASE WHEN a >= b THEN least(a, greatest(k // b, 1)) ELSE a END)::BIGINT AS width, (28 * CASE WHEN b > a THEN least(b, greatest(k // a, 1)) ELSE b END)::BIGINT AS height FROM t""")
def _capped(spark, d):
    """Every page at every resolution preset, and under a cap of a few patches."""
    caps = S.PIXEL_CAPS | {"tiny": 5000}
    sizes = F.array(*[F.struct(F.lit(n).alias("resolution"), S.capped_size(F.col("w"), F.col("h"), c).alias("s")) for n, c in caps.items()])
    return _page_sizes(spark, d).select("doc_id", "page_index", F.explode(sizes).alias("e")).select("doc_id", "page_index", "e.resolution", "e.s.width", "e.s.height")


@query("token_canaries", "SELECT seq, total_text_tokens - text_tokens_fed AS dropped, total_text_tokens - text_tokens_fed > 0 AS truncated FROM predictions")
def _canary(spark, d):
    n = F.col("total_text_tokens") - F.col("text_tokens_fed")
    return preds(spark, d).select("seq", n.alias("dropped"), (n > 0).alias("truncated"))


@query("reconciliation", sql.facts(f""", f AS (SELECT 'acc_' || representation AS "check", {sql.ACC} * 100 AS v FROM o GROUP BY 1), e("check", gate, expected, tolerance) AS (VALUES ('acc_T', 'headline', 50.0::DOUBLE, 3.0::DOUBLE), ('acc_TL', 'headline', 50.0::DOUBLE, 100.0::DOUBLE), ('acc_X', 'headline', 1.0::DOUBLE, 1.0::DOUBLE))
SELECT e."check", gate, expected, tolerance, v AS found, CASE WHEN v IS NULL THEN 'skip' WHEN abs(v - expected) <= tolerance THEN 'pass' ELSE 'fail' END AS status FROM e LEFT JOIN f ON e."check" = f."check" """))
def _rec(spark, d):
    from .tables import oracle

    a = stats.accuracy(oracle(judged(spark, d)), ["representation"])
    found = a.select(F.concat(F.lit("acc_"), "representation").alias("check"), (F.col("accuracy") * 100).alias("value"))
    want = spark.createDataFrame([("acc_T", "headline", 50.0, 3.0), ("acc_TL", "headline", 50.0, 100.0), ("acc_X", "headline", 1.0, 1.0)], "check string, gate string, value double, tolerance double")
    return reconcile(found, want).select("check", "gate", "expected", "tolerance", "found", "status")


@query("weighted_abstention", sql.facts(f", u AS (SELECT mode, count(*) AS n, {sql.RATE} AS rate FROM j WHERE is_unanswerable GROUP BY 1) SELECT round(sum(rate * n) / sum(n), 9) AS rate, sum(n)::BIGINT AS n FROM u"))
def _wrate(spark, d):
    from .tables import abstention

    return weighted_rate(abstention(judged(spark, d).filter("is_unanswerable"), ["mode"])).withColumn("rate", F.round("rate", 9))


@query("inspect_rows", sql.facts("SELECT seq, question_id, condition FROM j WHERE NOT correct AND base = 'oracle' AND representation = 'TLV' ORDER BY question_id, seq LIMIT 50"))
def _inspect(spark, d):
    j = judged(spark, d).filter(~F.col("correct") & (F.col("base") == "oracle") & (F.col("representation") == "TLV"))
    return j.select("seq", "question_id", "condition").orderBy("question_id", "seq").limit(50)


# -- phases ---------------------------------------------------------------------------

@query("judge_phase", sql.facts("SELECT seq, st = 'ok' AND correct AS correct, st = 'ok' AND abstained AS abstained FROM p2 WHERE prediction_key NOT IN (SELECT prediction_key FROM predictions WHERE run_tag = 'ladder-base')"))
def _phase(spark, d):
    """The rows of one run count as judged already; all others are judged, failed ones passed through."""
    from ..operators import phases

    p = preds(spark, d)
    c = [F.col(x) for x in ("condition", "doc_id", "model_spec", "page_indices", "question_id", "representation", "visual_resolution")]
    known = p.filter("run_tag = 'ladder-base'").select(S.prediction_key(*c, judge=F.lit("stub")).alias("result_key"))
    return phases.judge_phase(p, table(spark, d, "questions"), known).select("seq", "correct", "abstained")


@query("failed_rows", f"SELECT seq, {ST} AS status FROM predictions WHERE {ST} <> 'ok'")
def _failed(spark, d):
    from ..operators import phases

    return phases.select_failed(preds(spark, d)).select("seq", "status")


@query("classifier_rows", "SELECT doc_id, bin_label AS gold_bin, 'mixed-modality' AS predicted_bin, bin_label = 'mixed-modality' AS correct_bin FROM doc_labels WHERE doc_id IN (SELECT doc_id FROM questions)")
def _classifier(spark, d):
    from ..operators import phases

    c = phases.classify_documents(table(spark, d, "questions"), table(spark, d, "doc_labels"), F.lit("a mixed page"))
    return c.select("doc_id", "gold_bin", "predicted_bin", "correct_bin")


@query("metadata_whitelist", "SELECT seq, coalesce(len(list_filter(map_keys(metadata), lambda k: k IN ('source_dataset', 'output_truncated', 'max_new_tokens', 'prompt_template_version', 'quantization'))), 0) AS kept FROM predictions")
def _meta(spark, d):
    from ..operators import phases

    return preds(spark, d).select("seq", F.coalesce(F.size(phases.kept_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>")))), F.lit(0)).cast("long").alias("kept"))


@query("build_status", f"SELECT run_tag, count(*) AS rows, count(*) FILTER ({ST} = 'ok') AS ok, count(*) FILTER (regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]')) AS with_text, count(*) FILTER (coalesce(oom_occurred, false)) AS oom FROM predictions GROUP BY 1")
def _build(spark, d):
    from ..operators import phases

    return phases.build_status(preds(spark, d))


@query("documents_by_type", _CORPUS + ", x AS (SELECT doc_id, arg_min(doc_type, question_id) FILTER (doc_type IS NOT NULL) AS doc_type, count(DISTINCT doc_type) AS types FROM c GROUP BY 1) SELECT doc_type, count(*) AS docs, count(*) FILTER (types > 1) AS conflicts FROM x GROUP BY 1")
def _bytype(spark, d):
    from ..operators import phases

    c = corpus(spark, d)
    first = c.filter("doc_type is not null").groupBy("doc_id").agg(F.min_by("doc_type", "question_id").alias("t"))
    return phases.documents_by_type(c.drop("doc_type").join(c.select("question_id", "doc_type"), "question_id").join(first, "doc_id", "left").select("doc_id", "question_id", F.coalesce("doc_type", "t").alias("doc_type")))


@query("resolution_verdict", f"""WITH r AS (SELECT model_spec, visual_resolution, count(*) FILTER ({ST} = 'oom') AS oom, max(peak_vram_bytes) AS peak, CASE visual_resolution WHEN 'high' THEN 752640 WHEN 'med' THEN 501760 ELSE 313600 END AS cap FROM predictions WHERE visual_resolution IN ('high', 'med', 'low') GROUP BY ALL)
SELECT model_spec, arg_max(visual_resolution, cap) FILTER (oom = 0) AS highest_ok, coalesce(arg_max(visual_resolution, cap) FILTER (oom = 0 AND peak / 1e6 < 16384), arg_min(visual_resolution, cap)) AS highest_fitting FROM r GROUP BY 1""")
def _res(spark, d):
    from ..operators import phases

    return phases.resolution_verdict(preds(spark, d), S.PIXEL_CAPS)


@query("doc_type_backfill", _CORPUS + ", f AS (SELECT doc_id, arg_min(doc_type, question_id) AS t FROM c WHERE trim(coalesce(doc_type, '')) <> '' GROUP BY 1) SELECT question_id, CASE WHEN trim(coalesce(doc_type, '')) = '' THEN t ELSE doc_type END AS doc_type FROM c LEFT JOIN f USING (doc_id)")
def _backtype(spark, d):
    from ..operators import phases

    c = corpus(spark, d)
    return phases.backfill_doc_type(c.select("question_id", "doc_id", "doc_type"), c).select("question_id", "doc_type")


@query("gold_page_check", _CORPUS + f", {_NP} SELECT question_id, list_bool_and([p < np.pages for p in c.pg]) AS inside FROM c JOIN np ON np.doc_id = c.doc_id WHERE len(c.pg) > 0")
def _goldcheck(spark, d):
    from ..operators import phases

    n = table(spark, d, "doc_pages").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    c = corpus(spark, d).filter(F.size("pages") > 0).join(n, "doc_id")
    return c.select("question_id", phases.gold_in_range(F.col("pages"), F.col("n")).alias("inside"))
