"""DuckDB SQL of the core queries, written independently of the DataFrame code."""

from __future__ import annotations

from ..functions.scalar import ABSTENTIONS

_FORMS = " OR ".join(f"contains(flat, '{f}')" for f in ABSTENTIONS)

FACTS = f"""
gold AS (SELECT question_id, arg_min(answer, ingested_at) AS gold, arg_min(evidence_pages, ingested_at) AS pages, arg_min(doc_id, ingested_at) AS qdoc,
                arg_min(question, ingested_at) AS qtext FROM questions WHERE question_id IS NOT NULL GROUP BY question_id),
p0 AS (SELECT *, coalesce(status, 'ok') AS st, regexp_replace(trim(replace(lower(coalesce(text, '')), 'ß', 'ss')), '[\\s\\p{{Z}}]+', ' ', 'g') AS flat,
              replace(lower(coalesce(text, '')), 'ß', 'ss') AS low FROM predictions),
p1 AS (SELECT *, ({_FORMS}) AS abstained FROM p0),
p2 AS (SELECT p1.*, gold, pages, CASE WHEN coalesce(is_unanswerable, false) THEN abstained
              ELSE trim(coalesce(gold, '')) <> '' AND contains(low, trim(replace(lower(coalesce(gold, '')), 'ß', 'ss'))) AND NOT abstained END AS correct,
              split_part(condition, '__', 1) AS base, CASE WHEN contains(condition, '__') THEN substr(condition, strpos(condition, '__') + 2) ELSE '' END AS mode
       FROM p1 LEFT JOIN gold USING (question_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, condition, representation, model_spec, visual_resolution ORDER BY (st <> 'ok'), seq) AS rn FROM p2),
j AS (SELECT * REPLACE (CASE WHEN coalesce(doc_type, '') = '' THEN '(unknown)' ELSE doc_type END AS doc_type,
             CASE WHEN isnan(latency_s) THEN NULL ELSE latency_s END AS latency_s, CASE WHEN isnan(prefill_latency_s) THEN NULL ELSE prefill_latency_s END AS prefill_latency_s,
             CASE WHEN isnan(decode_latency_s) THEN NULL ELSE decode_latency_s END AS decode_latency_s) FROM best WHERE rn = 1 AND st = 'ok'),
ob AS (SELECT * FROM j WHERE base = 'oracle' OR NOT EXISTS (SELECT 1 FROM j WHERE base = 'oracle')),
spec AS (SELECT model_spec FROM ob GROUP BY 1 ORDER BY (model_spec <> 'orlin-8b-local'), count(*) DESC, min(seq) LIMIT 1),
o AS (SELECT * FROM ob WHERE model_spec IN (SELECT model_spec FROM spec))
"""
ACC = "sum(correct::INT)::BIGINT / count(*)"
RATE = "sum(abstained::INT)::BIGINT / count(*)"


def facts(body: str) -> str:
    return f"WITH {FACTS}{body}"


def acc(keys: str, source: str = "o", where: str = "true") -> str:
    return f"SELECT {keys}, count(*) AS n, {ACC} AS accuracy FROM {source} WHERE {where} GROUP BY ALL"


# gold pages: every integer of the list, lowered by one, distinct
GOLD = """,
gp AS (SELECT question_id, len(list_distinct([greatest(x - 1, 0) for x in [try_cast(y AS INT) for y in
        CASE WHEN pages IS NULL OR lower(trim(pages)) IN ('', 'none', 'nan', 'null') THEN [] ELSE str_split(regexp_replace(trim(pages), '[\\[\\]''\"\\s]', '', 'g'), ',') END]
        if x IS NOT NULL])) AS gold FROM gold)
"""
B5 = "CASE WHEN g <= 0 THEN '' WHEN g <= 3 THEN g::VARCHAR WHEN g <= 5 THEN '4-5' ELSE '6+' END"
B3 = "CASE WHEN g <= 0 THEN '' WHEN g <= 2 THEN g::VARCHAR ELSE '3+' END"
_RX = "^(retrieved|similarity)_(text|vision|joint|bm25|bge|colqwen\\w*)_k(\\d+)"
MODALITY = (f"CASE regexp_extract(base, '{_RX}', 2) WHEN '' THEN '' WHEN 'text' THEN 'text' WHEN 'bm25' THEN 'text' WHEN 'bge' THEN 'text' WHEN 'joint' THEN 'joint' ELSE 'vision' END")
K = f"try_cast(nullif(regexp_extract(base, '{_RX}', 3), '') AS INT)"
_PS = "^pageset:r=([A-Za-z0-9.\\-]+):g=(all|(?:keep|drop)_(?:top|bottom)-\\d+):d=(\\d+)(?::p=([xk][px][xo]))?$"
PAGESET = f""",
ps AS (SELECT *, regexp_extract(base, '{_PS}', 1) AS ranker, CASE WHEN regexp_extract(base, '{_PS}', 2) = 'all' THEN 'all' ELSE regexp_extract(regexp_extract(base, '{_PS}', 2), '^(.*)-\\d+$', 1) END AS gold_mode,
        CASE WHEN regexp_extract(base, '{_PS}', 2) = 'all' THEN 0 ELSE regexp_extract(regexp_extract(base, '{_PS}', 2), '-(\\d+)$', 1)::INT END AS gold_count,
        regexp_extract(base, '{_PS}', 3)::INT AS distractors FROM j WHERE regexp_matches(base, '{_PS}'))
"""
HOP = "sum(CASE WHEN hop = '{0}' THEN correct::INT END)::BIGINT / nullif(count(*) FILTER (hop = '{0}'), 0)"
S_, M_ = HOP.format("single"), HOP.format("multi")
UN = "SELECT * FROM j WHERE coalesce(is_unanswerable, false) OR NOT EXISTS (SELECT 1 FROM j WHERE is_unanswerable)"


def _transition(group: str, source: str) -> str:
    return f"""SELECT pairing, {group} AS "group", count(*) AS n, sum((NOT x AND y)::INT)::BIGINT / count(*) AS wrong_right, sum((x AND NOT y)::INT)::BIGINT / count(*) AS right_wrong,
      sum((x AND y)::INT)::BIGINT / count(*) AS right_right, sum((NOT x AND NOT y)::INT)::BIGINT / count(*) AS wrong_wrong FROM {source} GROUP BY ALL"""


_PAIRS = """,
lastrow AS (SELECT *, row_number() OVER (PARTITION BY question_id, representation ORDER BY seq DESC) AS ln FROM o),
l1 AS (SELECT * FROM lastrow WHERE ln = 1),
pr(a, b) AS (VALUES ('TL', 'TLV'), ('T', 'TL'), ('T', 'TLV')),
tr AS (SELECT a || '>' || b AS pairing, l.doc_type, l.evidence_sources, l.correct AS x, r.correct AS y FROM pr JOIN l1 l ON l.representation = a JOIN l1 r ON r.representation = b AND r.question_id = l.question_id)
"""
_LEVER = """SELECT * FROM (VALUES {rows}) v(lever, metric, bn, bs, ln, ls)"""


def _lever_rows() -> str:
    un = "coalesce(is_unanswerable, false)"
    o, cut = "base = 'oracle'", "representation = 'TLV'"
    mode = lambda m: f"{o} AND {cut} AND NOT {un} AND mode = '{m}'"
    spec = [
        ("resolution_med_high", "correct", f"{o} AND {cut} AND visual_resolution = 'med'", f"{o} AND {cut} AND visual_resolution = 'high'"),
        ("interleaving", "correct", f"{o} AND {cut}", f"{o} AND representation = 'TLVi'"), ("cot_prompt", "correct", mode("grounded"), mode("cot")),
        ("extraction", "correct", mode("grounded"), mode("extract_cot")),
        ("abstention_prompt", "abstained", f"{cut} AND {un} AND mode = 'none'", f"{cut} AND {un} AND mode = 'targeted'"),
        ("depth_k1_k5", "correct", "representation = 'V' AND base = 'retrieved_vision_k1'", "representation = 'V' AND base = 'retrieved_vision_k5'"),
        ("model_swap", "correct", f"{o} AND {cut} AND model_spec = 'orlin-8b-local'", f"{o} AND {cut} AND model_spec = 'tavex3-8b-local'"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS lever, '{m}' AS metric, count(*) FILTER ({a}) AS bn, count(*) FILTER ({a} AND {m}) AS bs, count(*) FILTER ({b}) AS ln, count(*) FILTER ({b} AND {m}) AS ls FROM j"
        for n, m, a, b in spec)


def _with_total(keys: str, detail: str, source: str, where: str = "true") -> str:
    k = f"{keys}, " if keys else ""
    return (f"SELECT {k}{detail}, count(*) AS n, {ACC} AS accuracy FROM {source} WHERE {where} GROUP BY ALL "
            f"UNION ALL SELECT {k}'(all)', count(*), {ACC} FROM {source} WHERE {where} GROUP BY ALL")


TABLES = {
    "headline": facts(_with_total("doc_type", "representation", "o")),
    "composition_explode": facts(f", s AS (SELECT *, unnest(CASE WHEN len(evidence_sources) > 0 THEN evidence_sources ELSE ['(none)'] END) AS source FROM o) {acc('source, representation', 's')}"),
    "source_stratification": facts(f", s AS (SELECT *, coalesce(nullif(metadata['source_dataset'], ''), '(uncoded)') AS stratum FROM o) {acc('stratum, representation', 's')}"),
    "transition_by_type": facts(_PAIRS + _transition("doc_type", "tr") + " UNION ALL " + _transition("'(all)'", "tr")),
    "transition_by_source": facts(_PAIRS + ", sx AS (SELECT *, unnest(CASE WHEN len(evidence_sources) > 0 THEN evidence_sources ELSE ['(none)'] END) AS src FROM tr) "
                                  + _transition("src", "sx") + " UNION ALL " + _transition("'(all)'", "tr")),
    "attribution_pairs": facts(f""",
lr AS (SELECT *, row_number() OVER (PARTITION BY question_id, representation ORDER BY seq DESC) AS ln FROM o),
a AS (SELECT representation, count(*) AS n, {ACC} AS accuracy FROM o GROUP BY 1),
r0 AS (SELECT * FROM j WHERE starts_with(base, 'retrieved_')),
rs AS (SELECT model_spec FROM r0 GROUP BY 1 ORDER BY (model_spec <> 'orlin-8b-local'), count(*) DESC, min(seq) LIMIT 1),
r1 AS (SELECT *, {K} AS k FROM r0 WHERE model_spec IN (SELECT * FROM rs)),
pair AS (SELECT r1.representation, r1.base, r1.seq, r1.correct, lr.correct AS oc FROM r1 JOIN lr ON lr.ln = 1 AND lr.question_id = r1.question_id AND lr.representation = r1.representation
         WHERE (r1.representation = 'V' AND k IN (1, 3, 5)) OR (r1.representation = 'TLV' AND k IN (1, 3))),
per AS (SELECT representation, base, count(*) AS paired_n, {ACC} AS retrieved, sum(oc::INT)::BIGINT / count(*) AS po, min(seq) AS f FROM pair GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY representation ORDER BY retrieved DESC, f) AS r FROM per)
SELECT a.representation, n, accuracy, (SELECT max(accuracy) FROM a) - accuracy AS representation_loss, b.base AS retrieval_ref, paired_n, retrieved, po - retrieved AS retrieval_loss
FROM a LEFT JOIN b ON b.r = 1 AND a.representation = b.representation"""),
    "hop_gap": facts(f"SELECT doc_type, representation, count(*) AS n, {S_} AS single, {M_} AS multi, ({M_} - {S_}) * 100 AS gap FROM o WHERE hop IN ('single', 'multi') GROUP BY ALL"),
    "bucket_rung": facts(GOLD + f", g AS (SELECT o.*, coalesce(gp.gold, 0) AS g FROM o LEFT JOIN gp USING (question_id)), gb AS (SELECT *, {B5} AS bucket FROM g) {acc('bucket, representation', 'gb', chr(34) + 'bucket' + chr(34) + ' <> ' + repr(''))}"),
    "bucket_slope": facts(GOLD + f""", g AS (SELECT o.*, coalesce(gp.gold, 0) AS g FROM o LEFT JOIN gp USING (question_id)), gb AS (SELECT *, {B5} AS bucket FROM g),
a AS (SELECT bucket, representation, {ACC} AS accuracy, CASE bucket WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4-5' THEN 3 ELSE 4 END AS r FROM gb WHERE bucket <> '' GROUP BY ALL)
SELECT representation, arg_max(accuracy, r) - arg_min(accuracy, r) AS slope FROM a GROUP BY 1"""),
    "hop_doctype": facts(GOLD + f", g AS (SELECT o.*, coalesce(gp.gold, 0) AS g FROM o LEFT JOIN gp USING (question_id)), gb AS (SELECT *, {B3} AS bucket FROM g) " + _with_total("doc_type, representation", "bucket", "gb", "bucket <> ''")),
    "selection_rules": facts(PAGESET + acc("gold_mode, gold_count, distractors, ranker, representation", "ps")),
    "selection_robustness": facts(GOLD + PAGESET + f""", u AS (SELECT question_id, representation, correct, distractors, ranker FROM ps WHERE gold_mode = 'all' UNION ALL SELECT question_id, representation, correct, 0, '' FROM o)
SELECT gp.gold::INT AS gold, distractors, ranker, representation, count(*) AS n, {ACC} AS accuracy FROM u JOIN gp USING (question_id) WHERE gp.gold > 0 GROUP BY ALL"""),
    "abstention_rate": facts(f", u AS ({UN}) SELECT CASE WHEN mode = '' THEN condition ELSE mode END AS prompt, count(*) AS n, {RATE} AS rate FROM u GROUP BY ALL"),
    "abstention_pivot": facts(f", u AS ({UN}) SELECT doc_type, " + ", ".join(
        f"sum(CASE WHEN mode = '{m}' THEN abstained::INT END)::BIGINT / nullif(count(*) FILTER (mode = '{m}'), 0) AS \"{m}\""
        for m in ("none", "generic", "grounded", "targeted", "abstain", "abstain_balanced", "cot", "extract_cot")) + " FROM u GROUP BY 1"),
    "faithfulness_full_outer": facts(f""",
a AS (SELECT mode, representation, count(*) AS n_answerable, {ACC} AS accuracy, {RATE} AS false_abstention, count(*) FILTER (coalesce(metadata['output_truncated'], 'false') = 'true') AS truncated
      FROM o WHERE NOT coalesce(is_unanswerable, false) GROUP BY ALL),
b AS (SELECT mode, representation, count(*) AS n_unanswerable, {RATE} AS abstention FROM o WHERE coalesce(is_unanswerable, false) GROUP BY ALL)
SELECT * FROM a FULL JOIN b USING (mode, representation)"""),
    "reasoner_unified": facts(f"SELECT model_spec, representation, count(*) AS n, {ACC} AS accuracy, ({M_} - {S_}) * 100 AS multi_minus_single FROM ob GROUP BY ALL"),
    "scale_weights": facts(f""", r AS (SELECT model_spec, representation, count(*) AS n, {ACC} AS accuracy, round(avg(latency_s) * 1000, 3) AS latency_ms, max(peak_vram_bytes) AS peak_vram_bytes FROM ob GROUP BY ALL)
SELECT r.*, w.weights_bytes, w.method FROM r LEFT JOIN (SELECT model_spec, sum(weights_bytes)::BIGINT AS weights_bytes, max(method) AS method FROM model_weights GROUP BY 1) w USING (model_spec)"""),
    "quant_delta": facts(f""", q AS (SELECT *, CASE WHEN model_spec LIKE '%-4bit' THEN '4bit' WHEN model_spec LIKE '%-8bit' THEN '8bit' ELSE '16bit' END AS quant FROM ob
       WHERE regexp_replace(model_spec, '-(4|8)bit$', '') = 'orlin-8b-local'), a AS (SELECT doc_type, quant, count(*) AS n, {ACC} AS accuracy, max(peak_vram_bytes) AS vram FROM q GROUP BY ALL)
SELECT a.*, (a.accuracy - b.accuracy) * 100 AS acc_delta, a.vram - b.vram AS vram_delta FROM a LEFT JOIN a b ON b.quant = '16bit' AND a.doc_type = b.doc_type"""),
    "quant_rung_delta": facts(f""", q AS (SELECT *, CASE WHEN model_spec LIKE '%-4bit' THEN '4bit' WHEN model_spec LIKE '%-8bit' THEN '8bit' ELSE '16bit' END AS quant FROM ob
       WHERE regexp_replace(model_spec, '-(4|8)bit$', '') = 'orlin-8b-local'), a AS (SELECT representation, quant, count(*) AS n, {ACC} AS accuracy, max(peak_vram_bytes) AS vram FROM q GROUP BY ALL)
SELECT a.*, (a.accuracy - b.accuracy) * 100 AS acc_delta, a.vram - b.vram AS vram_delta FROM a LEFT JOIN a b ON b.quant = '16bit' AND a.representation = b.representation"""),
    "vram_headroom_p95": facts(""", v AS (SELECT model_spec, representation, visual_resolution, peak_vram_bytes AS b, count(*) OVER w AS n, row_number() OVER (w ORDER BY peak_vram_bytes) - 1 AS i, max(peak_vram_bytes) OVER w AS mx
FROM j WHERE peak_vram_bytes > 0 WINDOW w AS (PARTITION BY model_spec, representation, visual_resolution))
SELECT model_spec, representation, visual_resolution, mx AS max_bytes, n, b AS p95_bytes, 16384 - mx / 1e6 AS headroom_mb FROM v WHERE i = round_even(0.95::DOUBLE * (n - 1), 0)::INT"""),
    "pages_bucket_rate": facts(""", c AS (SELECT *, coalesce(len(page_indices), 0) AS pn FROM best WHERE rn = 1), b AS (SELECT *, CASE WHEN pn <= 0 THEN '0' WHEN pn = 1 THEN '1' WHEN pn <= 5 THEN '2-5' WHEN pn <= 10 THEN '6-10' WHEN pn <= 20 THEN '11-20' ELSE '21+' END AS bucket FROM c)
SELECT representation, visual_resolution, bucket, count(*) AS n, count(*) FILTER (st = 'oom') AS n_oom, count(*) FILTER (st = 'oom') * 100 / count(*) AS oom_pct FROM b GROUP BY ALL"""),
    "prefill_cost": facts("SELECT doc_type, representation, count(*) AS n, round(CASE WHEN max(prefill_latency_s) > 0 THEN avg(prefill_latency_s) * 1000 END, 3) AS prefill_ms, round(avg(coalesce(total_text_tokens, 0) + coalesce(total_visual_tokens, 0)), 6) AS mean_tokens FROM o GROUP BY ALL"),
    "resolution_pivot": facts(acc("doc_type, representation, visual_resolution", "o", "representation IN ('TLV', 'V')")),
    "matched_cross": facts(f", m AS (SELECT *, {MODALITY} AS modality FROM j) {acc('doc_type, modality', 'm', 'modality <> ' + repr(''))}"),
    "kdepth_parse": facts(f", m AS (SELECT *, {MODALITY} AS modality, {K} AS k FROM j) {acc('k, modality', 'm', 'k IS NOT NULL')}"),
    "scan_split": facts(f""", s AS (SELECT o.* REPLACE (coalesce(nullif(CASE WHEN trim(coalesce(o.scan_label, '')) = '' THEN l.scan_label ELSE o.scan_label END, ''), '(unlabeled)') AS scan_label) FROM o LEFT JOIN doc_labels l USING (doc_id))
{acc('doc_type, representation, scan_label', 's')}"""),
    "levers_delta": facts(f", l AS ({_lever_rows()}) SELECT lever, metric, bn AS base_n, ln AS lever_n, CASE WHEN bn > 0 AND ln > 0 THEN bs / bn END AS base_value, CASE WHEN bn > 0 AND ln > 0 THEN ls / ln END AS lever_value, CASE WHEN bn > 0 AND ln > 0 THEN (ls / ln - bs / bn) * 100 END AS delta FROM l"),
    "labeled_union_matrix": facts(f"SELECT doc_type, run_tag, representation, count(*) AS n, count(DISTINCT question_id) AS questions, {ACC} AS accuracy FROM o WHERE representation IN ('TL', 'TLV') GROUP BY ALL"),
    "cost_summary": facts("SELECT model_spec, representation, count(*) AS n, round(avg(latency_s), 6) AS mean_latency_s, round(avg(prefill_latency_s), 6) AS mean_prefill_latency_s, round(avg(decode_latency_s), 6) AS mean_decode_latency_s, sum(total_text_tokens)::BIGINT AS text_tokens, sum(total_visual_tokens)::BIGINT AS visual_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(coalesce(total_text_tokens, 0) + coalesce(total_visual_tokens, 0))::BIGINT AS all_tokens, max(peak_vram_bytes) AS peak_vram_bytes FROM j GROUP BY ALL"),
    "accuracy_points": facts(acc("model_spec, representation", "j")),
}
