"""Queries over orders, samples, sheets, page-set rules, run summaries and further tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import facts, grid, pageset, profile, represent, retrieval, stats
from ..operators.packed import packed_values
from ..queries_data import ORACLE as DATA_SQL
from ..session import cut_lineage, table
from . import operators_queries as base
from . import sql
from .operators_queries import _BM, _CORPUS, _NP, _PRF, _RULE, ST, corpus, judged, page_questions, posted, preds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# -- fixed orders -----------------------------------------------------------------------

_KINDS = {
    "doc_type": ("doc_type", S.DOC_TYPES), "representation": ("representation", S.RUNGS), "prompt": ("mode", S.MODES),
    "resolution": ("visual_resolution", S.RESOLUTIONS), "quant": ("quant", S.QUANTS),
}


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rank_sql(kind: str, values) -> str:
    if kind == "prompt":
        return "CASE v " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in S.MODE_RANK.items()) + " ELSE 99 END"
    return f"coalesce(list_position({_listed(values)}, v) - 1, 99)"


@query("category_order", sql.facts(", v AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, v AS value, {_rank_sql(k, o)} AS r FROM (SELECT DISTINCT {'CASE WHEN model_spec LIKE ' + repr('%-4bit') + ' THEN ' + repr('4bit') + ' WHEN model_spec LIKE ' + repr('%-8bit') + ' THEN ' + repr('8bit') + ' ELSE ' + repr('16bit') + ' END' if k == 'quant' else c} AS v FROM j) WHERE v IS NOT NULL"
    for k, (c, o) in _KINDS.items()) + ") SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY r, value) AS place FROM v"))
def _order(spark, d):
    """The values that occur of every category with a fixed order, in that order, others after them by name."""
    j = judged(spark, d).withColumn("quant", S.quant_of(F.col("model_spec")))
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, (c, _) in _KINDS.items()])).alias("e")
    v = j.select(every).select("e.*").filter("value is not null").distinct()
    rank = F.lit(99)
    for k, (_, order) in _KINDS.items():
        own = S.rank_of(F.col("value"), order)
        if k == "prompt":
            own = F.lit(99)
            for m, n in S.MODE_RANK.items():
                own = F.when(F.col("value") == m, n).otherwise(own)
        rank = F.when(F.col("kind") == k, own).otherwise(rank)
    return v.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(rank, "value"))).select("kind", "value", "place")


# -- agreement ----------------------------------------------------------------------------

_PAIR = """WITH a AS (SELECT doc_id, lower(trim(scan_label)) AS a FROM doc_labels WHERE trim(coalesce(scan_label, '')) <> ''),
b AS (SELECT doc_id, min(lower(trim(scan_label))) AS b FROM questions WHERE trim(coalesce(scan_label, '')) <> '' GROUP BY 1), r AS (SELECT a, b FROM a JOIN b USING (doc_id)),
n AS (SELECT count(*) AS n, sum((a = b)::INT)::BIGINT / count(*) AS observed FROM r HAVING count(*) > 0),
e AS (SELECT coalesce(sum(x.c * y.c), 0)::BIGINT AS xy FROM (SELECT a, count(*) AS c FROM r GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM r GROUP BY 1) y ON a = b),
k AS (SELECT n AS shared, round(CASE WHEN xy / (n * n) = 1 THEN (observed = 1)::INT ELSE (observed - xy / (n * n)) / (1 - xy / (n * n)) END, 9) AS kappa FROM n, e)
SELECT shared, kappa, kappa >= 0.75 AS passes FROM k"""


@query("sheet_agreement", _PAIR)
def _agreement(spark, d):
    """Two sheets paired by their shared documents that both have filled; whether their agreement passes the gate."""
    filled = F.trim(F.coalesce("scan_label", F.lit(""))) != ""
    a = table(spark, d, "doc_labels").filter(filled).select("doc_id", F.lower(F.trim("scan_label")).alias("a"))
    b = table(spark, d, "questions").filter(filled).groupBy("doc_id").agg(F.min(F.lower(F.trim("scan_label"))).alias("b"))
    k = stats.kappa(a.join(b, "doc_id"), "a", "b")
    return k.select(F.col("n").alias("shared"), F.round("kappa", 9).alias("kappa")).withColumn("passes", stats.agreement_passes(F.col("kappa")))


@query("label_complaints", f"SELECT doc_id, 'bin_label' AS \"column\", trim(bin_label) AS bad FROM doc_labels WHERE trim(coalesce(bin_label, '')) NOT IN ('', {', '.join(repr(b) for b in S.BINS)}) UNION ALL SELECT doc_id, 'dominant_visual', v FROM (SELECT doc_id, unnest([trim(x) for x in regexp_split_to_array(coalesce(dominant_visual, ''), '[,;|]') if trim(x) <> '']) AS v FROM doc_labels) WHERE v NOT IN ('figures', 'charts')")
def _complaints(spark, d):
    """Values outside the vocabulary of a sheet, in single and in multi-value fields."""
    s = table(spark, d, "doc_labels")
    one = lambda c, ok, multi: profile.invalid_labels(s, c, ok, multi).select("doc_id", F.lit(c).alias("column"), "bad")
    return one("bin_label", S.BINS, False).unionByName(one("dominant_visual", ("figures", "charts"), True))


@query("sheet_distributions", "WITH v AS (SELECT 'bin_label' AS \"column\", trim(bin_label) AS value FROM doc_labels UNION ALL SELECT 'scan_label', trim(scan_label) FROM doc_labels UNION ALL SELECT 'dominant_visual', trim(unnest(regexp_split_to_array(dominant_visual, '[,;|]'))) FROM doc_labels) SELECT \"column\", value, count(*) AS docs FROM v WHERE value <> '' GROUP BY 1, 2")
def _distributions(spark, d):
    """How often each value stands in each column of a sheet; multi-value fields by their members."""
    return profile.distributions(table(spark, d, "doc_labels"), ("bin_label", "scan_label"), ("dominant_visual",))


@query("complete_rows", "SELECT doc_id, trim(coalesce(bin_label, '')) <> '' AND trim(coalesce(scan_label, '')) <> '' AND trim(coalesce(dominant_visual, '')) <> '' AS complete FROM doc_labels")
def _complete(spark, d):
    return table(spark, d, "doc_labels").select("doc_id", profile.is_complete("bin_label", "scan_label", "dominant_visual").alias("complete"))


@query("blind_subset")
def _blind(spark, d):
    """A seeded sample of fully labelled documents with their labels blanked, for a second reader."""
    return profile.blind_subset(table(spark, d, "doc_labels"), ("bin_label", "scan_label", "dominant_visual"), 20, seed=3).select("doc_id", "bin_label", "scan_label", "dominant_visual")


# -- samples of questions --------------------------------------------------------------

@query("capped_per_type", _CORPUS + ", r AS (SELECT question_id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY question_id) AS n FROM c) SELECT question_id, doc_type FROM r WHERE n <= 3")
def _capped(spark, d):
    """At most three questions of each doc_type, in corpus order."""
    return grid.cap_per_group(corpus(spark, d), "doc_type", 3).select("question_id", "doc_type")


@query("exact_draw")
def _exact(spark, d):
    """Exactly 40 questions per group: whole documents in a seeded order, cut in corpus order."""
    c = corpus(spark, d).withColumn("group", F.lower(F.trim("scan_label")))
    return grid.cap_per_group(grid.coherent_draw(c, "group", 40), "group", 40).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("uniform_sample")
def _uniform(spark, d):
    """25 pages drawn by the seeded generator from all pages in order."""
    p = table(spark, d, "doc_pages").select("doc_id", "page_index")
    return grid.uniform_sample(p, ["doc_id", "page_index"], 25, seed=5)


# -- documents --------------------------------------------------------------------------

@query("document_listing", _CORPUS + """, x AS (SELECT doc_id, count(*) AS questions, coalesce(arg_min(doc_type, question_id) FILTER (doc_type IS NOT NULL), '') AS doc_type, count(*) FILTER (un) AS unanswerable FROM c GROUP BY 1)
SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY questions DESC, doc_id) AS place FROM x""")
def _listing(spark, d):
    """Questions per document with its first doc_type, ordered within the type by count, then name."""
    x = corpus(spark, d).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("questions"), F.coalesce(F.min_by("doc_type", F.when(F.col("doc_type").isNotNull(), F.col("question_id"))), F.lit("")).alias("doc_type"), F.count_if("is_unanswerable").alias("unanswerable"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("doc_type").orderBy(F.desc("questions"), "doc_id")))


@query("scan_contingency", _CORPUS + """, x AS (SELECT DISTINCT doc_id, coalesce(doc_type, '') AS doc_type, CASE WHEN lower(trim(coalesce(scan_label, ''))) IN ('scanned', 'digital') THEN lower(trim(scan_label)) ELSE 'unknown' END AS s FROM c)
SELECT doc_type, count(*) FILTER (s = 'digital') AS digital, count(*) FILTER (s = 'scanned') AS scanned, count(*) FILTER (s = 'unknown') AS unknown FROM x GROUP BY 1""")
def _contingency(spark, d):
    """doc_type x digital, scanned, unknown, counted in documents."""
    label = F.lower(F.trim(F.coalesce("scan_label", F.lit(""))))
    x = corpus(spark, d).select("doc_id", F.coalesce("doc_type", F.lit("")).alias("doc_type"), F.when(label.isin("scanned", "digital"), label).otherwise("unknown").alias("s")).distinct()
    return x.groupBy("doc_type").agg(*[F.count_if(F.col("s") == k).alias(k) for k in ("digital", "scanned", "unknown")])


@query("class_totals", _CORPUS + """, s AS (SELECT question_id, doc_id, unnest(CASE WHEN len(pg) = 0 THEN ['(none)'] ELSE [x::VARCHAR for x in pg] END) AS class FROM c)
SELECT class, count(*) AS questions, count(DISTINCT doc_id) AS docs, row_number() OVER (ORDER BY count(*) DESC, min(question_id), class) AS place FROM s GROUP BY 1 UNION ALL SELECT '(all)', count(*), count(DISTINCT doc_id), 0 FROM c""")
def _totals(spark, d):
    """Questions and documents per class of a list field (here the gold pages), most frequent first, and totals that count each question once."""
    c = corpus(spark, d)
    return profile.class_totals(c, F.transform(F.coalesce("pages", F.array()), lambda p: p.cast("string")), "class")


# -- runs -------------------------------------------------------------------------------

@query("run_summary", f"""WITH e AS (SELECT run_tag, count(DISTINCT (question_id, condition, representation)) * count(DISTINCT model_spec) * greatest(count(DISTINCT nullif(visual_resolution, '')), 1) AS expected FROM predictions GROUP BY 1),
c AS (SELECT run_tag, max(CASE {ST} WHEN 'ok' THEN 2 WHEN 'oom' THEN 1 ELSE 0 END) AS r FROM predictions GROUP BY run_tag, {base.IDENT}), s AS (SELECT run_tag, count(*) AS done, count(*) FILTER (r = 2) AS ok, count(*) FILTER (r = 1) AS oom, count(*) FILTER (r = 0) AS error FROM c GROUP BY 1)
SELECT run_tag, expected, done, ok, oom, error, CASE WHEN expected > 0 THEN round_even(100 * done / expected, 0)::BIGINT || '%' ELSE '-' END AS done_pct, CASE WHEN done > 0 THEN round_even(100 * oom / done, 0)::BIGINT || '%' ELSE '-' END AS oom_pct FROM s JOIN e USING (run_tag)""")
def _summary(spark, d):
    """Per run the rows its grid asks for (cells x models x resolutions), what is done, and the shares."""
    return facts.run_summary(preds(spark, d))


@query("uncoded_cells", f"SELECT representation, count(*) AS cells, count(*) FILTER ({ST} = 'ok') AS ok FROM predictions WHERE coalesce(metadata['source_dataset'], '') = '' GROUP BY 1")
def _uncoded(spark, d):
    """Cells without a source dataset, counted from all prediction rows, failed ones too."""
    p = facts.with_status(preds(spark, d)).filter(F.coalesce(F.col("metadata")["source_dataset"], F.lit("")) == "")
    return p.groupBy("representation").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("status") == "ok").alias("ok"))


@query("attribution_residual", sql.facts(f""", a AS (SELECT representation, count(*) AS n, {sql.ACC} AS accuracy FROM o GROUP BY 1), b AS (SELECT *, max(accuracy) OVER () AS best, row_number() OVER (ORDER BY accuracy DESC, coalesce(list_position({_listed(S.RUNGS)}, representation), 99)) AS place FROM a)
SELECT representation, n, accuracy, (best - accuracy) * 100 AS representation_loss, CASE WHEN place = 1 THEN (1 - best) * 100 END AS residual FROM b"""))
def _residual(spark, d):
    """Representation loss per rung, and what is left to reasoning at the best one (the first of equals in rung order)."""
    from .tables import oracle

    a = stats.accuracy(oracle(judged(spark, d)), ["representation"])
    best = F.max("accuracy").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.orderBy(F.desc("accuracy"), S.rank_of(F.col("representation"), S.RUNGS)))
    b = a.withColumn("best", best).withColumn("place", place)
    return b.select("representation", "n", "accuracy", ((F.col("best") - F.col("accuracy")) * 100).alias("representation_loss"), F.when(F.col("place") == 1, (1 - F.col("best")) * 100).alias("residual"))


_GAP = "sum(CASE WHEN hop = 'multi' THEN correct::INT END)::BIGINT / nullif(count(*) FILTER (hop = 'multi'), 0) - sum(CASE WHEN hop = 'single' THEN correct::INT END)::BIGINT / nullif(count(*) FILTER (hop = 'single'), 0)"


@query("lever_hop_gap", sql.facts(f", g AS (SELECT model_spec, count(*) AS n, {_GAP} AS gap FROM j WHERE base = 'oracle' AND representation = 'TLV' GROUP BY 1), b AS (SELECT n, gap FROM g WHERE model_spec = 'orlin-8b-local') SELECT g.model_spec, b.n AS base_n, g.n AS lever_n, round(b.gap * 100, 9) AS base_value, round(g.gap * 100, 9) AS lever_value, round((g.gap - b.gap) * 100, 9) AS delta FROM g LEFT JOIN b ON true WHERE g.model_spec <> 'orlin-8b-local'"))
def _hop_lever(spark, d):
    """The eighth lever, for every model beside the default one: multi less single at TLV, in points."""
    of = lambda h: F.sum(F.when(F.col("hop") == h, F.col("correct").cast("long"))) / F.sum((F.col("hop") == h).cast("long"))
    j = judged(spark, d).filter((F.col("base") == "oracle") & (F.col("representation") == "TLV"))
    g = cut_lineage(j.groupBy("model_spec").agg(F.count(F.lit(1)).alias("n"), (of("multi") - of("single")).alias("gap")))
    b = g.filter(F.col("model_spec") == facts.DEFAULT_SPEC).first()
    n, gap = (b.n, b.gap) if b else (None, None)
    points = lambda c: F.round(c * 100, 9)
    base_gap = F.lit(gap).cast("double")
    return g.filter(F.col("model_spec") != facts.DEFAULT_SPEC).select(
        "model_spec", F.lit(n).cast("long").alias("base_n"), F.col("n").alias("lever_n"), points(base_gap).alias("base_value"), points(F.col("gap")).alias("lever_value"), points(F.col("gap") - base_gap).alias("delta"))


@query("evidence_overlap", "WITH v AS (SELECT question_id, list(evidence_source) AS l FROM (" + DATA_SQL["p1_found"] + ") GROUP BY 1) SELECT p.seq, len(list_distinct(p.evidence_sources)) AS told, len(list_intersect(p.evidence_sources, coalesce(l, []))) AS shared FROM predictions p LEFT JOIN v USING (question_id) WHERE p.evidence_sources IS NOT NULL")
def _overlap(spark, d):
    """Evidence labels of each prediction, and how many of them its question's packed field holds."""
    q = table(spark, d, "questions").select("question_id", "ingested_at", packed_values(F.col("evidence_sources")).alias("l"))
    q = facts.first_delivery(q, "question_id", "ingested_at", ["question_id", "l"])
    p = preds(spark, d).filter("evidence_sources is not null").select("seq", "question_id", "evidence_sources").join(q, "question_id", "left")
    shared = F.size(F.array_intersect("evidence_sources", F.coalesce("l", F.array().cast("array<string>"))))
    return p.select("seq", F.size(F.array_distinct("evidence_sources")).alias("told"), shared.alias("shared"))


@query("inspect_filters", sql.facts("""SELECT 'wrong' AS filter, seq FROM (SELECT seq FROM j WHERE NOT correct AND representation = 'V' ORDER BY question_id, representation, condition, seq LIMIT 20) UNION ALL
SELECT 'abstained', seq FROM (SELECT seq FROM j WHERE abstained AND condition = 'oracle' ORDER BY question_id, representation, condition, seq LIMIT 20) UNION ALL SELECT 'document', seq FROM j WHERE doc_id = (SELECT min(doc_id) FROM j)"""))
def _inspected(spark, d):
    """The filters of an inspection, each with its limit."""
    j = judged(spark, d)
    doc = j.agg(F.min("doc_id")).first()[0]
    parts = [("wrong", facts.inspect(j, 20, incorrect=True, representation="V")), ("abstained", facts.inspect(j, 20, abstained=True, condition="oracle")), ("document", facts.inspect(j, doc_id=doc))]
    out = None
    for name, r in parts:
        r = r.select(F.lit(name).alias("filter"), "seq")
        out = r if out is None else out.unionByName(r)
    return out


@query("condition_arms", "WITH b AS (SELECT DISTINCT split_part(condition, '__', 1) AS base FROM predictions) SELECT base, CASE WHEN starts_with(base, 'retrieved_text_') THEN 'text' WHEN starts_with(base, 'retrieved_vision_') THEN 'vision' WHEN starts_with(base, 'retrieved_joint_') THEN 'joint' ELSE '' END AS arm, coalesce(try_cast(nullif(regexp_extract(base, '_k(\\d+)$', 1), '') AS INT), 0) AS k FROM b")
def _arms(spark, d):
    arm, k = S.arm_and_k(F.col("base"))
    return preds(spark, d).select(S.base_condition(F.col("condition")).alias("base")).distinct().select("base", arm.alias("arm"), k.alias("k"))


# -- retrieval --------------------------------------------------------------------------

@query("stub_retrieval", _CORPUS + f", {_NP} SELECT question_id, array_to_string(range(0, least(3, np.pages)), ',') AS pages FROM c JOIN np ON np.doc_id = c.doc_id")
def _stub(spark, d):
    """The first k pages of each question's document."""
    n = table(spark, d, "doc_pages").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return corpus(spark, d).join(n, "doc_id").select("question_id", F.array_join(retrieval.first_pages(F.col("n"), 3), ",").alias("pages"))


@query("retriever_registry", _BM + f""", pgd AS (SELECT doc_id, page_index AS page, list_distinct({base._TOKS.format(base._PT)}) AS toks FROM doc_pages), qd AS (SELECT query_id, doc_id, list_distinct(toks) AS toks FROM qq),
fs AS (SELECT query_id, doc_id, page, round(len(list_intersect(qd.toks, pgd.toks)) + 1 / (1 + page), 6) AS score FROM qd JOIN pgd USING (doc_id)), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM fs),
sr AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY page) AS rank FROM qq JOIN pg USING (doc_id))
SELECT 'bm25' AS retriever, query_id, page, rank FROM rk WHERE rank <= 2 UNION ALL SELECT 'lexical', query_id, page, rank FROM fr WHERE rank <= 2 UNION ALL SELECT 'none', query_id, page, rank FROM sr WHERE rank <= 2""")
def _registry(spark, d):
    """The two best pages of each question by every retriever that needs no model, through the registry."""
    p, q = posted(spark, d), page_questions(spark, d)
    out = None
    for name in ("bm25", "lexical", "none"):
        r = retrieval.build(name)(p, q, 2).select(F.lit(name).alias("retriever"), "query_id", "page", "rank")
        out = r if out is None else out.unionByName(r)
    return out


_BY = _PRF.replace("m AS (SELECT retriever, k, len", "m AS (SELECT retriever, k, coalesce(doc_type, '') AS doc_type, len").replace("e AS (SELECT retriever, k,", "e AS (SELECT retriever, k, doc_type,").replace(
    "s AS (SELECT retriever, k, count", "s AS (SELECT retriever, k, CASE WHEN grouping(doc_type) = 1 THEN '(all)' ELSE doc_type END AS doc_type, count").replace("FROM e GROUP BY 1, 2)", "FROM e GROUP BY GROUPING SETS ((retriever, k, doc_type), (retriever, k)))")


@query("retrieval_by_doctype", _BY + " SELECT * FROM s")
def _bytype(spark, d):
    """Page precision, recall and F1 per retriever, k and doc_type, and pooled over the types."""
    q = corpus(spark, d).select(F.col("question_id").alias("query_id"), F.coalesce("doc_type", F.lit("")).alias("doc_type"))
    return retrieval.summary_with_total(base._prf(spark, d).join(q, "query_id"), ["retriever", "k"], "doc_type")


def _ruled(name: str, rule: str, distractors: int, kept: str, reason: str, added: str = "[]") -> None:
    """A page-set rule as a query; kept, added and reason say the same in SQL over g (gold in rank order) and o (others)."""
    QUERIES[name] = base._rule_query(rule, distractors)
    ORACLE[name] = _RULE + f", y AS (SELECT query_id, {kept} AS kp, {added} AS ad, {reason} AS reason FROM z) SELECT query_id, CASE WHEN reason = '' THEN array_to_string(list_sort(list_concat(kp, ad)), ',') ELSE '' END AS pages, CASE WHEN reason = '' THEN 'ok' ELSE 'error' END AS status, reason FROM y"


_FEW = "CASE WHEN len(g) = 0 THEN 'no gold pages' WHEN {0} THEN 'gold pool too small' ELSE '' END"
_ruled("pageset_keep_top", "pageset:r=bm25:g=keep_top-2:d=0", 0, "g[1:2]", _FEW.format("len(g) < 2"))
_ruled("pageset_keep_bottom", "pageset:r=bm25:g=keep_bottom-1:d=0", 0, "g[len(g):]", _FEW.format("len(g) < 1"))
_ruled("pageset_drop_bottom", "pageset:r=bm25:g=drop_bottom-1:d=0", 0, "g[1:len(g) - 1]", _FEW.format("len(g) <= 1"))
_ruled("pageset_keep_all_gold", "pageset:r=bm25:g=keep_top-3:d=1:p=kpx", 1, "CASE WHEN len(g) >= 3 THEN g[1:3] ELSE g END", _FEW.format("false"), "o[1:1]")
_ruled("pageset_only_distractors", "pageset:r=bm25:g=all:d=2:p=xpo", 2, "g", "CASE WHEN len(g) + len(o) = 0 THEN 'empty page set' ELSE '' END", "o[1:2]")
_ruled("pageset_strict_distractors", "pageset:r=bm25:g=all:d=6:p=xxx", 6, "g", "CASE WHEN len(g) = 0 THEN 'no gold pages' WHEN len(o) < 6 THEN 'distractor pool too small' ELSE '' END", "o[1:6]")


# -- representations --------------------------------------------------------------------

@query("page_tiles", f"""WITH s AS (SELECT * FROM ({base._SIZE}) WHERE w IS NOT NULL AND h IS NOT NULL), c AS (SELECT a.c AS cols, b.r AS rows FROM (SELECT unnest(range(1, 13)) AS c) a, (SELECT unnest(range(1, 13)) AS r) b WHERE a.c * b.r <= 12),
x AS (SELECT doc_id, page_index, cols, rows, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY abs(w / h - cols / rows), -(cols * rows), cols) AS n FROM s CROSS JOIN c)
SELECT doc_id, page_index, cols::INT AS cols, rows::INT AS rows, (cols * rows + (cols * rows > 1)::INT)::INT AS tiles FROM x WHERE n = 1""")
def _tiles(spark, d):
    """The tiling of each page that comes nearest to its shape, and its tiles with the overview."""
    t = represent.tile_grid(F.col("w") / F.col("h"))
    return base._page_sizes(spark, d).withColumn("t", t).select("doc_id", "page_index", "t.cols", "t.rows", represent.tile_count(F.col("t")).alias("tiles"))


@query("page_count_values", "SELECT question_id, CASE WHEN regexp_matches(trim(p), '^\\d+$') THEN try_cast(trim(p) AS INT) WHEN trim(p) LIKE '[%]' THEN len(list_filter(str_split(trim(p)[2:-2], ','), lambda x: trim(x) <> '')) END::INT AS pages FROM (SELECT question_id, arg_min(evidence_pages, ingested_at) AS p FROM questions WHERE question_id IS NOT NULL GROUP BY 1)")
def _page_counts(spark, d):
    """A count from a field that is a number, a string of digits or a list; nothing of others."""
    q = facts.first_delivery(table(spark, d, "questions"), "question_id", "ingested_at", ["question_id", "evidence_pages"])
    return q.select("question_id", profile.page_count(F.col("evidence_pages")).alias("pages"))


@query("conditioner_registry", _CORPUS + f""", {_NP}, x AS (SELECT question_id, [p for p in c.pg if p < np.pages] AS g, np.pages AS n FROM c JOIN np ON np.doc_id = c.doc_id)
SELECT question_id, 'oracle' AS conditioner, (CASE WHEN len(g) > 0 THEN len(g) ELSE 1 END)::INT AS pages FROM x UNION ALL SELECT question_id, 'full', n::INT FROM x""")
def _conditioners(spark, d):
    """Pages that each conditioner which needs no ranking feeds, through the registry."""
    n = table(spark, d, "doc_pages").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    c = corpus(spark, d).join(n, "doc_id")
    row = {"gold": F.col("pages"), "page_count": F.col("n")}
    out: DataFrame | None = None
    for name in ("oracle", "full"):
        r = c.select("question_id", F.lit(name).alias("conditioner"), F.size(pageset.condition(name, row)).alias("pages"))
        out = r if out is None else out.unionByName(r)
    return out

