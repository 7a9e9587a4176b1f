"""The analysis tables as numeric DataFrames over the judged rows, which are picked and written once for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import facts, stats
from ..operators.percentiles import exact_percentiles, nearest_even

DT, RUNG = "doc_type", "representation"
PAIRS = (("TL", "TLV"), ("T", "TL"), ("T", "TLV"))
IN_SCOPE = (("V", (1, 3, 5)), ("TLV", (1, 3)))


def oracle(j: DataFrame) -> DataFrame:
    """Rows fed the gold pages, one model."""
    return facts.primary_spec(facts.for_base(j, "oracle"))


def gold_counts(questions: DataFrame) -> DataFrame:
    """question_id, gold: number of gold pages, from the dirty page lists."""
    q = facts.first_delivery(questions, "question_id", "ingested_at", ["question_id", "evidence_pages"])
    return q.select("question_id", F.size(S.zero_based_pages(F.col("evidence_pages"))).alias("gold"))


def headline(j: DataFrame) -> DataFrame:
    return stats.accuracy_with_total(oracle(j), RUNG, [DT])


def headline_frontier(j: DataFrame) -> DataFrame:
    return stats.frontier(stats.bootstrap(oracle(j), [DT, RUNG]), [DT])


def composition(j: DataFrame) -> DataFrame:
    src = F.when(F.size(F.coalesce("evidence_sources", F.array())) > 0, F.col("evidence_sources")).otherwise(F.array(F.lit("(none)")))
    return stats.accuracy(oracle(j).withColumn("source", F.explode(src)), ["source", RUNG])


def source_stratification(j: DataFrame) -> DataFrame:
    return stats.accuracy(oracle(j).withColumn("stratum", S.blank_to(F.col("source_dataset"), "(uncoded)")), ["stratum", RUNG])


def attribution(j: DataFrame) -> DataFrame:
    """Per rung: oracle accuracy, representation loss, best in-scope retrieval and its paired loss."""
    o = oracle(j)
    acc = stats.accuracy(o, [RUNG])
    acc = acc.withColumn("representation_loss", F.max("accuracy").over(Window.partitionBy(F.lit(1))) - F.col("accuracy"))
    modality, k = S.retrieval_parts(F.col("base"))
    scope = None
    for rung, ks in IN_SCOPE:
        c = (F.col(RUNG) == rung) & F.col("k").isin(*ks)
        scope = c if scope is None else scope | c
    got = facts.primary_spec(j.filter(F.col("base").startswith("retrieved_"))).withColumn("k", k).filter(scope)
    last = o.withColumn("__n", F.row_number().over(Window.partitionBy("question_id", RUNG).orderBy(F.desc("seq")))).filter("__n = 1")
    pair = got.join(last.select("question_id", RUNG, F.col("correct").alias("oc")), ["question_id", RUNG])
    share = lambda c: F.sum(F.col(c).cast("long")) / F.count(F.lit(1))
    per = pair.groupBy(RUNG, "base").agg(F.count(F.lit(1)).alias("paired_n"), share("correct").alias("retrieved"), share("oc").alias("paired_oracle"), F.min("seq").alias("first"))
    best = per.withColumn("__n", F.row_number().over(Window.partitionBy(RUNG).orderBy(F.desc("retrieved"), "first"))).filter("__n = 1")
    best = best.select(RUNG, F.col("base").alias("retrieval_ref"), "paired_n", "retrieved", (F.col("paired_oracle") - F.col("retrieved")).alias("retrieval_loss"))
    return acc.join(best, RUNG, "left")


def integration(j: DataFrame) -> DataFrame:
    """doc_type x rung: accuracy of single- and multi-page questions and the gap in points."""
    r = oracle(j).filter(F.col("hop").isin("single", "multi"))
    of = lambda h: F.sum(F.when(F.col("hop") == h, F.col("correct").cast("long"))) / F.sum((F.col("hop") == h).cast("long"))
    s, m = of("single"), of("multi")
    return r.groupBy(DT, RUNG).agg(F.count(F.lit(1)).alias("n"), s.alias("single"), m.alias("multi"), ((m - s) * 100).alias("gap"))


def hop_rung(j: DataFrame, questions: DataFrame) -> DataFrame:
    g = oracle(j).join(gold_counts(questions), "question_id", "left").withColumn("bucket", S.gold_bucket(F.coalesce("gold", F.lit(0))))
    return stats.accuracy(g.filter("bucket <> ''"), ["bucket", RUNG])


def hop_slope(j: DataFrame, questions: DataFrame) -> DataFrame:
    """Accuracy of the last bucket present less that of the first, per rung."""
    a = hop_rung(j, questions).withColumn("r", S.rank_of(F.col("bucket"), ("1", "2", "3", "4-5", "6+")))
    return a.groupBy(RUNG).agg((F.max_by("accuracy", "r") - F.min_by("accuracy", "r")).alias("slope"))


def hop_doctype(j: DataFrame, questions: DataFrame) -> DataFrame:
    g = oracle(j).join(gold_counts(questions), "question_id", "left").withColumn("bucket", S.gold_bucket3(F.coalesce("gold", F.lit(0))))
    return stats.accuracy_with_total(g.filter("bucket <> ''"), "bucket", [DT, RUNG])


def selection(j: DataFrame) -> DataFrame:
    """Page-set rules: accuracy per gold mode, count, distractors, ranker and rung."""
    parts = S.pageset_parts(F.col("base"))
    r = j.filter(F.col("base").startswith("pageset:")).withColumns(parts).filter("ranker is not null")
    return stats.accuracy(r, ["gold_mode", "gold_count", "distractors", "ranker", RUNG])


def selection_robustness(j: DataFrame, questions: DataFrame) -> DataFrame:
    """All gold plus d distractors, blocked by gold count, with the oracle rows as baseline (d = 0, ranker '')."""
    g = gold_counts(questions)
    parts = S.pageset_parts(F.col("base"))
    r = j.filter(F.col("base").startswith("pageset:")).withColumns(parts).filter("gold_mode = 'all'")
    a = r.select("question_id", RUNG, "correct", "distractors", "ranker")
    b = oracle(j).select("question_id", RUNG, "correct", F.lit(0).alias("distractors"), F.lit("").alias("ranker"))
    both = a.unionByName(b).join(g, "question_id").filter("gold > 0")
    return stats.accuracy(both, ["gold", "distractors", "ranker", RUNG])


def abstention(j: DataFrame, keys: list[str]) -> DataFrame:
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("abstained").cast("long")) / F.count(F.lit(1))).alias("rate"))


def unanswerable(j: DataFrame) -> DataFrame:
    return facts.or_all(j, F.coalesce(F.col("is_unanswerable"), F.lit(False)))


def hallucination(j: DataFrame) -> DataFrame:
    return abstention(unanswerable(j).withColumn("prompt", S.mode_or_condition(F.col("condition"))), ["prompt"])


def faithfulness_pools(j: DataFrame) -> DataFrame:
    """Per mode and rung: accuracy on answerable rows beside abstention on unanswerable ones; either side may miss."""
    r = facts.primary_spec(facts.for_base(j, "oracle"))
    un = F.coalesce(F.col("is_unanswerable"), F.lit(False))
    a = r.filter(~un).groupBy("mode", RUNG).agg(F.count(F.lit(1)).alias("n_answerable"), (F.sum(F.col("correct").cast("long")) / F.count(F.lit(1))).alias("accuracy"),
                                              (F.sum(F.col("abstained").cast("long")) / F.count(F.lit(1))).alias("false_abstention"), F.count_if("output_truncated").alias("truncated"))
    b = r.filter(un).groupBy("mode", RUNG).agg(F.count(F.lit(1)).alias("n_unanswerable"), (F.sum(F.col("abstained").cast("long")) / F.count(F.lit(1))).alias("abstention"))
    return a.join(b, ["mode", RUNG], "full")


def abstention_by_doctype(j: DataFrame) -> DataFrame:
    u = unanswerable(j)
    out = u.groupBy(DT).pivot("mode", list(S.MODES)).agg(F.sum(F.col("abstained").cast("long")) / F.count(F.lit(1)))
    return out.select(DT, *[F.col(f"`{m}`").alias(m) for m in S.MODES])


def reasoner_unified(j: DataFrame) -> DataFrame:
    """Model x rung: accuracy and multi minus single, oracle pages."""
    r = facts.for_base(j, "oracle")
    of = lambda h: F.sum(F.when(F.col("hop") == h, F.col("correct").cast("long"))) / F.sum((F.col("hop") == h).cast("long"))
    return r.groupBy("model_spec", RUNG).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("correct").cast("long")) / F.count(F.lit(1))).alias("accuracy"), ((of("multi") - of("single")) * 100).alias("multi_minus_single"))


def scale(j: DataFrame, weights: DataFrame) -> DataFrame:
    r = facts.for_base(j, "oracle").groupBy("model_spec", RUNG).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("correct").cast("long")) / F.count(F.lit(1))).alias("accuracy"),
        F.round(F.avg("latency_s") * 1000, 3).alias("latency_ms"), F.max("peak_vram_bytes").alias("peak_vram_bytes"))
    w = weights.groupBy("model_spec").agg(F.sum("weights_bytes").alias("weights_bytes"), F.max("method").alias("method"))
    return r.join(w, "model_spec", "left")


def quantization(j: DataFrame, keys: tuple[str, ...] = (DT,), default: str = facts.DEFAULT_SPEC) -> DataFrame:
    """Accuracy and memory per quantization level of the default model, with differences to 16 bit."""
    r = facts.for_base(j, "oracle").withColumn("quant", S.quant_of(F.col("model_spec"))).filter(S.base_spec(F.col("model_spec")) == default)
    a = r.groupBy(*keys, "quant").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("correct").cast("long")) / F.count(F.lit(1))).alias("accuracy"), F.max("peak_vram_bytes").alias("vram"))
    base = a.filter("quant = '16bit'").select(*keys, F.col("accuracy").alias("ba"), F.col("vram").alias("bv"))
    joined = a.join(base, list(keys), "left")
    return joined.select(*keys, "quant", "n", "accuracy", "vram", ((F.col("accuracy") - F.col("ba")) * 100).alias("acc_delta"), (F.col("vram") - F.col("bv")).alias("vram_delta"))


def vram_headroom(j: DataFrame) -> DataFrame:
    """Model x rung x resolution: greatest memory, the value at rank round(.95 (n-1)), room below 16 384 MB."""
    key = ["model_spec", RUNG, "visual_resolution"]
    p = exact_percentiles(j.select(*key, "peak_vram_bytes"), key, ["peak_vram_bytes"], (0.95, 1.0), rank=nearest_even)
    top, p95 = F.col("p100").cast("long"), F.col("p95").cast("long")
    return p.select(*key, "n", top.alias("max_bytes"), p95.alias("p95_bytes"), (16384 - top / 1e6).alias("headroom_mb"))


def oom_frontier(rows: DataFrame) -> DataFrame:
    """Rung x resolution x pages fed: share of cells that ran out of memory."""
    b = facts.best_rows(facts.with_status(rows)).withColumn("bucket", S.pages_bucket(F.size(F.coalesce("page_indices", F.array()))))
    return b.groupBy(RUNG, "visual_resolution", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "oom").alias("n_oom"), (F.count_if(F.col("status") == "oom") * 100 / F.count(F.lit(1))).alias("oom_pct"))


def prefill_cost(j: DataFrame) -> DataFrame:
    """doc_type x rung: mean prefill in ms (null where none was measured) and mean input tokens."""
    tokens = F.coalesce("total_text_tokens", F.lit(0)) + F.coalesce("total_visual_tokens", F.lit(0))
    return oracle(j).groupBy(DT, RUNG).agg(F.count(F.lit(1)).alias("n"), F.round(F.when(F.max("prefill_latency_s") > 0, F.avg("prefill_latency_s") * 1000), 3).alias("prefill_ms"), F.round(F.avg(tokens), 6).alias("mean_tokens"))


def resolution(j: DataFrame) -> DataFrame:
    return stats.accuracy(oracle(j).filter(F.col(RUNG).isin("TLV", "V")), [DT, RUNG, "visual_resolution"])


def matched_cross(j: DataFrame) -> DataFrame:
    modality, _ = S.retrieval_parts(F.col("base"))
    return stats.accuracy(j.withColumn("modality", modality).filter("modality <> ''"), [DT, "modality"])


def kdepth(j: DataFrame) -> DataFrame:
    modality, k = S.retrieval_parts(F.col("base"))
    return stats.accuracy(j.withColumn("modality", modality).withColumn("k", k).filter("k is not null"), ["k", "modality"])


def scan_vs_digital(j: DataFrame, labels: DataFrame) -> DataFrame:
    r = facts.backfill(oracle(j), labels, "scan_label", "(unlabeled)")
    return stats.accuracy(r, [DT, RUNG, "scan_label"])


def routing(j: DataFrame, classifier_s: float = 0.0) -> DataFrame:
    """Accuracy, prefill and latency of uniform and routed policies; the routed ones take each doc_type's frontier rung, the predicted one pays the classifier's seconds, too."""
    o = oracle(j)
    chosen = headline_frontier(j)
    routed = o.join(F.broadcast(chosen), DT).filter(F.col(RUNG) == F.col("rung")).drop("rung")
    parts = [("uniform_cheapest", o.filter(F.col(RUNG) == "T")), ("uniform_strongest", o.filter(F.col(RUNG) == "TLV")), ("oracle_routing", routed), ("predicted_routing", routed)]
    out = None
    for name, r in parts:
        one = r.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("correct").cast("long")) / F.count(F.lit(1))).alias("accuracy"),
                    F.round(F.avg("prefill_latency_s") * 1000, 3).alias("prefill_ms"), F.round((F.avg("latency_s") + (classifier_s if name == "predicted_routing" else 0.0)) * 1000, 3).alias("latency_ms")).select(F.lit(name).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def levers(j: DataFrame) -> DataFrame:
    """What each intervention does: base and lever value, difference, counts, in one pass over the rows."""
    o, cut = (F.col("base") == "oracle"), (F.col(RUNG) == "TLV")
    un = F.coalesce(F.col("is_unanswerable"), F.lit(False))
    dflt = F.col("model_spec") == facts.DEFAULT_SPEC
    mode = lambda m: o & cut & ~un & (F.col("mode") == m)
    spec = [
        ("resolution_med_high", "correct", o & cut & (F.col("visual_resolution") == "med"), o & cut & (F.col("visual_resolution") == "high")),
        ("interleaving", "correct", o & cut, o & (F.col(RUNG) == "TLVi")),
        ("cot_prompt", "correct", mode("grounded"), mode("cot")),
        ("extraction", "correct", mode("grounded"), mode("extract_cot")),
        ("abstention_prompt", "abstained", cut & un & (F.col("mode") == "none"), cut & un & (F.col("mode") == "targeted")),
        ("depth_k1_k5", "correct", (F.col(RUNG) == "V") & (F.col("base") == "retrieved_vision_k1"), (F.col(RUNG) == "V") & (F.col("base") == "retrieved_vision_k5")),
        ("model_swap", "correct", o & cut & dflt, o & cut & (F.col("model_spec") == "tavex3-8b-local")),
    ]
    aggs = []
    for name, flag, a, b in spec:
        for side, cond in (("b", a), ("l", b)):
            aggs += [F.count_if(cond).alias(f"{name}_{side}n"), F.count_if(cond & F.col(flag)).alias(f"{name}_{side}s")]
    one = j.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("lever"), F.lit(m).alias("metric"), *[F.col(f"{n}_{x}").alias(x) for x in ("bn", "bs", "ln", "ls")]) for n, m, *_ in spec])
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    both = (F.col("bn") > 0) & (F.col("ln") > 0)
    base, lever = F.when(both, F.col("bs") / F.col("bn")), F.when(both, F.col("ls") / F.col("ln"))
    return r.select("lever", "metric", F.col("bn").alias("base_n"), F.col("ln").alias("lever_n"), base.alias("base_value"), lever.alias("lever_value"), ((lever - base) * 100).alias("delta"))


def parser_matrix(j: DataFrame) -> DataFrame:
    """Labelled union of two runs: doc_type x run x {TL, TLV}, with distinct questions."""
    r = oracle(j).filter(F.col(RUNG).isin("TL", "TLV"))
    return r.groupBy(DT, "run_tag", RUNG).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("question_id").alias("questions"), (F.sum(F.col("correct").cast("long")) / F.count(F.lit(1))).alias("accuracy"))
