"""The core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from ..operators import stats
from ..session import table
from . import operators_queries, report_queries, sql, tables

Query = Callable[[SparkSession, str], DataFrame]


CORE = ("seq", "question_id", "doc_id", "doc_type", "condition", "base", "mode", "representation", "model_spec", "visual_resolution", "hop", "is_unanswerable",
        "run_tag", "correct", "abstained")
TIMES = ("latency_s", "prefill_latency_s", "decode_latency_s")
TOKENS = ("total_text_tokens", "total_visual_tokens", "output_tokens")


def over(build: Callable[..., DataFrame], *dims: str, also: tuple[str, ...] = ()) -> Query:
    """A query that builds a table from the judged rows, which are written once for all queries, and the named tables."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return build(operators_queries.judged(spark, d).select(*CORE, *also), *[table(spark, d, t) for t in dims])

    return run


TABLES: dict[str, Query] = {
    "headline": over(tables.headline),
    "headline_frontier": over(tables.headline_frontier),
    "composition_explode": over(tables.composition, also=("evidence_sources",)),
    "source_stratification": over(tables.source_stratification, also=("source_dataset",)),
    "transition_by_type": over(lambda j: stats.transitions(tables.oracle(j), tables.PAIRS, by="doc_type")),
    "transition_by_source": over(lambda j: stats.transitions(tables.oracle(j), tables.PAIRS, explode="evidence_sources"), also=("evidence_sources",)),
    "attribution_pairs": over(tables.attribution),
    "hop_gap": over(tables.integration),
    "bucket_rung": over(tables.hop_rung, "questions"),
    "bucket_slope": over(tables.hop_slope, "questions"),
    "hop_doctype": over(tables.hop_doctype, "questions"),
    "selection_rules": over(tables.selection),
    "selection_robustness": over(tables.selection_robustness, "questions"),
    "abstention_rate": over(tables.hallucination),
    "abstention_pivot": over(tables.abstention_by_doctype),
    "faithfulness_full_outer": over(tables.faithfulness_pools, also=("output_truncated",)),
    "reasoner_unified": over(tables.reasoner_unified),
    "scale_weights": over(tables.scale, "model_weights", also=(*TIMES, "peak_vram_bytes")),
    "quant_delta": over(tables.quantization, also=("peak_vram_bytes",)),
    "quant_rung_delta": over(lambda j: tables.quantization(j, ("representation",)), also=("peak_vram_bytes",)),
    "vram_headroom_p95": over(tables.vram_headroom, also=("peak_vram_bytes",)),
    "pages_bucket_rate": lambda spark, d: tables.oom_frontier(table(spark, d, "predictions")),
    "prefill_cost": over(tables.prefill_cost, also=(*TIMES, *TOKENS)),
    "resolution_pivot": over(tables.resolution),
    "matched_cross": over(tables.matched_cross),
    "kdepth_parse": over(tables.kdepth),
    "scan_split": over(tables.scan_vs_digital, "doc_labels", also=("scan_label",)),
    "routing_policies": over(tables.routing, also=TIMES),
    "levers_delta": over(tables.levers),
    "labeled_union_matrix": over(tables.parser_matrix),
    "cost_summary": over(lambda j: stats.cost(j, ["model_spec", "representation"]), also=(*TIMES, *TOKENS, "peak_vram_bytes")),
    "accuracy_points": over(lambda j: stats.accuracy(j, ["model_spec", "representation"])),
    "accuracy_bootstrap": over(lambda j: stats.bootstrap(tables.oracle(j), ["representation"])),
}
QUERIES: dict[str, Query] = TABLES | operators_queries.QUERIES | report_queries.QUERIES
ORACLE: dict[str, str] = sql.TABLES | operators_queries.ORACLE | report_queries.ORACLE
