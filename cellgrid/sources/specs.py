"""Run specifications and the registry of corpora: read, checked, expanded, as rows.

A specification is a mapping (from YAML or JSON). What it may hold is told by FIELDS; what
is wrong is reported at once and by the run's name. A list under a field of the grid makes
one run for each of its values; other lists are values of the run itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.grid import HOPS, POOLS


class SpecError(ValueError):
    """A specification that no run can be made from."""


#: Field -> (kind, default). grid: a list makes runs; list: values of one run; one: a single value; table: a mapping.
FIELDS: dict[str, tuple[str, object]] = {
    "task_name": ("one", None), "run_tag": ("one", None), "dataset": ("grid", "mmlongbench"), "parser": ("grid", "paddleocrvl"), "parser_dpi": ("one", 200),
    "model_specs": ("list", ["orlin-8b-local"]), "quantization": ("list", ["bf16"]), "visual_resolutions": ("list", ["med"]), "representations": ("list", list(S.RUNGS)),
    "prompt_modes": ("list", ["none"]), "text_retrievers": ("list", []), "vision_retrievers": ("list", []), "k_values": ("list", []), "corpus": ("table", {"pool": "answerable"}),
    "page_set": ("table", None), "decode_budget": ("table", None), "classifier": ("one", None), "final_answer_delimiter": ("one", None),
}
_BLANK = ("", "none")


def _listed(v: object) -> list:
    return [] if v is None else list(v) if isinstance(v, (list, tuple)) else [v]


def _none(v: object) -> object:
    return None if isinstance(v, str) and v.strip().lower() in _BLANK else v


def _budget(tag: str, b: object) -> dict[str, int]:
    if not isinstance(b, dict) or "default" not in b:
        raise SpecError(f"{tag}: decode_budget must be a mapping with a default")
    wrong = {k: v for k, v in b.items() if k not in ("default", *S.MODES) or isinstance(v, bool) or not isinstance(v, int) or v <= 0}
    if wrong:
        raise SpecError(f"{tag}: decode_budget has unknown modes or counts that are not positive: {wrong}")
    return dict(b)


def _page_set(tag: str, p: object, hop: object) -> list[str]:
    """The page-set rules of a block, by their code; every one must parse."""
    if not isinstance(p, dict):
        raise SpecError(f"{tag}: page_set must be a mapping or none")
    known = {"ranking_source", "gold", "distractor", "policies"}
    if set(p) - known:
        raise SpecError(f"{tag}: unknown page_set keys: {sorted(set(p) - known)}")
    rankers, gold = _listed(p.get("ranking_source")), p.get("gold") or {"mode": "all"}
    if not rankers:
        raise SpecError(f"{tag}: page_set must name a ranking_source")
    mode, count = gold.get("mode", "all"), gold.get("count", 0)
    if mode != "all" and not (hop == "multi" or str(hop).isdigit() and int(hop) >= 2):
        raise SpecError(f"{tag}: gold mode {mode!r} needs questions of several pages")
    tail = f":p={p['policies']}" if p.get("policies", "xpx") != "xpx" else ""
    rules = [f"pageset:r={r}:g={mode if mode == 'all' else f'{mode}-{count}'}:d={d}{tail}" for r in rankers for d in _listed((p.get("distractor") or {}).get("count", 0))]
    bad = [r for r in rules if not re.match(S.PAGESET, r) or mode != "all" and int(count) < 1]
    if bad:
        raise SpecError(f"{tag}: invalid page_set rules: {bad}")
    return rules


def _checked(raw: object) -> dict:
    """One run's fields, defaults filled in and checked."""
    if not isinstance(raw, dict):
        raise SpecError("a run must be a mapping")
    if set(raw) - set(FIELDS):
        raise SpecError(f"unknown fields: {sorted(set(raw) - set(FIELDS))}")
    run = {k: (_listed(v) if FIELDS[k][0] in ("list", "grid") else _none(v)) if (v := raw.get(k)) not in (None, []) else (_listed(FIELDS[k][1]) if FIELDS[k][0] in ("list", "grid") else FIELDS[k][1]) for k in FIELDS}
    if not run["task_name"]:
        raise SpecError("a run must name its task")
    tag = run["run_tag"] = str(run["run_tag"] or run["task_name"])
    for k, known in (("visual_resolutions", S.RESOLUTIONS), ("representations", S.RUNGS), ("prompt_modes", S.MODES)):
        if set(run[k]) - set(known):
            raise SpecError(f"{tag}: unknown {k}: {sorted(set(run[k]) - set(known))}")
    corpus = run["corpus"]
    if not isinstance(corpus, dict) or set(corpus) - {"scan", "pool", "sampling", "hop"}:
        raise SpecError(f"{tag}: corpus takes scan, pool, sampling and hop")
    if corpus.get("pool", "all") not in POOLS or not (str(corpus.get("hop", "any")) in HOPS or str(corpus.get("hop")).isdigit()):
        raise SpecError(f"{tag}: unknown pool or hop")
    run["rules"] = _page_set(tag, run["page_set"], corpus.get("hop", "any")) if run["page_set"] else []
    if run["decode_budget"] is not None:
        run["decode_budget"] = _budget(tag, run["decode_budget"])
    plain = ("bf16", *_BLANK)
    run["model_specs"] = [s if str(q).lower() in plain else f"{s}-{q}" for s in run["model_specs"] for q in run["quantization"]]
    return run


def expand(raw: object) -> list[dict]:
    """The runs of a specification ({"runs": [...]} or one run), one per combination of its grid fields, with tags of their own."""
    entries = raw["runs"] if isinstance(raw, dict) and "runs" in raw else [raw]
    if not isinstance(entries, list) or not entries:
        raise SpecError("runs must be a list of runs")
    grid = [k for k, (kind, _) in FIELDS.items() if kind == "grid"]
    out: list[dict] = []
    for run in map(_checked, entries):
        for values in product(*[run[k] for k in grid]):
            tag = "-".join([run["run_tag"], *[str(v) for k, v in zip(grid, values) if len(run[k]) > 1]])
            out.append(run | dict(zip(grid, values)) | {"run_tag": tag})
    tags = [r["run_tag"] for r in out]
    twice = sorted({t for t in tags if tags.count(t) > 1})
    if twice:
        raise SpecError(f"run tags must differ: {twice}")
    return out


def read_spec(path: str) -> list[dict]:
    """The runs of a YAML or JSON file."""
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return expand(json.loads(text))
    try:
        import yaml
    except ImportError as error:
        raise SpecError("reading YAML needs the yaml package") from error
    return expand(yaml.safe_load(text))


def spec_rows(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """run_tag, task_name, dataset, model_spec, visual_resolution, representation, prompt_mode: the settings that cells are made for."""
    kind = "run_tag string, task_name string, dataset string, model_specs array<string>, visual_resolutions array<string>, representations array<string>, prompt_modes array<string>"
    df = spark.createDataFrame([tuple(r[k] for k in ("run_tag", "task_name", "dataset", "model_specs", "visual_resolutions", "representations", "prompt_modes")) for r in runs], kind)
    for many, one in (("model_specs", "model_spec"), ("visual_resolutions", "visual_resolution"), ("representations", "representation"), ("prompt_modes", "prompt_mode")):
        df = df.withColumn(one, F.explode(many)).drop(many)
    return df


def read_env(text: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """The settings of KEY=VALUE lines under those of the real environment, which win."""
    found = re.findall(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*(.*?)[ \t]*$", text)
    return {k: v.strip("'\"") for k, v in reversed(found)} | dict(os.environ if env is None else env)


def candidates(names: list[str], hints: tuple[str, ...] = (), suffixes: tuple[str, ...] = (".jsonl", ".json"), most: int = 6) -> list[str]:
    """Annotation files of a listing, the likeliest first: evaluation splits and hinted names before others, papers about the data last."""
    weights = {"test": 3, "val": 2, "dev": 2, "train": 1, **{h.lower(): 2 for h in hints}}
    papers = ("readme", "license", "config", "gitattributes")

    def weight(name: str) -> int:
        low = name.lower()
        splits = sum(w for k, w in weights.items() if k in low and not (k == "dev" and "val" in low))
        return splits - 5 * any(p in low for p in papers)

    return sorted((n for n in names if n.lower().endswith(suffixes)), key=lambda n: -weight(n))[:most]


#: Loaders of corpora by name.
CORPORA: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_LOADED: dict[tuple[str, str, str], DataFrame] = {}


def corpus_loader(name: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        CORPORA[name] = f
        return f

    return add


def load_corpus(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The corpus of a name, planned once per session; an unknown name raises."""
    if name not in CORPORA:
        raise ValueError(f"unknown corpus {name!r}; known: {sorted(CORPORA)}")
    key = (spark.sparkContext.applicationId, name, path)
    if key not in _LOADED:
        _LOADED[key] = CORPORA[name](spark, path)
    return _LOADED[key]
