"""Page sets as column expressions: gold, top-k, joint, whole document, and rules over a ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<int>"


def tidy(pages: Column) -> Column:
    return F.sort_array(F.array_distinct(pages))


def oracle(gold: Column, page_count: Column) -> Column:
    inside = F.filter(F.coalesce(gold, F.array()), lambda p: (p >= 0) & (p < page_count))
    first = F.when(page_count > 0, F.array(F.lit(0))).otherwise(F.array().cast(_NONE))
    return tidy(F.when(F.size(inside) == 0, first).otherwise(inside))


def retrieved(ranking: Column, k: int) -> Column:
    return tidy(F.slice(ranking, 1, k))


def joint(text: Column, vision: Column, k: int) -> Column:
    return tidy(F.array_union(F.slice(text, 1, k), F.slice(vision, 1, k)))


def full(page_count: Column) -> Column:
    return F.when(page_count > 0, F.sequence(F.lit(0), page_count - 1)).otherwise(F.array().cast(_NONE))


def by_rule(ranking: Column, gold: Column, mode: Column, count: Column, distractors: Column, policies: Column) -> dict[str, Column]:
    """pages, status and reason of a rule. Rules that a question cannot meet are rows with status 'error', never wrong pages."""
    is_gold = lambda p: F.array_contains(gold, p)
    g, d = F.filter(ranking, is_gold), F.filter(ranking, lambda p: ~is_gold(p))
    n = F.size(g)
    met = F.when(mode.startswith("keep_"), n >= count).when(mode.startswith("drop_"), n > count).otherwise(True)
    size = lambda x: F.greatest(x, F.lit(0))
    cut = (
        F.when(mode == "keep_top", F.slice(g, F.lit(1), size(count))).when(mode == "keep_bottom", F.slice(g, size(n - count) + 1, size(count)))
        .when(mode == "drop_top", F.slice(g, size(count) + 1, size(n - count))).when(mode == "drop_bottom", F.slice(g, F.lit(1), size(n - count))).otherwise(g)
    )
    kept = F.when(met, cut).otherwise(g)
    add = F.slice(d, F.lit(1), distractors)
    pages = F.concat(kept, add)
    pol = lambda i: F.substring(policies, i, 1)
    reason = (
        F.when((n == 0) & (pol(3) != "o"), "no gold pages").when((n > 0) & ~met & (pol(1) == "x"), "gold pool too small")
        .when((F.size(add) < distractors) & (pol(2) == "x"), "distractor pool too small").when(F.size(pages) == 0, "empty page set")
    )
    note = F.when(F.size(add) < distractors, F.concat(F.lit("d_actual="), F.size(add).cast("string"))).otherwise("")
    return {
        "pages": F.when(reason.isNull(), tidy(pages)), "status": F.when(reason.isNull(), "ok").otherwise("error"),
        "reason": F.coalesce(reason, F.lit("")), "note": F.when(reason.isNull(), note).otherwise(""),
    }


#: Conditioners by name: what they read of a row -> pages.
CONDITIONERS: dict[str, Callable[[dict[str, Column], int], Column]] = {
    "oracle": lambda r, k: oracle(r["gold"], r["page_count"]),
    "full": lambda r, k: full(r["page_count"]),
    "retrieved": lambda r, k: retrieved(r["ranking"], k),
    "similarity": lambda r, k: retrieved(r["ranking"], k),
    "joint": lambda r, k: joint(r["text_ranking"], r["vision_ranking"], k),
}


def condition(name: str, row: dict[str, Column], k: int = 3) -> Column:
    """The pages that a conditioner feeds; an unknown name raises."""
    if name not in CONDITIONERS:
        raise ValueError(f"unknown conditioner {name!r}; known: {sorted(CONDITIONERS)}")
    return CONDITIONERS[name](row, k)
