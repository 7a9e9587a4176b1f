"""Small tables as CSV and markdown; the numbers are rendered on the driver at the last step."""

from __future__ import annotations

import csv
import json
import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(c: Column, pattern: str = "0.0") -> Column:
    """A number under a pattern, halves of its exact binary value to even."""
    return F.call_function("format_number", c.cast("double"), F.lit(pattern))


def points(c: Column) -> Column:
    """A share as percent with one digit."""
    return F.when(c.isNull(), "-").otherwise(fixed(c * 100))


def accuracy_cell(acc: Column, low: Column, high: Column) -> Column:
    return F.when(acc.isNull(), "-").otherwise(F.concat(points(acc), F.lit(" ["), points(low), F.lit("-"), points(high), F.lit("]")))


def signed(c: Column) -> Column:
    text = fixed(F.abs(c))
    return F.when(c.isNull(), "-").otherwise(F.concat(F.when(c < 0, "-").otherwise("+"), text))


def grid(table: DataFrame, order: list[str], limit: int = 10_000) -> tuple[list[str], list[list[str]]]:
    """Columns and rows as text; refuses tables that are no report."""
    rows = table.orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    return table.columns, [["" if v is None else str(v) for v in r] for r in rows]


def write_csv(path: str, columns: list[str], rows: list[list[str]], caption: dict[str, str] | None = None, footer: list[list[str]] | None = None) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerows([[f"# {k}", v] for k, v in (caption or {}).items()])
        w.writerow(columns)
        w.writerows(rows)
        w.writerows(footer or [])


def markdown(title: str, columns: list[str], rows: list[list[str]], caption: dict[str, str] | None = None) -> str:
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ")
    line = lambda xs: "| " + " | ".join(map(cell, xs)) + " |"
    body = rows or [[""] * len(columns)]
    head = [f"### {title}", ""] + [f"- {k}: {v}" for k, v in (caption or {}).items()]
    return "\n".join([*head, "", line(columns), line(["---"] * len(columns)), *map(line, body)]) + "\n"


def report(sections: dict[str, list[str]]) -> str:
    return "\n".join(f"## {name}\n\n" + "\n".join(parts) for name, parts in sections.items())


def caption(axis: str, baseline: dict[str, str], swept: tuple[str, ...] = (), **extra: str) -> dict[str, str]:
    """The swept axis and what was held fixed."""
    fixed = ", ".join(f"{k}={v}" for k, v in baseline.items() if k not in swept)
    return {"swept": axis, "held fixed": fixed, **extra}


def n_footer(columns: list[str], n: dict[str, int]) -> list[list[str]]:
    return [["n", *[str(n.get(c, "")) for c in columns[1:]]]]


def write_status(path: str, phase: str, counts: dict[str, int]) -> None:
    with open(path, "w") as f:
        json.dump({"phase": phase, "at": datetime.now(timezone.utc).isoformat(timespec="seconds"), **counts}, f, indent=1)
