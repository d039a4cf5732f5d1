"""Evaluation reports from small aggregates: JSON with sorted keys, and Markdown tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def markdown(rows: list[dict], title: str) -> str:
    if not rows:
        return f"## {title}\n\nNo rows.\n"
    names = list(rows[0])
    shown = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    return "\n".join([f"## {title}", "", *lines, *["| " + " | ".join(shown(r[n]) for n in names) + " |" for r in rows], ""])


def write(aggregates: dict[str, DataFrame], folder: str, most_rows: int = 10_000) -> None:
    """aggregates by title; each must be small."""
    data = {}
    for title, df in aggregates.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{title} is no small aggregate")
        data[title] = [r.asDict(recursive=True) for r in rows]
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "report.json").write_text(json.dumps(data, sort_keys=True, indent=1, default=str))
    Path(folder, "report.md").write_text("\n".join(markdown(rows, title) for title, rows in data.items()))
