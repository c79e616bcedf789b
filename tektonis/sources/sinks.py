"""Writers: JSON reports, payloads, drawings of graphs and of score tables."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_report(rows: DataFrame, path: str, totals: dict[str, Column] | None = None, limit: int | None = None) -> None:
    """A folder of JSON: all rows (or the first ones, where the report is a top-k report), and beside it one object of totals."""
    (rows.limit(limit) if limit else rows).write.mode("overwrite").json(f"{path}/rows")
    agg = {"rows": F.count("*")} | (totals or {})
    rows.agg(*[c.alias(n) for n, c in agg.items()]).coalesce(1).write.mode("overwrite").json(f"{path}/totals")


def payload(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, value): the columns of each row as one JSON object."""
    return df.select(key, F.to_json(F.struct(*columns)).alias("value"))


def matches_payload(matches: Column) -> Column:
    """Matches as structs (iri, branch, text)."""
    return F.transform(matches, lambda m: F.struct(m["iri"].alias("iri"), m["branch"].alias("branch"), m["text"].alias("text")))


def counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that meet each condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def network_html(nodes: DataFrame, edges: DataFrame, path: str, most: int = 5000) -> int:
    """A page that draws a graph; ValueError above `most` nodes or ten times as many edges, which no browser would draw."""
    n = [r.asDict() for r in nodes.limit(most + 1).collect()]
    if len(n) > most:
        raise ValueError(f"more than {most} nodes")
    keep = nodes.select(F.col("id").alias("src"))
    e = [r.asDict() for r in edges.join(keep, "src", "left_semi").limit(most * 10 + 1).collect()]
    if len(e) > most * 10:
        raise ValueError(f"more than {most * 10} edges")
    body = f"<!doctype html><meta charset=utf-8><title>graph</title><script>const nodes={json.dumps(n)},edges={json.dumps(e)};</script><pre id=g></pre><script>g.textContent=edges.map(e=>`${{e.src}} -${{e.label}}-> ${{e.dst}}`).join('\\n')</script>"
    Path(path).write_text(body, encoding="utf-8")
    return len(n)


def bar_chart_svg(rows: list[tuple[str, float]], path: str, title: str = "") -> None:
    """A bar chart of percentages as SVG, for a handful of rows."""
    width, bar = 640, 26
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + bar * len(rows)}" font-family="sans-serif" font-size="13"><text x="8" y="20">{html.escape(title)}</text>']
    for i, (name, value) in enumerate(rows):
        y = 36 + i * bar
        parts.append(f'<text x="8" y="{y + 14}">{html.escape(name)}</text><rect x="200" y="{y}" width="{max(0.0, min(100.0, value)) * 4:.1f}" height="{bar - 8}" fill="#4a7ab5"/><text x="{206 + max(0.0, min(100.0, value)) * 4:.1f}" y="{y + 14}">{value:.1f}</text>')
    Path(path).write_text("".join(parts) + "</svg>", encoding="utf-8")
