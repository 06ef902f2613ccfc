"""Results out: CSV, JSON, Markdown and HTML; and results within a budget of rows and bytes."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

ROWS, MOST_ROWS, MOST_BYTES = 1_000, 5_000, 16 << 20


def within_budget(df: DataFrame, rows: int = ROWS, most_bytes: int = MOST_BYTES) -> dict:
    """At most ``rows`` rows and ``most_bytes`` bytes, and whether there was more: one row beyond is read to tell."""
    rows = max(1, min(rows, MOST_ROWS))
    out, size, truncated = [], 0, False
    for row in df.limit(rows + 1).toLocalIterator():
        text = json.dumps(row.asDict(recursive=True), default=str)
        if len(out) == rows or size + len(text.encode()) > most_bytes:
            truncated = True
            break
        out.append(json.loads(text))
        size += len(text.encode())
    return {"columns": df.columns, "rows": out, "truncated": truncated, "bytes": size}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _cell(x) -> str:
    return "—" if x is None else f"{x:g}" if isinstance(x, float) else str(x)


def markdown(df: DataFrame, title: str, rows: int = ROWS) -> str:
    """A report's table; a pipe in a cell is escaped."""
    got = within_budget(df, rows)
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    body = [line(_cell(r[c]) for c in got["columns"]) for r in got["rows"]]
    return "\n".join([f"# {title}", "", line(got["columns"]), line("---" for _ in got["columns"]), *body, *(["", "_More rows were left out._"] if got["truncated"] else []), ""])


def as_html(df: DataFrame, title: str, rows: int = ROWS) -> str:
    got = within_budget(df, rows)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in got["columns"])
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(r[c]))}</td>" for c in got["columns"]) + "</tr>" for r in got["rows"])
    more = "<p>More rows were left out.</p>" if got["truncated"] else ""
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>{more}"
