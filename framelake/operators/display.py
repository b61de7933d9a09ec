"""Tables for people: a few rows as text or HTML."""

from __future__ import annotations

from html import escape
from textwrap import fill

from pyspark.sql import DataFrame


def _cells(df: DataFrame, limit: int, width: int) -> tuple[list[str], list[list[str]]]:
    cut = lambda v: "null" if v is None else s if len(s := str(v)) <= width else s[: width - 1] + "…"
    return df.columns, [[cut(v) for v in r] for r in df.limit(limit).collect()]


def ascii_table(df: DataFrame, limit: int = 5, width: int = 32) -> str:
    names, rows = _cells(df, limit, width)
    if not names:
        return "No data"
    wide = [max(map(len, c)) for c in zip(names, *rows)]
    line = lambda a, b, c: a + b.join("─" * (w + 2) for w in wide) + c
    show = lambda r: "│" + "│".join(f" {v:<{w}} " for v, w in zip(r, wide)) + "│"
    return "\n".join([line("┌", "┬", "┐"), show(names), line("├", "┼", "┤"), *map(show, rows), line("└", "┴", "┘")])


def html_table(df: DataFrame, limit: int = 5, width: int = 64) -> str:
    names, rows = _cells(df, limit, width)
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + row(names, "th") + "".join(row(r, "td") for r in rows) + "</table>"


def wrap_text(text: str, width: int) -> str:
    """Each line of a text filled to a width."""
    return "\n".join(fill(line, width) for line in text.splitlines())
