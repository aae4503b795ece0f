"""The two-table report of a corpus as text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels of the printed report.
ICONS = {
    "Output File": "📂",
    "Process Time": "⏱️",
    "Files Processed": "📄",
    "Total Lines": "📝",
    "LLM Tokens": "📦",
    "Cache Hit Rate": "🔄",
}
FILE_HEADER = ("File Path", "Lines", "Est. Tokens")
SUMMARY_HEADER = ("Metric", "Value")
SUMMARY_TITLE = "✅  EXTRACTION COMPLETE"
EMOJI_SELECTOR = "️"


def duration_text(seconds: float) -> str:
    """Four decimals in the largest unit that leaves a whole part."""
    for unit, scale in (("s", 1), ("ms", 1e3), ("µs", 1e6)):
        if seconds * scale >= 1:
            return f"{seconds * scale:.4f}{unit}"
    return f"{seconds * 1e9:.4f}ns"


def cells(text: str) -> int:
    """Width of a text on a terminal."""
    width = 0
    for char in text:
        if char == EMOJI_SELECTOR or unicodedata.east_asian_width(char) in "WF":
            width += 1 if char == EMOJI_SELECTOR else 2
        elif not unicodedata.combining(char):
            width += 1
    return width


def box(header, rows) -> str:
    """Rounded table, left aligned, one space of padding."""
    table = [list(header), *[list(row) for row in rows]]
    widths = [max(cells(row[i]) for row in table) for i in range(len(header))]

    def rule(left: str, middle: str, right: str) -> str:
        return left + middle.join("─" * (w + 2) for w in widths) + right

    def line(row) -> str:
        padded = (f" {c}{' ' * (w - cells(c))} " for c, w in zip(row, widths, strict=True))
        return "│" + "│".join(padded) + "│"

    body = [line(row) for row in table]
    return "\n".join(
        [rule("╭", "┬", "╮"), body[0], rule("├", "┼", "┤"), *body[1:], rule("╰", "┴", "╯")]
    )


def _files_title(title: str) -> str:
    return f"📋  {title}  📋" if title.startswith("TOP") else f"📋  {title}"


@F.pandas_udf(T.StringType())
def _print(title: pd.Series, files: pd.Series, summary: pd.Series) -> pd.Series:
    def one(heading, file_rows, summary_rows):
        listed = [(r["display_path"], r["lines"], r["tokens"]) for r in file_rows]
        metrics = [(f"{ICONS[r['metric']]} {r['metric']}", r["value"]) for r in summary_rows]
        files_box, summary_box = box(FILE_HEADER, listed), box(SUMMARY_HEADER, metrics)
        return f"{_files_title(heading)}\n{files_box}\n\n{SUMMARY_TITLE}\n{summary_box}"

    return pd.Series([one(*row) for row in zip(title, files, summary, strict=True)])


def console_report(files_report: DataFrame, summary: DataFrame) -> DataFrame:
    """One printed report per corpus.

    Both inputs are bounded per corpus, at most 15 files and 6 metrics, so gathering them
    into one row is safe.
    """
    listed = files_report.groupBy("corpus").agg(
        F.max("title").alias("title"),
        F.sort_array(
            F.collect_list(F.struct("rank", "display_path", "lines", "tokens"))
        ).alias("files"),
    )
    metrics = summary.groupBy("corpus").agg(
        F.sort_array(F.collect_list(F.struct("row", "metric", "value"))).alias("summary")
    )
    return listed.join(metrics, "corpus").select(
        "corpus", _print("title", "files", "summary").alias("report")
    )
