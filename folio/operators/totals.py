"""Totals and report rows per corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import paths, quoted
from folio.functions import text as txt
from folio.operators.content import COUNTED


def corpus_totals(measured: DataFrame) -> DataFrame:
    """Files, lines and characters; link lengths and failed reads add nothing.

    Counting with conditions instead of filtering keeps the classification from being
    evaluated a second time below the filter.
    """
    return measured.groupBy("corpus").agg(
        F.expr(f"count_if({COUNTED}) AS files"),
        F.expr("sum(if(read_status = 'ok', lines, 0)) AS lines"),
        F.expr("sum(if(read_status = 'ok', chars, 0)) AS chars"),
    )


def file_details(measured: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """One row per reported path; of several writes the last one stays.

    Files of a repository (`repos` with corpus, repo_owner, repo_name) are reported below its owner and name.

    As in the totals, what does not count is left out by a condition and after grouping, so
    that contents are not classified twice.
    """
    last = f"max(if({COUNTED}, struct(modified, size, lines, chars, hash), NULL)) AS last"
    rows = measured.groupBy("corpus", "path").agg(F.expr(last)).where("last IS NOT NULL")
    shown = paths.packed_path("path")
    if repos is not None:
        rows = rows.join(repos.select("corpus", "repo_owner", "repo_name"), "corpus", "left")
        inside = paths.report_path("concat_ws('/', corpus, path)", "corpus", "repo_owner", "repo_name")
        shown = f"if(repo_name IS NULL, {shown}, {inside})"
    return (
        rows.selectExpr(
            "corpus",
            "path",
            f"{shown} AS report_path",
            "last.lines",
            "last.chars",
            "last.hash",
        )
    )


def token_label(totals: DataFrame) -> DataFrame:
    """Counted tokens where there are any, else the estimate from the character total."""
    return totals.selectExpr(
        "corpus",
        f"coalesce(tokens, {txt.token_estimate('chars')}) AS tokens",
        "if(tokens IS NULL, 'estimated', 'counted') AS token_source",
    )


def summary_report(totals: DataFrame, output_file: str, duration: str) -> DataFrame:
    """(metric, value) rows per corpus from files, lines, chars, tokens, hits and lookups.

    The hit-rate row is left out where the corpus had no token model (`lookups` is NULL).
    """
    tokens = txt.count_text(f"coalesce(tokens, {txt.token_estimate('chars')})")
    source = "if(tokens IS NULL, ' tokens (estimated)', ' tokens (counted)')"
    rate = txt.one_decimal("if(lookups > 0, hits / lookups * 100D, 0D)")
    hits = f"concat({rate}, '% (', hits, ' hits / ', lookups, ' total)')"
    metrics = [
        ("Output File", quoted(output_file)),
        ("Process Time", quoted(duration)),
        ("Files Processed", txt.count_text("files")),
        ("Total Lines", txt.count_text("lines")),
        ("LLM Tokens", f"concat({tokens}, {source})"),
        ("Cache Hit Rate", f"if(lookups IS NULL, NULL, {hits})"),
    ]
    rows = ", ".join(
        f"{number}, '{name}', {value}" for number, (name, value) in enumerate(metrics, start=1)
    )
    stacked = f"stack({len(metrics)}, {rows}) AS (row, metric, value)"
    return totals.selectExpr("corpus", stacked).where("value IS NOT NULL")
