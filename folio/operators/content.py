"""From bytes to bounded text with its measures; one pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folio.functions import case, quoted
from folio.functions import text as txt
from folio.options import PackOptions

# Texts that stand in for contents.
TOO_LARGE = "File too large to include content. Size: "
READ_FAILED = "Failed to read file content: stream did not contain valid UTF-8"
OPEN_FAILED = "Failed to open file: "

# Entries that count as processed; those that failed to be read do not.
COUNTED = "read_status IN ('ok', 'oversize', 'binary', 'symlink')"

_UNREADABLE = "(kind = 'file' AND open_error IS NOT NULL AND raw IS NULL)"


def accepted(files: DataFrame) -> DataFrame:
    """Entries a pack can hold. Asked before classification, so it costs no content test."""
    return files.where(f"kind IN ('file', 'symlink') AND NOT {_UNREADABLE}")


def rejects(files: DataFrame) -> DataFrame:
    """Entries a pack cannot hold, by corpus and reason."""
    reason = f"if(kind = 'unreadable' OR {_UNREADABLE}, 'unreadable', 'other') AS reason"
    rejected = files.where(f"kind NOT IN ('file', 'symlink', 'directory') OR {_UNREADABLE}")
    return rejected.selectExpr("corpus", reason).groupBy("corpus", "reason").count().withColumnRenamed(
        "count", "entries"
    )


def entry_kind(options: PackOptions) -> str:
    """text, binary, symlink, directory or other."""
    is_text = txt.looks_like_text(
        "raw", "size", options.text_limit, options.sample_bytes, options.trim_partial_char
    )
    return f"if(kind = 'file', if({is_text}, 'text', 'binary'), kind)"


def _with(rows: DataFrame, *expressions: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Rows with expressions added or replaced, in one step."""
    replaced = {e.rsplit(" AS ", 1)[1] for e in expressions} | set(without)
    return rows.selectExpr(*[f"`{c}`" for c in rows.columns if c not in replaced], *expressions)


def classify(files: DataFrame, options: PackOptions) -> DataFrame:
    return _with(files, f"{entry_kind(options)} AS kind")


def with_content(classified: DataFrame, options: PackOptions) -> DataFrame:
    """Swap the bytes for `content`, and say in `read_status` where it came from."""
    status = case(
        ("kind <> 'text'", "kind"),
        (f"size > {options.inline_limit}", "'oversize'"),
        ("open_error IS NOT NULL", "'open_error'"),
        ("is_valid_utf8(cast(raw AS STRING))", "'ok'"),
        otherwise="'read_error'",
    )
    content = case(
        ("read_status = 'ok'", "cast(raw AS STRING)"),
        ("read_status = 'oversize'", f"concat('{TOO_LARGE}', {txt.size_text('size')})"),
        ("read_status = 'read_error'", quoted(READ_FAILED)),
        ("read_status = 'open_error'", f"concat('{OPEN_FAILED}', open_error)"),
    )
    rows = _with(classified, f"{status} AS read_status")
    return _with(rows, f"{content} AS content", without=("raw", "open_error"))


def with_measures(contents: DataFrame) -> DataFrame:
    """Lines and characters; zero for what is not readable text, link length for symlinks."""
    lines = f"if(read_status = 'ok', {txt.line_count('content')}, 0L) AS lines"
    chars = case(
        ("read_status = 'ok'", txt.char_count("content")),
        ("read_status = 'symlink'", "cast(length(target) AS BIGINT)"),
        otherwise="0L",
    )
    return _with(contents, lines, f"{chars} AS chars")


def with_hash(contents: DataFrame) -> DataFrame:
    """Cache key of readable text."""
    return _with(contents, f"if(read_status = 'ok', {txt.content_hash('content')}, NULL) AS hash")


def measured(files: DataFrame, options: PackOptions) -> DataFrame:
    """Per-file facts without the contents: what every report and cache step works on."""
    rows = with_content(classify(accepted(files), options), options)
    rows = with_hash(with_measures(rows))
    return rows.select(
        "corpus", "path", "kind", "read_status", "size", "modified", "permissions",
        "target", "lines", "chars", "hash",
    )
