"""The files table: its schema, and adapters from document tables.

    corpus STRING      root or repository the file belongs to
    path STRING        relative to the root, '/'-separated
    kind STRING        file, symlink, directory or other
    size BIGINT        bytes
    modified TIMESTAMP
    permissions STRING octal
    target STRING      of a symlink
    raw BINARY         contents; only the head where the size is over the inline limit
    open_error STRING  why the contents could not be opened after the head was read
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.functions import quoted

FILES_SCHEMA = T.StructType(
    [
        T.StructField("corpus", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("permissions", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("raw", T.BinaryType()),
        T.StructField("open_error", T.StringType()),
    ]
)


def files_from_texts(
    rows: DataFrame,
    corpus: str,
    path: str,
    text: str,
    modified: str = "timestamp_seconds(0)",
    permissions: str = "'644'",
) -> DataFrame:
    """Any table with a text per row as a files table; the parts are SQL expressions."""
    return rows.selectExpr(
        f"cast({corpus} AS STRING) AS corpus",
        f"{path} AS path",
        "'file' AS kind",
        f"cast(octet_length({text}) AS BIGINT) AS size",
        f"{modified} AS modified",
        f"{permissions} AS permissions",
        "cast(NULL AS STRING) AS target",
        f"cast({text} AS BINARY) AS raw",
        "cast(NULL AS STRING) AS open_error",
    )


def from_documents(documents: DataFrame) -> DataFrame:
    """One corpus per source, one file per document."""
    return files_from_texts(documents, "source", "concat(lang, '/', doc_id, '.txt')", "text")


def from_pages(pages: DataFrame) -> DataFrame:
    """One corpus per host; the path is the URL path, with the page id to keep it unique."""
    parts = quoted(r"\Ahttps?://([^/?#]+)/?([^?#]*)")
    folder = f"regexp_replace(regexp_extract(url, {parts}, 2), {quoted(r'/+\z')}, '')"
    path = f"concat_ws('/', nullif({folder}, ''), concat(page_id, '.html'))"
    return files_from_texts(pages, f"lower(regexp_extract(url, {parts}, 1))", path, "html")


def from_conversations(conversations: DataFrame) -> DataFrame:
    """One corpus per conversation, one file per turn."""
    path = "concat(role, '/', lpad(turn, 6, '0'), '.txt')"
    return files_from_texts(conversations, "conv_id", path, "text")


def metadata(files: DataFrame) -> DataFrame:
    """What is known of an entry without its contents."""
    return files.select("corpus", "path", "kind", "size", "modified", "permissions", "target")
