"""Measures of files that are too large for one row, from chunks cut at any byte.

    chunks: corpus STRING, path STRING, chunk BIGINT (from 0), raw BINARY     all but the last of a file at least 4 bytes

A chunk is summed up where it is read: line ends, characters, and its edges, which are whether it begins with a line feed or ends with a
carriage return, and the bytes of a character that it begins or ends in the middle of. Contents stay out of the shuffle;
the states of a file meet in order, and each seam is judged by the two edges that touch there. A content hash takes the
bytes one after the other, so a file's chunks go in order to one task, which holds one batch of them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import quoted

CHUNK_BYTES = 64 * 1024 * 1024
CHUNKS = "corpus STRING, path STRING, chunk BIGINT, raw BINARY"
# Bytes as characters of the same number, so that expressions over text see bytes.
_BYTES = "decode(raw, 'ISO-8859-1')"
_CONTINUES = r"\u0080-¿"
_HEAD = quoted(rf"\A[{_CONTINUES}]{{1,3}}")
_TAIL = quoted(rf"(?:[Â-ß]|[à-ï][{_CONTINUES}]?|[ð-ô][{_CONTINUES}]{{0,2}})\z")


def chunks_of(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Files of a files table in chunks; an empty file has one empty chunk."""
    last = f"greatest((octet_length(raw) - 1) div {chunk_bytes}, 0L)"
    numbered = files.where("raw IS NOT NULL").selectExpr("corpus", "path", "raw", f"explode(sequence(0L, {last})) AS chunk")
    part = f"substring(raw, cast(chunk * {chunk_bytes} + 1 AS INT), {chunk_bytes}) AS raw"
    return numbered.selectExpr("corpus", "path", "chunk", part)


def read_chunks(entries: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of listed files (corpus, root, path, size), each read by itself, so the tasks share a large file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with open(os.path.join(row.root, row.path), "rb") as source:
                    source.seek(row.chunk * chunk_bytes)
                    raw = source.read(chunk_bytes)
                yield pd.DataFrame([(row.corpus, row.path, row.chunk, raw)], columns=["corpus", "path", "chunk", "raw"])

    last = f"greatest((size - 1) div {chunk_bytes}, 0L)"
    asked = entries.selectExpr("corpus", "root", "path", f"explode(sequence(0L, {last})) AS chunk")
    return asked.repartition("corpus", "path", "chunk").mapInPandas(read, CHUNKS)


def states(chunks: DataFrame) -> DataFrame:
    """What a chunk adds to the measures of its file, without its content."""
    rows = chunks.selectExpr("corpus", "path", "chunk", "raw", f"{_BYTES} AS b")
    edges = rows.selectExpr("*", f"regexp_extract(left(b, 3), {_HEAD}, 0) AS head", f"regexp_extract(right(b, 3), {_TAIL}, 0) AS tail")
    middle = "substring(raw, length(head) + 1, length(b) - length(head) - length(tail))"
    return edges.selectExpr(
        "corpus", "path", "chunk", "head", "tail", "cast(length(b) AS BIGINT) AS size",
        "cast(length(b) - length(replace(b, '\\n', '')) AS BIGINT) AS feeds",
        f"cast(regexp_count(b, {quoted(f'[^{_CONTINUES}]')}) AS BIGINT) AS points",
        "cast(regexp_count(b, '\\r\\n') AS BIGINT) AS pairs",
        "startswith(b, '\\n') AS begins_lf", "endswith(b, '\\r') AS ends_cr", "endswith(b, '\\n') AS ends_lf",
        f"is_valid_utf8(cast({middle} AS STRING)) AS sound",
    )


def measures(states: DataFrame) -> DataFrame:
    """(corpus, path, size, lines, chars, valid) of files from the states of their chunks; no measures where not valid."""
    before = "OVER (PARTITION BY corpus, path ORDER BY chunk)"
    seams = states.selectExpr(
        "*", f"coalesce(lag(ends_cr) {before}, false) AND begins_lf AS pair_between",
        f"concat(coalesce(lag(tail) {before}, ''), head) AS seam", f"lead(chunk) {before} IS NULL AS is_last",
    )
    whole = "sound AND is_valid_utf8(cast(encode(seam, 'ISO-8859-1') AS STRING)) AND NOT (is_last AND tail <> '')"
    sums = seams.groupBy("corpus", "path").agg(
        F.sum("size").alias("size"), F.sum("feeds").alias("feeds"), F.sum("points").alias("points"),
        F.expr("sum(pairs + if(pair_between, 1, 0)) AS pairs"), F.expr("bool_or(is_last AND ends_lf) AS ends_lf"),
        F.expr(f"bool_and({whole}) AS valid"),
    )
    open_line = "if(size = 0 OR ends_lf, 0L, 1L)"
    return sums.selectExpr(
        "corpus", "path", "size", f"if(valid, feeds + {open_line}, NULL) AS lines",
        f"if(valid, points - pairs + {open_line}, NULL) AS chars", "valid",
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state = None, None

    def told() -> pa.RecordBatch:
        return pa.record_batch([pa.array([v], pa.string()) for v in (*at, state.hexdigest())], names=["corpus", "path", "hash"])

    for batch in batches:
        for corpus, path, raw in zip(batch.column("corpus").to_pylist(), batch.column("path").to_pylist(), batch.column("raw")):
            if (corpus, path) != at:
                if at is not None:
                    yield told()
                at, state = (corpus, path), hashlib.sha256()
            state.update(raw.as_buffer())
    if at is not None:
        yield told()


def hashes(chunks: DataFrame) -> DataFrame:
    """(corpus, path, hash) of files: the hash of their whole content."""
    in_order = chunks.repartition("corpus", "path").sortWithinPartitions("corpus", "path", "chunk")
    return in_order.select("corpus", "path", "raw").mapInArrow(_hashed, "corpus STRING, path STRING, hash STRING")
