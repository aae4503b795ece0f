"""Formats of the caller's own: any function from the events of a pack to its lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from folio.functions import case, paths
from folio.operators.render import BODY, HEADER, TRAILER
from folio.options import WRITERS

#: Lines that go back to Spark at once, and their bytes.
BATCH_LINES = 4096
BATCH_BYTES = 8 * 1024 * 1024


class Event(NamedTuple):
    """What a pack tells next: begin, open, text, binary, symlink, close or end."""

    event: str
    name: str | None
    path: str | None
    depth: int
    size: int | None
    permissions: str | None
    content: str | None
    target: str | None


Writer = Callable[[Iterator[Event]], Iterator[str]]


def register_writer(name: str, write: Writer) -> None:
    """Add a format. `write` is called for each corpus in each part of its pack, with the events in order, and yields lines.

    A pack is cut at any event, so what a line needs to know must be in its event; folders open and close with
    events of their own, which carry their depth.
    """
    WRITERS[name] = write


def event_frame(corpora: DataFrame, dirs: DataFrame) -> DataFrame:
    """Everything of a pack but its leaves, as events: begin and end of each corpus, folders opening and closing."""
    both = "inline(array(struct({} AS section, {} AS sort_key, {} AS event), struct({} AS section, {} AS sort_key, {} AS event)))"
    ends = both.format(HEADER, "''", "'begin'", TRAILER, "''", "'end'")
    folders = both.format(BODY, paths.dir_key("dir"), "'open'", BODY, paths.dir_close_key("dir"), "'close'")
    whole = corpora.selectExpr("corpus", "cast(NULL AS STRING) AS path", ends)
    return whole.unionByName(dirs.selectExpr("corpus", "dir AS path", folders))


def described(rows: DataFrame) -> DataFrame:
    """Rows of a pack in order, classified and read, as the columns of events behind `corpus` and `part`."""
    name = case(("path IS NULL OR path = ''", "corpus"), otherwise=paths.name_of("path"))
    return rows.selectExpr(
        "corpus", "part", "coalesce(event, kind) AS event", f"{name} AS name", f"{paths.packed_path('path')} AS path",
        f"if(path IS NULL, 0, {paths.depth_of('path')}) AS depth", "size", "permissions",
        "if(event IS NULL, content, NULL) AS content", "target",
    )


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for corpus, part, *event in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
            yield (corpus, part), Event(*event)


def written(rows: DataFrame, name: str) -> DataFrame:
    """(corpus, part, fragment): the lines that the registered format writes for `described` rows."""
    write = WRITERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (corpus, part), group in groupby(_events(batches), key=lambda e: e[0]):
            lines, held = [], 0

            def batch(lines=lines, corpus=corpus, part=part) -> pa.RecordBatch:
                columns = [pa.array([corpus] * len(lines), pa.string()), pa.array([part] * len(lines), pa.int32()), pa.array(lines, pa.string())]
                return pa.record_batch(columns, names=["corpus", "part", "fragment"])

            for line in write(event for _, event in group):
                lines.append(line)
                held += len(line)
                if len(lines) >= BATCH_LINES or held >= BATCH_BYTES:
                    yield batch()
                    lines.clear()
                    held = 0
            if lines:
                yield batch()

    return rows.mapInArrow(run, "corpus STRING, part INT, fragment STRING")
