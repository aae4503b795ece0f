"""File trees as a source of Spark: `spark.read.format("tree").load(root)`, and `readStream` for files as they arrive.

    from folio.sources.tree_source import register
    register(spark)
    spark.read.format("tree").option("content", "true").load("/mnt/src/app").where("name LIKE '%.sql'")

Rows are those of a files table and the entry's `name`; folders are rows as well. Options: `corpus` (the root's last folder
unless given), `content` (whole contents; off by default), `recordSymlinks`, and `tasks` (input partitions, 200 by default).

Planning opens folders from the root on until `FOLDERS_PER_TASK` times `tasks` of them are known, which bounds what the
driver lists whatever the tree holds. A task walks the folders dealt to it. Names and paths that a query asks for are
tested before an entry is looked at, and folders that cannot hold such a path are not opened. One folder's subtree below the
planned ones is one task's work: trees that hang on a single deep folder are listed level by level by `sources.tree`.

The stream's offset is a time of the storage: a batch holds the regular files whose last change of contents, name or place
falls between two offsets, so nothing is kept between batches and a batch is replayed from its two offsets. Files are taken
when they have been at rest for `settle` seconds (2 by default); a file that is changed again arrives again. A file changed
between a failed batch and its replay moves to a later batch.
"""

from __future__ import annotations

import os
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from folio.sources.tree import BATCH_BYTES, BATCH_ROWS, look_at, unreadable

SCHEMA = (
    "corpus STRING, path STRING, kind STRING, size BIGINT, modified TIMESTAMP, permissions STRING, target STRING, "
    "raw BINARY, open_error STRING, name STRING"
)
_ARROW = pa.schema(
    [
        ("corpus", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()),
        ("modified", pa.timestamp("us", tz="UTC")), ("permissions", pa.string()), ("target", pa.string()),
        ("raw", pa.binary()), ("open_error", pa.string()), ("name", pa.string()),
    ]
)
TASKS = 200
FOLDERS_PER_TASK = 4
SETTLE_SECONDS = 2.0
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: How a filter on a text column judges a value.
_TESTS = {
    EqualTo: lambda value, wanted: value == wanted,
    In: lambda value, wanted: value in wanted,
    StringStartsWith: lambda value, wanted: value.startswith(wanted),
    StringEndsWith: lambda value, wanted: value.endswith(wanted),
    StringContains: lambda value, wanted: wanted in value,
}


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.dataSource.register(TreeSource)
    spark.conf.set(PUSHDOWN, "true")


@dataclass
class Folders(InputPartition):
    """Folders whose subtrees a task walks, and folders whose own entries it lists."""

    deep: list[str]
    flat: list[str]
    after: int | None = None
    until: int | None = None


class _Walk:
    """What planning and reading share: the root, the options, and the filters."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("load() takes the root of the tree")
        self.root = os.path.realpath(options["path"])
        self.corpus = options.get("corpus") or os.path.basename(self.root)
        self.content = options.get("content", "false").lower() == "true"
        self.record_symlinks = options.get("recordsymlinks", "false").lower() == "true"
        self.tasks = int(options.get("tasks", TASKS))
        if self.tasks < 1:
            raise ValueError("tasks must be 1 at least")
        self.tests: list[tuple[str, type, object]] = []

    def push(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take filters on names and paths; the others stay with Spark."""
        for asked in filters:
            column = getattr(asked, "attribute", ())
            wanted = getattr(asked, "value", None)
            if type(asked) in _TESTS and column in (("name",), ("path",)) and wanted is not None:
                self.tests.append((column[0], type(asked), wanted))
            else:
                yield asked

    def wants(self, path: str) -> bool:
        return all(
            _TESTS[kind](path if column == "path" else path.rpartition("/")[2], wanted)
            for column, kind, wanted in self.tests
        )

    def may_hold(self, folder: str) -> bool:
        """Whether paths below a folder can pass the filters on paths."""
        below = f"{folder}/"
        for column, kind, wanted in self.tests:
            if column == "name":
                continue
            if kind is StringStartsWith and not (below.startswith(wanted) or wanted.startswith(below)):
                return False
            if kind is EqualTo and not wanted.startswith(below):
                return False
            if kind is In and not any(w is not None and w.startswith(below) for w in wanted):
                return False
        return True

    def subfolders(self, folder: str) -> list[str]:
        """Folders right below one; none where it cannot be listed, which the task that reads it reports."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                paths = [self._below(folder, e.name) for e in entries if e.is_dir(follow_symlinks=False)]
        except OSError as problem:
            if not folder:
                raise FileNotFoundError(f"Target directory not found: {self.root}") from problem
            return []
        return sorted(path for path in paths if self.may_hold(path))

    @staticmethod
    def _below(folder: str, name: str) -> str:
        return f"{folder}/{name}" if folder else name

    def plan(self, after: int | None = None, until: int | None = None) -> list[Folders]:
        """Breadth first; folders opened here are listed flat, the open ends are walked."""
        ends, opened = deque([""]), []
        while ends and len(ends) + len(opened) < FOLDERS_PER_TASK * self.tasks:
            folder = ends.popleft()
            opened.append(folder)
            ends.extend(self.subfolders(folder))
        ends = list(ends)
        parts = [Folders(ends[k :: self.tasks], opened[k :: self.tasks], after, until) for k in range(self.tasks)]
        return [part for part in parts if part.deep or part.flat]

    def _listed(self, folder: str, below: list[str] | None) -> Iterator[tuple]:
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in entries:
                    path = self._below(folder, entry.name)
                    if below is not None and entry.is_dir(follow_symlinks=False) and self.may_hold(path):
                        below.append(path)
                    if self.wants(path):
                        yield look_at(self.corpus, self.root, path, self.record_symlinks)
        except OSError as problem:
            if self.wants(folder):
                yield unreadable(self.corpus, self.root, folder, problem)

    def entries(self, part: Folders) -> Iterator[tuple]:
        for folder in part.flat:
            yield from self._listed(folder, None)
        left = list(part.deep)
        while left:
            below: list[str] = []
            yield from self._listed(left.pop(), below)
            left += below

    def _arrived(self, path: str, part: Folders) -> bool:
        try:
            changed = os.stat(os.path.join(self.root, path)).st_ctime_ns // 1000
        except OSError:  # gone since it was listed
            return False
        return part.after < changed <= part.until

    def batches(self, part: Folders) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for corpus, root, path, kind, size, modified, permissions, target, error in self.entries(part):
            if part.until is not None and not (kind == "file" and self._arrived(path, part)):
                continue
            raw = None
            if self.content and kind == "file":
                try:
                    with open(os.path.join(root, path), "rb") as source:
                        raw = source.read()
                except OSError as problem:
                    error = problem.strerror
            rows.append((corpus, path, kind, size, modified, permissions, target, raw, error, path.rpartition("/")[2]))
            held += len(raw or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.walk = _Walk(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.walk.push(filters)

    def partitions(self) -> list[InputPartition]:
        return self.walk.plan()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.walk.batches(partition)


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.walk = _Walk(options)
        self.settle = float(options.get("settle", SETTLE_SECONDS))

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": int((time.time() - self.settle) * 1_000_000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.walk.plan(start["until"], end["until"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.walk.batches(partition)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStreamReader(self.options)
