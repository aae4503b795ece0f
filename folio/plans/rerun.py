"""Runs over what an earlier run has measured: only files that changed are read.

The measured table of a run (one row for each file, without contents) is the snapshot that the next one is compared with.
A file is the same while its kind, size, time, permissions and link target are; a path that occurs several times is
the same while all its rows are. Totals are kept by what changed: old contributions are taken off, new ones put on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import content, totals
from folio.options import PackOptions
from folio.plans.scratch import staged
from folio.sources.tables import FILES_SCHEMA
from folio.sources.tree import list_trees, read_contents

KEYS = ["corpus", "path"]
_STATE = "xxhash64(if(kind = 'symlink', kind, 'file'), size, unix_micros(modified), permissions, target)"
SUMS = ("entries", "files", "lines", "chars")


@dataclass(frozen=True)
class Rerun:
    """The next snapshot, its totals, and what changed: (corpus, path, change), `change` added, changed or removed."""

    measured: DataFrame
    totals: DataFrame
    changes: DataFrame


def _states(rows: DataFrame, name: str) -> DataFrame:
    """What is known of each path without its contents, as one number; the sum holds for paths that occur several times."""
    keyed = rows.selectExpr("corpus", "path", f"cast({_STATE} AS DECIMAL(20, 0)) AS state")
    return keyed.groupBy(*KEYS).agg(F.struct(F.count("*"), F.sum("state")).alias(name))


def changes(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(corpus, path, change) of what differs between a listing and a snapshot; contents are not looked at."""
    now, then = _states(listing, "now").alias("n"), _states(snapshot, "then").alias("t")
    both = now.join(then, F.expr(" AND ".join(f"n.{k} <=> t.{k}" for k in KEYS)), "full_outer")
    change = "CASE WHEN then IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change"
    differing = both.where("NOT (now <=> then)")
    return differing.selectExpr(*[f"if(now IS NULL, t.{k}, n.{k}) AS {k}" for k in KEYS], change)


def _of(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    renamed = keys.selectExpr(*[f"{k} AS key_{k}" for k in KEYS])
    return rows.join(renamed, F.expr(" AND ".join(f"{k} <=> key_{k}" for k in KEYS)), how)


def contributions(measured: DataFrame) -> DataFrame:
    """Totals per corpus with the number of rows they come from."""
    entries = measured.groupBy("corpus").agg(F.count("*").alias("entries"))
    sums = totals.corpus_totals(measured).withColumnRenamed("corpus", "c")
    return entries.join(sums, F.expr("corpus <=> c")).select("corpus", *SUMS)


def totals_after(before: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """`contributions` after rows `gone` went and rows `fresh` came; a corpus without rows has none."""
    taken = contributions(gone).selectExpr("corpus", *[f"-{s} AS {s}" for s in SUMS])
    every = before.select("corpus", *SUMS).unionByName(taken).unionByName(contributions(fresh))
    return every.groupBy("corpus").agg(*[F.sum(s).alias(s) for s in SUMS]).where("entries > 0")


def rerun(listing: DataFrame, read, snapshot: DataFrame, before: DataFrame, options: PackOptions) -> Rerun:
    """The next snapshot and its totals. `read` gives the files table for the keys (corpus, path) that are to be read."""
    changed = staged(changes(content.accepted(listing), snapshot), "changes")
    fresh = staged(content.measured(read(changed.where("change <> 'removed'")), options), "fresh")
    gone = _of(snapshot, changed, "left_semi")
    same = _of(snapshot, changed, "left_anti")
    return Rerun(staged(same.unionByName(fresh), "measured"), totals_after(before, gone, fresh), changed)


def rerun_files(files: DataFrame, snapshot: DataFrame, before: DataFrame, options: PackOptions) -> Rerun:
    """`rerun` over a files table; columns of its other rows' contents are not read."""
    return rerun(files, lambda keys: _of(files, keys, "left_semi"), snapshot, before, options)


def rerun_trees(spark: SparkSession, roots: DataFrame, snapshot: DataFrame, before: DataFrame, options: PackOptions) -> Rerun:
    """`rerun` over file trees: all are listed, and only changed files are opened. Ignore files are not asked."""
    listed = list_trees(roots, options).where("kept AND kind <> 'directory'")
    listing = listed.withColumns({"modified": F.timestamp_micros("modified_us"), "raw": F.lit(None).cast("binary")}).select(*FILES_SCHEMA.names)
    return rerun(listing, lambda keys: read_contents(_of(listed, keys, "left_semi"), options), snapshot, before, options)
