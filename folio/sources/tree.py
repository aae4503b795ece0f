"""Scan of file trees on storage that all executors mount.

Folders are listed level by level: every level is a table of folders, listed in parallel,
whose sub-folders make the next one. No listing passes through the driver, ignored folders
are not entered, and one deep or wide tree is shared by all tasks. Contents are read in a
second pass, spread over tasks by file.

A file source of Spark cannot be used here: it leaves out names that start with a dot or an
underscore and empty files, and knows neither permissions nor links.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import paths, quoted
from folio.operators.filters import is_ignored_name, is_output_file, matches_globs
from folio.options import PackOptions
from folio.plans.scratch import new_path
from folio.sources.tables import FILES_SCHEMA

LISTING = (
    "corpus STRING, root STRING, path STRING, kind STRING, size BIGINT, modified_us BIGINT, "
    "permissions STRING, target STRING, open_error STRING"
)
READ = (
    "corpus STRING, path STRING, kind STRING, size BIGINT, modified_us BIGINT, "
    "permissions STRING, target STRING, raw BINARY, open_error STRING"
)
_READ_COLUMNS = [field.split()[0] for field in READ.split(", ")]
_COLUMNS = [field.split()[0] for field in LISTING.split(", ")]
BATCH_ROWS = 4096
BATCH_BYTES = 32 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024
TASK_FOLDERS = 1000


def _kind(mode: int) -> str:
    if stat.S_ISDIR(mode):
        return "directory"
    return "file" if stat.S_ISREG(mode) else "other"


def unreadable(corpus, root, path, problem):
    return corpus, root, path, "unreadable", 0, 0, None, None, problem.strerror or str(problem)


def look_at(corpus, root, path, record_symlinks):
    """Facts of one entry, following links; one of kind `unreadable` when there are none to be had."""
    full = os.path.join(root, path) if path else root
    try:
        link = os.readlink(full) if os.path.islink(full) else None
        info = os.lstat(full) if link is not None and record_symlinks else os.stat(full)
    except OSError as problem:
        return unreadable(corpus, root, path, problem)
    kind = _kind(info.st_mode)
    if link is not None:
        # A linked folder is not entered: the walk would not end on a cycle.
        kind = "symlink" if record_symlinks else ("other" if kind == "directory" else kind)
    return (
        corpus, root, path, kind, info.st_size, info.st_mtime_ns // 1000,
        format(stat.S_IMODE(info.st_mode) & 0o777, "o"), link, None,
    )


def _lister(record_symlinks: bool):
    def list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for corpus, root, folder in zip(batch.corpus, batch.root, batch.path, strict=True):
                try:
                    with os.scandir(os.path.join(root, folder) if folder else root) as names:
                        for name in names:
                            path = f"{folder}/{name.name}" if folder else name.name
                            rows.append(look_at(corpus, root, path, record_symlinks))
                            if len(rows) >= BATCH_ROWS:
                                yield pd.DataFrame(rows, columns=_COLUMNS)
                                rows = []
                except OSError as problem:
                    if not folder:
                        message = f"Target directory not found: {root}"
                        raise FileNotFoundError(message) from problem
                    rows.append(unreadable(corpus, root, folder, problem))
        yield pd.DataFrame(rows, columns=_COLUMNS)

    return list_folders


def _keep_entry(options: PackOptions) -> str:
    name = paths.name_of("path")
    keep = f"NOT {is_ignored_name(name, options)} AND NOT {is_output_file('path', options)}"
    if options.include_patterns:
        included = matches_globs(name, options.include_patterns)
        anyway = "false" if options.include_dirs else "kind IN ('directory', 'unreadable')"
        keep += f" AND ({anyway} OR {included})"
    return keep


def _is_rule_file(options: PackOptions, always: bool = False) -> str:
    names = [".gitignore", ".ignore"] if options.respect_gitignore or always else []
    names += [options.custom_ignore_name] if options.custom_ignore_name else []
    wanted = ", ".join(quoted(name) for name in names)
    return f"kind = 'file' AND {paths.name_of('path')} IN ({wanted})" if names else "false"


def list_trees(roots: DataFrame, options: PackOptions) -> DataFrame:
    """Entries below the roots (corpus, root) that pass the name filters, folders included.

    What cannot be looked at, a folder that cannot be listed among it, is an entry of kind `unreadable` with the reason.

    Ignore files themselves are kept in the listing, marked by `kept` false, since their
    rules count although they are not packed.
    """
    spark = roots.sparkSession
    path, level, tasks = new_path(spark, "listing"), 0, spark.sparkContext.defaultParallelism
    found = roots.count()
    folders = roots.selectExpr("corpus", "if(root = '/', '/', rtrim('/', root)) AS root", "'' AS path")
    while True:
        target = f"{path}/level={level}"
        # A number of our own, as a few short rows would otherwise be joined into one task.
        spread = folders.repartition(max(tasks, -(-found // TASK_FOLDERS)), "corpus", "path")
        listed = spread.mapInPandas(_lister(options.record_symlinks), LISTING)
        marked = listed.selectExpr("*", f"{_keep_entry(options)} AS kept")
        marked.where(f"kept OR {_is_rule_file(options)}").write.parquet(target)
        folders = spark.read.parquet(target).where("kind = 'directory' AND kept")
        found = folders.count()
        if not found:
            break
        level += 1
    levels = [f"{path}/level={n}" for n in range(level + 1)]
    return spark.read.schema(LISTING + ", kept BOOLEAN").parquet(*levels)


def _reader(inline_limit: int, sample_bytes: int):
    names = _READ_COLUMNS

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                raw, error = None, row.open_error
                if row.kind == "file":
                    full = os.path.join(row.root, row.path)
                    try:
                        with open(full, "rb") as source:
                            raw = source.read(sample_bytes)
                            if row.size <= inline_limit:
                                raw += source.read()
                    except OSError as problem:
                        error = problem.strerror
                rows.append(
                    (
                        row.corpus, row.path, row.kind, row.size, row.modified_us,
                        row.permissions, row.target, raw, error,
                    )
                )
                held += len(raw or b"")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return read


def read_contents(entries: DataFrame, options: PackOptions) -> DataFrame:
    """Files table of listed entries: whole contents up to the inline limit, else the head.

    Tasks are counted by the bytes to read and filled by a hash of the file, so neither a
    large corpus nor a large folder ends up in one of them.
    """
    readable = f"sum(least(size, {options.inline_limit}))"
    total = entries.where("kind = 'file'").agg(F.expr(readable)).first()[0] or 0
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    spread = entries.where("kind <> 'directory'").repartition(tasks, "corpus", "path")
    read = spread.mapInPandas(_reader(options.inline_limit, options.sample_bytes), READ)
    modified = F.timestamp_micros("modified_us").alias("modified")
    return read.withColumn("modified", modified).select(*FILES_SCHEMA.names)


def scan_trees(roots: DataFrame, options: PackOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, directories, ignore files) below the roots."""
    listed = list_trees(roots, options)
    files = read_contents(listed.where("kept"), options)
    folders = listed.where("kept AND kind = 'directory'").selectExpr(
        "corpus", "path", "size", "timestamp_micros(modified_us) AS modified", "permissions"
    )
    rule_files = read_contents(listed.where(_is_rule_file(options, always=True)), options)
    return files, folders, rule_files


def scan_tree(
    spark: SparkSession, root: str, options: PackOptions, corpus: str | None = None
) -> DataFrame:
    """Files table of one tree, named after its last folder unless given."""
    real = os.path.realpath(root)
    name = corpus or os.path.basename(real)
    roots = spark.createDataFrame([(name, real)], "corpus STRING, root STRING")
    return scan_trees(roots, options)[0]
