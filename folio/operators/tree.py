"""Directories of a files table and the order of a pack."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folio.functions import paths


def ancestors_of(directory: str) -> str:
    """Generator: the root, each folder above, and the directory itself."""
    levels = f"sequence(0, {paths.depth_of(directory)})"
    return f"explode(transform({levels}, n -> substring_index({directory}, '/', n)))"


def directories(files: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Every directory of a corpus as (corpus, dir), the root as ''.

    Parents are made distinct before they are expanded, so a folder with many files is
    expanded once per task. `listed` adds directories known otherwise, such as empty ones.
    """
    parents = files.selectExpr("corpus", f"{paths.dir_of('path')} AS dir")
    if listed is not None:
        parents = parents.unionByName(listed.selectExpr("corpus", "path AS dir"))
    return parents.distinct().selectExpr("corpus", f"{ancestors_of('dir')} AS dir").distinct()


def directory_rows(dirs: DataFrame) -> DataFrame:
    """Directories with name, packed path and depth; the root is named after its corpus."""
    return dirs.selectExpr(
        "corpus",
        "dir",
        f"if(dir = '', coalesce(corpus, ''), {paths.name_of('dir')}) AS name",
        f"{paths.packed_path('dir')} AS packed_path",
        f"{paths.depth_of('dir')} AS depth",
    )


def pack_order(files: DataFrame) -> DataFrame:
    """Sort key per file: subdirectories before files, siblings by name."""
    return files.selectExpr("corpus", "path", f"{paths.file_key('path')} AS sort_key")
