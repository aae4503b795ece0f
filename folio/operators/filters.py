"""Which entries stay. Every predicate reads the path only, so contents are not touched."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import paths, quoted
from folio.functions.globs import glob_body, names_regex
from folio.options import DEFAULT_IGNORE, PackOptions


def matches_globs(name: str, globs) -> str:
    """Any of the globs matches the whole name; no globs match nothing."""
    plain, negated = names_regex(globs)
    found = [] if plain is None else [f"{name} RLIKE {quoted(plain)}"]
    found += [f"NOT {name} RLIKE {quoted(expression)}" for expression in negated]
    return f"({' OR '.join(found)})" if found else "false"


def _default_names(with_globs: bool) -> list[str]:
    """Expressions for the listed names; a listed glob is a plain name unless asked for."""
    entries = sorted(set(DEFAULT_IGNORE))
    if not with_globs:
        return [re.escape(entry) for entry in entries if "/" not in entry]
    return [glob_body(entry.rstrip("/")) for entry in entries]


def is_default_ignored(name: str, with_globs: bool = False) -> str:
    """Listed by name; with `with_globs` the listed globs count as globs."""
    listed = "|".join(_default_names(with_globs))
    return f"{name} RLIKE {quoted(rf'(?s)\A(?:{listed})\z')}"


def _name_expressions(options: PackOptions) -> list[str]:
    """Ignored names: the list, the plain globs, and hidden entries in ignore-file mode."""
    names = _default_names(options.default_globs)
    names += [glob_body(glob) for glob in options.ignore_patterns if not glob.startswith("!")]
    if options.respect_gitignore:
        names.append(r"\.[^/]*")
    return names


def ignored_component(options: PackOptions) -> str:
    """One expression that finds an ignored name anywhere in a path.

    It takes the place of a lambda over the parts of the path, so the filter reads the path
    once and stays in generated code.
    """
    return rf"(?s)(?:\A|/)(?:{'|'.join(_name_expressions(options))})(?:/|\z)"


def _output(options: PackOptions) -> str:
    parts = [re.escape(p) for p in options.output_name.split("/") if p not in ("", ".")]
    return rf"(?:\A|/){'/'.join(parts)}\z"


def is_output_file(path: str, options: PackOptions) -> str:
    """The last components of the path are those of the pack's own output."""
    return f"{path} RLIKE {quoted(_output(options))}"


def _negated(options: PackOptions) -> list[str]:
    return [
        rf"(?s)\A{glob_body(glob[1:])}\z" for glob in options.ignore_patterns if glob.startswith("!")
    ]


def is_ignored_name(name: str, options: PackOptions) -> str:
    """The entry's own name is ignored, or it has none."""
    listed = rf"(?s)\A(?:{'|'.join(_name_expressions(options))})?\z"
    found = [f"{name} IS NULL", f"{name} RLIKE {quoted(listed)}"]
    found += [f"NOT {name} RLIKE {quoted(expression)}" for expression in _negated(options)]
    return f"({' OR '.join(found)})"


def _included(path: str, options: PackOptions) -> str:
    """The name, or the name and all folders, match the include globs."""
    globs = options.include_patterns
    if any(glob.startswith("!") for glob in globs):
        parts = f"split({path}, '/')" if options.include_dirs else f"array({paths.name_of(path)})"
        return f"forall({parts}, c -> {matches_globs('c', globs)})"
    name = "(?:" + "|".join(glob_body(glob) for glob in globs) + ")"
    folders = rf"(?:{name}/)*" if options.include_dirs else "(?:.*/)?"
    return f"{path} RLIKE {quoted(rf'(?s)\A{folders}{name}\z')}"


def keep_path(path: str, options: PackOptions) -> str:
    """An entry stays when neither its name nor any folder above it is ignored."""
    out = rf"{ignored_component(options)}|{_output(options)}|\A\z|/\z"
    keep = [f"NOT {path} RLIKE {quoted(out)}"]
    keep += [
        f"forall(split({path}, '/'), c -> c RLIKE {quoted(named)})" for named in _negated(options)
    ]
    if options.include_patterns:
        keep.append(_included(path, options))
    return f"({' AND '.join(keep)})"


def prune_dirs(files: DataFrame, options: PackOptions) -> DataFrame:
    """Drop everything below an ignored folder, whatever the entry itself is called."""
    return files.where(f"NOT {paths.dir_of('path')} RLIKE {quoted(ignored_component(options))}")


def select_files(files: DataFrame, options: PackOptions) -> DataFrame:
    """All name and folder filters of a run; ignore files are applied separately."""
    return files.where(keep_path("path", options))


def count_files(files: DataFrame, options: PackOptions, by_name_only: bool = False) -> DataFrame:
    """Files per corpus that a run will process; no contents are read.

    `by_name_only` looks at the entry's own name and not at the folders above it.
    """
    keep = keep_path("path", options)
    if by_name_only:
        name = paths.name_of("path")
        keep = f"NOT {is_ignored_name(name, options)} AND NOT {is_output_file('path', options)}"
        if options.include_patterns:
            keep += f" AND {matches_globs(name, options.include_patterns)}"
    kept = files.where(f"kind = 'file' AND {keep}")
    return kept.groupBy("corpus").agg(F.expr("count(1) AS files"))
