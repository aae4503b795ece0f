"""Expressions over '/'-separated paths."""

from __future__ import annotations

from folio.functions import case, quoted
from folio.options import DISPLAY_PATH_BYTES

# Separator of the sort key. It sorts below every printable character, so a directory is
# followed by its own entries before a sibling whose name merely starts the same way.
KEY_SEPARATOR = "\x01"


def name_of(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def dir_of(path: str) -> str:
    """Parent directory, '' for an entry at the root."""
    return f"regexp_extract({path}, {quoted(r'(?s)^(.*)/[^/]*\z')}, 1)"


def ext_of(path: str) -> str:
    """Extension without the dot; '' for none, for a leading dot only, and for a final dot."""
    return f"regexp_extract({path}, {quoted(r'(?s)^(?:.*/)?[^/]+\.([^./]*)\z')}, 1)"


def depth_of(path: str) -> str:
    """Number of components, 0 for the root itself."""
    slashes = f"octet_length({path}) - octet_length(replace({path}, '/', ''))"
    return f"if({path} = '', 0, {slashes} + 1)"


def relative_to(path: str, root: str) -> str:
    """`path` below `root`; '' for the root itself, unchanged outside it."""
    return case(
        (f"{path} = {root}", "''"),
        (f"startswith({path}, concat({root}, '/'))", f"substring({path}, length({root}) + 2)"),
        otherwise=path,
    )


def report_path(path: str, root: str, owner: str, name: str) -> str:
    """`owner/name/rest` for paths of a repository, the path itself outside it."""
    inside = f"({path} = {root} OR startswith({path}, concat({root}, '/')))"
    rest = f"nullif({relative_to(path, root)}, '')"
    return f"if({inside}, concat_ws('/', {owner}, {name}, {rest}), {path})"


def display_path(path: str, limit: int = DISPLAY_PATH_BYTES) -> str:
    """Path shortened to `limit` bytes: '...' and as many whole trailing segments as fit.

    The part that fits is the longest tail of at most `limit - 3` bytes that starts at a
    slash, so cutting the byte tail and dropping up to its first slash gives it directly.
    """
    room = limit - 3
    tail = f"cast(substring(cast({path} AS BINARY), -{room}, {room}) AS STRING)"
    segments = f"regexp_extract({tail}, {quoted(r'(?s)^[^/]*(/.*)\z')}, 1)"
    return case(
        (f"octet_length({path}) <= {limit}", path),
        (f"{depth_of(path)} <= 2", f"concat('...', right({path}, {room}))"),
        otherwise=f"concat('...', {segments})",
    )


def sanitize_path(path: str) -> str:
    """Path as a plain file name: everything but letters, digits and `_-.` becomes `_`."""
    return f"regexp_replace({path}, {quoted(r'[^\p{L}\p{N}_.-]')}, '_')"


def output_path(output: str, storage_path: str) -> str:
    """Where the pack of a repository goes: a bare name lands in the repository folder."""
    return f"if(contains({output}, '/'), {output}, concat_ws('/', {storage_path}, {output}))"


def packed_path(path: str, corpus: str = "corpus") -> str:
    """Path as it is printed: the corpus first."""
    return f"concat_ws('/', {corpus}, nullif({path}, ''))"


def _sortable(path: str) -> str:
    """Escape the key separator; the order of names is kept."""
    escaped = f"replace({path}, '\x02', '\x02\x03')"
    return f"replace({escaped}, '{KEY_SEPARATOR}', '\x02\x02')"


def dir_key(directory: str) -> str:
    """Sort key at which a directory opens; its entries all start with it."""
    parts = f"replace({_sortable(directory)}, '/', '{KEY_SEPARATOR}0')"
    return f"if({directory} = '', '', concat('0', {parts}, '{KEY_SEPARATOR}'))"


def dir_close_key(directory: str) -> str:
    return f"concat({dir_key(directory)}, '2')"


def file_key(path: str) -> str:
    """Sort key of a leaf: after the subdirectories of its directory, by name."""
    return f"concat({dir_key(dir_of(path))}, '1', {_sortable(name_of(path))})"
