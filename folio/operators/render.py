"""Packs as rows: (corpus, section, sort_key, fragment).

Sorting the rows and joining the fragments by newlines gives the pack. Directories open and
close with rows of their own, whose keys enclose the keys of what they contain, so nothing
is nested by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from folio.functions import case, lines, paths, quoted
from folio.functions import text as txt
from folio.operators.tree import directory_rows
from folio.options import PackOptions

HEADER, OVERVIEW, BODY, TRAILER = 0, 1, 2, 3
REPO_COLUMNS = ("repo_url", "repo_host", "repo_owner", "repo_name")

# Lines of the text pack.
RULE = "=" * 48
SYSTEM_TITLE = "=================== SYSTEM INFO ==================="
REPOSITORY_TITLE = "=================== REPOSITORY ==================="


def _event(section: int, key: str, fragment: str) -> str:
    return f"struct({section} AS section, {key} AS sort_key, {fragment} AS fragment)"


def _rows(source: DataFrame, *events: str) -> DataFrame:
    """Pack rows that one pass over `source` emits."""
    return source.selectExpr("corpus", f"inline(array({', '.join(events)}))")


def _leaf_rows(source: DataFrame, section: int, fragment: str) -> DataFrame:
    key = paths.file_key("path")
    return source.selectExpr(
        "corpus", f"{section} AS section", f"{key} AS sort_key", f"{fragment} AS fragment"
    )


# --- metadata ---------------------------------------------------------------------------


def metadata_txt() -> str:
    return lines(
        "concat('  Size: ', size)",
        f"concat('  Modified: ', {txt.rfc3339('modified')})",
        "concat('  Permissions: ', permissions)",
    )


def metadata_xml(pad: str) -> str:
    def line(tag: str, value: str) -> str:
        return f"concat({pad}, '  <{tag}>', {value}, '</{tag}>')"

    return lines(
        f"concat({pad}, '<metadata>')",
        line("size", "size"),
        line("modified", txt.rfc3339("modified")),
        line("permissions", txt.xml_escape("permissions")),
        f"concat({pad}, '</metadata>')",
    )


# --- text -------------------------------------------------------------------------------


def txt_fragment(options: PackOptions) -> str:
    """Text of one leaf; NULL where it prints nothing."""
    described = metadata_txt() if options.include_metadata else "NULL"
    shown = paths.packed_path("path")
    fenced = lines(
        f"'\\n{RULE}'",
        shown,
        f"'{RULE}\\n'",
        described,
        f"concat('```', {paths.ext_of('path')})",
        "content",
        "'```'",
    )
    return case(
        ("kind = 'text'", fenced),
        ("kind = 'symlink'", lines(f"concat('[S] ', {shown}, ' -> ', target)", described)),
        ("kind = 'binary'", described),
    )


def txt_fragments(contents: DataFrame, options: PackOptions) -> DataFrame:
    """Text rows of the leaves that print something, made by a generator and not a filter,
    which would be moved ahead of the classification and repeat it."""
    event = _event(BODY, paths.file_key("path"), txt_fragment(options))
    prints = "true" if options.include_metadata else "kind IN ('text', 'symlink')"
    return contents.selectExpr("corpus", f"inline(if({prints}, array({event}), array()))")


# --- XML --------------------------------------------------------------------------------


def _tag(pad: str, tag: str, close: str = ">", **attributes: str) -> str:
    parts = [pad, f"'<{tag}'"]
    for name, value in attributes.items():
        parts += [f"' {name}=\"'", txt.xml_escape(value), "'\"'"]
    return f"concat({', '.join(parts)}, '{close}')"


def xml_leaf(options: PackOptions) -> str:
    """Element of one leaf. Folders indent twice: once for themselves, once for contents."""
    pad = f"repeat(' ', {paths.depth_of('path')} * 4 + 2)"
    inner = f"concat({pad}, '  ')"
    described = metadata_xml(inner) if options.include_metadata else "NULL"
    content = f"concat({inner}, '<content>', {txt.cdata('content')}, '</content>')"
    target = f"concat({inner}, '<target>', {txt.xml_escape('target')}, '</target>')"
    # One opening and one closing tag for all kinds, so that each is computed once.
    tag = "CASE kind WHEN 'text' THEN 'file' ELSE kind END"
    names = (
        f"' name=\"', {txt.xml_escape(paths.name_of('path'))}, '\" path=\"', "
        f"{txt.xml_escape(paths.packed_path('path'))}, '\">'"
    )
    return lines(
        f"concat({pad}, '<', {tag}, {names})",
        described,
        case(("kind = 'text'", content), ("kind = 'symlink'", target)),
        f"concat({pad}, '</', {tag}, '>')",
    )


def xml_leaves(contents: DataFrame, options: PackOptions) -> DataFrame:
    return _leaf_rows(contents, BODY, xml_leaf(options))


def _body_events(with_metadata: bool) -> list[str]:
    """Opening and closing of a directory in the body."""
    pad = "repeat(' ', depth * 4 + 2)"
    inner = f"concat({pad}, '  ')"
    described = f"if(size IS NULL, NULL, {metadata_xml(inner)})" if with_metadata else "NULL"
    opening = lines(
        _tag(pad, "directory", name="name", path="packed_path"),
        described,
        f"concat({inner}, '<contents>')",
    )
    closing = lines(f"concat({inner}, '</contents>')", f"concat({pad}, '</directory>')")
    return [
        _event(BODY, paths.dir_key("dir"), opening),
        _event(BODY, paths.dir_close_key("dir"), closing),
    ]


def _overview_events() -> list[str]:
    pad = "repeat(' ', depth * 2 + 4)"
    return [
        _event(OVERVIEW, paths.dir_key("dir"), _tag(pad, "directory", name="name")),
        _event(OVERVIEW, paths.dir_close_key("dir"), f"concat({pad}, '</directory>')"),
    ]


def _described(dirs: DataFrame, dir_metadata: DataFrame | None) -> DataFrame:
    """Directories with `dir_metadata` (corpus, dir, size, modified, permissions) if there is."""
    rows = directory_rows(dirs)
    return rows if dir_metadata is None else rows.join(dir_metadata, ["corpus", "dir"], "left")


def xml_events(
    contents: DataFrame,
    dirs: DataFrame,
    options: PackOptions,
    dir_metadata: DataFrame | None = None,
) -> DataFrame:
    """Body of the XML pack. Directories derived from file paths have no metadata."""
    with_metadata = options.include_metadata and dir_metadata is not None
    folders = _rows(_described(dirs, dir_metadata), *_body_events(with_metadata))
    return xml_leaves(contents, options).unionByName(folders)


def _overview_leaves(entries: DataFrame) -> DataFrame:
    pad = f"repeat(' ', {paths.depth_of('path')} * 2 + 4)"
    tag = "if(kind = 'symlink', 'symlink', 'file')"
    name = txt.xml_escape(paths.name_of("path"))
    return _leaf_rows(entries, OVERVIEW, f"concat({pad}, '<', {tag}, ' name=\"', {name}, '\"/>')")


def xml_overview(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """Names only. Reads corpus, path and whether an entry is a symlink, never contents."""
    folders = _rows(directory_rows(dirs), *_overview_events())
    return _overview_leaves(entries).unionByName(folders)


# --- header and trailer -----------------------------------------------------------------


def with_repos(corpora: DataFrame, repos: DataFrame | None) -> DataFrame:
    """Rows of corpora with their repository, where `repos` (corpus, repo_*) has one."""
    if repos is None:
        return corpora.selectExpr("*", *[f"cast(NULL AS STRING) AS {c}" for c in REPO_COLUMNS])
    return corpora.join(repos.select("corpus", *REPO_COLUMNS), "corpus", "left")


def _txt_header(options: PackOptions) -> str:
    facts = f"Hostname: {options.hostname}\nOS: {options.os}\nKernel: {options.kernel}\n"
    system = quoted(SYSTEM_TITLE + "\n" + facts) if options.include_metadata else "NULL"
    repository = lines(
        f"'{REPOSITORY_TITLE}'",
        "concat('URL: ', repo_url)",
        "concat('Host: ', repo_host)",
        "concat('Owner: ', repo_owner)",
        "concat('Repository: ', repo_name, '\\n')",
    )
    return lines(
        system,
        f"if(repo_url IS NULL, NULL, {repository})",
        "concat('<codebase name=\"', coalesce(corpus, ''), '\">')",
    )


def _xml_header(options: PackOptions) -> str:
    def element(pad: int, tag: str, value: str) -> str:
        return f"concat('{' ' * pad}<{tag}>', {txt.xml_escape(value)}, '</{tag}>')"

    repository = lines(
        "'    <git_repository>'",
        element(6, "url", "repo_url"),
        element(6, "host", "repo_host"),
        element(6, "owner", "repo_owner"),
        element(6, "name", "repo_name"),
        "'    </git_repository>'",
    )
    return lines(
        "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>'",
        _tag("''", "directory_scan", timestamp=quoted(options.timestamp)),
        "'  <system_info>'",
        element(4, "hostname", quoted(options.hostname)),
        element(4, "os", quoted(options.os)),
        element(4, "kernel", quoted(options.kernel)),
        f"if(repo_url IS NULL, NULL, {repository})",
        "'  </system_info>\\n  <overview>'",
    )


def headers(corpora: DataFrame, options: PackOptions) -> DataFrame:
    """Header rows of corpora (corpus, repo_*) in the chosen format."""
    header = _txt_header(options) if options.format == "txt" else _xml_header(options)
    return _rows(corpora, _event(HEADER, "''", header))


# --- whole packs ------------------------------------------------------------------------


def leaf(options: PackOptions) -> str:
    """Fragment of a leaf in the chosen format."""
    return txt_fragment(options) if options.format == "txt" else xml_leaf(options)


def txt_frame(
    corpora: DataFrame, options: PackOptions, repos: DataFrame | None = None
) -> DataFrame:
    """Everything of a text pack but its files, from one row per corpus."""
    return _rows(
        with_repos(corpora, repos),
        _event(HEADER, "''", _txt_header(options)),
        _event(TRAILER, "''", "'</codebase>'"),
    )


def xml_frame(
    entries: DataFrame,
    dirs: DataFrame,
    options: PackOptions,
    repos: DataFrame | None = None,
    dir_metadata: DataFrame | None = None,
) -> DataFrame:
    """Everything of an XML pack but its files; reads paths and kinds only.

    Every corpus has one root directory, which stands for the document as a whole; only
    these rows meet the repositories, so the join has one row per corpus.
    """
    with_metadata = options.include_metadata and dir_metadata is not None
    folders = _rows(
        _described(dirs, dir_metadata), *_overview_events(), *_body_events(with_metadata)
    )
    documents = _rows(
        with_repos(dirs.where("dir = ''").select("corpus"), repos),
        _event(HEADER, "''", _xml_header(options)),
        _event(OVERVIEW, "'3'", "'  </overview>'"),
        _event(TRAILER, "''", "'</directory_scan>'"),
    )
    return _overview_leaves(entries).unionByName(folders).unionByName(documents)
