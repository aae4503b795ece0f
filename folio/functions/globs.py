"""Name globs and ignore-file lines as regular expressions.

These run on patterns, never on data rows: the expressions they return are evaluated by
Spark, and stay inside the subset that Java and RE2 read alike.
"""

from __future__ import annotations

import re
from typing import NamedTuple


def _char_class(glob: str, start: int) -> tuple[str, int] | None:
    """Translate the class that opens at `start`; None when it never closes."""
    pos = start + 1
    negated = pos < len(glob) and glob[pos] in "!^"
    if negated:
        pos += 1
    members, first = "", True
    while pos < len(glob):
        char = glob[pos]
        if char == "]" and not first:
            return ("[^/" if negated else "[") + members + "]", pos + 1
        if char == "\\" and pos + 1 < len(glob):
            pos += 1
            members += re.escape(glob[pos])
        elif char == "-":
            at_edge = first or pos + 1 >= len(glob) or glob[pos + 1] == "]"
            members += r"\-" if at_edge else "-"
        else:
            members += re.escape(char)
        first = False
        pos += 1
    return None


def glob_body(glob: str) -> str:
    """Unanchored expression for a glob over a '/'-separated path."""
    out, pos, braces = "", 0, 0
    while pos < len(glob):
        char = glob[pos]
        if glob.startswith("**", pos):
            end = pos
            while end < len(glob) and glob[end] == "*":
                end += 1
            at_start = pos == 0 or glob[pos - 1] == "/"
            if at_start and end - pos == 2 and glob.startswith("/", end):
                out += "(?:.*/)?"
                pos = end + 1
            elif at_start and end - pos == 2 and end == len(glob):
                out += ".*" if pos == 0 else ".+"
                pos = end
            else:
                out += "[^/]*"
                pos = end
            continue
        if char == "*":
            out += "[^/]*"
        elif char == "?":
            out += "[^/]"
        elif char == "[" and (translated := _char_class(glob, pos)):
            out += translated[0]
            pos = translated[1]
            continue
        elif char == "{" and "}" in glob[pos:]:
            out += "(?:"
            braces += 1
        elif char == "}" and braces:
            out += ")"
            braces -= 1
        elif char == "," and braces:
            out += "|"
        elif char == "\\" and pos + 1 < len(glob):
            pos += 1
            out += re.escape(glob[pos])
        else:
            out += re.escape(char)
        pos += 1
    return out


def names_regex(globs) -> tuple[str | None, list[str]]:
    """(expression for any plain glob, expressions whose absence of a match counts)."""
    plain = [glob_body(g) for g in globs if not g.startswith("!")]
    negated = [rf"(?s)\A(?:{glob_body(g[1:])})\z" for g in globs if g.startswith("!")]
    return (rf"(?s)\A(?:{'|'.join(plain)})\z" if plain else None), negated


class IgnoreRule(NamedTuple):
    line_no: int
    regex: str
    negated: bool
    dir_only: bool


def parse_ignore_line(line: str) -> tuple[str, bool, bool] | None:
    """(expression on the path below the rule file's folder, negated, directories only)."""
    line = line.rstrip("\r")
    if line.startswith("#"):
        return None
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    dir_only = line.endswith("/")
    if dir_only:
        line = line[:-1]
    if not line:
        return None
    anchored = "/" in line
    body = glob_body(line[1:] if line.startswith("/") else line)
    return ("" if anchored else "(?:.*/)?") + body, negated, dir_only


def _compiles(regex: str) -> bool:
    try:
        re.compile(regex)
    except re.error:
        return False
    return True


def bad_ignore_lines(text: str) -> list[int]:
    """Numbers of the lines that compile_ignore_text skips because they are no valid pattern."""
    lines = enumerate(text.split("\n"), start=1)
    return [n for n, line in lines if (parsed := parse_ignore_line(line)) and not _compiles(parsed[0])]


def compile_ignore_text(text: str) -> list[IgnoreRule]:
    """Rules of one ignore file.

    Neighbouring lines of the same kind cannot override each other, so each such run
    becomes one alternation; only the order between runs matters. A line that is no valid
    pattern, such as one with an open brace or a reversed range, is skipped; see bad_ignore_lines.
    """
    runs: list[tuple[int, bool, bool, list[str]]] = []
    for number, line in enumerate(text.split("\n"), start=1):
        parsed = parse_ignore_line(line)
        if parsed is None:
            continue
        regex, negated, dir_only = parsed
        if not _compiles(regex):
            continue
        if runs and runs[-1][1:3] == (negated, dir_only):
            runs[-1][3].append(regex)
        else:
            runs.append((number, negated, dir_only, [regex]))
    return [
        IgnoreRule(number, rf"(?s)\A(?:{'|'.join(bodies)})\z", negated, dir_only)
        for number, negated, dir_only, bodies in runs
    ]
