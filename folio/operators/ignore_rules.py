"""Ignore files: which entries of a tree they exclude.

    rules: corpus STRING, base_dir STRING, depth INT, rank INT, content STRING     one row for each ignore file

Rules of a higher rank come before all others: those of a custom file, then of `.ignore`, then of `.gitignore`; of one rank
the deepest file comes first, and in a file the last line.

The ignore files above a folder are its chain. Texts are interned by hash and chains by the hashes of their texts, so path
tables carry one short id, and the text of a chain goes only to the tasks that match its paths, once to each. A task
compiles it into one matcher, which looks plain names, plain paths and suffixes up and tries expressions for the
rest alone, so the cost of a path does not grow with the lines of the first three kinds. Verdicts on folders are kept, so
each is reached once. The paths of a chain that governs very many are dealt to several tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import paths, quoted
from folio.functions.globs import parse_ignore_line
from folio.operators.skew import HOT_ROWS, hot_keys, lookup
from folio.operators.tree import ancestors_of
from folio.plans.scratch import staged

RULES_SCHEMA = "corpus STRING, base_dir STRING, depth INT, rank INT, content STRING"
GIT_RANK, PLAIN_RANK, CUSTOM_RANK = 0, 1, 2
#: Verdicts on folders that a matcher keeps.
KEPT_FOLDERS = 100_000
ANYWHERE = "(?:.*/)?"
ANY_NAME = "[^/]*"


def rules_from(ignore_files: DataFrame, custom: bool = False, rank: int = GIT_RANK) -> DataFrame:
    """Rules of ignore files given as (corpus, path, content)."""
    based = ignore_files.selectExpr("corpus", f"{paths.dir_of('path')} AS base_dir", "coalesce(content, '') AS content")
    number = CUSTOM_RANK if custom else rank
    return based.selectExpr("corpus", "base_dir", f"{paths.depth_of('base_dir')} AS depth", f"{number} AS rank", "content")


def ignore_files_in(contents: DataFrame, name: str = ".gitignore") -> DataFrame:
    """The ignore files of a table; they count although they are not packed themselves."""
    named = contents.where(f"{paths.name_of('path')} = {quoted(name)}")
    return named.select("corpus", "path", "content")


# --- matching ---------------------------------------------------------------------------


class Verdict(NamedTuple):
    line_no: int
    negated: bool


def _literal(expression: str) -> str | None:
    """The text that an expression stands for, if it stands for one text."""
    text = re.sub(r"\\(.)", r"\1", expression, flags=re.DOTALL)
    return text if re.escape(text) == expression else None


class Matcher:
    """The lines of one ignore file, by how they are found: name, path below the file, suffix of the name, expression."""

    def __init__(self, text: str):
        self.names: dict[str, list[tuple[Verdict, bool]]] = {}
        self.paths: dict[str, list[tuple[Verdict, bool]]] = {}
        self.suffixes: dict[str, list[tuple[Verdict, bool]]] = {}
        others: list[tuple[str, Verdict, bool]] = []
        for number, line in enumerate(text.split("\n"), start=1):
            parsed = parse_ignore_line(line)
            if parsed is None:
                continue
            expression, negated, dir_only = parsed
            verdict = Verdict(number, negated)
            anywhere = expression.startswith(ANYWHERE)
            rest = expression.removeprefix(ANYWHERE)
            if (plain := _literal(rest)) is not None:
                (self.names if anywhere else self.paths).setdefault(plain, []).append((verdict, dir_only))
            elif anywhere and rest.startswith(ANY_NAME + r"\.") and (ending := _literal(rest.removeprefix(ANY_NAME))):
                self.suffixes.setdefault(ending, []).append((verdict, dir_only))
            elif _compiles(expression):
                others.append((expression, verdict, dir_only))
        others.reverse()
        self.others = {is_dir: _alternation([(e, v) for e, v, d in others if is_dir or not d]) for is_dir in (False, True)}

    def verdict(self, path: str, is_dir: bool) -> Verdict | None:
        """Of the last line that matches a path below this file."""
        name = path.rsplit("/", 1)[-1]
        found = [*self.names.get(name, ()), *self.paths.get(path, ())]
        at = name.find(".") if self.suffixes else -1
        while at >= 0:
            found += self.suffixes.get(name[at:], ())
            at = name.find(".", at + 1)
        best = max((v for v, dir_only in found if is_dir or not dir_only), default=None)
        expression, verdicts = self.others[is_dir]
        if expression is not None and (match := expression.match(path)):
            other = verdicts[match.lastindex - 1]
            best = other if best is None else max(best, other)
        return best


def _compiles(expression: str) -> bool:
    try:
        re.compile(expression)
    except re.error:
        return False
    return True


def _alternation(lines: list[tuple[str, Verdict]]) -> tuple[re.Pattern | None, list[Verdict]]:
    """One expression that tries lines in turn and tells by its group which one matched the whole path."""
    if not lines:
        return None, []
    return re.compile("|".join(rf"({e}\Z)" for e, _ in lines), re.DOTALL), [v for _, v in lines]


class Chain:
    """The ignore files above a folder, strongest first, as (depth, matcher)."""

    def __init__(self, files: list[tuple[int, Matcher]]):
        self.files, self.dead = files, {}

    def ignores(self, parts: list[str], is_dir: bool) -> bool:
        for depth, matcher in self.files:
            if depth < len(parts) and (verdict := matcher.verdict("/".join(parts[depth:]), is_dir)):
                return not verdict.negated
        return False

    def excludes(self, path: str) -> bool:
        """The entry or a folder above it is ignored."""
        parts = path.split("/")
        return self._is_dead(parts[:-1]) or self.ignores(parts, is_dir=False)

    def _is_dead(self, folder: list[str]) -> bool:
        """A folder is dead when it or one above it is ignored; from the deepest known one down."""
        known, verdict = len(folder), None
        while known and (verdict := self.dead.get("/".join(folder[:known]))) is None:
            known -= 1
        for depth in range(known + 1, len(folder) + 1):
            verdict = verdict or self.ignores(folder[:depth], is_dir=True)
            if len(self.dead) >= KEPT_FOLDERS:
                self.dead.clear()
            self.dead["/".join(folder[:depth])] = verdict
        return bool(verdict)


def _excluded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Excluded paths. Rows come by chain, its texts ahead of its paths."""
    matchers: dict[str, Matcher] = {}
    chain, key = None, None
    for batch in batches:
        keep = []
        columns = (batch.column(c).to_pylist() for c in ("chain", "salt", "path", "files"))
        for row, (name, salt, path, files) in enumerate(zip(*columns)):
            if files is not None:
                if len(matchers) > 1000:
                    matchers.clear()
                for f in files:
                    if f["content"] not in matchers:
                        matchers[f["content"]] = Matcher(f["content"])
                chain, key = Chain([(f["depth"], matchers[f["content"]]) for f in files]), (name, salt)
            elif key == (name, salt) and chain.excludes(path):
                keep.append(row)
        yield batch.select(["corpus", "path"]).take(pa.array(keep, pa.int64()))


# --- tables -----------------------------------------------------------------------------


def governed_dirs(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Folders of files with ignore files above them: (corpus, dir, n, chain); `chain` names their texts and depths."""
    dirs = files.groupBy("corpus", "dir").agg(F.expr("count(1) AS n"))
    above = dirs.selectExpr("corpus", "dir", "n", f"{ancestors_of('dir')} AS base_dir")
    met = above.join(rules.select("corpus", "base_dir", "rank", "depth", "text_id"), ["corpus", "base_dir"])
    links = "sort_array(collect_list(struct(rank, depth, text_id)), false)"
    named = f"array_join(transform({links}, f -> concat_ws(':', f.rank, f.depth, f.text_id)), ' ') AS chain"
    return met.groupBy("corpus", "dir", "n").agg(F.expr(named))


def ignored_files(files: DataFrame, rules: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Files (corpus, path) that the rules exclude."""
    keys = staged(files.selectExpr("corpus", "path", f"{paths.dir_of('path')} AS dir"), "paths")
    known = staged(rules.withColumn("text_id", F.sha2("content", 256)), "rules")
    governed = staged(governed_dirs(keys, known).withColumn("chain_id", F.sha2("chain", 256)), "governed")
    # How many tasks share the paths of a chain; the names of its texts, for each of these tasks.
    sums = governed.groupBy("chain_id").agg(F.sum("n").alias("n"), F.min("chain").alias("chain"))
    chains = sums.selectExpr("chain_id AS chain", f"n div {hot_rows} + 1 AS salts", "chain AS links")
    link = "posexplode(transform(split(links, ' '), x -> split(x, ':'))) AS (place, link)"
    links = chains.selectExpr("chain", "salts", link).selectExpr("chain", "salts", "place", "cast(link[1] AS INT) AS depth", "link[2] AS text_id")
    texts = known.groupBy("text_id").agg(F.min("content").alias("content"))
    told = links.join(texts, "text_id").groupBy("chain", "salts").agg(
        F.expr("transform(sort_array(collect_list(struct(place, depth, content))), f -> struct(f.depth, f.content)) AS files")
    )
    definitions = told.selectExpr("chain", "explode(sequence(0L, salts - 1)) AS salt", "cast(NULL AS STRING) AS corpus", "cast(NULL AS STRING) AS path", "files")
    of_dir = governed.select("corpus", "dir", "chain_id").join(chains.selectExpr("chain AS chain_id", "salts"), "chain_id")
    # The paths of a folder with very many files are spread, too.
    hot = hot_keys(keys, ["corpus", "dir"], hot_rows)
    met = lookup(keys, of_dir, ["corpus", "dir"], "path", hot).where("chain_id IS NOT NULL")
    asked = met.selectExpr("chain_id AS chain", "pmod(xxhash64(corpus, path), salts) AS salt", "corpus", "path")
    rows = definitions.unionByName(asked.withColumn("files", F.lit(None).cast(definitions.schema["files"].dataType)))
    in_order = rows.repartition("chain", "salt").sortWithinPartitions("chain", "salt", F.col("files").isNull(), "corpus", "path")
    return in_order.mapInArrow(_excluded, "corpus STRING, path STRING")


def drop_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files without the excluded ones. The key is one file, so no key is hot."""
    return files.join(ignored, ["corpus", "path"], "left_anti")
