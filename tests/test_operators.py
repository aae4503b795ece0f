"""Operators on small tables, against brute force and with one key holding most rows."""

import random
import re
from fnmatch import fnmatchcase as fnmatch

import pandas as pd
import pytest

from folio.functions.globs import bad_ignore_lines, compile_ignore_text
from folio.operators import content, filters, ignore_rules, largest, repos, skew, tokens, totals, tree
from folio.operators.console import box, cells, console_report, duration_text
from folio.options import DEFAULT_IGNORE, PackOptions

SHOW = PackOptions(respect_gitignore=False)


def paths_of(df):
    return {r.path for r in df.select("path").collect()}


HERBS = (
    "sage", "beds/thyme.herb", "beds/north/mint.herb", ".hg/dirstate", "seeds.zip", "venv/lib.herb", "lanes/vendor/a/b.c",
    "plots/plan.sow", ".shed/key", "notes/.env.sample", "style.min.css", "Pods/pea", "dist/plan.ctx", "plan.ctx",
)


@pytest.fixture
def herbs(files_table):
    return files_table({("p", path): b"text\n" for path in HERBS})


def test_default_names_are_literal(herbs):
    kept = paths_of(filters.select_files(herbs, SHOW))
    assert set(HERBS) - kept == {".hg/dirstate", "venv/lib.herb", "lanes/vendor/a/b.c", "dist/plan.ctx"}
    globbed = paths_of(filters.select_files(herbs, PackOptions(respect_gitignore=False, default_globs=True)))
    assert kept - globbed == {"style.min.css", "Pods/pea", "seeds.zip"}
    hidden = paths_of(filters.select_files(herbs, PackOptions()))
    assert kept - hidden == {".shed/key", "notes/.env.sample"}
    assert len(set(DEFAULT_IGNORE)) == 126


def test_ignore_and_include_globs(herbs):
    def kept(**options):
        return paths_of(filters.select_files(herbs, PackOptions(respect_gitignore=False, **options)))

    every = kept()
    named = lambda glob: {p for p in every if fnmatch(p.rsplit("/", 1)[-1], glob)}
    for glob in ("*.herb", "s*", "?a*", "[p-t]*.*", "plan.ctx"):
        assert kept(ignore_patterns=(glob,)) == every - {p for p in every if any(fnmatch(c, glob) for c in p.split("/"))}
        assert kept(include_patterns=(glob,)) == named(glob)
        assert kept(include_patterns=("!" + glob,)) == every - named(glob)
    assert kept(ignore_patterns=("!*.zip",)) == {"seeds.zip"}
    assert kept(include_patterns=("*.sow",), include_dirs=True) == set()
    assert kept(include_patterns=("pl*", "*.sow"), include_dirs=True) == {"plots/plan.sow", "plan.ctx"}
    assert kept(output_file="./plan.ctx") == every - {"plan.ctx"}


def test_counts_of_files(herbs):
    def files(**kwargs):
        return filters.count_files(herbs, SHOW, **kwargs).first()["files"]

    assert files() == len(paths_of(filters.select_files(herbs, SHOW)))
    assert files(by_name_only=True) > files()


# --- ignore files -----------------------------------------------------------------------


def model_ignored(path, rule_files):
    """Walk down the path; every entry is judged by the strongest rule that matches it."""

    def judged(entry, is_dir):
        found = []
        for (base, custom), text in rule_files.items():
            if base and not entry.startswith(base + "/"):
                continue
            rest = entry[len(base) + 1:] if base else entry
            for rule in compile_ignore_text(text):
                pattern = rule.regex.replace(r"\z", r"\Z")
                if (is_dir or not rule.dir_only) and re.search(pattern, rest):
                    depth = base.count("/") + 1 if base else 0
                    found.append(((custom, depth, rule.line_no), rule.negated))
        return bool(found) and not max(found)[1]

    parts = path.split("/")
    return any(judged("/".join(parts[:i]), i < len(parts)) for i in range(1, len(parts) + 1))


def test_ignore_files_against_a_walk(spark, files_table):
    rng = random.Random(6)
    names = ["a", "b", "lib", "x.log", "y.log", "z.md", "docs"]
    lines = ["*.log", "!y.log", "lib/", "/a", "docs/*.md", "!docs", "a/**", "**/b/*", "z.*", "!/lib/a/", "b", "# c", ""]
    entries, texts, expected = {}, [], {}
    for corpus in ("one", "two", "three"):
        rule_files = {("", False): "\n".join(rng.choices(lines, k=4))}
        for base in rng.sample(["a", "a/lib", "docs", "b"], 2):
            rule_files[(base, False)] = "\n".join(rng.choices(lines, k=3))
        rule_files[("", True)] = rng.choice(["docs/\n!x.log", "z.md", ""])
        for (base, custom), text in rule_files.items():
            texts.append((corpus, f"{base}/rules" if base else "rules", text, custom))
        for _ in range(150):
            path = "/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) + f".f{rng.randint(0, 3)}"
            path = path if rng.random() < 0.5 else path.rsplit(".", 1)[0]
            entries[(corpus, path)] = b"x"
            expected[(corpus, path)] = model_ignored(path, rule_files)
    files = files_table(entries)
    rows = spark.createDataFrame(texts, "corpus STRING, path STRING, content STRING, custom BOOLEAN")
    rules = ignore_rules.rules_from(rows.where("NOT custom")).unionByName(
        ignore_rules.rules_from(rows.where("custom"), custom=True)
    )
    for hot_rows in (10, 1_000_000):  # with and without splitting
        ignored = ignore_rules.ignored_files(files, rules, hot_rows)
        assert sorted(map(tuple, ignored.collect())) == sorted(k for k, out in expected.items() if out)
    kept = ignore_rules.drop_ignored(files, ignored)
    assert kept.count() == sum(not out for out in expected.values())


# --- content ----------------------------------------------------------------------------


def test_content_of_every_status(spark, files_table):
    entries = {
        ("p", "ok.txt"): "é\r\nb".encode(),
        ("p", "empty"): b"",
        ("p", "bytes.bin"): bytes([0, 1, 2, 3]),
        ("p", "big.txt"): b"=" * 1_342_178,
        ("p", "late.txt"): b"a" * 9000 + b"\xff",
    }
    files = files_table(entries).unionByName(
        spark.createDataFrame(
            [
                ("p", "link", "symlink", 4, None, "777", "tärget", None, None),
                ("p", "gone.txt", "file", 4, None, "644", None, bytearray(b"head"), "Permission denied"),
                ("p", "locked.txt", "file", 4, None, "000", None, None, "Permission denied"),
                ("p", "pipe", "other", 0, None, "644", None, None, None),
            ],
            files_table(entries).schema,
        )
    )
    options = PackOptions(inline_limit=1_048_576)
    assert f"{len(entries['p', 'big.txt']) / 2**20:.2f}" == "1.28"
    rows = content.with_measures(
        content.with_content(content.classify(content.accepted(files), options), options)
    )
    got = {r.path: (r.kind, r.read_status, r.content, r.lines, r.chars) for r in rows.collect()}
    assert got == {
        "ok.txt": ("text", "ok", "é\r\nb", 2, 4),
        "empty": ("binary", "binary", None, 0, 0),
        "bytes.bin": ("binary", "binary", None, 0, 0),
        "big.txt": ("text", "oversize", "File too large to include content. Size: 1.28 MB", 0, 0),
        "late.txt": (
            "text", "read_error", "Failed to read file content: stream did not contain valid UTF-8", 0, 0
        ),
        "link": ("symlink", "symlink", None, 0, 6),
        "gone.txt": ("text", "open_error", "Failed to open file: Permission denied", 0, 0),
    }
    assert sorted(map(tuple, content.rejects(files).collect())) == [("p", "other", 1), ("p", "unreadable", 1)]
    total = totals.corpus_totals(content.measured(files, options)).first()
    assert (total.files, total.lines, total.chars) == (5, 2, 4)


# --- tokens -----------------------------------------------------------------------------


def test_same_text_is_counted_once(spark, files_table):
    seen = spark.sparkContext.accumulator(0)

    def constant(texts):
        seen.add(len(texts))
        return pd.Series([17] * len(texts))

    tokens.register_counter("constant", constant)
    files = files_table({("p", "a"): b"one tern, two terns", ("p", "b"): b"one tern, two terns", ("q", "c"): b"one tern, two terns"})
    facts = content.measured(files, PackOptions())
    cache = spark.createDataFrame([], tokens.CACHE_SCHEMA)
    misses = tokens.cache_misses(facts, cache, "m")
    fresh = tokens.count_misses(files, misses, "constant", "m", 100, PackOptions())
    stored = fresh.collect()
    assert [(r.model, r.tokens, r.ts) for r in stored] == [("m", 17, 100)]
    assert seen.value >= 1
    known = spark.createDataFrame(stored, tokens.CACHE_SCHEMA)
    assert tokens.cache_misses(facts, known, "m").count() == 0
    assert tokens.cache_misses(facts, known, "other").count() == 1
    cold = {r.corpus: (r.hits, r.misses) for r in tokens.cache_hit_rate(facts, cache, "m").collect()}
    warm = {r.corpus: (r.hits, r.misses) for r in tokens.cache_hit_rate(facts, known, "m").collect()}
    assert cold == {"p": (1, 1), "q": (0, 1)}
    assert warm == {"p": (2, 0), "q": (1, 0)}


def test_failed_counts_are_null_and_not_stored(spark, files_table):
    def picky(texts):
        if any("bad" in text for text in texts):
            raise ValueError("cannot count")
        return texts.str.len()

    tokens.register_counter("picky", picky)
    files = files_table({("p", "a"): b"good", ("p", "b"): b"bad", ("q", "c"): b"bad"})
    facts = content.measured(files, PackOptions())
    empty = spark.createDataFrame([], tokens.CACHE_SCHEMA)
    fresh = tokens.count_misses(files, tokens.cache_misses(facts, empty, "m"), "picky", "m", 1, PackOptions())
    assert [r.tokens for r in fresh.collect()] == [4]
    summary = tokens.corpus_summary(facts, empty, fresh, "m")
    got = {r.corpus: (r.files, r.tokens, r.hits, r.lookups) for r in summary.collect()}
    assert got == {"p": (2, 4, 0, 2), "q": (1, None, 0, 1)}
    labels = {r.corpus: (r.tokens, r.token_source) for r in totals.token_label(summary).collect()}
    assert labels == {"p": (4, "counted"), "q": (1, "estimated")}


def test_cache_upkeep(spark):
    cache = spark.createDataFrame([("h", "m", 1, 10), ("h", "n", 2, 10), ("g", "m", 3, 20)], tokens.CACHE_SCHEMA)
    fresh = spark.createDataFrame([("h", "m", 9, 30), ("k", "m", 4, 30)], tokens.CACHE_SCHEMA)
    upserted = sorted(map(tuple, tokens.cache_upsert(cache, fresh).collect()))
    assert upserted == [("g", "m", 3, 20), ("h", "m", 9, 30), ("h", "n", 2, 10), ("k", "m", 4, 30)]
    week = 7 * 86_400
    assert tokens.cache_expire(cache, week + 10).count() == 1
    assert tokens.cache_expire(cache, week + 9).count() == 3
    assert tokens.cache_expire(cache, 0).count() == 3


def test_hot_content_is_split_and_nothing_is_lost(spark):
    rows = spark.range(6000).selectExpr(
        "concat('c', id % 3) AS corpus", "cast(id AS STRING) AS path",
        "if(id % 3 > 0, 'hot', concat('h', id % 50)) AS hash",
    )
    cache = spark.range(40).selectExpr(
        "if(id = 0, 'hot', concat('h', id)) AS hash", "'m' AS model", "id AS tokens", "id AS ts"
    )
    hot = skew.hot_keys(rows, "hash", 1000)
    assert [r.hash for r in hot.collect()] == ["hot"]
    plain = tokens.cache_lookup(rows, cache, "m")
    split = tokens.cache_lookup(rows, cache, "m", hot)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
    assert split.count() == 6000


def test_repeated_paths_count_alike_cold_and_warm(spark, files_table):
    """Rows that share a path, corpora that share a name, and one content that the cache already holds."""
    entries = {("p", f"f{n}"): (b"license text" if n % 3 else b"own text %d" % n) for n in range(9)}
    files = files_table(entries).unionByName(files_table({("p", "f0"): b"license text", ("p", "f1"): b"own words"}))
    facts = content.measured(files, PackOptions())
    known = spark.createDataFrame([("license text", 2), ("own text 0", 3)], "text STRING, tokens BIGINT").selectExpr(
        "sha2(text, 256) AS hash", "'m' AS model", "tokens", "0L AS ts"
    )
    found = {}
    for name, cache, expected in (("cold", known.limit(0), 5), ("warm", known, 3)):
        misses = tokens.cache_misses(facts, cache, "m")
        fresh = tokens.count_misses(files, misses, "pieces", "m", 5, PackOptions())
        assert fresh.count() == expected
        # An entry that was counted although it is cached must not be counted twice.
        doubled = fresh.unionByName(known.select(*fresh.columns))
        for extra in (fresh, doubled):
            row = tokens.corpus_summary(facts, cache, extra, "m").first()
            found[name, extra is fresh] = (row.files, row.lines, row.chars, row.tokens, row.lookups)
    assert len(set(found.values())) == 1 and next(iter(found.values()))[0] == 11


def test_a_matcher_finds_the_last_line_that_matches():
    """Names, paths and suffixes that are looked up, and expressions, decide as trying every line does."""
    rng = random.Random(12)
    lines = ["tern", "*.egg", "*.tar.gz", "!/nest/tern", "/nest/", "n?st", "**/egg", "!*.egg", "nest/*.egg", "a\\*b", "*", "!tern/", "[a-n]est", ".*"]
    names = ["tern", "nest", "x.egg", "y.tar.gz", "a*b", "egg", ".egg", "new\nline.egg"]
    for _ in range(300):
        text = "\n".join(rng.choices(lines, k=rng.randint(0, 6)))
        matcher = ignore_rules.Matcher(text)
        path, is_dir = "/".join(rng.choices(names, k=rng.randint(1, 3))), rng.random() < 0.5
        rules = [r for r in compile_ignore_text(text) if is_dir or not r.dir_only]
        last = [r for r in rules if re.match(r.regex.replace(r"\z", r"\Z"), path)]
        found = matcher.verdict(path, is_dir)
        assert (found and found.negated) == (last[-1].negated if last else None)


def test_deep_folders_and_many_lines():
    chain = ignore_rules.Chain([(0, ignore_rules.Matcher("\n".join(f"name{n}\n*.ext{n}\n/p/{n}" for n in range(20_000)) + "\ndead/"))])
    assert not chain.excludes("/".join(["alive"] * 3000 + ["file"]))
    assert chain.excludes("/".join(["alive"] * 3000 + ["dead", "file"]))
    for path, out in (("a/name19999", True), ("a/b.ext7", True), ("p/5", True), ("q/p/5", False), ("dead", False)):
        assert chain.excludes(path) == out


def test_bad_ignore_lines_are_skipped(spark, files_table):
    texts = [("p", ".gitignore", "{{a}\n[z-a]\n*.log\n# caf\ufffd\n"), ("q", ".gitignore", None)]
    rules = ignore_rules.rules_from(spark.createDataFrame(texts, "corpus STRING, path STRING, content STRING"))
    assert bad_ignore_lines(texts[0][2]) == [1, 2]
    files = files_table({(c, n): b"x" for c in "pq" for n in ("a.txt", "b.log", "{a")})
    assert [tuple(r) for r in ignore_rules.ignored_files(files, rules).collect()] == [("p", "b.log")]


def test_context_windows(spark):
    sums = spark.createDataFrame([("p", 8192), ("q", None)], "corpus STRING, tokens BIGINT")
    rows = tokens.context_fit(sums).collect()
    assert len(rows) == 22
    fits = {(r.corpus, r.model_id): r.fits for r in rows}
    assert fits[("p", "gpt-4")] is True
    assert fits[("p", "meta-llama/Llama-2-7b-hf")] is False
    assert fits[("q", "gpt-4")] is None
    used = spark.createDataFrame([("gpt-4o",), ("unknown",)], "model_id STRING")
    assert sorted(map(tuple, tokens.model_catalog(used).collect())) == [
        ("gpt-4o", "Gpt4o", "openai", 8192), ("unknown", None, None, None)
    ]
    assert tokens.models(spark).count() == 11


# --- reports ----------------------------------------------------------------------------


def details_of(spark, sizes):
    rows = [(c, f"f{i:05d}", f"{c}/f{i:05d}", 1, n, None) for c, ns in sizes.items() for i, n in enumerate(ns)]
    schema = "corpus STRING, path STRING, report_path STRING, lines BIGINT, chars BIGINT, hash STRING"
    return spark.createDataFrame(rows, schema)


def test_largest_files_against_sorting(spark):
    rng = random.Random(7)
    sizes = {"all": [5] * 15, "top": [5] * 16, "hot": [rng.randint(0, 300) for _ in range(5000)], "one": [0]}
    details = details_of(spark, sizes).repartition(40)
    got = {}
    for row in largest.largest_files(details).collect():
        got.setdefault(row.corpus, []).append((row["rank"], row.path, row.chars, row.title))
    for corpus, numbers in sizes.items():
        order = sorted(((-n, f"f{i:05d}") for i, n in enumerate(numbers)))
        show_all = len(numbers) <= 15
        title = "PROCESSED FILES" if show_all else "TOP 10 LARGEST FILES BY CHARACTER COUNT"
        expected = [(k, p, -n, title) for k, (n, p) in enumerate(order[: None if show_all else 10], start=1)]
        assert sorted(got[corpus]) == expected


def test_last_write_of_a_path_stays(files_table):
    twice = files_table({("p", "a"): b"old\n"}).unionByName(files_table({("p", "a"): b"newer and longer\n"}))
    rows = totals.file_details(content.measured(twice, PackOptions())).collect()
    assert [(r.report_path, r.chars) for r in rows] == [("p/a", 17)]


def test_console_report(spark):
    totals_row = [("p", 37, 8400, 61_000, 15_300, 37, 40), ("q", 1, 2, 9, None, None, None)]
    schema = "corpus STRING, files BIGINT, lines BIGINT, chars BIGINT, tokens BIGINT, hits BIGINT, lookups BIGINT"
    summary = totals.summary_report(spark.createDataFrame(totals_row, schema), "pack.md", duration_text(0.0263))
    listed = spark.createDataFrame(
        [
            ("p", 1, "PROCESSED FILES", "notes/herons.md", "812", "6.6K"),
            ("p", 2, "PROCESSED FILES", "terns.csv", "95", "0.7K"),
            ("q", 1, "TOP 10 LARGEST FILES BY CHARACTER COUNT", "x", "1", "2"),
        ],
        "corpus STRING, rank INT, title STRING, display_path STRING, lines STRING, tokens STRING",
    )
    reports = {r.corpus: r.report for r in console_report(listed, summary).collect()}
    assert reports["p"] == "\n".join(
        [
            "📋  PROCESSED FILES",
            "╭─────────────────┬───────┬─────────────╮",
            "│ File Path       │ Lines │ Est. Tokens │",
            "├─────────────────┼───────┼─────────────┤",
            "│ notes/herons.md │ 812   │ 6.6K        │",
            "│ terns.csv       │ 95    │ 0.7K        │",
            "╰─────────────────┴───────┴─────────────╯",
            "",
            "✅  EXTRACTION COMPLETE",
            "╭────────────────────┬────────────────────────────╮",
            "│ Metric             │ Value                      │",
            "├────────────────────┼────────────────────────────┤",
            "│ 📂 Output File     │ pack.md                    │",
            "│ ⏱️ Process Time    │ 26.3000ms                  │",
            "│ 📄 Files Processed │ 37                         │",
            "│ 📝 Total Lines     │ 8.4K                       │",
            "│ 📦 LLM Tokens      │ 15.3K tokens (counted)     │",
            "│ 🔄 Cache Hit Rate  │ 92.5% (37 hits / 40 total) │",
            "╰────────────────────┴────────────────────────────╯",
        ]
    )
    assert "Cache Hit Rate" not in reports["q"]
    assert "2 tokens (estimated)" in reports["q"]
    assert reports["q"].startswith("📋  TOP 10 LARGEST FILES BY CHARACTER COUNT  📋")
    assert cells("⏱️ é漢") == 6
    assert box(("a",), []).count("\n") == 3


# --- repositories and directories -------------------------------------------------------


def test_refresh_plan_for_every_policy(spark):
    asked = [(f"https://github.com/o/{name}", policy) for name in ("new", "old") for policy in
             ("always_pull", "force_clone", "use_cache")] + [("not a url", "use_cache")]
    rows = repos.with_repo(spark.createDataFrame(asked, "url STRING, policy STRING"))
    snapshots = spark.createDataFrame(
        [("github", "github/o/old", True, 0), ("github", "github/o/new", False, 0)],
        "host_kind STRING, cache_path STRING, has_git BOOLEAN, modified_s BIGINT",
    )
    expected = {("new", p): "clone" for p in ("always_pull", "force_clone", "use_cache")}
    expected |= {("old", "always_pull"): "pull", ("old", "force_clone"): "reclone", ("old", "use_cache"): "use"}
    for hot_rows in (1, 1_000_000):
        plan = repos.refresh_plan(rows, snapshots, hot_rows).collect()
        assert {(r.url.rsplit("/", 1)[1], r.policy): r.action for r in plan} == expected


def test_snapshot_retention(spark):
    day = 86_400
    rows = [
        ("github", "a", True, 0), ("github", "b", False, 0), ("git", "c", True, 1), ("gitlab", "d", True, day),
        ("elsewhere", "e", True, 0),
    ]
    snapshots = spark.createDataFrame(rows, "host_kind STRING, cache_path STRING, has_git BOOLEAN, modified_s BIGINT")
    assert [tuple(r) for r in repos.snapshot_retention(snapshots, 0, 1).collect()] == [("github", 1)]
    got = repos.snapshot_retention(snapshots, 1, day + 1).collect()
    assert sorted(map(tuple, got)) == [("github", 1)]


def test_inputs_are_told_apart(spark):
    rows = spark.createDataFrame([("./here",), ("git@github.com:o/r.git",)], "input STRING")
    got = {r.input: (r.is_repo, r.root) for r in repos.resolve_inputs(rows).collect()}
    assert got == {"./here": (False, "./here"), "git@github.com:o/r.git": (True, "github/o/r")}


def test_directories(spark, files_table):
    files = files_table({("p", "a/b/c/f"): b"", ("p", "g"): b"", ("q", "a/f"): b""})
    listed = spark.createDataFrame([("p", "empty/inner")], "corpus STRING, path STRING")
    got = sorted(map(tuple, tree.directories(files, listed).collect()))
    assert got == [("p", d) for d in ("", "a", "a/b", "a/b/c", "empty", "empty/inner")] + [("q", ""), ("q", "a")]
