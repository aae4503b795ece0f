"""Scalar expressions against plain Python models."""

import random

import pytest

from folio.functions import paths, urls
from folio.functions import text as txt
from folio.operators.filters import matches_globs
from folio.functions.globs import compile_ignore_text, glob_body, parse_ignore_line

EDGES = ["", "\n", "\n\n", "a", "a\n", "a\nb", "a\r\n", "a\r", "\r\n", "\r\n\r\n", "é\n漢字\r\nx", "a\n\r\nb\r"]


def random_texts(seed, count=300):
    rng = random.Random(seed)
    letters = "ab \n\r\té漢😀]>&<'\"\x01\x0b"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def model_lines(text):
    pieces = text.split("\n")
    if pieces[-1] == "":
        pieces.pop()
        ended = len(pieces)
    else:
        ended = len(pieces) - 1
    return [p[:-1] if i < ended and p.endswith("\r") else p for i, p in enumerate(pieces)]


def test_lines_and_chars(evaluate):
    texts = EDGES + random_texts(1)
    assert evaluate(txt.line_count("x"), texts) == [len(model_lines(t)) for t in texts]
    expected = [sum(len(line) + 1 for line in model_lines(t)) for t in texts]
    assert evaluate(txt.char_count("x"), texts) == expected


def test_text_or_binary(evaluate):
    def model(raw, trim):
        head = raw[:8192]
        cuts = range(4) if trim and len(raw) > 8192 else range(1)
        valid = any(_is_utf8(head[: len(head) - cut]) for cut in cuts)
        controls = sum(b < 9 or 13 < b < 32 for b in head)
        return 0 < len(raw) < 8_000_000 and valid and controls / len(head) < 0.1

    rng = random.Random(2)
    raws = [b"", b"\x00", b"abc", b"\xff", b"a" * 9 + b"\x01", b"a" * 10 + b"\x01", "é".encode() * 5000]
    raws += [b"x" + "é".encode() * 5000, b"a" * 8192 + b"\xff", "漢".encode() * 3000, b"a" * 8_000_000]
    raws += [bytes(rng.choice(b"abc\n\x01\x1f\t\xc3\xa9") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for trim in (False, True):
        expression = txt.looks_like_text("x", "octet_length(x)", 8_000_000, 8192, trim)
        assert evaluate(expression, [bytearray(r) for r in raws], "BINARY") == [model(r, trim) for r in raws]


def _is_utf8(raw):
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


def test_number_texts(evaluate):
    rng = random.Random(3)
    sizes = [0, 1, 1023, 1024, 1029, 1536, 1048575, 1048576, 5 * 2**20 + 5243, 2**30, 3 * 2**40]
    sizes += [rng.randint(0, 2 ** rng.randint(1, 45)) for _ in range(400)] + [1024 * 2 + 512 * k for k in range(50)]

    def size_model(n):
        for unit, label in ((2**30, "GB"), (2**20, "MB"), (2**10, "KB")):
            if n >= unit:
                return f"{n / unit:.2f} {label}"
        return f"{n} bytes"

    assert evaluate(txt.size_text("x"), sizes, "BIGINT") == [size_model(n) for n in sizes]
    counts = [0, 999, 1000, 1049, 1050, 1150, 1250, 1350, 999_949, 999_950, 1_000_000, 1_250_000]
    counts += [50 * k for k in range(20, 20_000, 7)] + [50_000 * k for k in range(20, 400)]
    counts += [rng.randint(0, 10 ** rng.randint(1, 12)) for _ in range(300)]

    def count_model(n):
        if n >= 1_000_000:
            return f"{n / 1_000_000:.1f}M"
        return f"{n / 1000:.1f}K" if n >= 1000 else str(n)

    assert evaluate(txt.count_text("x"), counts, "BIGINT") == [count_model(n) for n in counts]


def test_timestamps_are_utc_and_keep_fractions(spark):
    micros = [0, 1_704_164_645_000_000, 1_704_164_645_250_000, 1_704_164_645_000_001, -1]
    rows = spark.createDataFrame([(m,) for m in micros], "m BIGINT")
    shown = [r[0] for r in rows.selectExpr(txt.rfc3339("timestamp_micros(m)")).collect()]
    assert shown == [
        "1970-01-01T00:00:00+00:00",
        "2024-01-02T03:04:05+00:00",
        "2024-01-02T03:04:05.250+00:00",
        "2024-01-02T03:04:05.000001+00:00",
        "1969-12-31T23:59:59.999999+00:00",
    ]


@pytest.mark.parametrize(
    "path, name, ext, folder",
    [
        ("a.txt", "a.txt", "txt", ""),
        ("d/a.tar.gz", "a.tar.gz", "gz", "d"),
        (".env", ".env", "", ""),
        ("d.x/.env.local", ".env.local", "local", "d.x"),
        ("d.x/Makefile", "Makefile", "", "d.x"),
        ("a/b/c.", "c.", "", "a/b"),
        ("a/b\nc/é.漢", "é.漢", "漢", "a/b\nc"),
    ],
)
def test_path_parts(evaluate, path, name, ext, folder):
    assert evaluate(paths.name_of("x"), [path]) == [name]
    assert evaluate(paths.ext_of("x"), [path]) == [ext]
    assert evaluate(paths.dir_of("x"), [path]) == [folder]
    assert evaluate(paths.depth_of("x"), [path]) == [path.count("/") + 1]


def test_paths_of_a_repository(evaluate):
    root = "/srv/nests/forge/wader/tern"
    inputs = [f"{root}/eggs.csv", f"{root}/log/may/9.md", "/srv/gulls/eggs.csv", root, root + "x/a"]
    assert evaluate(paths.relative_to("x", f"'{root}'"), inputs) == [
        "eggs.csv", "log/may/9.md", "/srv/gulls/eggs.csv", "", root + "x/a"
    ]
    shown = evaluate(paths.report_path("x", f"'{root}'", "'wader'", "'tern'"), inputs)
    assert shown == [
        "wader/tern/eggs.csv", "wader/tern/log/may/9.md", "/srv/gulls/eggs.csv",
        "wader/tern", root + "x/a",
    ]
    outputs = ["all.md", "packs/june/all.md", "/srv/all.md"]
    assert evaluate(paths.output_path("x", f"'{root}'"), outputs) == [
        f"{root}/all.md", "packs/june/all.md", "/srv/all.md"
    ]


def test_display_path(evaluate):
    def model(path):
        if len(path.encode()) <= 60:
            return path
        parts = path.split("/")
        if len(parts) <= 2:
            return "..." + path[-57:]
        kept, used = [], 3
        for part in reversed(parts):
            if used + len(part.encode()) + 1 > 60:
                break
            kept.append(part)
            used += len(part.encode()) + 1
        return "..." + "".join("/" + part for part in reversed(kept))

    rng = random.Random(4)
    samples = ["a" * 60, "a" * 61, "d/" + "é" * 40, "a/b/" + "c" * 70, "/" + "x/" * 40]
    samples += [
        "/".join(rng.choice("aé漢") * rng.randint(0, 25) for _ in range(rng.randint(1, 8)))
        for _ in range(300)
    ]
    assert evaluate(paths.display_path("x"), samples) == [model(p) for p in samples]


def test_sort_key_orders_folders_first(evaluate):
    rng = random.Random(5)
    names = ["a", "a-b", "a.b", "ab", "b", "é", "z\x01q", "z"]
    tree = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + "#f" for _ in range(200)})

    def walk(entries, prefix=""):
        inside = [e[len(prefix):] for e in entries if e.startswith(prefix)]
        folders = sorted({e.split("/")[0] for e in inside if "/" in e}, key=lambda n: n.encode())
        for folder in folders:
            yield from walk(entries, f"{prefix}{folder}/")
        yield from sorted((prefix + e for e in inside if "/" not in e), key=lambda n: n.encode())

    shuffled = tree[:]
    rng.shuffle(shuffled)
    keys = dict(zip(shuffled, evaluate(paths.file_key("x"), shuffled)))
    assert sorted(tree, key=lambda p: keys[p].encode()) == list(walk(tree))


def repository_urls(n, seed=11):
    """URLs put together from the grammar, each with whether it names a repository: owner and name behind a host."""
    rng = random.Random(seed)
    word = lambda letters="abcxyz019-_.": "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    for _ in range(n):
        host, owner, name = f"{word('abxyz')}.{word('abxyz')}", word("abxyz019-"), word("abxyz019-")
        parts = [owner, name][: rng.randint(0, 2)]
        suffix = rng.choice(["", ".git"]) if len(parts) == 2 else ""
        if rng.random() < 0.4:
            yield f"git@{host}:{'/'.join(parts)}{suffix}", len(parts) == 2
        else:
            scheme = rng.choice(["http", "https", "https", "ftp", "file", "ssh"])
            yield f"{scheme}://{host}/{'/'.join(parts)}{suffix}", scheme.startswith("http") and len(parts) == 2
        yield "/".join(parts), False


def test_repository_urls(evaluate):
    given = list(repository_urls(200))
    assert {wanted for _, wanted in given} == {True, False}
    assert evaluate(urls.is_repo_url("x"), [url for url, _ in given]) == [wanted for _, wanted in given]
    odd = [
        "https://github.com/wader/tern/", "https://github.com/a/b/tree/main", "https://GitHub.com/a/b",
        "https://www.github.com/a/b", "https://u:p@github.com:443/a/b.git.git?x=1", "https://github.com/a/b\n",
        "git@github.com:a/b/c", "ftp://github.com/a/b", "https:///a/b", "http://x y/a/b#f",
    ]
    parsed = evaluate(urls.parse_repo_url("x"), odd)
    assert [p and tuple(p) for p in parsed] == [
        None, ("github.com", "a", "b"), ("github.com", "a", "b"), ("www.github.com", "a", "b"),
        ("github.com", "a", "b.git"), ("github.com", "a", "b\n"), None, None, None, ("x y", "a", "b"),
    ]


def test_host_names(evaluate):
    hosts = ["github.com", "gitlab.com", "bitbucket.org", "forge.test"]
    kind = urls.host_kind("x")
    assert evaluate(kind, hosts) == ["github", "gitlab", "bitbucket", "git"]
    assert evaluate(urls.host_title(kind, "x"), hosts) == ["GitHub", "GitLab", "Bitbucket", "forge.test"]
    assert evaluate(urls.repo_display(kind, "x", "'wader'", "'tern'"), hosts[:1]) == ["GitHub/wader/tern"]
    stored = evaluate(urls.storage_path(kind, "x", "'wader'", "'tern'"), ["github.com", "nest.test"])
    assert stored == ["github/wader/tern", "git/nest.test/wader/tern"]


@pytest.mark.parametrize(
    "glob, hits, misses",
    [
        ("*.txt", ["a.txt", ".txt"], ["a.txt.md", "txt"]),
        ("?.rs", ["a.rs", "é.rs"], ["ab.rs", ".rs"]),
        ("[a-c]*", ["apple", "c"], ["d", ""]),
        ("[!a-c]*", ["dog"], ["apple", ""]),
        ("{foo,ba[rz]}.py", ["foo.py", "bar.py", "baz.py"], ["bat.py"]),
        ("a\\*b", ["a*b"], ["aXb"]),
        ("!*.md", ["a.txt"], ["a.md"]),
        ("**", ["anything", ""], []),
        ("a+b(c)", ["a+b(c)"], ["aab(c)"]),
        ("[]x]", ["]", "x"], ["y"]),
    ],
)
def test_name_globs(evaluate, glob, hits, misses):
    assert evaluate(matches_globs("x", [glob]), hits + misses) == [True] * len(hits) + [False] * len(misses)


def test_ignore_lines():
    assert parse_ignore_line("# note") is None
    assert parse_ignore_line("   ") is None
    assert parse_ignore_line("*.log") == ("(?:.*/)?[^/]*\\.log", False, False)
    assert parse_ignore_line("!/docs/") == ("docs", True, True)
    assert parse_ignore_line("a/b  ") == ("a/b", False, False)
    assert parse_ignore_line("\\#x") == ("(?:.*/)?" + glob_body("\\#x"), False, False)
    rules = compile_ignore_text("*.a\n*.b\n!c.b\nd/\r\ne/\n")
    assert [(r.line_no, r.negated, r.dir_only) for r in rules] == [(1, False, False), (3, True, False), (4, False, True)]
