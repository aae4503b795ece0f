"""Reruns: equal to fresh runs, and nothing that stayed the same is read."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from folio.operators import content
from folio.options import PackOptions
from folio.plans import rerun
from folio.plans.pack_run import run
from folio.plans.scratch import new_path, staged
from folio.sources.tables import FILES_SCHEMA
from folio.sources.tree import scan_trees

PLAIN = PackOptions(respect_gitignore=False)
START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def table(spark, rows):
    full = [(c, p, "file", len(raw), START + timedelta(seconds=t), mode, None, bytearray(raw), None) for c, p, raw, t, mode in rows]
    return spark.createDataFrame(full, FILES_SCHEMA)


def told(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_equals_a_fresh_run(spark):
    """Files that change, come, go and move, a corpus that goes, one without name, and a path that occurs twice."""
    rng = random.Random(5)
    word = lambda: b"".join(rng.choice([b"a", b"\n", b"\r\n", b"\xc3\xa9", b"\x00"]) for _ in range(rng.randint(0, 9)))
    first = [(rng.choice(["p", "q", "r", None, ""]), f"d{n % 4}/f{n}", word(), 0, "644") for n in range(120)]
    first += first[:3] + [("lost", "only", b"x", 0, "644")]
    second = []
    for row in first[:-1]:
        c, p, raw, t, mode = row
        second += rng.choice([[row], [row], [(c, p, raw + b"more\n", 5, mode)], [(c, p, raw, t, "600")], [], [(c, p + "-moved", raw, t, mode)]])
    second += [("new", "a", b"1\n2\n", 0, "644"), second[0]]
    snapshot = staged(content.measured(table(spark, first), PLAIN))
    found = rerun.rerun_files(table(spark, second), snapshot, rerun.contributions(snapshot), PLAIN)
    fresh = content.measured(table(spark, second), PLAIN)
    assert told(found.totals, ("corpus", *rerun.SUMS)) == told(rerun.contributions(fresh), ("corpus", *rerun.SUMS))
    assert told(found.measured, fresh.columns) == told(fresh, fresh.columns)
    again = rerun.rerun_files(table(spark, second), found.measured, found.totals, PLAIN)
    assert again.changes.count() == 0 and told(again.totals, rerun.SUMS) == told(found.totals, rerun.SUMS)
    nothing = rerun.rerun_files(table(spark, []), found.measured, found.totals, PLAIN)
    assert nothing.totals.count() == 0 and {r.change for r in nothing.changes.collect()} == {"removed"}


def test_unchanged_files_of_a_tree_are_not_opened(spark, shore):
    roots = spark.createDataFrame([("shore", str(shore))], "corpus STRING, root STRING")
    snapshot = staged(content.measured(scan_trees(roots, PLAIN)[0], PLAIN))
    before = rerun.contributions(snapshot)
    # The same size and time, with other lines: a rerun that opened it would count them.
    path = shore / "tides" / "week.log"
    times = os.stat(path)
    path.write_text("\n" * times.st_size)
    os.utime(path, ns=(times.st_atime_ns, times.st_mtime_ns))
    (shore / "maps" / "NOTES").write_text("north\nis\nup\n")
    (shore / "maps" / "more").write_text("one\ntwo\n")
    (shore / "birds.csv").unlink()
    found = rerun.rerun_trees(spark, roots, snapshot, before, PLAIN)
    assert told(found.changes, ("path", "change")) == [
        ("birds.csv", "removed"), ("maps/NOTES", "changed"), ("maps/more", "added"), ("newest", "changed")
    ]
    lines = {r.path: r.lines for r in found.measured.collect()}
    assert (lines["tides/week.log"], lines["maps/NOTES"], lines["newest"], lines["maps/more"]) == (1, 3, 3, 2)
    assert found.totals.first().lines == sum(lines.values())


@pytest.mark.parametrize("format", ["txt", "xml"])
def test_a_run_of_repositories_reports_below_owner_and_name(spark, format):
    files = table(spark, [("github/own/rep", "src/a.txt", b"1\n", 0, "644"), ("plain", "b", b"2", 0, "644")])
    repos = spark.createDataFrame(
        [("github/own/rep", "https://github.com/own/rep", "github.com", "own", "rep")],
        "corpus STRING, repo_url STRING, repo_host STRING, repo_owner STRING, repo_name STRING",
    )
    options = PackOptions(format=format, output_file="pack.out")
    found = run(files, options, new_path(spark, "packs"), repos=repos)
    assert told(found.details, ("corpus", "report_path")) == [("github/own/rep", "own/rep/src/a.txt"), ("plain", "plain/b")]
    assert told(found.files, ("display_path",)) == [("own/rep/src/a.txt",), ("plain/b",)]
    assert told(found.outputs, ("corpus", "output")) == [("github/own/rep", "github/own/rep/pack.out"), ("plain", "plain/pack.out")]
