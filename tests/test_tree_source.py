"""The tree format: rows as the level scan gives them, filters that spare folders and entries, and the stream."""

import os
import time

import pytest

from folio.options import PackOptions
from folio.sources import tree_source
from folio.sources.tree import scan_tree

SHARED = ["corpus", "path", "kind", "size", "permissions", "target", "open_error"]


@pytest.fixture
def tree(spark):
    tree_source.register(spark)
    return lambda root, **options: spark.read.format("tree").options(**options).load(str(root))


def test_rows_are_those_of_the_level_scan(spark, tree, shore):
    level = scan_tree(spark, str(shore), PackOptions(respect_gitignore=False))
    want = {r.path: r.asDict() for r in level.collect()}
    for tasks in (1, 2, 200):
        got = tree(shore, content="true", tasks=tasks).collect()
        assert len({r.path for r in got}) == len(got)
        files = {r.path: r for r in got if r.kind != "directory"}
        assert set(want) <= set(files) and set(files) - set(want) == {".svn/entries"}
        for path, row in want.items():
            assert all(files[path][c] == row[c] for c in [*SHARED, "modified", "raw"])
            assert files[path].name == os.path.basename(path)
        folders = {r.path for r in got if r.kind == "directory"}
        assert folders == {".svn", "maps", "maps/old", "maps/old/1890", "maps/old/1890/east", "maps/blank", "tides"}
    assert all(r.raw is None for r in tree(shore).collect())


def test_links_are_recorded_on_demand(tree, shore):
    (shore / "loop").symlink_to(shore)
    got = {r.path: r for r in tree(shore, recordSymlinks="true").collect()}
    assert got["newest"].kind == got["loop"].kind == "symlink" and got["newest"].target.endswith("NOTES")
    assert {r.path: r.kind for r in tree(shore).collect()}["loop"] == "other"


def test_conditions_give_what_they_say(tree, shore):
    every = tree(shore).collect()
    for condition, holds in [
        ("name = 'NOTES'", lambda r: r.name == "NOTES"),
        ("name LIKE '%.log'", lambda r: r.name.endswith(".log")),
        ("path LIKE 'maps/old/%' AND size > 3", lambda r: r.path.startswith("maps/old/") and r.size > 3),
        ("path IN ('birds.csv', 'tides/week.log')", lambda r: r.path in ("birds.csv", "tides/week.log")),
        ("path LIKE '%e%' AND kind = 'file'", lambda r: "e" in r.path and r.kind == "file"),
        ("name <> 'NOTES'", lambda r: r.name != "NOTES"),
        ("path IS NULL", lambda r: False),
    ]:
        got = sorted(r.path for r in tree(shore).where(condition).collect())
        assert got == sorted(r.path for r in every if holds(r)), condition


def test_folders_that_cannot_hold_a_path_stay_shut(shore, monkeypatch):
    reader = tree_source.TreeReader({"path": str(shore), "tasks": "1"})
    asked = [tree_source.StringStartsWith(("path",), "maps/old/18"), tree_source.EqualTo(("size",), 3)]
    assert list(reader.pushFilters(asked)) == asked[1:]
    opened, looked = [], []
    scandir, look_at = os.scandir, tree_source.look_at
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, shore)) or scandir(p))
    monkeypatch.setattr(tree_source, "look_at", lambda *a: looked.append(a[2]) or look_at(*a))
    found = [p for part in reader.partitions() for b in reader.read(part) for p in b.column("path").to_pylist()]
    assert sorted(found) == sorted(looked) == ["maps/old/1890", "maps/old/1890/east", "maps/old/1890/east/inlet.geo"]
    assert {"tides", ".svn", "maps/blank"}.isdisjoint(opened) and "maps/old/1890/east" in opened


def test_planning_is_bounded_and_every_folder_read_once(tmp_path, monkeypatch):
    for a in range(30):
        for b in range(5):
            (tmp_path / f"a{a}" / f"b{b}").mkdir(parents=True)
            (tmp_path / f"a{a}" / f"b{b}" / "f").touch()
    for tasks in (1, 3, 10, 400):
        reader = tree_source.TreeReader({"path": str(tmp_path), "tasks": str(tasks)})
        opened, scandir = [], os.scandir
        monkeypatch.setattr(os, "scandir", lambda p: opened.append(p) or scandir(p))
        parts = reader.partitions()
        monkeypatch.undo()
        assert len(parts) <= tasks and len(opened) <= tree_source.FOLDERS_PER_TASK * tasks
        paths = [p for part in parts for b in reader.read(part) for p in b.column("path").to_pylist()]
        assert len(paths) == len(set(paths)) == 30 + 150 + 150


def test_missing_root_and_bad_options(tree, tmp_path):
    with pytest.raises(Exception, match="Target directory not found"):
        tree(tmp_path / "none").count()
    with pytest.raises(ValueError, match="root of the tree"):
        tree_source.TreeReader({})
    with pytest.raises(ValueError, match="tasks"):
        tree_source.TreeReader({"path": "/", "tasks": "0"})
    assert tree(tmp_path).count() == 0


def test_a_folder_that_cannot_be_listed_is_a_row(shore, monkeypatch):
    reader = tree_source.TreeReader({"path": str(shore), "tasks": "1"})
    scandir = os.scandir

    def refuse(path):
        if path.endswith("tides"):
            raise PermissionError(13, "Permission denied")
        return scandir(path)

    monkeypatch.setattr(os, "scandir", refuse)
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    bad = [(r["path"], r["open_error"]) for r in rows if r["kind"] == "unreadable"]
    assert bad == [("tides", "Permission denied")] and not any(r["path"].startswith("tides/") for r in rows)


def test_stream_brings_every_file_once(spark, tmp_path):
    tree_source.register(spark)
    root, out, state = tmp_path / "root", str(tmp_path / "out"), str(tmp_path / "state")
    (root / "deep" / "er").mkdir(parents=True)

    def run():
        entries = spark.readStream.format("tree").options(content="true", settle="0", tasks="2").load(str(root))
        sink = entries.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True)
        sink.start(out).awaitTermination()
        return sorted((r.path, bytes(r.raw).decode()) for r in spark.read.schema(tree_source.SCHEMA).parquet(out).collect())

    (root / "deep" / "a").write_text("1")
    (root / "b").write_text("2")
    os.utime(root / "b", (0, 0))  # an old time of contents does not hide a file that has just come
    first = [("b", "2"), ("deep/a", "1")]
    assert run() == first
    assert run() == first
    time.sleep(0.05)
    (root / "deep" / "er" / "c").write_text("3")
    (root / "b").write_text("22")
    assert run() == sorted([*first, ("deep/er/c", "3"), ("b", "22")])
    (root / "deep" / "er" / "c").unlink()
    assert len(run()) == 4


def test_a_batch_is_replayed_from_its_offsets(shore):
    reader = tree_source.TreeStreamReader({"path": str(shore), "tasks": "2", "settle": "0"})
    start, end = reader.initialOffset(), reader.latestOffset()
    once, again = (
        sorted(p for part in reader.partitions(start, end) for b in reader.read(part) for p in b.column("path").to_pylist())
        for _ in range(2)
    )
    assert once == again and "birds.csv" in once and "maps" not in once
    assert not [p for part in reader.partitions(end, reader.latestOffset()) for p in reader.read(part)]
