"""Trees, packs, whole runs and the stream."""

import os
import random
import xml.etree.ElementTree as ET
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.operators import balance, content, prefix_sums, render, tokens, tree, writers
from folio.options import PackOptions
from folio.plans.pack_run import run, run_trees
from folio.plans.scratch import new_path, staged
from folio.sources import packs, tables, token_cache
from folio.sources.tree import scan_tree, scan_trees
from folio.streaming.incremental import count_batch, incremental_tokens

PLAIN = PackOptions(respect_gitignore=False)
XML = PackOptions(respect_gitignore=False, format="xml")


def pack_text(path, corpus):
    """A pack as its user reads it: blocks of the published version, and the parts in each, in name order."""
    version = sorted(name for name in os.listdir(f"{path}/manifests") if name.startswith("version="))[-1]
    folder = f"{path}/{version}/corpus={corpus}"
    parts = [
        f"{block}/{name}"
        for block in sorted(os.listdir(folder))
        for name in sorted(os.listdir(f"{folder}/{block}"))
        if name.startswith("part-")
    ]
    return "".join(open(f"{folder}/{name}", newline="").read() for name in parts), len(parts)


def roots_of(spark, root):
    return spark.createDataFrame([(root.name, str(root))], "corpus STRING, root STRING")


def scanned(spark, root, options):
    rows = scan_tree(spark, str(root), options)
    return {r.path: r for r in rows.selectExpr("*", "cast(raw AS STRING) AS text").collect()}


# --- trees ------------------------------------------------------------------------------

SHORE = {"birds.csv", "maps/NOTES", "maps/old/1890/east/inlet.geo", "tides/gauge.dat", "tides/week.log", "newest"}


def test_scan_of_a_tree(spark, shore):
    """Names that Spark's own sources leave out are there; default names, repository data among them, are not."""
    (shore / "_draft").write_text("")
    (shore / ".eelgrass").write_text("zostera\n")
    os.chmod(shore / "_draft", 0o640)
    os.utime(shore / "_draft", ns=(0, 1_600_000_000_987_654_000))
    (shore / "target").mkdir()
    (shore / "target" / "never").write_text("x")
    rows = scanned(spark, shore, PLAIN)
    assert set(rows) == SHORE | {"_draft", ".eelgrass"}
    assert rows["newest"].text == "north is up"
    assert (rows["_draft"].size, rows["_draft"].permissions, rows["_draft"].corpus) == (0, "640", "shore")
    moment = scan_tree(spark, str(shore), PLAIN).where("path = '_draft'")
    assert moment.selectExpr("unix_micros(modified) AS m").first().m == 1_600_000_000_987_654


def test_a_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="Target directory not found"):
        scan_tree(spark, str(tmp_path / "nowhere"), PLAIN).count()


def test_links_and_other_entries(spark, shore):
    (shore / "round").symlink_to(shore)
    (shore / "dead").symlink_to("drowned")
    os.mkfifo(shore / "horn")
    followed = scanned(spark, shore, PLAIN)
    assert (followed["dead"].kind, followed["dead"].open_error) == ("unreadable", "No such file or directory")
    assert followed["horn"].kind == followed["round"].kind == "other"
    recorded = scanned(spark, shore, PackOptions(respect_gitignore=False, record_symlinks=True))
    assert recorded["dead"].target == "drowned"
    assert recorded["round"].kind == "symlink"
    assert recorded["newest"].target.endswith("maps/NOTES")


@pytest.mark.parametrize(
    "options, kept",
    [
        ({"ignore_patterns": ("*.[gl]*",)}, SHORE - {"maps/old/1890/east/inlet.geo", "tides/week.log"}),
        ({"ignore_patterns": ("old", "tides")}, {"birds.csv", "maps/NOTES", "newest"}),
        ({"include_patterns": ("*.csv", "N*")}, {"birds.csv", "maps/NOTES"}),
        ({"include_patterns": ("N*",), "include_dirs": True}, set()),
        ({"include_patterns": ("N*", "m*s"), "include_dirs": True}, {"maps/NOTES"}),
    ],
)
def test_filters_while_listing(spark, shore, options, kept):
    assert set(scanned(spark, shore, PackOptions(respect_gitignore=False, **options))) == kept


def test_folders_of_a_tree(spark, shore):
    _, folders, _ = scan_trees(roots_of(spark, shore), PLAIN)
    assert {r.path for r in folders.collect()} == {"maps", "maps/blank", "maps/old", "maps/old/1890", "maps/old/1890/east", "tides"}


@pytest.mark.parametrize("limit", [9000, 20_000])
@pytest.mark.parametrize("above", [-1, 0, 1])
def test_the_limit_is_the_last_size_that_is_read(spark, shore, limit, above):
    (shore / "long").write_bytes(random.Random(limit).randbytes(limit // 2 + 1).hex()[: limit + above].encode())
    options = replace(PLAIN, inline_limit=limit, ignore_patterns=("*.*",))
    files = scan_tree(spark, str(shore), options).where("path = 'long'")
    row = content.with_content(content.classify(files, options), options).first()
    if above > 0:
        assert (row.read_status, row.content) == ("oversize", f"File too large to include content. Size: {(limit + 1) / 1024:.2f} KB")
        assert len(files.first().raw) == 8192
    else:
        assert (row.read_status, len(row.content)) == ("ok", limit + above)


def test_pack_of_a_tree(spark, shore):
    out = new_path(spark, "packs")
    result = run_trees(spark, roots_of(spark, shore), XML, out)
    text, _ = pack_text(out, "shore")
    root = ET.fromstring(text.encode())
    folders = {d.get("path") for d in root.find("directory").iter("directory")}
    assert folders == {"shore", *(f"shore/{d}" for d in ("maps", "maps/blank", "maps/old", "maps/old/1890", "maps/old/1890/east", "tides"))}
    assert {f.get("path"): f.find("content").text for f in root.iter("file") if f.get("path")} == {
        "shore/birds.csv": "name;seen\nknot;12\ncurlew;7\n", "shore/maps/NOTES": "north is up", "shore/newest": "north is up",
        "shore/maps/old/1890/east/inlet.geo": "POINT 3 4\nPOINT 5 6\n", "shore/tides/week.log": "mon 2.1\n",
    }
    assert [b.get("path") for b in root.iter("binary")] == ["shore/tides/gauge.dat"]
    assert "POINT 3 4\r\n" in text  # parsers fold line ends, the pack does not
    total = result.totals.first()
    assert (total.files, total.lines) == (6, 3 + 1 + 1 + 2 + 1)
    assert "PROCESSED FILES" in result.report.first().report


def test_ignore_files_of_a_tree(spark, shore):
    """A deeper file beats a higher one, `.ignore` beats `.gitignore`, and the custom file beats both."""
    (shore / ".gitignore").write_text("tides/\n*.csv\n/newest\n")
    (shore / "maps" / ".gitignore").write_text("old/1890/east/*\n!old/1890/east/inlet.geo\nNOTES\n")
    (shore / "maps" / ".ignore").write_text("!NOTES\n")
    (shore / ".keep").write_text("!*.csv\nN*S\n")
    (shore / "maps" / "old" / "1890" / "east" / "reef.geo").write_text("x")
    (shore / "gone").symlink_to("nowhere")
    names = {"custom_ignore_name": ".keep"}
    for custom, kept in (({}, {"maps/NOTES", "maps/old/1890/east/inlet.geo"}), (names, {"birds.csv", "maps/old/1890/east/inlet.geo"})):
        out = new_path(spark, "packs")
        result = run_trees(spark, roots_of(spark, shore), PackOptions(**custom), out)
        shown = {line.removeprefix("shore/") for line in pack_text(out, "shore")[0].split("\n") if line.startswith("shore/")}
        assert shown == kept
        assert ("shore", "unreadable", 1) in [tuple(r) for r in result.rejects.collect()]


def test_metadata_of_folders_and_files(spark, shore):
    os.chmod(shore / "maps" / "blank", 0o711)
    os.utime(shore / "maps" / "blank", ns=(0, 86_400 * 10**9))
    out = new_path(spark, "packs")
    options = PackOptions(respect_gitignore=False, format="xml", include_metadata=True)
    run_trees(spark, roots_of(spark, shore), options, out)
    root = ET.fromstring(pack_text(out, "shore")[0].encode())
    empty = root.find(".//directory[@path='shore/maps/blank']/metadata")
    assert (empty.find("permissions").text, empty.find("modified").text) == ("711", "1970-01-02T00:00:00+00:00")
    assert root.find(".//file[@path='shore/maps/NOTES']/metadata/size").text == "11"


# --- packs ------------------------------------------------------------------------------


def test_text_pack_to_the_letter(spark, files_table):
    files = files_table({("p", "b.rs"): b"fn main() {}\n", ("p", "a/x"): b"1", ("p", "z.bin"): b"\x00"})
    repos = spark.createDataFrame(
        [("p", "https://github.com/o/p", "github.com", "o", "p")], "corpus STRING, " + ", ".join(f"{c} STRING" for c in render.REPO_COLUMNS)
    )
    out = new_path(spark, "packs")
    run(files, PackOptions(include_metadata=True, hostname="h"), out, repos=repos)
    rule = "=" * 48
    meta = "  Modified: 2024-01-02T03:04:05+00:00\n  Permissions: 644\n"
    assert pack_text(out, "p")[0] == (
        "=================== SYSTEM INFO ===================\nHostname: h\nOS: linux\nKernel: unix\n\n"
        "=================== REPOSITORY ===================\nURL: https://github.com/o/p\nHost: github.com\n"
        'Owner: o\nRepository: p\n\n<codebase name="p">\n'
        f"\n{rule}\np/a/x\n{rule}\n\n  Size: 1\n{meta}```\n1\n```\n"
        f"\n{rule}\np/b.rs\n{rule}\n\n  Size: 13\n{meta}```rs\nfn main() {{}}\n\n```\n"
        f"  Size: 1\n{meta}</codebase>\n"
    )


def test_xml_pack_to_the_letter(files_table, spark):
    files = files_table({("p", "b.rs"): b"x ]]> y", ("p", 'a/<&"\'>'): b"1", ("p", "z.bin"): b"\x00"})
    out = new_path(spark, "packs")
    run(files, XML, out)
    assert pack_text(out, "p")[0] == """<?xml version="1.0" encoding="UTF-8"?>
<directory_scan timestamp="1970-01-01T00:00:00+00:00">
  <system_info>
    <hostname>unknown</hostname>
    <os>linux</os>
    <kernel>unix</kernel>
  </system_info>
  <overview>
    <directory name="p">
      <directory name="a">
        <file name="&lt;&amp;&quot;&apos;&gt;"/>
      </directory>
      <file name="b.rs"/>
      <file name="z.bin"/>
    </directory>
  </overview>
  <directory name="p" path="p">
    <contents>
      <directory name="a" path="p/a">
        <contents>
          <file name="&lt;&amp;&quot;&apos;&gt;" path="p/a/&lt;&amp;&quot;&apos;&gt;">
            <content><![CDATA[1]]></content>
          </file>
        </contents>
      </directory>
      <file name="b.rs" path="p/b.rs">
        <content><![CDATA[x ]]]]><![CDATA[> y]]></content>
      </file>
      <binary name="z.bin" path="p/z.bin">
      </binary>
    </contents>
  </directory>
</directory_scan>
"""


def test_packs_of_skewed_corpora_parse_and_hold_every_file(files_table, spark):
    rng = random.Random(8)
    letters = "ab<&>]\n é漢\x01"
    entries = {}
    for number in range(600):
        corpus = "hot" if number % 3 else f"c{number % 7}"
        depth = rng.randint(0, 4)
        path = "/".join([rng.choice(["a", "a-b", "b c", "é"]) for _ in range(depth)] + [f"f{number}.txt"])
        text = "x" * 100 + "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        entries[(corpus, path)] = text.encode()
    out = new_path(spark, "packs")
    run(files_table(entries), XML, out, partitions=6)
    seen = {}
    for corpus in {c for c, _ in entries}:
        text, parts = pack_text(out, corpus)
        assert corpus != "hot" or parts > 1
        for element in ET.fromstring(text.encode()).iter("file"):
            if element.get("path"):
                seen[(corpus, element.get("path").split("/", 1)[1])] = element.find("content").text
    assert seen == {key: raw.decode().replace("\x01", "�") for key, raw in entries.items()}


def test_text_pack_over_several_parts_keeps_its_order(files_table, spark):
    rng = random.Random(9)
    entries = {}
    for number in range(900):
        folders = [rng.choice(["a", "a-b", "ab", "z"]) for _ in range(rng.randint(0, 3))]
        raw = b"\x00\x01" if number % 5 == 0 else b"text %d" % number
        entries[("hot" if number % 3 else "cold", "/".join([*folders, f"f{number:03d}"]))] = raw
    out = new_path(spark, "packs")
    run(files_table(entries), PLAIN, out, partitions=7)
    for corpus in ("hot", "cold"):
        text, parts = pack_text(out, corpus)
        lines = text.split("\n")
        shown = [lines[i + 1] for i in range(len(lines) - 2) if lines[i] == lines[i + 2] == "=" * 48]
        wanted = [path for (c, path), raw in entries.items() if c == corpus and raw[0]]
        wanted.sort(key=lambda p: [(0, part) for part in p.split("/")[:-1]] + [(1, p.split("/")[-1])])
        assert shown == [f"{corpus}/{path}" for path in wanted]
        assert (lines[0], lines[-2]) == (f'<codebase name="{corpus}">', "</codebase>")
    assert parts >= 1 and pack_text(out, "hot")[1] > 2


def test_parts_are_cut_by_bytes(files_table, spark):
    """A few large files ahead of very many small ones: no part is much heavier than its share."""
    entries = {("p", f"a/large{n:02d}"): b"x" * 400_000 for n in range(40)}
    entries |= {("p", f"b/small{n:04d}"): b"y" * 100 for n in range(4000)}
    out = new_path(spark, "packs")
    run(files_table(entries), PLAIN, out, partitions=8)
    sizes = [r.bytes for r in packs.manifest(spark, out).collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.5 * sum(sizes) / 8
    text, _ = pack_text(out, "p")
    shown = [line for line in text.split("\n") if line.startswith("p/")]
    assert shown == [f"p/{path}" for _, path in sorted(entries)]


def test_cut_keys_are_where_the_running_sum_says(spark):
    rng = random.Random(4)
    rows = [(f"k{n:05d}", rng.choice([0, 1, 5, 400])) for n in range(3000)]
    total, parts, before, wanted = sum(w for _, w in rows), 13, 0, {}
    for key, weight in rows:
        wanted.setdefault(min(before * parts // total, parts - 1), key)
        before += weight
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "key STRING, weight BIGINT")
    cuts = prefix_sums.cut_keys(table, parts)
    assert cuts == sorted(wanted.values())
    placed = table.selectExpr("key", f"{prefix_sums.part_of('key', cuts)} AS part").collect()
    assert {r.key: r.part for r in placed} == {k: sum(c <= k for c in cuts) - 1 for k, _ in rows}
    assert prefix_sums.cut_keys(table.limit(0), parts) == [] and prefix_sums.part_of("key", []) == "0"


def test_packs_of_corpora_without_name_are_apart(files_table, spark):
    names = [None, "", "%none", "__HIVE_DEFAULT_PARTITION__", "a+b %41=/'é"]
    files = files_table({(name, f"f{k}"): b"text %d" % k for k, name in enumerate(names)})
    out = new_path(spark, "packs")
    run(files, XML, out)
    for k, name in enumerate(names):
        lines = [r.value for r in packs.read_pack(spark, out, name).collect()]
        assert sum("<content>" in line for line in lines) == 1 and any(f"text {k}]]" in line for line in lines)
    assert [r.fault for r in packs.pack_faults(spark, out).collect()] == [None] * len(names)


@pytest.mark.parametrize("options", [PLAIN, XML])
def test_small_packs_share_files_where_there_are_many(files_table, spark, monkeypatch, options):
    """Readers find the same lines, and folders are made for large packs alone."""
    names = [None, "", "%none", "a+b %41=/'é", *(f"c{n}" for n in range(30))]
    entries = {(name, f"d/f{k}"): b"text %d\r\n\n<a>\n" % k for k, name in enumerate(names)}
    entries |= {("c7", "big"): b"long " * 1000, ("c7", "d/last"): b"end"}
    files, (apart, shared) = files_table(entries), (new_path(spark, "packs") for _ in range(2))
    run(files, options, apart)
    monkeypatch.setattr(packs, "FOLDERS", 3, raising=False)
    monkeypatch.setattr(packs, "FOLDER_BYTES", 4000, raising=False)
    run(files, options, shared)
    (version,) = [n for n in os.listdir(shared) if n.startswith("version=")]
    assert [n for n in os.listdir(f"{shared}/{version}") if n.startswith("corpus=")] == ["corpus=c7"]

    def lines(path):
        return sorted((r.corpus or "", r.value) for r in packs.stored_lines(spark, path).collect())

    assert lines(shared) == lines(apart) and len(set(c for c, _ in lines(apart))) == len(names) - 1
    for name in (*names[:4], "c7", "c8"):
        found = [sorted(r.value for r in packs.read_pack(spark, path, name).collect()) for path in (shared, apart)]
        assert found[0] == found[1]
    whole = [sorted((r.corpus, r.bytes) for r in packs.manifest(spark, p).groupBy("corpus").agg(F.sum("bytes").alias("bytes")).collect()) for p in (shared, apart)]
    assert whole[0] == whole[1]
    if options is XML:
        assert [r.fault for r in packs.pack_faults(spark, shared).collect()] == [None] * len(names)
    frame = render.txt_frame(files.where("corpus <> 'c7'").select("corpus").distinct(), PLAIN)
    packs.write_pack(files.where("corpus <> 'c7'"), frame, PLAIN, shared, 3, checksums=True)
    assert packs.damaged_parts(spark, shared).count() == 0 and packs.read_pack(spark, shared, "c7").count() == 0
    assert packs.read_pack(spark, shared, "c8").count() > 3


def test_a_failed_run_leaves_the_pack_before(files_table, spark, monkeypatch):
    out = new_path(spark, "packs")
    assert packs.read_pack(spark, out, "p").count() == 0
    run(files_table({("p", "a"): b"first"}), PLAIN, out)
    before = [r.value for r in packs.read_pack(spark, out, "p").collect()]
    with monkeypatch.context() as broken:
        broken.setattr(packs, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost the driver")))
        with pytest.raises(RuntimeError):
            run(files_table({("p", "a"): b"second"}), PLAIN, out)
    assert len([n for n in os.listdir(out) if n.startswith("version=")]) == 2
    assert [r.value for r in packs.read_pack(spark, out, "p").collect()] == before
    run(files_table({("p", "a"): b"third"}), PLAIN, out)
    assert "third" in [r.value for r in packs.read_pack(spark, out, "p").collect()]


def test_damaged_parts_are_found(files_table, spark):
    files = files_table({("p", "a"): b"one\r\ntwo", ("q", "b"): b"three"})
    out = new_path(spark, "packs")
    frame = render.txt_frame(files.select("corpus").distinct(), PLAIN)
    version = packs.write_pack(files, frame, PLAIN, out, 1, checksums=True)
    assert packs.damaged_parts(spark, out).count() == 0
    folder = f"{out}/version={version}/corpus=q/block=000000000"
    (name,) = [n for n in os.listdir(folder) if n.startswith("part-")]
    text = open(f"{folder}/{name}").read()
    for n in os.listdir(folder):
        if n.startswith("."):
            os.remove(f"{folder}/{n}")
    with open(f"{folder}/{name}", "w") as changed:
        changed.write(text.replace("three", "threw"))
    assert [r.corpus for r in packs.damaged_parts(spark, out).collect()] == ["q"]


def test_a_format_of_ones_own(files_table, spark):
    """Events come in order with their depth; the lines of every part follow each other."""
    def write(events):
        for e in events:
            if e.event in ("text", "open"):
                yield "  " * e.depth + (e.name if e.event == "open" else f"{e.name}: {e.content}")

    writers.register_writer("indented", write)
    files = files_table({("p", "b/c/x"): b"1", ("p", "b/a"): b"2", ("p", "z"): b"3", ("q", "a\u00e9"): b"4", ("q", "n"): b"\x00"})
    out = new_path(spark, "packs")
    run(files, replace(PLAIN, format="indented"), out, partitions=3)
    assert pack_text(out, "p")[0] == "p\n  b\n    c\n      x: 1\n    a: 2\n  z: 3\n"
    assert pack_text(out, "q")[0] == "q\n  a\u00e9: 4\n"
    with pytest.raises(ValueError, match="format must be one of"):
        PackOptions(format="nothing of the kind")


BALANCED = """<?xml version="1.0"?>
<a x="1"><b/><c><![CDATA[ </a> <b> ]] ]]]]><![CDATA[> ]]></c>
<c><![CDATA[
</c>
]]></c></a>"""


@pytest.mark.parametrize(
    "text, fault",
    [
        (BALANCED, ""), (BALANCED[:-4], "<a> stays open"), (BALANCED + "</a>", "</a> closes nothing"),
        (BALANCED.replace("</c>\n<c>", "\n<c>"), "</a> closes <c>"), (BALANCED.replace("\n]]></c></a>", ""), "open"),
    ],
)
def test_balance_is_the_same_wherever_lines_are_cut(text, fault):
    lines = text.split("\n")
    for first in range(len(lines) + 1):
        for second in range(first, len(lines) + 1):
            whole = balance.Summary()
            for some in (lines[:first], lines[first:second], lines[second:]):
                outside, inside = balance.summed_up(some), balance.summed_up(some, True)
                whole = balance.joined(whole, inside if whole.inside else outside)
            assert whole == balance.summed_up(lines)
            table = pa.table({"block": ["0"], "part": ["0"], "start": [0], "outside": [balance._packed(whole)], "inside": [""]})
            found = balance._verdict((pa.scalar("p"),), table).column("fault")[0].as_py()
            assert (found or "").endswith(fault) and bool(found) == bool(fault)


def test_parts_grow_with_the_data():
    assert packs.parts_for(0, 4) == 4
    assert packs.parts_for(100 * 2**40, 4) == 409_600


def test_writers_share_a_cache(spark, files_table):
    """A stream that starts on the folder of a batch run loses nothing and counts nothing again."""
    path = new_path(spark, "shared-cache")
    options = PackOptions(model_id="m")
    held = spark.createDataFrame([("h", "m", 9, 0)], tokens.CACHE_SCHEMA)
    token_cache.save_version(held, path, 0)
    count_batch(files_table({("p", "a"): b"one two"}), 0, path, options, "stream-a")
    count_batch(files_table({("p", "a"): b"one two", ("p", "b"): b"three"}), 0, path, options, "stream-b")
    assert token_cache.load_versions(spark, path).count() == 3
    assert {r.tokens for r in token_cache.load(spark, path).collect()} == {9, 2, 1}


def test_parts_beyond_five_digits_sort(spark):
    rows = spark.range(99_990, 100_010).selectExpr("id AS part", f"concat({packs.BLOCK}, '/part-', lpad(id, greatest(5, length(id)), '0')) AS name")
    assert [r.part for r in rows.orderBy("name").collect()] == list(range(99_990, 100_010))


def test_what_is_left_out_is_told(spark, files_table, tmp_path):
    files = files_table({("p", "good"): b"x", ("p", "late"): b"a" * 9000 + b"\xff"})
    result = run(files, PLAIN, new_path(spark, "packs"))
    assert [tuple(r) for r in result.rejects.collect()] == [("p", "read_error", 1)]


def test_read_pack(files_table, spark):
    out = new_path(spark, "packs")
    run(files_table({("github/o/it's", "a"): b"1", ("q", "b"): b"2"}), PLAIN, out)
    lines = {r.value for r in packs.read_pack(spark, out, "github/o/it's").collect()}
    assert '<codebase name="github/o/it\'s">' in lines
    assert '<codebase name="q">' not in lines


# --- whole runs and caches --------------------------------------------------------------


def test_second_run_hits_the_cache(files_table, spark):
    files = files_table({("p", "a"): b"one two", ("p", "b"): b"one two", ("p", "c"): b"three!", ("q", "d"): b"one two"})
    options = PackOptions(respect_gitignore=False, model_id="gpt-4", now_s=1000)
    first = run(files, options, new_path(spark, "packs"))
    cold = {r.corpus: (r.files, r.tokens, r.hits, r.lookups) for r in first.totals.collect()}
    assert cold == {"p": (3, 6, 1, 3), "q": (1, 2, 0, 1)}
    assert first.fresh_cache.count() == 2
    path = new_path(spark, "cache")
    token_cache.save_version(first.fresh_cache, path, 0)
    cache = token_cache.load(spark, path, 2000)
    second = run(files, options, new_path(spark, "packs"), cache=cache)
    warm = {r.corpus: (r.tokens, r.hits, r.lookups) for r in second.totals.collect()}
    assert warm == {"p": (6, 3, 3), "q": (2, 1, 1)}
    assert second.fresh_cache.count() == 0
    assert {r.display_path: r.tokens for r in second.files.collect()}["p/c"] == "2"
    assert token_cache.load(spark, path, 1000 + 7 * 86_400).count() == 0


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), tokens.CACHE_SCHEMA)


def test_versions_of_a_cache(spark):
    path = new_path(spark, "cache")
    assert token_cache.load(spark, path).count() == 0 and token_cache.compact(spark, path) == 0
    token_cache.save_version(entries(spark, ("h", "m", 1, 10), ("g", "m", 2, 10)), path, 0, "w")
    token_cache.save_version(entries(spark, ("h", "m", 5, 20)), path, 1, "w")
    token_cache.save_version(entries(spark, ("h", "m", 6, 20)), path, 1, "w")  # a replay replaces its version
    assert sorted(map(tuple, token_cache.load(spark, path).collect())) == [("g", "m", 2, 10), ("h", "m", 6, 20)]
    assert token_cache.load_versions(spark, path, below=1, writer="w").count() == 2
    # Writes of two runs that name no version are kept apart.
    token_cache.save_version(entries(spark, ("k", "m", 7, 20)), path)
    token_cache.save_version(entries(spark, ("l", "m", 8, 20)), path)
    token_cache.save_version(entries(spark), path)
    assert {r.hash for r in token_cache.load(spark, path).collect()} == {"g", "h", "k", "l"}


def test_a_lookup_opens_only_buckets_that_may_hold_its_hashes(spark, monkeypatch):
    path = new_path(spark, "cache")
    monkeypatch.setattr(token_cache, "BUCKET_ENTRIES", 25)
    for part in range(3):
        token_cache.save_version(entries(spark, *[(f"{part}-{n}", "m", n, 10) for n in range(200)]), path)
    every = token_cache._folders(path, token_cache.live_segments(spark, path))
    assert len(every) == 3 * 8
    wanted = entries(spark, ("1-7", "", 0, 0), ("1-7", "", 0, 0), ("absent", "", 0, 0), (None, "", 0, 0)).select("hash")
    opened = token_cache.folders_for(wanted, path)
    assert set(opened) <= set(every) and len(opened) <= 3  # one that holds it, and few by chance
    assert [tuple(r) for r in token_cache.load_for(wanted, path).collect()] == [("1-7", "m", 7, 10)]
    assert set(token_cache.load_for(wanted, path).inputFiles()) <= {f for f in token_cache.load_versions(spark, path).inputFiles()}
    assert token_cache.folders_for(wanted.limit(0), path) == []


def test_filters_miss_nothing_and_pass_little():
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**63), 2**63 - 1, (4, 20_000))
    packed = token_cache.filter_of(h[0], h[1])
    assert token_cache.may_hold(packed, h[0], h[1]).all()
    assert token_cache.may_hold(packed, h[2], h[3]).mean() < 0.02


def test_compaction_keeps_segments_few_and_entries_newest(spark):
    path = new_path(spark, "cache")
    for n in range(token_cache.FANOUT):
        token_cache.save_version(entries(spark, ("same", "m", n, 10 + n), (f"own{n}", "m", n, 0 if n == 2 else 10)), path)
    before = token_cache.load_versions(spark, path)
    assert token_cache.compact(spark, path, 7 * 86_400 + 5) == token_cache.FANOUT
    live = token_cache.live_segments(spark, path)
    assert live.select("segment").distinct().count() == 1
    found = {r.hash: r.tokens for r in token_cache.load(spark, path).collect()}
    last = token_cache.FANOUT - 1
    assert found == {"same": last, **{f"own{n}": n for n in range(token_cache.FANOUT) if n != 2}}
    assert before.count() == 2 * token_cache.FANOUT  # readers of the segments before are not disturbed
    assert token_cache.compact(spark, path) == 0
    assert [token_cache.tier_of(n) for n in (0, 1, 3, 4, 15, 16, 64)] == [0, 0, 0, 1, 1, 2, 3]


def test_stream_counts_each_content_once_and_replays_safely(files_table, spark):
    options = PackOptions(model_id="m", now_s=10)
    arrived, cache, checkpoint = (new_path(spark, n) for n in ("arrived", "cache", "stream"))

    def arrive(entries):
        files_table(entries).coalesce(1).write.mode("append").parquet(arrived)

    def stream():
        rows = spark.readStream.schema(tables.FILES_SCHEMA).option("maxFilesPerTrigger", 1).parquet(arrived)
        incremental_tokens(rows, cache, checkpoint, options).awaitTermination()

    arrive({("p", "a"): b"one two", ("p", "b"): b"one"})
    arrive({("q", "c"): b"one two"})
    stream()
    arrive({("q", "d"): b"three four five", ("q", "e"): b"one"})
    stream()
    expected = sorted(map(tuple, token_cache.load(spark, cache).select("tokens").collect()))
    assert expected == [(1,), (2,), (3,)]
    assert token_cache.load_versions(spark, cache).count() == 3
    replayed = files_table({("q", "d"): b"three four five", ("q", "e"): b"one"})
    last = token_cache.live_segments(spark, cache).selectExpr("max(struct(version, writer)) AS last").first().last
    count_batch(replayed, last.version, cache, options, last.writer)
    assert token_cache.load_versions(spark, cache).count() == 3


def test_arrivals_are_spread_like_the_table_and_come_in_three_batches(spark, tmp_path, monkeypatch):
    from folio.plans import catalog

    rows = [(n, f"text {n}", "en", "p", 6) for n in range(1, 241)]
    documents = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    documents.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    made = {}
    monkeypatch.setattr(catalog, "new_path", lambda spark, name: made.setdefault(name, new_path(spark, name)))
    found = catalog.QUERIES["incremental_tokens"](spark, str(tmp_path))
    assert found.count() > 100
    assert len([n for n in os.listdir(made["arrived"]) if n.startswith("part-")]) > 3
    assert token_cache.live_segments(spark, made["cache"]).select("version").distinct().count() == 3


# --- plans ------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(files_table):
    return staged(files_table({("p", f"d/{n}.txt"): b"text\n" for n in range(50)}))


def test_reports_do_not_shuffle_contents(stored):
    facts = content.measured(stored, PLAIN)
    misses = tokens.cache_misses(facts, stored.sparkSession.createDataFrame([], tokens.CACHE_SCHEMA), "m")
    for df in (facts.groupBy("corpus").count(), misses):
        for line in plan_of(df).splitlines():
            if "Exchange" in line:
                assert "raw#" not in line and "content#" not in line


def test_contents_are_hashed_and_classified_once(stored):
    from folio.operators import largest, totals

    spark = stored.sparkSession
    facts = content.measured(stored, PLAIN)
    empty = spark.createDataFrame([], tokens.CACHE_SCHEMA)
    misses = tokens.cache_misses(facts, empty, "m")
    for df in (
        misses,
        tokens.cache_hit_rate(facts, empty, "m"),
        tokens.corpus_summary(facts, empty, None, "m"),
        totals.corpus_totals(facts),
        largest.largest_files(totals.file_details(facts)),
        tokens.count_misses(stored, staged(misses), "pieces", "m", 1, PLAIN),
    ):
        plan = plan_of(df)
        assert plan.count("sha2(") <= 1
        assert plan.count("x0E-") == 1


def test_missing_contents_are_counted_where_they_lie(stored, monkeypatch):
    """However many misses there are, ids go to the files and no content is shuffled; ids met by chance change nothing."""
    spark = stored.sparkSession
    other = stored.withColumn("raw", F.expr("encode(concat(path, ' more'), 'utf-8')")).withColumn("size", F.octet_length("raw").cast("bigint"))
    files = staged(stored.unionByName(other))
    facts = content.measured(files, PLAIN)
    misses = staged(tokens.cache_misses(facts, spark.createDataFrame([], tokens.CACHE_SCHEMA), "m"))
    few = misses.where("pmod(xxhash64(hash), 3) = 0")
    assert 0 < few.count() < misses.count() == 51
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for wanted in (misses, few, staged(misses.limit(0))):
            for bits in (2**29, 1):
                monkeypatch.setattr(tokens, "MAX_BITS", bits, raising=False)
                found = tokens.count_misses(files, wanted, "pieces", "m", 1, PLAIN)
                # The one exchange above the scan of the contents is that of their counts by hash.
                ahead = plan_of(found).split("FileScan parquet [corpus")[0]
                assert "BroadcastHashJoin [" in ahead and ahead.count("Exchange hashpartitioning(") == 1
                assert sorted(r.hash for r in found.collect()) == sorted(r.hash for r in wanted.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_packs_are_printed_behind_the_shuffle(stored):
    for options in (PLAIN, XML):
        frame = render.txt_frame(stored.select("corpus").distinct(), options)
        plan = plan_of(packs.ordered(stored, frame, options))
        behind, ahead = plan.split("Exchange ", 1)
        assert "x0E-" in behind and "x0E-" not in ahead


def test_paths_are_filtered_and_counted_without_contents(stored):
    from folio.operators.filters import count_files

    for df in (count_files(stored, PLAIN), tree.directories(stored), tree.pack_order(stored)):
        assert "raw" not in plan_of(df).split("ReadSchema")[1]


def test_top_files_are_limited_before_the_shuffle(stored):
    from folio.operators import largest, totals

    plan = plan_of(largest.largest_files(totals.file_details(content.measured(stored, PLAIN))))
    assert plan.count("WindowGroupLimit") >= 2
