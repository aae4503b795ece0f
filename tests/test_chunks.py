"""Measures of chunks against those of whole texts, at every place where a file can be cut."""

import hashlib

import pytest

from folio.operators import chunks

TEXTS = [b"", b"\n", b"\r\n", b"\r", b"a\r\nb\r\n\r", "é\r\n漢\n😀x".encode(), b"a" * 9 + b"\n", "😀😀é".encode(), b"\r\r\n\n\r\n"]
BROKEN = [b"ab\xff", b"\x80abc", "漢字漢字".encode()[:-1], b"ok\xe6\xbcok more", b"aaaa\xed\xa0\x80b", b"\xf5aaaaa", b"\xc0\xafaaaa", b"aa\x80\x80\x80\x80a"]


def model(raw):
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return (len(raw), None, None, False)
    lines = text.split("\n")[: -1 if text.endswith("\n") or not text else None]
    chars = sum(len(x.removesuffix("\r") if k < text.count("\n") else x) + 1 for k, x in enumerate(lines))
    return (len(raw), len(lines), chars, True)


def cut(raw):
    """Chunks of four bytes and more: every first cut, then pieces of four."""
    yield [raw]
    for at in range(4, len(raw)):
        yield [raw[:at], raw[at:]]
        yield [raw[:at], *[raw[k : k + 4] for k in range(at, len(raw), 4)]]


def test_every_cut(spark):
    rows, wanted = [], {}
    for k, raw in enumerate([*TEXTS, *BROKEN]):
        for n, parts in enumerate(cut(raw)):
            wanted["p", f"{k}/{n}"] = (model(raw), hashlib.sha256(raw).hexdigest())
            rows += [("p", f"{k}/{n}", i, bytearray(part)) for i, part in enumerate(parts)]
    table = spark.createDataFrame(rows, chunks.CHUNKS).repartition(3)
    found = {(r.corpus, r.path): (r.size, r.lines, r.chars, r.valid) for r in chunks.measures(chunks.states(table)).collect()}
    assert found == {key: value for key, (value, _) in wanted.items()}
    assert {(r.corpus, r.path): r.hash for r in chunks.hashes(table).collect()} == {key: h for key, (_, h) in wanted.items()}


@pytest.mark.parametrize("size", [4, 1000])
def test_chunks_of_a_tree(spark, shore, size):
    entries = [("shore", str(shore), str(p.relative_to(shore)), p.stat().st_size) for p in shore.rglob("*") if p.is_file()]
    listed = spark.createDataFrame(entries, "corpus STRING, root STRING, path STRING, size BIGINT")
    found = {r.path: (r.size, r.lines, r.chars, r.valid) for r in chunks.measures(chunks.states(chunks.read_chunks(listed, size))).collect()}
    assert found == {p: model((shore / p).read_bytes()) for _, _, p, _ in entries}
