"""The training-data operators against brute force on small tables with every odd case."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from folio.llm import bpe, chat, language, lines, near_dedup, packing, pages, quality, search, winnowing
from folio.llm.components import components
from folio.llm.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, part int"
ODD = [
    (1, None), (2, ""), (3, "   "), (4, "\n\n"), (5, "one"), (5, "one"), (6, " a  b\n\n c <|endoftext|> x\ty "),
    (7, "日本語　テキスト  émile\x1c\x1c!"), (8, "\x00 nul \x00"), (None, "no id don't"), (None, None), (9, "word " * 9000),
    (10, "x" * 50_000), (11, "!\x1c \x85\x85 a"),
]


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "kept", 0) for i, t in pairs], SCHEMA)


def library():
    return bpe.tokenizer(BPE)


def test_bpe_round_trip(spark):
    found = bpe.decode(bpe.encode(rows(spark, ODD), BPE, block_bytes=30_000), BPE).collect()
    assert len(found) == len(ODD) and {r.part for r in found} == {0}
    for r in found:
        ids = library().encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library().decode(ids, skip_special_tokens=False)
    assert bpe.encode(rows(spark, []), BPE).count() == 0


def test_cuts_cost_as_little_as_any():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(2, 40)
        at = np.array([0, *sorted(rng.sample(range(1, 4 * n), n - 1))])
        keep = [0]
        for p in at[1:]:
            while p - keep[-1] > 16:
                keep.append(keep[-1] + 16)
            keep.append(int(p))
        at = np.array(sorted(set(keep)))
        pen = np.array([rng.randint(0, 9) for _ in at])

        def window(size):
            free = size & (size - 1) == 0 and size >= min(packing.LEAST_POWER, 16)
            return (0 if free else 16 - size) + packing.WINDOW_COST

        best = [0] + [math.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + window(at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= 16)
        cut = packing.cuts(at, pen, 16)
        place = {int(p): k for k, p in enumerate(at)}
        assert sum(window(b - a) + pen[place[b]] for a, b in zip(cut, cut[1:])) == best[-1]


def test_packing_keeps_every_id_once(spark):
    docs = rows(spark, ODD + [(100 + k, "A sentence of some words. " * (k % 50)) for k in range(300)])
    pieces = packing.pack(docs, BPE).collect()
    windows = collections.defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    for parts in windows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    by_doc = collections.defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
    for doc_id, text in [(1, None), (2, ""), (6, ODD[6][1]), (9, ODD[11][1]), (149, "A sentence of some words. " * 49)]:
        parts = sorted(by_doc[doc_id], key=lambda r: r.start)
        want = library().encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == want
        assert {r.doc_tokens for r in parts} == {len(want)}
    assert sum(r.length for r in by_doc[5]) == 2 * (len(library().encode("one").ids) + 1)
    assert packing.pack(rows(spark, []), BPE).count() == 0


def test_layouts_give_the_same_turns(spark):
    records = [
        '{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}',
        '{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"id": 3, "instruction": "q", "output": "a"}', '{"id": 4, "prompt": "q", "completion": "a"}',
        '{"id": 5, "prompt": "q", "response": "a"}', '{"id": 6, "instruction": "q", "input": "", "output": "a"}',
        "no json", None, '{"id": 7}',
    ]
    turns = chat.canonical_records(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    by_id = collections.defaultdict(list)
    for t in sorted(turns):
        by_id[t.conv_id].append((t.role, t.text))
    assert set(by_id) == {1, 2, 3, 4, 5, 6} and {tuple(v) for v in by_id.values()} == {(("user", "q"), ("assistant", "a"))}
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1,)], "other int"))


def test_chat_reads_back(spark):
    nasty = ["<|im_end|>\n", "<\\|im_start|>", "[INST]\\[/INST]</s><s>", "<<SYS>>x<</SYS>>", "", None, "<", "<|", "é\n\n", "\\"]
    table = [(k, j, role, t) for k, t in enumerate(nasty) for j, role in enumerate(["us\ner\\n", "assistant", None])]
    table += [(99, 0, "user", "again"), (99, 0, "user", "again"), (None, None, "assistant", "lost")]
    turns = chat.canonical(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS extra"))
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}
    for k, t in enumerate(nasty):
        assert [tuple(x) for x in got[k].turns] == [("us\ner\\n", t or ""), ("assistant", t or ""), ("", t or "")]
        assert got[k].loss_text == (t or "")
    assert len(got[99].turns) == 2 and got[None].loss_text == "lost"
    assert chat.formatted(turns.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(200)], k=rng.randint(0, 60)))) for k in range(400)]
    docs += [(400, None), (401, ""), (402, docs[0][1]), (403, docs[0][1])]
    table = rows(spark, docs)
    index = search.build(table, shard_bytes=20_000)
    assert index.select("shard").distinct().count() > 2
    found = search.search(index, table.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), k=5).collect()
    bags = {i: collections.Counter((t or "").split()) for i, t in docs}
    df = collections.Counter(w for b in bags.values() for w in b)
    size = {i: sum(b.values()) for i, b in bags.items()}
    mean = sum(size.values()) / len(bags)
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r.rank):
        got[r.query_id].append((r.doc_id, r.score))
    for q in [i for i in bags if i % 20 == 0]:
        scores = {
            i: sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w in bags[q] if w in b)
            for i, b in bags.items()
        }
        want = sorted(((-s, i) for i, s in scores.items() if s > 0))[:5]
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in want], rel=1e-4)
    assert search.search(search.build(rows(spark, [])), rows(spark, []).withColumnRenamed("doc_id", "query_id")).count() == 0


def test_quality_on_held_out_rows(spark):
    found = QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in found if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_quality_of_odd_texts(spark):
    none = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    got = quality.score(rows(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(0.99 < r.score <= 1 for r in got)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.predict(x) > 0.5) == y).mean() > 0.95
    # One row walked by hand through the flattened trees.
    raw = trees.base
    for f, t, v in zip(trees.feature, trees.threshold, trees.value):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(x[7][f[node]] > t[node])
        raw += v[node - len(f)]
    assert trees.predict(x[7:8])[0] == pytest.approx(1 / (1 + math.exp(-raw)))


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    own = lines.Cuckoo(len(keys))
    own.insert(keys)
    own = lines.Cuckoo.from_bytes(own.to_bytes())
    assert own.contains(keys).all()
    assert own.contains(rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.01
    own.delete(keys[:10_000])
    assert own.contains(keys[10_000:]).all() and own.contains(keys[:10_000]).mean() < 0.01
    tight = lines.Cuckoo(1)
    tight.insert(keys[:50])
    assert tight.contains(keys[:50]).all() and tight.overflow


def kept_lines(docs):
    holders = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    return sorted(
        (i, "\n".join(x for x in (t or "").split("\n") if len(key(x).decode()) < 10 or min(holders[key(x)]) == i)) for i, t in docs
    )


def test_lines_can_come_and_go(spark):
    first = [(1, "A shared line\nown line of one\nshort"), (2, "\ta SHARED line \nshort\nown line of two"), (3, None), (4, "ééééé ééé\nééééé éééé"), (5, "ÉÉÉÉÉ éééé\nééééé ÉÉÉÉ")]
    more = [(0, "a shared line"), (6, "own line of two\nown line of two\n")]

    def kept(index, docs):
        return sorted((r.doc_id, r.kept_text) for r in lines.dedup(rows(spark, docs), index.drops()).collect())

    index = lines.LineIndex.build(rows(spark, first), shard_keys=1)
    assert kept(index, first) == kept_lines(first)
    grown = index.insert(rows(spark, more))
    assert kept(grown, first + more) == kept_lines(first + more)
    back = grown.delete(rows(spark, more))
    assert kept(back, first) == kept_lines(first)
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, index.refs.collect()))
    nothing = lines.LineIndex.build(rows(spark, []))
    assert nothing.drops().count() == 0
    counted = lines.dedup(rows(spark, [(None, "x\ny"), (2, "")]), nothing.drops()).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept_text, r.part) for r in counted) == [(1, 0, "", 0), (2, 0, "x\ny", 0)]


def test_winnowing(spark):
    docs = [(k, " ".join(f"w{(7 * k + j) % 500}x{k % 9}" for j in range(10 * k))) for k in range(12)]
    docs += [(50, None), (51, ""), (52, docs[11][1]), (53, "one two"), (54, "y" * 5000), (52, docs[11][1]), (None, "a b c")]
    found = winnowing.fingerprints(rows(spark, docs)).collect()
    assert len(found) == len(docs) and "PythonUDF" not in str(winnowing.fingerprints(rows(spark, docs))._jdf.queryExecution().toString())
    texts = {i: t or "" for i, t in docs}
    ids = sorted((i for i in texts if i is not None), reverse=True) + [None]
    following = {a: ids[(k + 1) % len(ids)] for k, a in enumerate(ids)}
    for r in found:
        text = texts[r.doc_id]
        q = len(text) // 3
        assert r.edited == text[: len(text) - q] + texts[following[r.doc_id]][:q] and r.n_chars == len(text)
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[52] == prints[11] and prints[50] == prints[51] == ""
    # Every window of grams has its smallest hash, the rightmost of equals, among the chosen.
    text = "a b " * 40
    marks = spark.sql(f"SELECT {winnowing.chosen(repr(text))} AS m").first().m
    places = [2**27 - 1 - (m & (2**27 - 1)) for m in marks]
    # 77 grams of two alternating hashes: each of the 62 windows chooses the rightmost of the smaller.
    assert len(places) == 31 and all(b - a == 2 for a, b in zip(places, places[1:]))
    assert winnowing.fingerprints(rows(spark, [])).count() == 0


def test_winnowing_without_white_space(spark):
    rng = random.Random(5)
    for start, size in ((0x4E00, 3000), (0x20000, 3000), (0x61, 26)):
        text = "".join(chr(start + rng.randrange(size)) for _ in range(400))
        other = "".join(chr(start + rng.randrange(size)) for _ in range(150))
        asked = {"whole": text, "moved": chr(start) + text, "part": other[:77] + text[100:119] + other[77:]}
        values = ", ".join(f"('{k}', '{v}')" for k, v in asked.items())
        marks = spark.sql(f"SELECT k, {winnowing.hashes_of(winnowing.chosen('t'))} AS m FROM VALUES {values} AS v(k, t)").collect()
        found = {r.k: set(r.m) for r in marks}
        assert len(found["whole"] & found["moved"]) >= 0.9 * len(found["whole"] | found["moved"])
        assert found["whole"] & found["part"]


def test_pages(spark):
    nav = "<nav><ul><li><a href=x>menu</a></ul></nav>"
    html = {
        1: f"<body>{nav}<div class='post'><p>a &amp; b&nbsp; c<ul><li>x<li>y</ul><div id=comments><p>no</div></div><aside>n</aside>tail &lt;",
        2: "<main><h1>T</h1><p>a<b>b</b>c<br>d</p><form>q<input></form><section class='reader-comments'>z</section></main><footer>f",
        3: None, 4: "", 5: "<", 6: "a < b > c", 7: "<p>x<script>if(a<b)</script>y</p", 8: "<!-- <p>no</p> --><p>yes", 9: "<p>" + "long " * 20_000,
    }
    table = [(k, "http://host.test/x", h, "extra") for k, h in html.items()] + [(10, None, "<p>q", "extra"), (10, None, "<p>q", "extra")]
    table += [(100 + k, "http://shop.test/", f"<body><div><a href=/>Home</a></div><p>Shown everywhere</p><div class=t><p>Text {k}</p></div>", "") for k in range(12)]
    df = spark.createDataFrame(table, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert got[1] == "a & b c\nx\ny\ntail <" and got[2] == "T\nabc d"
    assert (got[3], got[4], got[5], got[6], got[7], got[8], got[10]) == ("", "", "<", "a < b > c", "xy", "yes", "q")
    assert got[9] == ("long " * 20_000).strip()
    # The template of a host: its links and the text on all of its pages are no content.
    assert [got[100 + k] for k in range(12)] == [f"Text {k}" for k in range(12)]
    assert pages.extract(df.limit(0)).count() == 0


def host_pages(spark, htmls):
    table = [(k, "http://one.test/", h) for k, h in enumerate(htmls)]
    found = pages.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_links_in_sentences_stay(spark):
    # A menu goes with its separators; a sentence keeps its links, also where its other words are the same on every page.
    menu = "<div class=m><a href=/>Home</a> | <a href=/n>News</a> | <a href=/{0}>Page {0}</a></div>"
    post = "<div class=post><p>See <a href=x><b>the</b> report</a> for {0} more<p><a href=/{0}>Link {0}</a><p>Words and words {0}</div>"
    got = host_pages(spark, [(menu + post).format(k) for k in range(8)])
    assert got == [f"See the report for {k} more\nLink {k}\nWords and words {k}" for k in range(8)]


def test_only_attributes_frame_an_element():
    label = pages.label
    assert label("div", ' style="overflow:hidden" title="The hidden gem" data-class="footer"') == label("a", ' href="/a?id=footer"').replace("a", "div")
    assert label("p", " class = 'a  b' ID=c HIDDEN role=Main class=nav") == "p.a b c@main!" and label("p", ' class="w-1/2 !m"') == "p.w-1_2 _m"
    assert label("img", ' title="it\'s hidden" alt=\'say "id=nav"\' hidden=""') == "img!"
    for name in ("article-header", "side-by-side", "search-results", "form-factor", "alert-history", "notice-of-award"):
        assert pages.page_text(f"<article><div class={name}>kept</div><p>x</article>") == "kept\nx", name
    for name in ("site-header", "reader-comments", "sidebar", "NAV", "x search-form", "cookie-banner", "related_posts"):
        assert pages.page_text(f"<main><div class='{name}'>gone</div><p>x</main>") == "x", name
    assert pages.page_text('<main><p style="overflow:hidden">a<p title="The hidden gem">b<a href="/a?id=footer">c</a><p hidden>d') == "a\nbc"


def test_every_layout_of_a_host_is_template(spark):
    # Three layouts, each on a third of the pages, with varying numbers of paragraphs; a passage that some pages share is text.
    made, want = [], []
    for k in range(30):
        kind, paragraphs = "abc"[k % 3], [f"Own {k} {j}" for j in range(1 + k % 4)] + ["Passage one", "Passage two"] * (k < 6)
        body = "".join(f"<p>{t}</p>" for t in paragraphs)
        made.append(f"<body><div class=l{kind}><p>Shop {kind}</p><div>{body}</div><p>Call {kind} now</p></div></body>")
        want.append("\n".join(paragraphs))
    assert host_pages(spark, made) == want
    # A text on most pages whose occurrences no other token shares is in no class.
    made = [f"<body><p>Own {k}</p>{'<p>Some news</p>' * (k > 2)}</body>" for k in range(12)]
    made = [m + f"<p>more {k}</p>" * (k % 2) for k, m in enumerate(made)]
    assert ["Some news" in t for t in host_pages(spark, made)] == [k > 2 for k in range(12)]
    # Two texts of one class on most pages are in it.
    made = [f"<body><p>Own {k}</p>{'<p>Some news</p><p>Other news</p>' * (k > 2)}{f'<p>more {k}</p>' * (k % 2)}</body>" for k in range(12)]
    assert host_pages(spark, made) == [f"Own {k}" + f"\nmore {k}" * (k % 2) for k in range(12)]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(2)
    known = language.vocabulary(PIECES)
    p = rng.random((len(known) + 2, 2)) / 50
    p[0] = 0
    word = "themen"

    def total(rest):
        if not rest:
            return np.ones(2)
        out = np.zeros(2)
        for m in range(1, len(rest) + 1):
            piece = known.get(rest[:m], language.LONE if m == 1 else 0)
            if piece:
                out += p[piece] * total(rest[m:])
        return out

    ((_, table),) = language.lattices([word], PIECES)
    assert language.forward(table, p)[0] == pytest.approx(total(language.START + word))


def test_the_longest_pieces_count():
    known = language.vocabulary(PIECES)
    piece = max(known, key=len)
    assert len(piece) == language.longest(PIECES) > 8 and piece[0] == language.START
    p = np.zeros((len(known) + 2, 1))
    p[known[piece]] = 0.25
    ((_, table),) = language.lattices([piece[1:]], PIECES)
    assert language.forward(table, p).tolist() == [[0.25]]
    counts = language.expected(table, p[:, 0], np.array([3.0]))
    assert counts[known[piece]] == pytest.approx(3) and counts.sum() == pytest.approx(3)


def test_words_have_letters():
    assert language.words_of("x² ² ½ Ⅷ 三 été 7") == ["x²", "三", "été"]
    assert language.words_of("²" * 100 + " \u0660") == language.words_of(None) == []


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect() if r.lang}
    found = [r for r in QUERIES["op9_language"](spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    model = language.train(docs.limit(0), PIECES)
    assert {(r.lang_pred, r.score) for r in language.identify(rows(spark, ODD), model).collect()} == {("und", 0.0)}
    model = language.train(docs.limit(60), PIECES)
    odd = {r.doc_id: r for r in language.identify(rows(spark, ODD), model).collect()}
    assert all((odd[k].lang_pred, odd[k].score) == ("und", 0.0) for k in (1, 2, 3, 4)) and odd[5].lang_pred != "und"
    assert all(0 <= r.score <= 1 and r.part == 0 for r in odd.values())


def test_small_languages_are_learned(spark):
    # Three documents of one language among very many of another.
    many = spark.range(40_000).selectExpr("id AS doc_id", "'the cat sat on the mat' AS text", "'en' AS lang")
    few = spark.createDataFrame([(100_000 + k, "le chat est assis sur le tapis", "fr") for k in range(3)], many.schema)
    model = language.train(many.unionByName(few), PIECES)
    assert model.names == ["en", "fr"] and all(p.max() > 9 * p[2:].min() for p in model.p.T)
    asked = spark.createDataFrame([(1, "le chat sur le tapis"), (2, "the cat on the mat")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()} == {1: "fr", 2: "en"}


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(7, 7)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {v: got.get(v, v) for v in parent} == {v: root(v) for v in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "PARTNERS", 3)
    rng = random.Random(6)
    words = [f"v{k}" for k in range(400)]
    docs, base = [], [rng.choices(words, k=120) for _ in range(6)]
    for k in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((1000 - k, " ".join(text)))
    docs += [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A B"), (6, "a b c"), (None, docs[0][1]), (7, docs[3][1]), (7, docs[3][1]), (8, "ä b c d e")]
    sets = {i: frozenset(near_dedup.shingles(t).tolist()) for i, t in docs}
    parent = {i: i for i in sets if i is not None}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in parent:
        for b in parent:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = near_dedup.link(rows(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        want = root(r.doc_id) if r.doc_id is not None else None
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want, r.doc_id is not None and want == r.doc_id)
    assert near_dedup.link(rows(spark, [])).count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(8)
    for common in (60, 300, 1500):
        for share in (0.6, 0.8, 0.95):
            alone = int(common * (1 - share) / share / 2)
            pool = rng.integers(0, 2**63, common + 2 * alone, dtype=np.uint64)
            a, b = np.sort(pool[: common + alone]), np.sort(np.concatenate([pool[:common], pool[common + alone :]]))
            marks = np.array([near_dedup.odd_sketch(s) for s in (a, b)], np.int64).view(np.uint64)
            assert near_dedup.estimates(marks[:1], marks[1])[0] == pytest.approx(common / (common + 2 * alone), abs=near_dedup.SLACK)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(spark, name):
    import duckdb

    base = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    answer = base.execute(CHECKS[name])
    names = [column[0] for column in answer.description]
    assert sorted(got.columns) == sorted(names)
    # Whole rows as they are: a query may give several rows for one id, and nulls.
    want = sorted(answer.fetchall(), key=repr)
    assert want and sorted(map(tuple, got.select(names).collect()), key=repr) == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids
        ids = now
    assert re.sub(r"\s", "", "".join(r.text for r in docs.collect()))
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in pieces} == ids
