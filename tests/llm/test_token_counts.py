"""Token counts against the library, and merging against merging one pair after the other."""

import random

import public_tokenizers
import pytest

from folio.llm import bpe, token_counts
from folio.llm.queries import QUERIES
from tests.llm.test_llm import FOLDER, ODD, rows

BPE = public_tokenizers.path("byte_bpe_50k.json")


def wanted(text):
    return len(bpe.tokenizer(BPE).encode(text or "", add_special_tokens=False).ids)


def strings(seed, alphabet, lengths):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(n)) for n in lengths]


@pytest.mark.parametrize(
    "alphabet",
    ["abcdeéüß \n\t'.,!0129\xa0\x85\x1c\x1fAZ<|>²½ªº", ["a", "日本", "и", " ", "  ", "\n", "’s", "'s", "٣", "ǅ", "　", "<|endoftext|>"], "ab"],
)
def test_counts_of_mixed_texts(alphabet):
    texts = strings(4, alphabet, [n % 70 for n in range(400)])
    assert token_counts.count_texts(iter(texts), BPE) == [wanted(t) for t in texts]


@pytest.mark.parametrize("length", [255, 256, 257, 5000])
def test_long_runs_without_space(length):
    """The index from rank to places gives what scanning gives, on both sides of the bound."""
    table = token_counts.merges(BPE)
    for text in [*strings(length, "abcdefghijklmnopqrstuvwxyz", [length]), *strings(length, "ab", [length]), "x" * length]:
        n = wanted(text)
        assert token_counts.survivors([text.encode()], table).tolist() == [n]
        assert token_counts._survivors_of_long(text.encode(), table) == n


def test_sequences_do_not_touch_each_other():
    words = strings(9, "theing ", [n % 40 for n in range(500)])
    together = token_counts.survivors([w.encode() for w in words], token_counts.merges(BPE)).tolist()
    assert together == [len(w) and int(token_counts.survivors([w.encode()], token_counts.merges(BPE))[0]) for w in words]


def test_portions_and_kept_counts_change_nothing(monkeypatch):
    texts = strings(5, "ab cd  e\nf's <|endoftext|>", [300] * 20)
    plain = [wanted(t) for t in texts]
    monkeypatch.setattr(token_counts, "PORTION", 16)
    monkeypatch.setattr(token_counts, "KEPT", 5)
    assert all("".join(token_counts.portions(t)) == t for t in texts)
    assert token_counts.count_texts(iter(texts), BPE) == plain


def test_odd_rows_and_clashing_columns(spark):
    docs = rows(spark, ODD).selectExpr("*", "'x' AS n_tokens", "true AS over_limit", "1 AS n_bytes")
    found = token_counts.count(docs, BPE, limit=3).collect()
    assert len(found) == len(ODD)
    assert {r.ids for r in found} == {"kept"}
    for r in found:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), wanted(r.text))
        assert r.over_limit == (r.n_tokens > 3)
    assert token_counts.count(rows(spark, []), BPE).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op13_token_counts"](spark, FOLDER).collect()
    assert {r.doc_id for r in found} == set(texts) and len(found) == len(texts)
    for r in found:
        assert (r.n_tokens, r.over_limit) == (wanted(texts[r.doc_id]), wanted(texts[r.doc_id]) > 1024)
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())
