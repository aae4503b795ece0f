"""Sums over segmentations against plain recurrences in decimals, for words of any length."""

from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest

from folio.llm import language

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["themen", "a", "über", "straße" * 30, "三三", "日本語" * 50, "x" * 2000, "information" * 9, "the", "theme", "the"]


def steep(seed, names):
    """Probabilities that lie far apart."""
    p = np.random.default_rng(seed).random((len(language.vocabulary(PIECES)) + 2, names)) ** 6 + 1e-12
    p[0] = 0
    return p / p.sum(0)


def logs_of(word, p):
    known, word = language.vocabulary(PIECES), language.START + word
    sums = [[Decimal(1)] * p.shape[1]] + [[Decimal(0)] * p.shape[1] for _ in word]
    for i in range(len(word)):
        for m in range(1, min(language.longest(PIECES), len(word) - i) + 1):
            piece = known.get(word[i : i + m], language.LONE if m == 1 else 0)
            if piece:
                sums[i + m] = [s + b * Decimal(float(q)) for s, b, q in zip(sums[i + m], sums[i], p[piece])]
    return [float(s.ln()) for s in sums[-1]]


@pytest.mark.parametrize("cells", [100, 100_000])
def test_sums_of_words_of_any_length(cells):
    p, met = steep(1, 3), []
    for places, table in language.lattices(WORDS, PIECES, cells):
        got = language.log_forward(table, p)
        for k, row in zip(places, got):
            assert row == pytest.approx(logs_of(WORDS[k], p), rel=1e-9)
        met += places
    assert sorted(met) == list(range(len(WORDS)))


def test_expected_uses_cover_every_letter():
    p = steep(2, 1)[:, 0]
    letters = {number: len(piece) for piece, number in language.vocabulary(PIECES).items()} | {language.LONE: 1}
    for places, table in language.lattices(WORDS, PIECES):
        weight = np.array([k + 1.0 for k in places])
        counts = language.expected(table, p, weight)
        covered = sum(counts[piece] * letters[piece] for piece in np.flatnonzero(counts))
        assert covered == pytest.approx(sum((len(WORDS[k]) + 1) * (k + 1) for k in places))


def test_expected_uses_are_slopes_of_the_logarithm():
    # Uses of a piece are how fast the logarithm of the sum grows with the logarithm of its probability.
    p = steep(3, 1)
    ((_, table),) = language.lattices(["information" * 9], PIECES)
    counts = language.expected(table, p[:, 0], np.ones(1))
    for piece in np.argsort(-counts)[:8]:
        more = p.copy()
        more[piece] *= 1 + 1e-6
        slope = (language.log_forward(table, more) - language.log_forward(table, p))[0, 0] / 1e-6
        assert counts[piece] == pytest.approx(slope, rel=1e-3, abs=1e-4)


def test_texts_are_scored_the_same_in_any_company():
    p = steep(4, 2)
    model = language.Languages(["a", "b"], np.zeros(2), p, PIECES)
    texts = ["the cat", None, "", "7 ²", "x" * 500 + " information", "the the the"]
    sums, n = language.text_scores(texts, model, "all")
    assert n.tolist() == [2, 0, 0, 0, 2, 3]
    for k, text in enumerate(texts):
        alone, _ = language.text_scores([text], model, f"one {k}")
        assert sums[k] == pytest.approx(alone[0])
        assert sums[k] == pytest.approx(sum((np.array(logs_of(w, p)) for w in language.words_of(text)), np.zeros(2)))
