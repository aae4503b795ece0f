"""Language identification by unigram pieces, summed over all segmentations.

A word is a run of letters in lower case, led by the mark of a word's start. Each language has a probability for every
piece of a fixed public vocabulary; the probability of a word is the sum, over all ways to cut it into pieces, of the
products of their probabilities, which the forward algorithm gives without listing the ways. Probabilities come from
expectation maximisation: expected counts of pieces are summed by Spark over the distinct words of each language.

A text is scored by the sum over its words plus the log share of the language; `score` is the share of the winner among
all languages, as a probability. Texts that are null or have no letter, and all texts when nothing could be learned, are
`und` with score 0. Words of any length are scored whole. Ties go to the language that comes first by
name. All labelled documents are learned from. Repeated rows are scored alike; other columns are carried along.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import staged

ROUNDS = 3
SMOOTHING = 0.1
#: Scores of words, by language, that a process keeps; beyond it the table starts anew.
KEPT_SCORES = 1_600_000
#: Letters of words that are cut into pieces at a time.
CELLS = 200_000
#: Words of a language that are gathered before their pieces are counted.
GATHERED = 40_000
#: Places between two scalings of running sums; so many factors cannot make them vanish.
SCALE_EVERY = 16
SLOT_BITS = 18
START = "▁"
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Piece numbers: no such piece, and a character that the vocabulary lacks.
NO_PIECE, LONE = 0, 1


@cache
def vocabulary(path: str) -> dict[str, int]:
    """Pieces made of letters, with or without the start mark, numbered from 2 on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        body = piece.removeprefix(START)
        if piece == START or body.isalpha() and body == body.lower():
            found.setdefault(piece, len(found) + 2)
    return found


@cache
def longest(path: str) -> int:
    """Characters of the longest piece of the vocabulary, 1 at least."""
    return max(map(len, vocabulary(path)), default=1)


def words_of(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    if found and not text.isascii():  # signs such as ² or Ⅷ are numbers without being digits
        found = [w for w in found if w.isalpha() or any(map(str.isalpha, w))]
    return found


def _grown(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one letter longer."""
    mixed = (hashes ^ letters) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def _letters(words: list[str], length: int) -> np.ndarray:
    """Code points, a column per word, zeros behind its end."""
    joined = "".join([w.ljust(length, "\0") for w in words]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4").reshape(len(words), length).T.astype(np.uint64, order="C")


@cache
def _tables(path: str) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """Beginnings of pieces by the hash of their letters, with the piece's number or `NO_PIECE`: tables of slots, each
    with those that found their slot taken in the one before."""
    known = {piece[:m]: NO_PIECE for piece in vocabulary(path) for m in range(1, len(piece) + 1)} | vocabulary(path)
    hashes, numbers = np.zeros(len(known), np.uint64), np.array(list(known.values()), np.int32)
    for column in _letters(list(known), longest(path)):
        hashes = np.where(column > 0, _grown(hashes, column), hashes)
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two pieces of the vocabulary have one hash")
    made = []
    while len(hashes):
        shift = np.uint64(64 - SLOT_BITS - 3 * len(made))
        slots = (hashes >> shift) & np.uint64(2**SLOT_BITS - 1)
        _, first = np.unique(slots, return_index=True)
        keys, values = np.zeros(2**SLOT_BITS, np.uint64), np.zeros(2**SLOT_BITS, np.int32)
        keys[slots[first]], values[slots[first]] = hashes[first], numbers[first]
        made.append((shift, keys, values))
        hashes, numbers = np.delete(hashes, first), np.delete(numbers, first)
    return made


def _looked_up(hashes: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether each begins a piece, and the piece that it is."""
    known, numbers, left = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int32), None
    for shift, keys, values in _tables(path):
        asked = hashes if left is None else hashes[left]
        slot = ((asked >> shift) & np.uint64(2**SLOT_BITS - 1)).astype(np.intp)
        held = keys[slot]
        hit = np.flatnonzero(held == asked)
        at = hit if left is None else left[hit]
        known[at], numbers[at] = True, values[slot[hit]]
        # A free slot ends the search.
        other = np.flatnonzero((held != asked) & (held != 0))
        left = other if left is None else left[other]
    return known, numbers


def _groups(words: list[str], cells: int) -> Iterator[tuple[list[int], int]]:
    """Places of words of like length and the longest of each group; a group has about `cells` letters at most."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    first = 0
    while first < len(order):
        least, last = len(words[order[first]]), first
        while last < len(order):
            length = len(words[order[last]])
            if length > least + least // 8 or last > first and (last - first + 1) * (length + 1) > cells:
                break
            last += 1
        yield order[first:last], len(words[order[last - 1]]) + 1
        first = last


def lattices(words: list[str], path: str, cells: int = CELLS) -> Iterator[tuple[list[int], np.ndarray]]:
    """For words of like length at a time: their places, and the piece that has m + 1 characters and starts at i, by m, i
    and word. Behind a word's end there are no pieces."""
    most = longest(path)
    for places, length in _groups(words, cells):
        letters = _letters([START + words[k] for k in places], length).ravel()
        n = len(places)
        table = np.zeros((most, len(letters)), np.int32)
        at = np.flatnonzero(letters)
        hashes = np.zeros(len(at), np.uint64)
        for m in range(most):
            # Strings that begin a piece so far are grown by a letter, if their words have one more.
            more = at + m * n
            on = np.flatnonzero(more < len(letters)) if m else np.arange(len(at))
            on = on[letters[more[on]] != 0]
            at, hashes = at[on], _grown(hashes[on], letters[more[on]])
            known, numbers = _looked_up(hashes, path)
            table[m, at] = numbers
            at, hashes = at[known], hashes[known]
        table[0][(table[0] == NO_PIECE) & (letters > 0)] = LONE
        yield places, table.reshape(most, length, n)


def _ends(table: np.ndarray) -> np.ndarray:
    return np.count_nonzero(table[0], axis=0)


def log_forward(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over all segmentations, for every word and language; p: pieces by languages. Sums are kept for
    as many places as a piece may span and scaled as they go, so no length of a word makes them vanish."""
    most, length, n = table.shape
    ends = _ends(table)
    sums = np.zeros((most + 1, n, p.shape[1]))
    sums[0] = 1
    taken, result = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
    for i in range(length + 1):
        now = sums[i % (most + 1)]
        done = np.flatnonzero(ends == i)
        if len(done):
            result[done] = np.log(now[done]) + taken[done]
        if i == length:
            break
        if i % SCALE_EVERY == SCALE_EVERY - 1:
            top = sums.max(0)
            top[top == 0] = 1
            sums /= top
            taken += np.log(top)
        for m in range(min(most, length - i)):
            column = table[m, i]
            some = np.flatnonzero(column)
            if len(some) == n:
                sums[(i + m + 1) % (most + 1)] += now * p[column]
            elif len(some):
                sums[(i + m + 1) % (most + 1), some] += now[some] * p[column[some]]
        now[:] = 0
    return result


def forward(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sums themselves, which long words bring down to zero."""
    return np.exp(log_forward(table, p))


def expected(table: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in words of one language, each counted `weight` times."""
    most, length, n = table.shape
    ends, every = _ends(table), np.arange(n)
    before, after = np.zeros((length + 1, n)), np.zeros((length + 1, n))
    before[0], after[ends, every] = 1, 1
    # Logarithms of what has been taken out of the sums at each place.
    taken, given = np.zeros((length + 1, n)), np.zeros((length + 1, n))

    def scaled(sums: np.ndarray, logs: np.ndarray, window: slice, rest: slice) -> None:
        top = sums[window].max(0)
        top[top == 0] = 1
        sums[window] /= top
        logs[rest] += np.log(top)

    spans = []
    for i in range(length):
        if i % SCALE_EVERY == SCALE_EVERY - 1:
            scaled(before, taken, slice(i, i + most), slice(i, None))
        for m in range(min(most, length - i)):
            at = np.flatnonzero(table[m, i])
            if len(at):  # spans without a piece add nothing
                piece = table[m, i, at]
                spans.append((i, m, at, piece))
                before[i + m + 1, at] += before[i, at] * p[piece]
    last = length
    for i, m, at, piece in reversed(spans):
        if i != last:
            last = i
            if i % SCALE_EVERY == SCALE_EVERY - 1:
                scaled(after, given, slice(i + 1, i + most + 1), slice(0, i + most + 1))
        after[i, at] += after[i + m + 1, at] * p[piece]
    total = np.maximum(before[ends, every], 1e-300)
    whole = taken[ends, every]
    pieces, uses = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, m, at, piece in spans:
        part = before[i, at] * p[piece] * after[i + m + 1, at]
        if length >= SCALE_EVERY:
            part *= np.exp(taken[i, at] + given[i + m + 1, at] - whole[at])
        pieces.append(piece)
        uses.append(part * weight[at] / total[at])
    counts = np.bincount(np.concatenate(pieces), np.concatenate(uses), len(p))
    counts[NO_PIECE] = 0
    return counts


@dataclass
class Languages:
    names: list[str]
    log_share: np.ndarray
    p: np.ndarray
    path: str


def train(labelled: DataFrame, path: str, text: str = "text", lang: str = "lang") -> Languages:
    """Piece probabilities from all rows with a text and a language."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    shares = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    names = sorted(shares)
    total = sum(shares.values())

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for name, value in zip(batch[lang], batch[text]):
                counts[name].update(words_of(value))
            yield pd.DataFrame([(g, w, c) for g, ws in counts.items() for w, c in ws.items()], columns=["g", "w", "c"])

    words = rows.select(lang, text).mapInPandas(count_words, "g string, w string, c long")
    words = staged(words.groupBy("g", "w").agg(F.sum("c").alias("c")), "language-words")
    size = len(vocabulary(path)) + 2
    p = np.full((size, max(1, len(names))), 1.0 / size)
    p[NO_PIECE] = 0
    for _ in range(ROUNDS if names else 0):
        now = p

        def uses(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            sums = np.zeros_like(now)
            held = defaultdict(lambda: ([], []))

            def count(g: str) -> None:
                k, (found, weights) = names.index(g), held.pop(g)
                weight = np.array(weights, np.float64)
                for places, table in lattices(found, path):
                    sums[:, k] += expected(table, now[:, k], weight[places])

            for batch in batches:
                for g, part in batch.groupby("g"):
                    held[g][0].extend(part["w"])
                    held[g][1].extend(part["c"])
                    if len(held[g][0]) >= GATHERED:
                        count(g)
            for g in list(held):
                count(g)
            piece, k = np.nonzero(sums)
            yield pd.DataFrame({"piece": piece, "k": k, "uses": sums[piece, k]})

        # At most one row per piece of the vocabulary and language.
        got = words.mapInPandas(uses, "piece long, k long, uses double").groupBy("piece", "k").agg(F.sum("uses").alias("u"))
        counts = np.zeros_like(p)
        for r in got.toLocalIterator():
            counts[r.piece, r.k] = r.u
        p = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * size)
        p[NO_PIECE] = 0
    log_share = np.log(np.array([shares[n] / total for n in names])) if names else np.zeros(1)
    return Languages(names, log_share, p, path)


class _WordScores(dict):
    """Numbers of words in the order in which they were met, and the scores of those met before the last texts."""

    def __init__(self, token: str = "", names: int = 0):
        super().__init__()
        self.token, self.scores, self.met = token, np.zeros((1024, names)), []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.met.append(word)
        return number

    def score_met(self, model: Languages) -> None:
        first, names = len(self) - len(self.met), len(model.names)
        if len(self) > len(self.scores):
            grown = np.zeros((len(self) + len(self) // 4, names))
            grown[:first] = self.scores[:first]
            self.scores = grown
        for places, table in lattices(self.met, model.path, CELLS * 4 // max(4, names)):
            self.scores[first + np.array(places)] = log_forward(table, model.p)
        self.met = []


_KEPT = [_WordScores()]


def text_scores(texts, model: Languages, token: str) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of texts by language, and their numbers of words."""
    found = [words_of(t) for t in texts]
    names = len(model.names)
    if _KEPT[0].token != token or len(_KEPT[0]) * names > KEPT_SCORES:
        _KEPT[0] = _WordScores(token, names)
    kept = _KEPT[0]
    n = np.array([len(ws) for ws in found], np.int64)
    sums = np.zeros((len(found), names))
    some = np.flatnonzero(n)
    if len(some):
        at = np.fromiter(map(kept.__getitem__, chain.from_iterable(found)), np.int64, n.sum())
        kept.score_met(model)
        starts = np.concatenate([[0], np.cumsum(n[some])])
        for k in range(0, len(some), 32):  # a few texts at a time, as each word takes a row of scores
            edges = starts[k : k + 33]
            sums[some[k : k + 32]] = np.add.reduceat(kept.scores[at[edges[0] : edges[-1]]], edges[:-1] - edges[0])
    return sums, n


def identify(df: DataFrame, model: Languages, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`df` with the most likely language and its probability."""
    import uuid

    token = uuid.uuid4().hex
    spread = df.sparkSession.sparkContext.broadcast(model)  # pieces by languages: bounded by the vocabulary

    @F.pandas_udf("lang string, score double")
    def identified(texts: pd.Series) -> pd.DataFrame:
        model = spread.value
        if not model.names:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0})
        langs, scores = [], []
        values = texts.tolist()
        for k in range(0, len(values), 500):
            sums, n = text_scores(values[k : k + 500], model, token)
            total = sums + model.log_share
            best = total.argmax(1)
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            langs += [model.names[b] if c else UNKNOWN for b, c in zip(best, n)]
            scores += np.where(n > 0, p, 0.0).tolist()
        return pd.DataFrame({"lang": langs, "score": scores})

    # The struct is made once, behind a step that is not folded into the two columns that are read from it.
    return df.withColumn("__language", identified(F.col(text))).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in (lang, score)],
        F.col("__language.lang").alias(lang),
        F.col("__language.score").alias(score),
    )
