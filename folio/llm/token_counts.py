"""Token counts of whole texts by rank-synchronous array merging.

A text is split into pre-tokens as the byte-level BPE tokenizer splits it. Pre-tokens that this process has not counted yet
are held together as ragged numpy arrays: all their symbols in a row, with the length of each. In every round each
sequence merges all occurrences of its own pair of lowest rank, all sequences at once, until none has a pair that merges;
the symbols that survive are the tokens. A merge makes a symbol that no pair of lower or equal rank holds, so merging all
occurrences at once gives what merging them one by one gives; of overlapping occurrences the left ones are merged. A
sequence longer than `SCANNED` symbols finds the places of its lowest rank in an index from rank to places, as scanning it
in each round would cost the square of its length; its merges are the same.

Nothing is shuffled: a text is counted where it is read, in portions that end before a single space, where no
pre-token crosses. Counts of pre-tokens are kept per process, up to `KEPT` of them.

Null and empty texts have no tokens. A special token spelled out in a text is one token, as the library counts it.
Repeated rows stay rows; other columns are carried along, those named like the results are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.bpe import MAX_FAST, special_pattern, special_tokens, tokenizer

LIMIT = 1024
#: Pre-tokens whose counts a process keeps.
KEPT = 400_000
#: Characters of text whose pre-tokens are held at once.
PORTION = 1_000_000
#: Symbols of the longest sequence that is scanned in every round.
SCANNED = 256
_NONE = np.int32(2**31 - 1)
#: A single space between two other characters: pre-tokens start here.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_FAR = re.compile(f"[^\0-{chr(ord(MAX_FAST) - 1)}]")


class Merges:
    """The tokenizer's merges as arrays: a sorted pair key for each rank, and the symbol that a rank makes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([self.key(vocab[a], vocab[b]) for a, b in pairs], np.int64)
        self.ranks = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.ranks]
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], np.int64)

    @staticmethod
    def key(left, right):
        return (left << 32) | right

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; `_NONE` where a pair does not merge."""
        keys = self.key(left, right)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    @cached_property
    def by_pair(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist()))


@cache
def merges(path: str) -> Merges:
    return Merges(path)


@cache
def byte_alphabet() -> tuple[str, ...]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return tuple(chr(b if b in shown else next(hidden)) for b in range(256))


def survivors(words: list[bytes], table: Merges) -> np.ndarray:
    """How many symbols are left of each word when no pair of it merges any more."""
    left = np.array([len(w) for w in words], np.int64)
    long = np.flatnonzero(left > SCANNED)
    for k in long.tolist():
        left[k] = _survivors_of_long(words[k], table)
    who = np.flatnonzero((left > 1) & (np.array([len(w) for w in words]) <= SCANNED))
    symbols = table.of_byte[np.frombuffer(b"".join([words[k] for k in who.tolist()]), np.uint8)]
    lengths = left[who]
    ends = np.cumsum(lengths) - 1
    rank = np.full(len(symbols), _NONE, np.int32)
    if len(symbols):
        rank[:-1] = table.rank(symbols[:-1], symbols[1:])
        rank[ends] = _NONE
    while len(who):
        lowest = np.minimum.reduceat(rank, ends - lengths + 1)
        live = lowest != _NONE
        left[who[~live]] = lengths[~live]
        if not live.all():
            stay = np.repeat(live, lengths)
            symbols, rank = symbols[stay], rank[stay]
            who, lengths, lowest = who[live], lengths[live], lowest[live]
            if not len(who):
                break
        owner = np.repeat(np.arange(len(who)), lengths)
        at = np.flatnonzero(rank == lowest[owner])
        # Of places in a row, which share a symbol, every other one merges, beginning on the left.
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        turn = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        at = at[turn % 2 == 0]
        symbols[at] = table.made[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        lengths = lengths - np.bincount(owner[at], minlength=len(who))
        symbols, rank = symbols[keep], rank[keep]
        ends = np.cumsum(lengths) - 1
        new = at - np.arange(len(at))
        touched = np.concatenate([new, np.maximum(new - 1, 0)])
        touched = touched[touched + 1 < len(symbols)]
        rank[touched] = table.rank(symbols[touched], symbols[touched + 1])
        rank[ends] = _NONE
    return left


def _survivors_of_long(word: bytes, table: Merges) -> int:
    """The same for one long sequence: a linked list of symbols, and the places of each rank."""
    symbols = table.of_byte[np.frombuffer(word, np.uint8)].tolist()
    by_pair, made = table.by_pair, table.made
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    places: dict[int, list[int]] = {}
    ranks: list[int] = []

    def note(at: int) -> None:
        rank = by_pair.get((symbols[at] << 32) | symbols[after[at]]) if at >= 0 and after[at] >= 0 else None
        if rank is not None:
            if rank not in places:
                places[rank] = []
                heapq.heappush(ranks, rank)
            places[rank].append(at)

    for at in range(n):
        note(at)
    while ranks:
        rank = heapq.heappop(ranks)
        for at in sorted(set(places.pop(rank))):
            gone = after[at]
            if symbols[at] < 0 or gone < 0 or by_pair.get((symbols[at] << 32) | symbols[gone]) != rank:
                continue
            symbols[at], symbols[gone] = int(made[rank]), -1
            after[at] = after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            n -= 1
            note(at)
            note(before[at])
    return n


@cache
def _splitter() -> re.Pattern:
    """The splitting pattern for Latin texts, its classes written out: `re` is three times as fast as `regex` here."""
    from public_tokenizers import PATTERN

    near = [chr(c) for c in range(ord(MAX_FAST))]
    classes = {name: "".join(re.escape(c) for c in near if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    inside = PATTERN.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(classes.values()) + "]").replace(r"\S", f"[^{classes[chr(92) + 's']}]")
    for name, members in classes.items():
        inside = inside.replace(name, f"[{members}]")
    return re.compile(inside)


def pre_tokens(text: str, path: str) -> list[str]:
    """Pre-tokens in order. Letters beyond the Latin blocks are told apart by the library itself."""
    if _FAR.search(text) is None:
        return _splitter().findall(text)
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    found = tokenizer(path).pre_tokenizer.pre_tokenize_str(text)
    return [bytes(map(byte_of.__getitem__, name)).decode() for name, _ in found]


def portions(text: str) -> Iterator[str]:
    """The text in slices of about `PORTION` characters that split where pre-tokens do."""
    start = 0
    while len(text) - start > PORTION and (found := _BREAK.search(text, start + PORTION)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class Counter:
    """Counts of the pre-tokens that a process has met last."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, list(words)
        self.known.update(zip(new, survivors([w.encode() for w in new], merges(self.path)).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        split = [pre_tokens(t, self.path) for t in texts]
        self.learn(set().union(*split))
        return [sum(map(self.known.__getitem__, words)) for words in split]


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def count_texts(texts: Iterator[str], path: str) -> list[int]:
    """Tokens of each text; pieces of up to `PORTION` characters of several texts are counted together."""
    counter, special, names = _counter(path), special_pattern(path), special_tokens(path)
    totals: list[int] = []
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def settle() -> None:
        for k, n in zip(owners, counter.count(held)):
            totals[k] += n
        held.clear()
        owners.clear()

    for k, text in enumerate(texts):
        totals.append(0)
        parts = [text]
        if special and any(n in text for n in names):
            parts = special.split(text)
            totals[k] = len(parts) // 2
            parts = parts[::2]
        for part in parts:
            for portion in portions(part):
                held.append(portion)
                owners.append(k)
                size += len(portion)
                if size >= PORTION:
                    settle()
                    size = 0
    settle()
    return totals


def count(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit of each whole text."""

    @F.arrow_udf("long")
    def tokens(column: pa.Array) -> pa.Array:
        return pa.array(count_texts((v.as_py() or "" for v in column), path), pa.int64())

    whole = F.col(text)
    sizes = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(whole), F.lit(0)).cast("long"), "n_tokens": tokens(whole)})
    return sizes.withColumn("over_limit", F.col("n_tokens") > limit)
