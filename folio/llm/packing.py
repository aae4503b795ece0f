"""Packs token streams into windows by order-preserving dynamic programming.

Documents keep their order; a window is a stretch of the token stream of at most `window` tokens. Windows end at document
ends or sentence ends (in long runs without either, also at every `HARD_STEP`th token). A cut costs its truncation penalty
and a window its padding, unless its length is a power of two, plus a fixed `WINDOW_COST`. The best earlier cut within a
window's reach is a sliding minimum, kept by a monotone queue, so the work is linear in the number of possible cuts.

Each task packs its own rows in the order in which it reads them: nothing is shuffled, and only the last window of a task
is padded for want of rows. Within a task the stream is packed in stretches; the last window of a stretch opens the next.

Null texts are empty; every document ends with the id `end`, so an empty one is that id alone. Repeated rows are packed
once each; an empty table gives no rows; other columns are left out of the pieces.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folio.llm import bpe

WINDOW = 2048
STRETCH_TOKENS = 400_000
SENTENCE_PENALTY = 3
HARD_PENALTY = 12
HARD_STEP = 32
WINDOW_COST = 8
#: Lengths below this are not worth a window of their own, though they need no padding.
LEAST_POWER = 256
#: Units kept per process; beyond it the table starts anew.
KEPT_UNITS = 600_000
PIECES = "{id} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(positions: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cheapest cuts, as positions; the first position opens the stream and the last ends it."""
    n = len(positions)
    powers = []
    size = 1
    while size < window:
        if size >= min(LEAST_POWER, window):
            at = np.searchsorted(positions, positions - size)
            powers.append(np.where(positions[np.minimum(at, n - 1)] == positions - size, at, -1))
        size *= 2
    free = np.stack(powers).max(axis=0) if powers else np.full(n, -1)
    shared = (np.stack(powers) >= 0).sum(axis=0) > 1 if powers else np.zeros(n, bool)
    several = {int(j): [int(p[j]) for p in powers if p[j] >= 0] for j in np.flatnonzero(shared)}
    pos, pen, free = positions.tolist(), penalties.tolist(), free.tolist()
    cost, back = [0] * n, [0] * n
    # The queue holds candidates by rising cost + position; that sum decides between starts of a padded window.
    queue = deque([(pos[0], pos[0], 0)])
    for j in range(1, n):
        p = pos[j]
        least = p - window
        while queue[0][1] < least:
            queue.popleft()
        key, _, i = queue[0]
        best = key + window - p
        if free[j] >= 0:
            for k in several.get(j, (free[j],)):
                if cost[k] < best:
                    best, i = cost[k], k
        best += pen[j] + WINDOW_COST
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [], n - 1
    while j:
        out.append(pos[j])
        j = back[j]
    out.append(pos[0])
    return out[::-1]


@cache
def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its piece closes a sentence or a line."""
    closing = re.compile(rb"[.!?\n][\"')\]]*\s*\Z")
    return np.array([bool(closing.search(p)) for p in bpe.pieces(path)])


_KNOWN: dict[str, dict[str, bytes]] = {}
#: Letters that only the tokenizers library itself splits as it does.
_FAR = re.compile(f"[{bpe.MAX_FAST}-\U0010ffff]")


def text_ids(text: str, path: str) -> bytes:
    """Ids of one text. A text of Latin letters is encoded whole; of others the units that this process has not met."""
    fast = bpe.merger(path)
    if fast is not None and _FAR.search(text) is None and not any(t in text for t in bpe.special_tokens(path)):
        return array("I", fast.encode_ordinary(text)).tobytes()
    known = _KNOWN.setdefault(path, {})
    names = bpe.units(text, path)
    try:
        return b"".join([known[n] for n in names])
    except KeyError:
        if len(known) > KEPT_UNITS:
            known.clear()
        new = list({n for n in names if n not in known})
        known.update(zip(new, bpe.encode_units(new, path)))
        return b"".join([known[n] for n in names])


def stretch_cuts(lengths: np.ndarray, ids: np.ndarray, closing: np.ndarray, window: int) -> list[int]:
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    inner = np.flatnonzero(closing[ids]) + 1
    penalty = np.full(total + 1, -1, np.int64)
    penalty[inner] = SENTENCE_PENALTY
    penalty[ends] = 0
    penalty[0] = 0
    known = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(known) > 2 * HARD_STEP)
    for k in wide.tolist():
        penalty[np.arange(known[k] + HARD_STEP, known[k + 1], HARD_STEP)] = HARD_PENALTY
    positions = np.flatnonzero(penalty >= 0)
    return cuts(positions, penalty[positions], window)


def _pack(id_column: str, text: str, path: str, end: int, window: int, kind: pa.DataType):
    names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        closing = sentence_ends(path)
        # Open documents: id, start of the rest, ids of the rest, ids in all.
        waiting: list[tuple[object, int, bytes, int]] = []
        held = 0

        def emit(final: bool) -> pa.RecordBatch:
            nonlocal waiting, sequence, held
            lengths = np.array([len(raw) // 4 for _, _, raw, _ in waiting], np.int64)
            ends = np.cumsum(lengths)
            stream = b"".join([raw for _, _, raw, _ in waiting])
            at = stretch_cuts(lengths, np.frombuffer(stream, "<u4"), closing, window)
            stop = len(at) if final else max(2, len(at) - 1)
            at = np.array(at[:stop], np.int64)
            limit = int(at[-1])
            edges = np.unique(np.concatenate([at, ends[ends < limit]]))
            first, until = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, first, side="right")
            window_no = np.searchsorted(at, first, side="right") - 1
            opened = ends - lengths
            starts = np.array([s for _, s, _, _ in waiting], np.int64)
            totals = np.array([t for _, _, _, t in waiting], np.int64)
            out = pa.record_batch(
                [
                    pa.array([waiting[d][0] for d in doc.tolist()], kind),
                    pa.array(starts[doc] + first - opened[doc]),
                    pa.array(until - first),
                    pa.array([stream[4 * a : 4 * b] for a, b in zip(first.tolist(), until.tolist())], pa.binary()),
                    pa.array(totals[doc]),
                    pa.array(sequence + window_no),
                    pa.array(first - at[window_no]),
                ],
                names=names,
            )
            sequence += len(at) - 1
            rest = []
            for k in range(int(np.searchsorted(ends, limit, side="right")), len(waiting)):
                key, start, raw, total = waiting[k]
                skip = max(0, limit - int(opened[k]))
                rest.append((key, start + skip, raw[4 * skip :], total))
            waiting, held = rest, int(ends[-1]) - limit
            return out

        for batch in batches:
            for key, value in zip(batch.column(id_column).to_pylist(), batch.column(text)):
                raw = text_ids(value.as_py() or "", path) + last
                waiting.append((key, 0, raw, len(raw) // 4))
                held += len(raw) // 4
                if held >= STRETCH_TOKENS:
                    yield emit(final=False)
        if waiting:
            yield emit(final=True)

    return run


def pack(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = 1, window: int = WINDOW
) -> DataFrame:
    """One row per piece of a document: its ids, where they start in the document and where they lie in a window.

    `window` is a power of two, so a full window needs no padding.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    kind = docs.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = PIECES.format(id=f"`{doc_id}`", kind=kind.simpleString())
    return docs.select(doc_id, text).mapInArrow(_pack(doc_id, text, path, end, window, to_arrow_type(kind)), schema)
