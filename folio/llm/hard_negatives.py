"""Hard negatives by a vertical scan with branch and bound (BOND).

Rows (an id, a label, a vector of whole numbers) and anchors are packed by the task that reads them. Every block of about
`ROWS` rows meets every group of about `ANCHORS` anchors in one cell of a grid, which a shuffle deals out: a cell receives
packed groups first and packed blocks after them and streams over the blocks. So the work is that of a stated query set
against all rows, in blocks, and a task holds one group and one block whatever the table's size.

In a block the vectors lie by dimension, with the least and the greatest value of each. An anchor reads dimensions in
descending order of its own magnitudes, a few at a time, into partial scores. What the unread dimensions can still
add or take away bounds the score of every candidate, and a bitmap of candidates shrinks by these bounds:

1. Positives: candidates are rows of the anchor's label. Those that cannot reach the `positives`-th best lower bound, in
   this block or in those before, go. The best of all cells are the anchor's positives.
2. Negatives: candidates are rows of other labels. Those whose bounds leave the span of the anchor's windows, from the
   scores of its positives, go. When all dimensions are read the scores are exact, and each window takes its first rows.

Higher scores come first, ties by smaller id. Rows without id, label or vector, and vectors with a null or non-finite
component, take no part; an empty vector scores 0 with other empty ones. Vectors are compared with those of as many
components. Repeated rows count each for itself; rows that share the anchor's id are not other rows. Scores beyond a long
are cut to its ends before windows are drawn. Other columns are ignored. An anchor without positives has no rows, nor has an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import parts_for, staged

#: Rows of a block and anchors of a group: what a cell of the grid compares at once.
ROWS = 16_384
ANCHORS = 512
#: Dimensions read between two looks at the bounds, at first; doubled each time.
STEP = 8
#: Shuffle partitions of the grid at most; cells share them beyond.
TASKS = 100_000
SCALE = 256.0
_ANCHORS, _WINDOWS, _ROWS = 0, 1, 2
_PACKED = "kind int, dims int, piece long, n int, data binary"
_CELLS = "kind int, dims int, chunk int, bucket int, data binary"
_LONG = 2**63 - 1


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x); as Python's integers where products could pass what a long holds."""
    whole = np.floor(vectors * SCALE)
    top = float(np.abs(whole).max(initial=0.0))
    if top * top * max(1, whole.shape[1]) < 2.0**52:
        return whole
    return _exact(whole)


def _exact(whole: np.ndarray) -> np.ndarray:
    """Whole numbers as Python's integers."""
    return np.array([int(x) for x in whole.ravel().tolist()], object).reshape(whole.shape)


def _packed(**arrays: np.ndarray) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def _opened(raw: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(raw)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    if any("vectors" in p and p["vectors"].dtype == object for p in parts):
        parts = [{n: _exact(a) if n == "vectors" and a.dtype != object else a for n, a in p.items()} for p in parts]
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def _packs(anchor_step: int, rows: int, anchors: int):
    """Batches of (id, label, vector) as packed rows and packed anchors of one length each."""

    def pack(kind: int, dims: int, number: int, part: dict) -> pa.RecordBatch:
        values = [[kind], [dims], [number], [len(part["ids"])], [_packed(**part)]]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(v, t) for v, t in zip(values, types)], names=_names(_PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("id").to_numpy()
            labels = batch.column("label").to_numpy()
            lists = batch.column("vector")
            sizes = lists.value_lengths().to_numpy()
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                flat = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dims)
                chosen = np.flatnonzero(ids[at] % anchor_step == 0)
                for kind, which, size in ((_ROWS, np.arange(len(at)), rows), (_ANCHORS, chosen, anchors)):
                    for some in np.array_split(which, -(-len(which) // size)) if len(which) else ():
                        part = {"ids": ids[at[some]], "labels": labels[at[some]], "vectors": quantised(flat[some])}
                        if kind == _ANCHORS:
                            part["numbers"] = number + np.arange(len(some), dtype=np.int64)
                        yield pack(kind, dims, number, part)
                        number += len(some)

    return run


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class Block:
    """Rows by dimension, with the range of each, and the rows of each label."""

    def __init__(self, part: dict[str, np.ndarray]):
        self.ids, self.labels = part["ids"], part["labels"]
        self.columns = np.ascontiguousarray(part["vectors"].T)
        self.low = self.columns.min(axis=1) if len(self.ids) else np.zeros(len(self.columns))
        self.high = self.columns.max(axis=1) if len(self.ids) else np.zeros(len(self.columns))

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, passes) -> tuple[np.ndarray, np.ndarray]:
        """Rows among `candidates` that `passes(least, greatest)` never turned down, and their exact scores."""
        if self.columns.dtype == object and anchor.dtype != object:
            anchor = _exact(anchor)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor * self.low, anchor * self.high
        least, most = np.minimum(*ends)[order], np.maximum(*ends)[order]
        below, above = least.sum() - np.cumsum(least), most.sum() - np.cumsum(most)
        scores = np.zeros(len(candidates), np.result_type(anchor.dtype, self.columns.dtype))
        at, step = 0, STEP
        while at < len(order) and len(candidates):
            read = order[at : at + step]
            at, step = at + len(read), step * 2
            whole = len(candidates) == len(self.ids)
            columns = self.columns[read] if whole else self.columns[read[:, None], candidates[None, :]]
            scores = scores + anchor[read] @ columns
            bitmap = passes(scores + below[at - 1], scores + above[at - 1]).astype(bool)
            if not bitmap.all():
                candidates, scores = candidates[bitmap], scores[bitmap]
        if not len(order) and len(candidates):
            bitmap = passes(scores, scores).astype(bool)
            candidates, scores = candidates[bitmap], scores[bitmap]
        return candidates, scores


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by smaller id."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    if scores.dtype == object:  # exact integers, which numpy sorts by one key only
        return np.array(sorted(near.tolist(), key=lambda k: (-scores[k], ids[k]))[:n], np.int64)
    return near[np.lexsort((ids[near], -scores[near]))[:n]]


def _to_long(score) -> int:
    return max(-_LONG - 1, min(_LONG, int(score)))


class Positives:
    """The best rows of its label for every anchor of a group, over the blocks seen so far."""

    schema = "anchor_no long, anchor_id long, other_id long, score long"

    def __init__(self, group: dict[str, np.ndarray], windows, take: int):
        self.group, self.take = group, take
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(group["ids"])

    def meet(self, block: Block) -> None:
        group, take = self.group, self.take
        of_label = {label: np.flatnonzero(block.labels == label) for label in np.unique(group["labels"]).tolist()}
        for k in range(len(group["ids"])):
            scores, ids = self.best[k]
            candidates = of_label[int(group["labels"][k])]
            candidates = candidates[block.ids[candidates] != group["ids"][k]]
            known = scores[take - 1] if len(scores) >= take else None

            def passes(least, greatest, known=known):
                bar = known
                if len(least) > take:
                    own = np.partition(least, len(least) - take)[len(least) - take]
                    bar = own if bar is None else max(bar, own)
                return np.ones(len(least), bool) if bar is None else greatest >= bar

            found, exact = block.scan(group["vectors"][k], candidates, passes)
            scores, ids = np.concatenate([scores, exact]), np.concatenate([ids, block.ids[found]])
            first = _first(scores, ids, take)
            self.best[k] = scores[first], ids[first]

    def rows(self) -> list[tuple]:
        group = zip(self.group["numbers"].tolist(), self.group["ids"].tolist(), self.best)
        return [(no, anchor, i, _to_long(s)) for no, anchor, (scores, ids) in group for s, i in zip(scores, ids.tolist())]


class Negatives:
    """The first rows of other labels in each window of every anchor of a group, over the blocks seen so far."""

    schema = "anchor_no long, place int, negative_id long, negative_score long"

    def __init__(self, group: dict[str, np.ndarray], windows: dict[str, np.ndarray], take: int):
        self.group, self.take = group, take
        self.windows: dict[int, list[tuple]] = {}
        for no, place, low, high in zip(*(windows[c].tolist() for c in ("numbers", "places", "lows", "highs"))):
            self.windows.setdefault(no, []).append((place, low, high))
        self.best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def meet(self, block: Block) -> None:
        group = self.group
        others = {label: np.flatnonzero(block.labels != label) for label in np.unique(group["labels"]).tolist()}
        for k, no in enumerate(group["numbers"].tolist()):
            windows = self.windows.get(no)
            if not windows:
                continue
            low, high = min(w[1] for w in windows), max(w[2] for w in windows)
            candidates = others[int(group["labels"][k])]
            candidates = candidates[block.ids[candidates] != group["ids"][k]]
            found, exact = block.scan(group["vectors"][k], candidates, lambda least, most: (most >= low) & (least <= high))
            for place, low_, high_ in windows:
                inside = np.flatnonzero((exact >= low_) & (exact <= high_))
                if len(inside):
                    scores, ids = self.best.get((no, place), (exact[:0], block.ids[:0]))
                    scores = np.concatenate([scores, exact[inside]])
                    ids = np.concatenate([ids, block.ids[found[inside]]])
                    first = _first(scores, ids, self.take)
                    self.best[no, place] = scores[first], ids[first]

    def rows(self) -> list[tuple]:
        return [
            (no, place, i, _to_long(s))
            for (no, place), (scores, ids) in self.best.items() for s, i in zip(scores, ids.tolist())
        ]


def _cell_scan(kind, take: int, rows: int):
    """Over cells in order, each with its anchors first: what `kind` keeps of every group."""
    names = _names(kind.schema)
    types = [pa.int32() if f.endswith(" int") else pa.int64() for f in kind.schema.split(", ")]

    def told(found) -> Iterator[pa.RecordBatch]:
        for some in batched(found.rows() if found else (), 50_000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, groups, windows, found, held = None, [], [], None, []

        def settle() -> None:
            nonlocal found
            if held and groups:
                if found is None:
                    none = {c: np.zeros(0, object) for c in ("numbers", "places", "lows", "highs")}
                    found = kind(_joined(groups), _joined(windows) if windows else none, take)
                found.meet(Block(_joined(held)))
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                key = tuple(batch.column(c)[k].as_py() for c in ("dims", "chunk", "bucket"))
                if key != cell:
                    settle()
                    yield from told(found)
                    cell, groups, windows, found = key, [], [], None
                which, part = batch.column("kind")[k].as_py(), _opened(batch.column("data")[k].as_py())
                {_ANCHORS: groups, _WINDOWS: windows, _ROWS: held}[which].append(part)
                if which == _ROWS and sum(len(p["ids"]) for p in held) >= rows:
                    settle()
        settle()
        yield from told(found)

    return run


class Grid:
    """Packed rows and anchors, and how many buckets and chunks they are dealt to."""

    def __init__(self, rows: DataFrame, anchor_step: int, block_rows: int = ROWS, anchors: int = ANCHORS):
        self.packed = staged(rows.mapInArrow(_packs(anchor_step, block_rows, anchors), _PACKED), "vectors")
        counts = {r.kind: r.n for r in self.packed.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        self.block_rows = block_rows
        self.buckets = parts_for(counts.get(_ROWS, 0), block_rows)
        self.chunks = parts_for(counts.get(_ANCHORS, 0), anchors)

    def scan(self, kind, take: int, windows: DataFrame | None = None) -> DataFrame:
        """What `kind` finds in every cell."""
        of_rows = self.packed.where(F.col("kind") == _ROWS).selectExpr(
            "kind", "dims", f"explode(sequence(0, {self.chunks - 1})) AS chunk",
            f"cast(pmod(xxhash64(piece), {self.buckets}) AS INT) AS bucket", "data",
        )
        of_anchors = self.packed.where(F.col("kind") == _ANCHORS).selectExpr("kind", "dims", f"{self.chunk('piece')} AS chunk", "data")
        if windows is not None:
            of_anchors = of_anchors.unionByName(windows)
        every = f"explode(sequence(0, {self.buckets - 1})) AS bucket"
        cells = of_rows.unionByName(of_anchors.selectExpr("kind", "dims", "chunk", every, "data"))
        tasks = min(TASKS, self.buckets * self.chunks)
        dealt = cells.repartition(tasks, "dims", "chunk", "bucket").sortWithinPartitions("dims", "chunk", "bucket", "kind")
        return dealt.mapInArrow(_cell_scan(kind, take, self.block_rows), kind.schema)

    def chunk(self, piece: str) -> str:
        return f"cast(pmod(xxhash64({piece}), {self.chunks}) AS INT)"

    def anchor_places(self) -> DataFrame:
        """(anchor_no, dims, chunk) of every anchor; a pack numbers its anchors from its own number on."""
        numbers = "explode(sequence(piece, piece + n - 1)) AS anchor_no"
        return self.packed.where((F.col("kind") == _ANCHORS) & (F.col("n") > 0)).selectExpr("dims", f"{self.chunk('piece')} AS chunk", numbers)


def _window_packs(low_percent: int, high_percent: int):
    """Score windows of a chunk's anchors as one packed row; whole numbers, so the bounds round inwards."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        scores = table.column("score").to_pylist()
        part = {
            "numbers": np.array(table.column("anchor_no").to_pylist(), object),
            "places": np.array(table.column("place").to_pylist(), object),
            "lows": np.array([-((-low_percent * s) // 100) for s in scores], object),
            "highs": np.array([high_percent * s // 100 for s in scores], object),
        }
        values = [[_WINDOWS], [key[0].as_py()], [key[1].as_py()], [_packed(**part)]]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("kind", "dims", "chunk", "data"), values, types)})

    return run


def usable(df: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    whole = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity'))"
    rows = df.where(f"{vec_id} IS NOT NULL AND {label} IS NOT NULL AND {vector} IS NOT NULL AND {whole}")
    return rows.selectExpr(
        f"cast({vec_id} AS BIGINT) AS id", f"cast({label} AS BIGINT) AS label", f"cast({vector} AS ARRAY<DOUBLE>) AS vector"
    )


def mine(
    df: DataFrame,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    anchor_step: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    block_rows: int = ROWS,
    anchors: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, the ids divisible by `anchor_step`."""
    grid = Grid(usable(df, vec_id, label, vector), anchor_step, block_rows, anchors)
    found = grid.scan(Positives, positives)
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY anchor_no ORDER BY score DESC, other_id) AS place")
    best = staged(ranked.where(F.col("place") <= positives), "positives")
    placed = best.join(grid.anchor_places(), "anchor_no")
    windows = placed.groupBy("dims", "chunk").applyInArrow(_window_packs(low_percent, high_percent), "kind int, dims int, chunk int, data binary")
    near = grid.scan(Negatives, negatives, windows)
    order = "row_number() OVER (PARTITION BY anchor_no, place ORDER BY negative_score DESC, negative_id) AS rank"
    kept = near.selectExpr("*", order).where(F.col("rank") <= negatives)
    return kept.join(best.withColumnRenamed("score", "positive_score"), ["anchor_no", "place"]).selectExpr(
        "anchor_id", "other_id AS positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
