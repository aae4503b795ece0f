"""Line dedup with sharded cuckoo filters over exact reference-count tables.

A line's key is the line trimmed of white space and with A-Z in lower case; keys are compared by 128-bit hashes. The exact
table holds one row per (key, document); counts and smallest documents follow from it. Keys fall into shards by hash;
a shard's cuckoo filter holds the fingerprints of the keys that lie in more than one document. A line asks its shard's
filter first, and only lines that the filter admits are looked up in the exact table, so a filter's false alarms cost
time and never change a result. Adding documents adds rows and fingerprints, removing documents takes rows away and
deletes the fingerprints of keys that fell to one document: nothing is hashed anew for what stays.

A key of at least `LEAST` code points that lies in two or more documents keeps its lines in the smallest doc_id only. A
null or empty text is one empty line. Rows that share a doc_id are one document. Rows with a null doc_id are kept whole
and hold no line. Other columns are carried along; one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import SPACES, parts_for, staged

LEAST = 10
SHARD_KEYS = 500_000
#: Copies of a shard's filter, so that a line found everywhere is looked up by as many tasks.
SALTS = 8
BUCKET = 4
MAX_KICKS = 500
_TRIM = SPACES.encode()


def line_keys(text: str | None) -> list[bytes]:
    """The 128-bit key of each line that may be dropped, else b"", in order."""
    out = []
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        key = line.strip(_TRIM).lower()
        if len(key) >= 4 * LEAST or len(key) >= LEAST and len(key.decode("utf-8", "replace")) >= LEAST:
            out.append(xxhash.xxh3_128_digest(key))
        else:
            out.append(b"")
    return out


class Cuckoo:
    """A cuckoo filter over 64-bit hashes: 16-bit fingerprints, four to a bucket, a power of two of buckets.

    Bulk insertion settles what fits at once with array operations and moves entries about only for the rest. A
    fingerprint that finds no place after many moves doubles nothing and loses nothing: it goes to an exact overflow.
    """

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (BUCKET * 0.85) + 1))))
        self.slots = np.zeros((self.buckets, BUCKET), np.uint16)
        self.overflow: set[int] = set()

    def _homes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.buckets - 1)
        print_ = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = hashes & mask
        return print_, first, (first ^ self._shift(print_)) & mask

    def _shift(self, print_: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (print_.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3)

    def insert(self, hashes: np.ndarray) -> None:
        hashes = np.unique(hashes.astype(np.uint64))
        print_, first, second = self._homes(hashes)
        left = np.arange(len(hashes))
        for home in (first, second):
            for slot in range(BUCKET):
                if len(left):
                    free = left[self.slots[home[left], slot] == 0]
                    _, pick = np.unique(home[free], return_index=True)
                    taken = free[pick]
                    self.slots[home[taken], slot] = print_[taken]
                    left = np.setdiff1d(left, taken, assume_unique=True)
        rng = np.random.default_rng(7)
        for k in left.tolist():
            self._place(int(hashes[k]), int(print_[k]), int(first[k]), rng)

    def _place(self, key: int, mark: int, home: int, rng) -> None:
        moves = []
        for _ in range(MAX_KICKS):
            row = self.slots[home]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return
            slot = int(rng.integers(BUCKET))
            moves.append((home, slot, int(row[slot])))
            row[slot], mark = mark, int(row[slot])
            home = (home ^ int(self._shift(np.array([mark], np.uint16))[0])) & (self.buckets - 1)
        for place, slot, old in reversed(moves):  # undo: the newcomer alone goes to the overflow
            self.slots[place, slot] = old
        self.overflow.add(key)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.astype(np.uint64)
        print_, first, second = self._homes(hashes)
        found = (self.slots[first] == print_[:, None]).any(1) | (self.slots[second] == print_[:, None]).any(1)
        if self.overflow:
            found |= np.isin(hashes, np.array(sorted(self.overflow), np.uint64))
        return found

    def delete(self, hashes: np.ndarray) -> None:
        """Deletes hashes that were inserted."""
        hashes = hashes.astype(np.uint64)
        print_, first, second = self._homes(hashes)
        for key, mark, *homes in zip(hashes.tolist(), print_.tolist(), first.tolist(), second.tolist()):
            if key in self.overflow:
                self.overflow.discard(key)
                continue
            for home in homes:
                at = np.flatnonzero(self.slots[home] == mark)
                if len(at):
                    self.slots[home, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return np.array([self.buckets, *sorted(self.overflow)], np.uint64).tobytes() + b"|" + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Cuckoo:
        buckets = int(np.frombuffer(raw[:8], np.uint64)[0])
        size = buckets * BUCKET * 2
        made = cls.__new__(cls)
        made.buckets = buckets
        made.slots = np.frombuffer(raw[-size:], np.uint16).reshape(buckets, BUCKET).copy()
        made.overflow = set(np.frombuffer(raw[8 : -size - 1], np.uint64).tolist())
        return made


def references(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The exact table: one row (key, doc_id) for each key that a document holds."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, value in zip(batch.column(doc_id).to_pylist(), batch.column(text)):
                own = {k for k in line_keys(value.as_py()) if k}
                ids += [doc] * len(own)
                keys += own
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, batch.schema.field(doc_id).type)], names=["key", "doc_id"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(doc_id, text)
    return rows.mapInArrow(run, f"key binary, doc_id {kind}").distinct()


def counts(refs: DataFrame) -> DataFrame:
    """Documents that hold each key, and the smallest of them; summed in part before the shuffle."""
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def shard_of(key: str, shards: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("int")


def _hash64(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2]


def filters(shared: DataFrame, shards: int) -> DataFrame:
    """One cuckoo filter per shard over the keys of `shared`: (shard, filter)."""

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_hash64(b.column("key").to_pylist()) for b in batches]
        hashes = np.concatenate(parts)
        made = Cuckoo(len(hashes))
        made.insert(hashes)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([made.to_bytes()], pa.binary())], names=["shard", "filter"])

    return shared.select(shard_of("key", shards).alias("shard"), "key").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def changed_filters(old: DataFrame, gained: DataFrame, lost: DataFrame, shards: int) -> DataFrame:
    """The filters after some keys came to be shared and others ceased to be."""
    change = gained.select("key", F.lit(True).alias("more")).unionByName(lost.select("key", F.lit(False).alias("more")))

    def apply(held: pa.Table, change: pa.Table) -> pa.Table:
        raw = held.column("filter").to_pylist()
        shard = (held if held.num_rows else change).column("shard")[0].as_py()
        more = np.array(change.column("more").to_pylist(), bool)
        keys = change.column("key").to_pylist()
        hashes = _hash64(keys) if keys else np.zeros(0, np.uint64)
        made = Cuckoo.from_bytes(raw[0]) if raw else Cuckoo(int(more.sum()))
        made.delete(hashes[~more])
        made.insert(hashes[more])
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

    keyed = change.select(shard_of("key", shards).alias("shard"), "key", "more")
    return old.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(apply, "shard int, filter binary")


class LineIndex:
    """References, shared keys and filters of a set of documents; adding and removing documents give a new index."""

    def __init__(self, refs: DataFrame, shared: DataFrame, filters_: DataFrame, shards: int):
        self.refs, self.shared, self.filters, self.shards = refs, shared, filters_, shards

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS) -> LineIndex:
        refs = staged(references(docs, doc_id, text), "line-refs")
        shared = staged(counts(refs).where("n_docs > 1"), "line-shared")
        shards = parts_for(shared.count(), shard_keys)
        return cls(refs, shared, staged(filters(shared, shards), "line-filters"), shards)

    def _changed(self, refs: DataFrame) -> LineIndex:
        refs = staged(refs, "line-refs")
        shared = staged(counts(refs).where("n_docs > 1"), "line-shared")
        gained, lost = (a.join(b, "key", "left_anti") for a, b in ((shared, self.shared), (self.shared, shared)))
        made = changed_filters(self.filters, gained, lost, self.shards)
        return LineIndex(refs, shared, staged(made, "line-filters"), self.shards)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        return self._changed(self.refs.unionByName(references(docs, doc_id, text)).distinct())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents named in the column doc_id: as if they had never been added."""
        return self._changed(self.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select("key", "doc_id"))

    def drops(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines leave a document."""
        n = self.shards

        def admitted(lines: pa.Table, held: pa.Table) -> pa.Table:
            raw = held.column("filter").to_pylist()
            keys = lines.column("key").to_pylist()
            if not raw or not keys:
                return lines.slice(0, 0).select(["key", "doc_id"])
            return lines.filter(pa.array(Cuckoo.from_bytes(raw[0]).contains(_hash64(keys)))).select(["key", "doc_id"])

        kind = self.refs.schema["doc_id"].dataType.simpleString()
        lines = self.refs.select("key", "doc_id", shard_of("key", n).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
        salted = self.filters.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        maybe = lines.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(admitted, f"key binary, doc_id {kind}")
        exact = self.shared.select("key", "first_doc", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        maybe = maybe.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        losers = maybe.join(exact, ["key", "salt"]).where("doc_id > first_doc")
        return losers.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup(docs: DataFrame, drops: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n_lines, n_dropped and kept_text: its lines without those whose keys it loses."""

    @F.arrow_udf("n_lines long, n_dropped long, kept_text string")
    def cut(texts: pa.Array, keys: pa.Array) -> pa.Array:
        n, dropped, kept = [], [], []
        for value, lost in zip(texts, keys):
            text = value.as_py() or ""
            lines = text.split("\n")
            n.append(len(lines))
            if lost.is_valid:
                gone = set(lost.as_py())
                stay = [line for line, key in zip(lines, line_keys(text)) if key not in gone]
                dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            else:
                dropped.append(0)
                kept.append(text)
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["n_lines", "n_dropped", "kept_text"]
        )

    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    joined = docs.join(drops.select(F.col("doc_id").alias("__doc"), F.col("keys").alias("__keys")), F.col(doc_id) == F.col("__doc"), "left")
    cutted = joined.withColumn("__cut", cut(F.col(text), F.col("__keys")))
    return cutted.select(*[F.col(f"`{c}`") for c in docs.columns], "__cut.n_lines", "__cut.n_dropped", "__cut.kept_text")
