"""MinHash near-duplicates with odd sketches.

A text's set is that of its distinct shingles of `words` consecutive words (a shorter text is one shingle; a text without
words has an empty set and is linked with nothing). Texts with equal sets form a class, represented by its smallest
doc_id; all further work is on classes. A class has `SAMPLES` MinHash samples, which cut into bands name the buckets in
which similar classes meet, and one more sample for each of `BINS` parts of the hash range (one-permutation MinHash).
These are folded into a parity bitmap, the odd sketch: the set bits of its XOR with another tell how many samples differ,
and with the bitmap of the parts that have a sample, how similar the sets are. Small sets are sampled nearly whole.

1. In each bucket every class is paired with the smallest one. Pairs that the sketches put far below the threshold go;
   the rest are confirmed on the full sets. Confirmed links make first components.
2. Buckets that still hold several components are looked at again: pairs across components that the sketches let pass
   are confirmed too. Large buckets are compared in blocks, so no task holds more than two blocks of one bucket.
So a large group of near copies costs a pair per member, and no link between different components goes untested.

Rows that share a doc_id are one document, linked by any of its texts. Rows with a null doc_id are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import staged
from folio.llm.components import components

SHINGLE = 5
PERCENT = 80
SAMPLES = 128
BAND = 4
BINS = 1024
SKETCH_BITS = 4096
#: Pairs whose estimate lies further below the threshold are not confirmed: four deviations.
SLACK = 0.055
#: Members of a bucket, or partners of a class, that one task compares at once.
BLOCK = 2_000
PARTNERS = 256
KEPT_WORDS = 500_000
_RNG = np.random.default_rng(20_240_607)
_A = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_K = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z count as a-z, words end at ASCII white space."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)], np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = len(found) - words + 1
    total = hashes[:n] * _K[0]
    for k in range(1, words):
        total = total + hashes[k : n + k] * _K[k % len(_K)]
    return np.unique(mixed(total))


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of non-empty sets, one row each."""
    out = np.empty((len(sets), SAMPLES), np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 60_000):
            size += len(sets[last])
            last += 1
        values = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        for k in range(SAMPLES):
            out[first:last, k] = np.minimum.reduceat(values * _A[k] + _B[k], starts)
        first = last
    return out


def odd_sketch(values: np.ndarray) -> list[int]:
    """Parity bitmap of the samples, then the bitmap of the bins that have one; as 64-bit words."""
    hashes = np.sort(mixed(values * _A[0] + _B[0]))
    bins, first = np.unique(hashes >> np.uint64(54), return_index=True)
    at = mixed(hashes[first] + _B[1]) % np.uint64(SKETCH_BITS)
    bits = np.zeros(SKETCH_BITS + BINS, np.uint8)
    bits[:SKETCH_BITS] = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    bits[SKETCH_BITS + bins.astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def bands(found: np.ndarray) -> np.ndarray:
    """A 64-bit name for every band of the samples."""
    rows = found.reshape(len(found), SAMPLES // BAND, BAND)
    total = np.arange(SAMPLES // BAND, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND):
        total = mixed(total + rows[:, :, k] * _K[k])
    return total.view(np.int64)


def _described(words: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(v.as_py(), words) for v in batch.column(1)]
            full = [k for k, s in enumerate(sets) if len(s)]
            found = samples([sets[k] for k in full]) if full else np.zeros((0, SAMPLES), np.uint64)
            names: list = [None] * len(sets)
            marks: list = [None] * len(sets)
            for k, b, o in zip(full, bands(found).tolist(), [odd_sketch(sets[k]) for k in full]):
                names[k], marks[k] = b, o
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(names, pa.list_(pa.int64())),
                    pa.array(marks, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return run


def described(docs: DataFrame, words: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Size, identity, band names and odd sketch of every row's set."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    schema = f"doc_id {kind.simpleString()}, n_shingles long, set_key binary, bands array<long>, sketch array<long>"
    return docs.select(doc_id, text).mapInArrow(_described(words, to_arrow_type(kind)), schema)


WORDS = SKETCH_BITS // 64


def _bits(array: str) -> str:
    return f"aggregate({array}, 0, (s, x) -> s + bit_count(x))"


def estimate(a: str, b: str) -> str:
    """SQL: similarity from two odd sketches."""
    differing = _bits(f"zip_with(slice({a}, 1, {WORDS}), slice({b}, 1, {WORDS}), (x, y) -> x ^ y)")
    tail_a, tail_b = (f"slice({s}, {WORDS + 1}, {BINS // 64})" for s in (a, b))
    used = _bits(f"zip_with({tail_a}, {tail_b}, (x, y) -> x | y)")
    samples_ = f"{-SKETCH_BITS / 2} * ln(greatest(1e-9, 1 - 2.0 * {differing} / {SKETCH_BITS}))"
    return f"({_bits(tail_a)} + {_bits(tail_b)} - {samples_}) / (2.0 * {used})"


def estimates(marks: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The same for many sketches against one."""
    differing = np.bitwise_count(marks[:, :WORDS] ^ one[:WORDS]).sum(1)
    used = np.bitwise_count(marks[:, WORDS:] | one[WORDS:]).sum(1)
    own = np.bitwise_count(marks[:, WORDS:]).sum(1) + int(np.bitwise_count(one[WORDS:]).sum())
    gone = -SKETCH_BITS / 2 * np.log(np.maximum(1e-9, 1 - 2.0 * differing / SKETCH_BITS))
    return (own - gone) / (2.0 * used)


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sizes allow the threshold and whose sketches do not speak against it."""
    own = classes.select("rep", "n_shingles", "sketch")
    left = own.toDF("a", "n_a", "sketch_a")
    right = own.toDF("b", "n_b", "sketch_b")
    sized = pairs.join(left, "a").join(right, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sized.where(f"{estimate('sketch_a', 'sketch_b')} >= {percent / 100 - SLACK}").select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of documents, those whose full sets reach the threshold.

    The texts travel: that of `a` once per pair, that of `b` once per PARTNERS of its pairs.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    load = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    salted = pairs.join(load, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    texts = docs.join(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id")
    members = salted.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    members = members.select("b", "salt", "a", "text_a")
    heads = load.select(F.col("b").alias("head"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"))
    heads = heads.join(texts.select(F.col("doc_id").alias("head"), F.col("text").alias("text_b")), "head")

    def run(members: pa.Table, heads: pa.Table) -> pa.Table:
        own = [shingles(t.as_py(), words) for t in heads.column("text_b")]
        keep = []
        for value in members.column("text_a"):
            mine = shingles(value.as_py(), words)
            common = [(len(np.intersect1d(mine, s, assume_unique=True)), len(s)) for s in own]
            keep.append(any(100 * c >= percent * (len(mine) + n - c) for c, n in common))
        return members.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return members.groupBy("b", "salt").cogroup(heads.groupBy("head", "part")).applyInArrow(run, f"a {kind}, b {kind}")


def across(held: DataFrame, percent: int, kind: str) -> DataFrame:
    """Pairs across components within a bucket that sizes and sketches let pass; held: bucket, rep, component, n_shingles,
    sketch, bands, least (the bucket's smallest class, which was compared with all others before), members.

    Two classes that share several buckets are a pair of the first of these only."""
    blocks = held.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = blocks.select("*", other.alias("other")).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "rep", "component", "n_shingles", "sketch", "bands", "least",
    )

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        reps, comps = rows.column("rep").to_pylist(), rows.column("component").to_pylist()
        block, n = rows.column("block").to_numpy(), rows.column("n_shingles").to_numpy()
        code = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([code[c] for c in comps])
        first = np.array([r == s for r, s in zip(reps, rows.column("least").to_pylist())])
        flat = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64)
        marks = flat.reshape(len(reps), -1)
        names = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(reps), -1)
        bucket = key[0].as_py()
        a, b = [], []
        for k in np.flatnonzero((block == low) & ~first).tolist():
            may = (block == high) & (comp != comp[k]) & ~first
            if low == high:
                may[: k + 1] = False
            may &= 100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])
            at = np.flatnonzero(may)
            if len(at):
                shared = names[at] == names[k]
                at = at[shared.argmax(1) == np.argmax(names[k] == bucket)]
                at = at[estimates(marks[at], marks[k]) >= percent / 100 - SLACK]
                for j in at.tolist():
                    low_high = sorted((reps[k], reps[j]))
                    a.append(low_high[1])
                    b.append(low_high[0])
        kind = rows.schema.field("rep").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    return dealt.groupBy("bucket", "low", "high").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def link(
    docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    kind = docs.schema[doc_id].dataType.simpleString()
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = staged(described(plain, words), "sets")
    some = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = some.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
    )
    classes = staged(classes, "classes")
    named = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = named.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("least")).where("members > 1")
    held = staged(named.join(shared, "bucket"), "buckets")

    pairs = held.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    tested = staged(promising(pairs, classes, percent), "pairs")
    links = staged(confirmed(tested, plain, words, percent), "links")

    # A document with several texts ties their classes together.
    tied = some.select("doc_id", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key")
    several = tied.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("m"), F.collect_set("rep").alias("reps"))
    ties = several.where("v <> m").select(F.explode("reps").alias("u"), "v")
    edges = links.toDF("u", "v").unionAll(ties)
    first = components(edges)

    found = F.coalesce("component", "rep").alias("component")
    members = held.join(first.withColumnRenamed("vertex", "rep"), "rep", "left").select("bucket", "rep", "least", "members", found)
    split = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_ = members.join(split.select("bucket"), "bucket").join(classes.select("rep", "n_shingles", "sketch", "bands"), "rep")
    more = staged(across(open_, percent, kind), "across")
    found_too = staged(confirmed(more, plain, words, percent), "links")
    final = components(first.toDF("u", "v").unionAll(found_too.toDF("u", "v")))

    reps = classes.select("set_key", F.col("rep")).join(final.withColumnRenamed("vertex", "rep"), "rep", "left")
    reps = reps.select("set_key", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", component)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
