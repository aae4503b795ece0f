"""The token cache as a log-structured table.

    <path>/segments/segment=<id>/bucket=<b>/part-...    entries of one write, dealt to buckets by hash
    <path>/log/commit=<time>-<id>/part-...              one file for each write, written last

A write adds a segment and then a commit, one file that says what the segment holds: the entries of each bucket, a
membership filter of their hashes, and the segments it takes the place of. So writers do not touch each other, a failed
write leaves nothing that is read, and a replayed write replaces itself.

A lookup of some hashes asks the filters first and opens the buckets that may hold one of them. `compact` keeps the number
of segments near the logarithm of the entries: `FANOUT` segments of one size are merged into one of the next.
Replaced segments and their commits are left for the owner of the folder to expire.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.tokens import CACHE_SCHEMA, cache_expire, cache_upsert

#: Entries that a bucket of a segment is to hold.
BUCKET_ENTRIES = 250_000
#: Segments of one size that are merged, and how sizes are told apart.
FANOUT = 4
FILTER_BITS, FILTER_HASHES = 10, 7
_LOG = (
    "segment STRING, writer STRING, version BIGINT, committed BIGINT, buckets INT, bucket INT, entries BIGINT, "
    "bytes BIGINT, filter BINARY, replaced ARRAY<STRING>"
)
_COLUMNS = [field.split()[0] for field in CACHE_SCHEMA.split(", ")]
_KEYS = ("xxhash64(hash) AS h1", "xxhash64(hash, 1) AS h2")


# --- membership filters -------------------------------------------------------------------


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """Where each hash sets its bits: one row for each of its hash functions."""
    steps = np.arange(FILTER_HASHES, dtype=np.uint64)[:, None]
    return (h1.astype(np.uint64) + steps * (h2.astype(np.uint64) | np.uint64(1))) % np.uint64(bits)


def filter_of(h1: np.ndarray, h2: np.ndarray) -> bytes:
    bits = np.zeros(max(64, 8 * math.ceil(len(h1) * FILTER_BITS / 8)), bool)
    bits[_places(h1, h2, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(packed: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """False where a filter proves that a hash is not there."""
    raw = np.frombuffer(packed, np.uint8)
    places = _places(h1, h2, 8 * len(raw))
    return ((raw[places >> np.uint64(3)] >> (7 - (places & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


def _described(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h1, h2 = [], []
    for batch in batches:
        h1.append(batch.column("h1").to_numpy())
        h2.append(batch.column("h2").to_numpy())
    a, b = np.concatenate(h1), np.concatenate(h2)
    values = ([key[0].as_py()], [len(a)], [filter_of(a, b)])
    types = (pa.int32(), pa.int64(), pa.binary())
    yield pa.record_batch([pa.array(v, t) for v, t in zip(values, types)], names=["bucket", "entries", "filter"])


# --- writing ------------------------------------------------------------------------------


def _segment_path(path: str, segment: str) -> str:
    return f"{path}/segments/segment={segment}"


def _commit(entries: DataFrame, path: str, writer: str, version: int, replaced: list[str], size: int | None = None) -> str:
    """Write a segment and commit it."""
    spark, segment, schema = entries.sparkSession, uuid.uuid4().hex, CACHE_SCHEMA + ", bucket INT"
    target, buckets = _segment_path(path, segment), 1
    if size is None:
        entries.select(_COLUMNS).write.parquet(f"{target}/bucket=0")
        stored = spark.read.schema(schema).parquet(target)
        size = stored.count()  # from the footers
    if size > BUCKET_ENTRIES or replaced:
        # More than one bucket holds: what was written is dealt out anew, under another name.
        buckets = 1 << max(0, math.ceil(math.log2(max(1, size) / BUCKET_ENTRIES)))
        segment = uuid.uuid4().hex
        target = _segment_path(path, segment)
        source = entries if replaced else stored
        dealt = source.select(_COLUMNS).withColumn("bucket", F.expr(f"cast(pmod(xxhash64(hash), {buckets}) AS INT)"))
        dealt.repartitionById(buckets, "bucket").sortWithinPartitions("hash").write.partitionBy("bucket").parquet(target)
    stored = spark.read.schema(schema).parquet(target).selectExpr("bucket", *_KEYS)
    rows = stored.groupBy("bucket").applyInArrow(_described, "bucket INT, entries BIGINT, filter BINARY")
    now = time.time_ns()
    facts = {
        "segment": F.lit(segment), "writer": F.lit(writer), "version": F.lit(version).cast("bigint"), "committed": F.lit(now).cast("bigint"),
        "buckets": F.lit(buckets), "bytes": F.octet_length("filter").cast("bigint"),
        "replaced": F.array(*[F.lit(s) for s in replaced]).cast("array<string>"),
    }
    # A segment without entries is committed as well: it may take the place of others.
    nothing = spark.createDataFrame([(-1, 0, None)], "bucket INT, entries BIGINT, filter BINARY")
    log = rows.unionByName(nothing).withColumns(facts).select([field.split()[0] for field in _LOG.split(", ")])
    # Filters are made where their buckets are and meet in one file; `coalesce` would make them all in its one task.
    log.repartition(1).write.parquet(f"{path}/log/commit={now:020d}-{segment}")
    return segment


def save_version(entries: DataFrame, path: str, version: int = 0, writer: str | None = None) -> str:
    """Add entries as `version` of `writer`; the same version of a writer again replaces it. Without a writer the write is its own."""
    return _commit(entries, path, writer or f"run-{uuid.uuid4().hex}", version, [])


# --- reading ------------------------------------------------------------------------------


def live_segments(spark: SparkSession, path: str) -> DataFrame:
    """Log rows of the segments in force: of each writer's version the last one, without those replaced by others."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{path}/log/*")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)
    replaced = log.selectExpr("explode(replaced) AS segment").distinct()
    last = log.groupBy("writer", "version").agg(F.expr("max_by(segment, committed) AS segment")).select("segment")
    return log.join(last, "segment", "left_semi").join(replaced, "segment", "left_anti")


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(*folders)


def _folders(path: str, rows: DataFrame) -> list[str]:
    """Folders of the buckets of log rows; as many as buckets, which compaction keeps few."""
    found = rows.where("bucket >= 0").select("segment", "bucket").distinct().collect()
    return sorted(f"{_segment_path(path, r.segment)}/bucket={r.bucket}" for r in found)


def load_versions(spark: SparkSession, path: str, below: int | None = None, writer: str | None = None) -> DataFrame:
    """All stored entries; `below` leaves out that version of `writer` and later ones of the same writer."""
    return _read(spark, _folders(path, _without(live_segments(spark, path), below, writer)))


def _without(rows: DataFrame, below: int | None, writer: str | None) -> DataFrame:
    if below is None:
        return rows
    return rows.where(~((F.col("writer") == F.lit(writer)) & (F.col("version") >= below)))


def load(spark: SparkSession, path: str, now_s: int | None = None) -> DataFrame:
    """One entry per hash and model, expired ones left out when `now_s` is given."""
    return _newest(load_versions(spark, path), now_s)


def _newest(stored: DataFrame, now_s: int | None) -> DataFrame:
    if now_s is not None:
        stored = cache_expire(stored, now_s)
    return cache_upsert(stored, stored.limit(0))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of segments that may hold one of the hashes. Rows come by bucket, its filters ahead of the hashes."""
    at, filters, found = None, [], []
    for batch in batches:
        keys = list(zip(batch.column("buckets").to_pylist(), batch.column("bucket").to_pylist()))
        segments = batch.column("segment").to_pylist()
        h1, h2 = batch.column("h1").to_numpy(zero_copy_only=False), batch.column("h2").to_numpy(zero_copy_only=False)
        row = 0
        while row < len(keys):
            if keys[row] != at:
                at, filters = keys[row], []
            if segments[row] is not None:
                filters.append((segments[row], batch.column("filter")[row].as_py()))
                row += 1
                continue
            end = row
            while end < len(keys) and keys[end] == at and segments[end] is None:
                end += 1
            some = h1[row:end].astype(np.int64), h2[row:end].astype(np.int64)
            hits = [segment for segment, packed in filters if may_hold(packed, *some).any()]
            found += [(segment, at[1]) for segment in hits]
            filters = [f for f in filters if f[0] not in hits]
            row = end
    yield pa.record_batch([pa.array([s for s, _ in found], pa.string()), pa.array([b for _, b in found], pa.int32())], names=["segment", "bucket"])


def folders_for(hashes: DataFrame, path: str, below: int | None = None, writer: str | None = None) -> list[str]:
    """Folders that may hold an entry of one of the hashes (hash STRING)."""
    rows = _without(live_segments(hashes.sparkSession, path).where("bucket >= 0"), below, writer)
    sizes = [r.buckets for r in rows.select("buckets").distinct().collect()]
    if not sizes:
        return []
    # Segments have powers of two of buckets, so the few numbers there are make the copies of a hash few.
    each = f"explode(array({', '.join(map(str, sizes))})) AS buckets"
    keyed = hashes.where("hash IS NOT NULL").distinct().selectExpr(*_KEYS, each)
    asked = keyed.selectExpr("buckets", "cast(pmod(h1, buckets) AS INT) AS bucket", "h1", "h2")
    asked = asked.selectExpr("*", "cast(NULL AS STRING) AS segment", "cast(NULL AS BINARY) AS filter")
    held = rows.selectExpr("buckets", "bucket", "0L AS h1", "0L AS h2", "segment", "filter")
    in_order = asked.unionByName(held).repartition("buckets", "bucket").sortWithinPartitions("buckets", "bucket", F.col("segment").isNull())
    return _folders(path, in_order.mapInArrow(_met, "segment STRING, bucket INT"))


def load_for(
    hashes: DataFrame, path: str, now_s: int | None = None, below: int | None = None, writer: str | None = None
) -> DataFrame:
    """Entries of the given hashes (hash STRING), each once per model; buckets that hold none of them are not opened."""
    stored = _read(hashes.sparkSession, folders_for(hashes, path, below, writer))
    return _newest(stored.join(hashes.select("hash").distinct(), "hash", "left_semi"), now_s)


# --- compaction ---------------------------------------------------------------------------


def tier_of(entries: int) -> int:
    """Segments of one tier differ in size by less than `FANOUT` times."""
    return int(math.log(max(1, entries), FANOUT) + 1e-9)


def compact(spark: SparkSession, path: str, now_s: int | None = None) -> int:
    """Merge segments of one size until no `FANOUT` of them are left; returns how many were merged.

    Entries that others replace go, and with `now_s` expired ones. What a merge replaces stays in place for
    those who are reading it.
    """
    merged = 0
    while True:
        sizes = live_segments(spark, path).groupBy("segment").agg(F.sum("entries").alias("n")).collect()
        tiers: dict[int, list[str]] = {}
        for row in sizes:
            tiers.setdefault(tier_of(row.n), []).append(row.segment)
        chosen = next((sorted(s) for _, s in sorted(tiers.items()) if len(s) >= FANOUT), None)
        if chosen is None:
            return merged
        rows = live_segments(spark, path).where(F.col("segment").isin(chosen))
        size = sum(r.n for r in sizes if r.segment in chosen)
        entries = _newest(_read(spark, _folders(path, rows)), now_s)
        _commit(entries, path, f"compaction-{uuid.uuid4().hex}", 0, chosen, size)
        merged += len(chosen)
