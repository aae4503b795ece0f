"""Token counts for files as they arrive: only contents not seen before are counted."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folio.operators.content import measured
from folio.operators.tokens import cache_misses, count_misses
from folio.options import PackOptions
from folio.plans.scratch import staged
from folio.sources.token_cache import load_for, save_version


def count_batch(
    files: DataFrame, version: int, cache_path: str, options: PackOptions, writer: str = "stream"
) -> None:
    """Count the missing contents of one batch and store them as one cache version.

    The version is the batch number of this writer. All other writers' entries and its own earlier ones are
    consulted, so a batch that is replayed after a failure writes its entries to the same place, and a cache that
    came from elsewhere is kept and used.
    """
    facts = staged(measured(files, options), "measured")
    # Only the buckets that may hold a content of this batch are opened.
    known = load_for(facts.select("hash"), cache_path, options.now_s, below=version, writer=writer)
    misses = staged(cache_misses(facts, known, options.model_id), "misses")
    fresh = count_misses(files, misses, options.counter, options.model_id, options.now_s, options)
    save_version(fresh, cache_path, version, writer)


def incremental_tokens(
    files: DataFrame,
    cache_path: str,
    checkpoint: str,
    options: PackOptions,
    clock: Callable[[], int] | None = None,
) -> StreamingQuery:
    """Start the stream over a files table; it stops when the table is read up.

    The state is the cache table, keyed by content, so no watermark is needed. The checkpoint names the writer, so
    streams and batch runs share a cache. `clock` gives the time of every batch; without it `options.now_s` stands.
    """
    writer = "stream-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def count(batch: DataFrame, number: int) -> None:
        now = options if clock is None else replace(options, now_s=clock())
        count_batch(batch, number, cache_path, now, writer)

    return (
        files.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
