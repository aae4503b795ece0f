"""Token counts memoised by content hash, and the upkeep of the table that holds them.

    token_cache: hash STRING, model STRING, tokens BIGINT, ts BIGINT (epoch seconds)
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import quoted
from folio.functions import text as txt
from folio.operators.content import COUNTED, accepted, classify, with_content
from folio.operators.skew import lookup
from folio.options import CACHE_TTL_SECONDS, MODELS, PackOptions
from folio.plans.scratch import staged

CACHE_SCHEMA = "hash STRING, model STRING, tokens BIGINT, ts BIGINT"
FILE_ID = "xxhash64(corpus, path)"
#: Bits for each missing content in the bitmap that goes to the files, at most so many in all (64 MB), and the words of a block.
ID_BITS, MAX_BITS, BLOCK_WORDS = 16, 2**29, 1024
MODELS_SCHEMA = "name STRING, model_id STRING, provider STRING, context_window BIGINT"

# Counters: a text column in, a BIGINT column out. These two stay inside Spark expressions.
_counters: dict[str, Callable[[str], Column]] = {
    "estimate": lambda text: F.expr(txt.token_estimate(txt.char_count(text))),
    "pieces": lambda text: F.expr(txt.piece_count(text)),
}


def register_counter(name: str, count: Callable[[pd.Series], pd.Series]) -> None:
    """Add a counter over batches of texts, such as one that wraps a model vocabulary.

    A text it cannot count gets NULL; one bad text does not spoil the batch.
    """

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        counts = pd.Series(pd.NA, index=texts.index, dtype="Int64")
        present = texts[texts.notna()]
        try:
            counts[present.index] = list(count(present)) if len(present) else []
        except Exception:
            counts[present.index] = [_count_one(count, text) for text in present]
        return counts

    _counters[name] = counted


def _count_one(count, text):
    try:
        value = count(pd.Series([text])).iloc[0]
        return None if pd.isna(value) else int(value)
    except Exception:
        return None


def counter(name: str) -> Callable[[str], Column]:
    return _counters[name]


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, MODELS_SCHEMA)


def _models_array() -> str:
    """The model table as one constant, so that reading it needs no join."""
    rows = ", ".join(
        f"struct('{name}' AS name, '{model_id}' AS model_id, '{provider}' AS provider, "
        f"{window}L AS context_window)"
        for name, model_id, provider, window in MODELS
    )
    return f"array({rows})"


def model_catalog(used_models: DataFrame) -> DataFrame:
    """Provider and window of each model id in use; NULL for ids that are not known."""
    known = f"get(filter({_models_array()}, m -> m.model_id = model_id), 0) AS m"
    return used_models.selectExpr("*", known).select(
        *used_models.columns, "m.name", "m.provider", "m.context_window"
    )


def context_fit(token_totals: DataFrame) -> DataFrame:
    """For every corpus and model: does the pack fit the context window?"""
    each = token_totals.selectExpr("corpus", "tokens", f"inline({_models_array()})")
    return each.selectExpr(
        "corpus", "tokens", "model_id", "context_window", "tokens <= context_window AS fits"
    )


# --- the cache as a table ---------------------------------------------------------------


def cache_expire(cache: DataFrame, now_s: int, ttl: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Entries younger than the time to live; the future counts as young."""
    return cache.where(f"{now_s} - ts < {ttl}")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """One entry per hash and model, the newest."""
    return (
        cache.select("hash", "model", "tokens", "ts")
        .unionByName(fresh.select("hash", "model", "tokens", "ts"))
        .groupBy("hash", "model")
        .agg(F.expr("max(struct(ts, tokens)) AS e"))
        .select("hash", "model", "e.tokens", "e.ts")
    )


def entries_of(cache: DataFrame, model_id: str) -> DataFrame:
    """(hash, tokens) of one model, each hash once."""
    return (
        cache.where(F.col("model") == model_id)
        .groupBy("hash")
        .agg(F.expr("max(struct(ts, tokens)) AS e"))
        .select("hash", "e.tokens")
    )


def cache_lookup(
    keys: DataFrame, cache: DataFrame, model_id: str, hot: DataFrame | None = None
) -> DataFrame:
    """Keys (corpus, path, hash, ...) with the cached tokens, NULL and `cached` false if none.

    `hot` are the hashes that very many of the keys share.
    """
    entries = entries_of(cache, model_id).withColumn("cached", F.lit(True))
    found = lookup(keys, entries, "hash", FILE_ID, hot)
    return found.withColumn("cached", F.expr("coalesce(cached, false)"))


def cache_misses(keys: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """Distinct hashes without an entry, each with the id of one file that has the content.

    Grouping comes first: however often a content is repeated, every task sends one row of
    it, and the contents themselves stay out of the shuffle.
    """
    distinct = (
        keys.groupBy("hash")
        .agg(F.expr(f"min({FILE_ID}) AS file_id"), F.expr("count(hash) AS n"))
        .where("n > 0")
        .select("hash", "file_id")
    )
    known = cache.where(F.col("model") == model_id).select("hash")
    return distinct.join(known, "hash", "left_anti")


def count_misses(
    files: DataFrame, misses: DataFrame, counter_name: str, model_id: str, now_s: int, options: PackOptions
) -> DataFrame:
    """Cache entries for the missing contents.

    `files` is the files table the misses were found in. File ids only narrow down what is read: several files may
    share one, by a repeated path or by chance. What is stored is decided by the hash of what was read, with the test
    of readability that found the misses. A bitmap of the ids goes to the files, so contents are never shuffled. Failed
    counts are left out.
    """
    narrowed = _in_bitmap(files, misses)
    contents = with_content(classify(accepted(narrowed), options), options)
    readable = contents.selectExpr("if(read_status = 'ok', content, NULL) AS content")
    counted = _counted(readable, counter_name).groupBy("hash").agg(F.max("tokens").alias("tokens"))
    wanted = counted.join(misses.select("hash"), "hash", "left_semi").where("tokens IS NOT NULL")
    return wanted.selectExpr("hash", f"{quoted(model_id)} AS model", "tokens", f"{now_s}L AS ts")


def _in_bitmap(files: DataFrame, misses: DataFrame) -> DataFrame:
    """Files whose id is that of a miss, and few others by chance.

    `ID_BITS` bits for each miss, at most `MAX_BITS`, are dealt to blocks of `BLOCK_WORDS` words, and a file meets the one block
    that may hold its bit. With more misses than the bits can tell apart more files pass, up to all of them.
    """
    blocks = max(1, -(-min(MAX_BITS, ID_BITS * misses.count()) // (64 * BLOCK_WORDS)))

    def place(file_id: str) -> tuple[str, str, str]:
        # Each of the three from bits of its own; the id is a hash already.
        return (
            f"pmod({file_id}, {blocks}L) AS block",
            f"cast(pmod(xxhash64({file_id}), {BLOCK_WORDS}) AS INT) AS word",
            f"cast(shiftrightunsigned(xxhash64({file_id}), 58) AS INT) AS bit",
        )

    words = misses.selectExpr(*place("file_id")).groupBy("block", "word").agg(F.expr("bit_or(shiftleft(1L, bit)) AS bits"))
    held = words.groupBy("block").agg(F.expr("map_from_entries(collect_list(struct(word, bits))) AS held"))
    all_words = f"transform(sequence(0, {BLOCK_WORDS - 1}), w -> coalesce(held[w], 0L)) AS words"
    bitmap = staged(held.selectExpr("block", all_words), "missing")
    block, word, bit = place(FILE_ID)
    met = files.selectExpr("*", block, word, bit).join(F.broadcast(bitmap), "block")
    return met.where("getbit(get(words, word), bit) = 1").select(*files.columns)


def _counted(contents: DataFrame, counter_name: str) -> DataFrame:
    """(hash, tokens) of texts. Batches that go to Python are bounded in bytes by Spark.

    A missing text has the hash '', which no text has. So the column is never NULL, and Spark
    does not hash everything once more to test for it ahead of a join.
    """
    return contents.select(
        F.expr(f"coalesce({txt.content_hash('content')}, '')").alias("hash"),
        counter(counter_name)("content").alias("tokens"),
    )


# Every copy of a known content hits; of an unknown one all but the first do.
#
# Below, files without a hash are left out after grouping, by their count. A filter on the
# hash itself would be moved into the scan, where every content would be hashed twice.
_HITS = "sum(if(coalesce(cached, false), n, greatest(n - 1, 0))) AS hits"


def _copies(keys: DataFrame) -> DataFrame:
    """How often each content occurs in a corpus; a hot content is one row per corpus."""
    return keys.groupBy("corpus", "hash").agg(F.expr("count(hash) AS n")).where("n > 0")


def cache_hit_rate(keys: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """Hits, misses and rate per corpus, as if its files were counted one after the other.

    A content in the cache hits every time; any other misses once and hits from then on. So
    the number of copies per corpus decides, and no row-by-row order is needed.
    """
    entries = entries_of(cache, model_id).selectExpr("hash", "true AS cached")
    copies = lookup(_copies(keys), entries, "hash")
    sums = copies.groupBy("corpus").agg(F.expr(_HITS), F.expr("sum(n) AS lookups"))
    return sums.selectExpr(
        "corpus", "hits", "lookups - hits AS misses", "lookups", "hits / lookups * 100D AS hit_rate"
    )


def cached_token_total(keys: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """Token total per corpus from the cache; NULL when none of its contents is there."""
    copies = lookup(_copies(keys), entries_of(cache, model_id), "hash")
    return copies.groupBy("corpus").agg(F.expr("sum(n * tokens) AS tokens"))


def corpus_summary(
    measured: DataFrame, cache: DataFrame, fresh: DataFrame | None, model_id: str
) -> DataFrame:
    """Totals, tokens and cache hits per corpus in one go.

    `fresh` are entries counted in this run; they give tokens but are no hits. Files are
    summed per content first, so that the join sees each content once per corpus.
    """
    entries = entries_of(cache, model_id).selectExpr("hash", "tokens", "true AS cached")
    if fresh is not None:
        counted_now = fresh.selectExpr("hash", "tokens", "false AS cached")
        # One entry per content; a cached one comes before one that was counted now.
        both = entries.unionByName(counted_now).groupBy("hash").agg(F.expr("max(struct(cached, tokens)) AS e"))
        entries = both.select("hash", "e.tokens", "e.cached")
    per_content = measured.groupBy("corpus", "hash").agg(
        F.expr(f"count_if({COUNTED}) AS files"),
        F.expr("sum(if(read_status = 'ok', lines, 0)) AS lines"),
        F.expr("sum(if(read_status = 'ok', chars, 0)) AS chars"),
        F.expr("count(hash) AS n"),
    )
    return (
        lookup(per_content, entries, "hash")
        .groupBy("corpus")
        .agg(
            *[F.sum(name).alias(name) for name in ("files", "lines", "chars")],
            F.expr("sum(n * tokens) AS tokens"),
            F.expr(_HITS),
            F.expr("sum(n) AS lookups"),
        )
    )
