"""Document fingerprints by winnowing, in DataFrame operations only.

Grams are runs of `GRAM` words. White space ends a word; of runs of more than `WORD_CHARS` characters without white space,
as in Chinese, Japanese or Thai, every character is a word, so no gram depends on how far into its run it lies.
Their hashes roll by doubling: a gram's hash is made from those of its halves. In each window of `WINDOW` grams the
smallest hash is chosen, the rightmost of equal ones: hash and position are packed into one number whose order is that of
the choice, so a window's choice is a minimum, and sliding minima are built by doubling too. Texts that share a run of
GRAM + WINDOW - 1 words share a chosen hash; positions are kept.

A text of fewer than GRAM words is one gram, one of fewer than WINDOW grams one window; an empty text has no fingerprint.
Two empty fingerprints have likeness 1, one empty and one not 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import staged

GRAM = 4
WINDOW = 16
WORD_CHARS = 16
HASH_BITS, PLACE_BITS = 36, 27
_PLACES = 2**PLACE_BITS - 1
#: Stands for a null doc_id while neighbours are sought: such rows come last.
NO_ID = -(2**63)


def _let(name: str, value: str, then: str) -> str:
    """`then` with `name` bound to a value that is worked out once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def chosen(text: str) -> str:
    """SQL: the chosen grams of a text, as packed numbers in order of their windows."""
    words = f"regexp_extract_all({text}, '(?<!\\\\S)\\\\S{{1,{WORD_CHARS}}}(?!\\\\S)|\\\\S', 0)"
    hashes = "transform(w, x -> xxhash64(x))"
    pairs = "zip_with(h, slice(h, 2, size(h)), (x, y) -> xxhash64(x, y))"
    fours = "slice(zip_with(p, slice(p, 3, size(p)), (x, y) -> xxhash64(x, y)), 1, size(p) - 3)"
    grams = _let("h", hashes, _let("p", pairs, fours))
    grams = f"if(size(w) < {GRAM}, array(xxhash64(array_join(w, ' '))), {grams})"
    packed = f"transform(g, (x, i) -> shiftleft(x & {2**HASH_BITS - 1}L, {PLACE_BITS}) | ({_PLACES}L - (i & {_PLACES})))"
    least = "v"
    span = 1
    while span < WINDOW:
        least = _let(f"m{span}", least, f"zip_with(m{span}, slice(m{span}, {span + 1}, size(m{span})), (x, y) -> least(x, y))")
        span *= 2
    windows = f"if(size(v) <= {WINDOW}, array(array_min(v)), array_distinct(slice({least}, 1, size(v) - {WINDOW - 1})))"
    some = _let("g", grams, _let("v", packed, windows))
    return _let("w", words, f"if(size(w) = 0, cast(array() AS array<bigint>), {some})")


def hashes_of(packed: str) -> str:
    return f"array_distinct(transform({packed}, x -> shiftright(x, {PLACE_BITS})))"


def printed(packed: str) -> str:
    """SQL: `hash@position` of each choice, positions counting words from 0."""
    return f"array_join(transform({packed}, x -> concat(hex(shiftright(x, {PLACE_BITS})), '@', {_PLACES}L - (x & {_PLACES}L))), ' ')"


def likeness(a: str, b: str) -> str:
    """SQL: common share of two sets of hashes."""
    common = f"size(array_intersect({a}, {b}))"
    shared = _let("c", common, f"cast(c AS double) / (size({a}) + size({b}) - c)")
    return f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE {shared} END"


def next_ids(keys: DataFrame) -> DataFrame:
    """(key, next_key): the next smaller key, the largest one for the smallest. Keys are distinct.

    Keys are dealt by range; neighbours are sought within each range, and between ranges from one row per range.
    """
    ranged = keys.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    edges = ranged.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    # Rows of `edges`: the number of ranges.
    edges = edges.selectExpr("part", "lag(hi) OVER (ORDER BY part) AS below", "max(hi) OVER () AS top")
    near = ranged.selectExpr("*", "lag(key) OVER (PARTITION BY part ORDER BY key) AS near")
    return near.join(edges, "part").selectExpr("key", "chars", "coalesce(near, below, top) AS next_key")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the start of the next document's, by descending doc_id. Of rows that
    share a doc_id the smallest text is the one that others take; each of them is edited on its own. Rows without doc_id
    count as one document behind all others.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("key")
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = staged(next_ids(rows.groupBy("key").agg(F.max(F.char_length("text")).alias("chars"))), "next")
    dealt = rows.repartition("key")
    first = dealt.selectExpr("*", "row_number() OVER (PARTITION BY key ORDER BY text) AS no").where("no = 1")
    taker = order.selectExpr("next_key AS key", "key AS taker", "cast(floor(chars / 3) AS int) AS take")
    heads = first.join(taker, "key").selectExpr("taker AS key", "left(text, take) AS head", f"{chosen('text')} AS near_marks")
    heads = heads.selectExpr("key", "head", f"{hashes_of('near_marks')} AS next_hashes")
    both = dealt.join(heads, "key").selectExpr("key", "text", "next_hashes", "head", "cast(char_length(text) AS bigint) AS n_chars")
    third = "cast(floor(n_chars / 3) AS int)"
    edited = both.selectExpr("key", "n_chars", "text", "next_hashes", f"concat(left(text, cast(n_chars AS int) - {third}), left(head, {third})) AS edited")
    marked = edited.selectExpr("key", "n_chars", "edited", "next_hashes", f"{chosen('text')} AS marks", f"{chosen('edited')} AS edited_marks")
    hashed = marked.selectExpr("*", f"{hashes_of('marks')} AS hashes", f"{hashes_of('edited_marks')} AS edited_hashes")
    return hashed.selectExpr(
        f"nullif(key, cast('{NO_ID}' AS bigint)) AS `{doc_id}`",
        "n_chars",
        "edited",
        f"{printed('marks')} AS fingerprint",
        f"{printed('edited_marks')} AS edited_fingerprint",
        f"{likeness('hashes', 'edited_hashes')} AS near_edited",
        f"{likeness('hashes', 'next_hashes')} AS near_next",
    )
