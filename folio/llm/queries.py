"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, chat, hard_negatives, language, lines, near_dedup, packing, pages, prefix_trie, quality, search, token_counts, winnowing
from folio.llm.common import crc_of_id

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hex_sha256(column: str) -> F.Column:
    """Lower-case hex digest of a binary column or of a text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(F.col(column), F.lit("").cast("binary")), 256)


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, BYTE_BPE).select("doc_id", "ids"), BYTE_BPE)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    one = [(-7, [("user", said), ("assistant", said)])]
    other = spark.createDataFrame(one, "id long, messages array<struct<role:string,content:string>>")
    turns = chat.canonical(table(spark, folder, "conversations")).unionByName(chat.canonical(other))
    return chat.read_back(chat.formatted(turns)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256)").alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(packing.pack(table(spark, folder, "documents"), BYTE_BPE))


def op4_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return search.search(search.build(docs), asked)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False))
    labelled = quality.labelled_documents(docs, table(spark, folder, "labels")).where(~held_out)
    scored = quality.score(docs.select("doc_id", "text"), quality.train(labelled))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.dedup(docs, lines.LineIndex.build(docs).drops())
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op7_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.fingerprints(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op8_pages(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(crc_of_id("doc_id") % 4 == 2, F.lit(False))
    model = language.train(docs.where(~held_out), PIECE_BPE)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.link(table(spark, folder, "documents"), words=4)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.numbered(table(spark, folder, "conversations"))
    return prefix_trie.build(*prefix_trie.with_lent_heads(turns)).withColumnRenamed("saved_bytes", "saved_tokens")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", moved))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count(table(spark, folder, "documents").select("doc_id", "text"), BYTE_BPE)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_chat": op2_chat,
    "op3_packing": op3_packing,
    "op4_search": op4_search,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_winnowing": op7_winnowing,
    "op8_pages": op8_pages,
    "op9_language": op9_language,
    "op10_near_dedup": op10_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}

#: Turns escaped as the template does; a control string behind its first character, after any backslashes.
_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g')"

#: crc32 of the decimal text of conv_id, bit by bit: each byte comes in with the first of its eight steps.
_CRC = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, e: CASE WHEN xor(c, e) % 2 = 1 THEN xor(xor(c, e) // 2, 3988292384::BIGINT) ELSE xor(c, e) // 2 END
), 4294967295::BIGINT)"""

CHECKS: dict[str, str] = {
    "op11_prefix_trie": f"""
WITH own AS (
    SELECT conv_id, {_CRC} % 9 AS h,
           list(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')
                ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
           list(strlen(coalesce(text, ''))::BIGINT ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS sizes
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
    SELECT own.conv_id,
           list_concat(list_slice(coalesce(base.turns, []), 1, own.h), list_slice(own.turns, own.h + 1, 1000000)) AS turns,
           list_concat(list_slice(coalesce(base.sizes, []), 1, own.h), list_slice(own.sizes, own.h + 1, 1000000)) AS sizes
    FROM own LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 5
), paths AS (
    SELECT conv_id, d AS depth, len(turns) AS n,
           CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size,
           sha256(array_to_string(list_transform(list_slice(turns, 1, d), lambda x: sha256(x)), ',')) AS node,
           CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(list_slice(turns, 1, d - 1), lambda x: sha256(x)), ',')) END AS parent
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
           max(n) = depth AS is_leaf, (count(*) - 1) * any_value(size) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
    FROM paths GROUP BY node, depth
), children AS (
    SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM nodes GROUP BY parent, depth
), sums AS (
    SELECT p.node, p.depth, count(*) FILTER (WHERE is_leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM nodes JOIN paths p ON p.conv_id = nodes.conv_id AND p.depth <= nodes.depth GROUP BY p.node, p.depth
)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes
JOIN sums ON sums.node = nodes.node AND sums.depth = nodes.depth
LEFT JOIN children ON children.parent = nodes.node AND children.depth = nodes.depth
LEFT JOIN nodes up ON up.node = nodes.parent AND up.depth = nodes.depth - 1
""",
    "op12_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
           list_dot_product(a.e, o.e)::BIGINT AS score
    FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n
  ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
""",
    "op2_chat": f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')) v
)
SELECT conv_id,
       count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op6_line_dedup": """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE doc_id > first_doc))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE first_doc IS NULL OR doc_id = first_doc), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id
""",
}
