"""A corpus made ready for training: quality, language, line dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs`, and returns the columns of `documents` (doc_id, text,
lang, source, n_chars; others are carried along), the last one the pieces of the packed sequences. `run` writes every
stage's rows as Parquet to the shared folder and hands the written table to the next.

* quality: documents that the classifier scores below its threshold go. Labels come from `labels`.
* language: documents without a letter, or without one language likelier than all others together, go.
* line dedup: repeated lines leave all documents but the smallest; n_chars follows the text. Emptied documents stay.
* near dedup: of each group of near-duplicates the document with the smallest doc_id stays; rows without doc_id stay.
* packing: one row per piece of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import language, lines, near_dedup, packing, quality
from folio.llm.common import crc_of_id, staged
from folio.llm.queries import BYTE_BPE, PIECE_BPE, piece_digests

LEAST_LANGUAGE_SCORE = 0.5
#: SQL cannot express the trained stages.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False))
    trees = quality.train(quality.labelled_documents(docs, labels).where(~held_out))
    scored = quality.score(docs, trees, out="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_of_id("doc_id") % 4 == 2, F.lit(False))
    model = language.train(docs.where(~held_out), PIECE_BPE)
    found = language.identify(docs, model, lang="__lang", score="__score")
    known = (F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).drop("__lang", "__score")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.dedup(docs, lines.LineIndex.build(docs).drops())
    kept = kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dedup.link(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_digests(packing.pack(docs, BYTE_BPE))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
