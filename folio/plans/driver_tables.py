"""Files, rules, cache and repository tables derived from the given tables.

The given tables hold no file trees, so paths and edge contents are made from the columns of
every document. FILES_SQL is SQL that Spark and the checking database both run, but for the edges.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import case, quoted
from folio.functions import text as txt
from folio.operators.repos import with_repo
from folio.plans.scratch import staged
from folio.sources.tables import files_from_texts

NOW_S = 1_704_067_200 + 8 * 86_400
MODEL = "gpt-4"
OTHER_MODEL = "gpt-4o"

FILES_SQL = """
SELECT corpus,
       CONCAT(CASE CAST(k % 10 AS INT)
                WHEN 0 THEN 'build/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'node_modules/pkg/'
                WHEN 3 THEN 'src/target/' WHEN 4 THEN 'src/' WHEN 5 THEN 'src/lib/'
                WHEN 6 THEN '.github/' ELSE '' END,
              CASE WHEN k % 11 = 0 THEN '_' WHEN k % 13 = 0 THEN '.' ELSE '' END,
              lang, '_', CAST(doc_id AS STRING), CASE edge WHEN 1 THEN '_none' WHEN 2 THEN '_bytes' ELSE '' END,
              CASE CAST(k % 7 AS INT)
                WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' WHEN 3 THEN '.rs'
                WHEN 4 THEN '.log' WHEN 5 THEN '.min.js' ELSE '' END) AS path,
       CASE WHEN doc_id % 3 = 0 THEN '755' ELSE '644' END AS permissions,
       1704067200 + doc_id * 60 AS modified_s,
       CASE WHEN edge = 1 THEN ''
            WHEN edge = 2 THEN REPEAT(CHR(1), 40)
            WHEN doc_id % 83 = 0 THEN REPLACE(text, CHR(10), CONCAT(CHR(13), CHR(10)))
            WHEN doc_id % 79 = 0 THEN CONCAT(text, ']]> & <x a="1">', CHR(10))
            ELSE text END AS text,
       doc_id, lang
FROM (SELECT d.*, source AS corpus, CAST(FLOOR(doc_id / 20.0) AS BIGINT) AS k, {edges} AS edge FROM {documents} d) t
"""
# Some documents are there once more, empty or as bytes that are no text: two rows of one scan.
_EDGES = "CASE WHEN doc_id % 97 = 0 THEN {0}0, 1{1} WHEN doc_id % 89 = 0 THEN {0}0, 2{1} ELSE {0}0{1} END"
SPARK_EDGES = f"explode({_EDGES.format('array(', ')')})"
CHECK_EDGES = f"unnest({_EDGES.format('[', ']')})"


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_rows(spark: SparkSession, folder: str) -> DataFrame:
    documents = parquet(spark, folder, "documents")
    return spark.sql(FILES_SQL.replace("{edges}", SPARK_EDGES), documents=documents)


def files(spark: SparkSession, folder: str) -> DataFrame:
    rows = text_rows(spark, folder)
    return files_from_texts(
        rows, "corpus", "path", "text", "timestamp_seconds(modified_s)", "permissions"
    )


def token_cache(spark: SparkSession, folder: str) -> DataFrame:
    """What earlier runs stored over two weeks: English under one model, the rest under another.

    Every write is there, so a key may occur more than once with different times.
    """
    return text_rows(spark, folder).where("text <> ''").selectExpr(
        f"{txt.content_hash('text')} AS hash",
        f"if(lang = 'en', '{MODEL}', '{OTHER_MODEL}') AS model",
        f"{txt.piece_count('text')} AS tokens",
        f"{NOW_S} - (doc_id * 6007) % 1209600 AS ts",
    )


def repos(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories asked for: every page URL, with a policy by top-level domain."""
    pages = with_repo(parquet(spark, folder, "pages").select("page_id", "url"))
    policy = case(
        ("endswith(host, '.com')", "'always_pull'"),
        ("endswith(host, '.net')", "'force_clone'"),
        otherwise="'use_cache'",
    )
    return pages.selectExpr("*", f"{policy} AS policy")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories on disk: those of the pages, complete where a page was secure."""
    found = repos(spark, folder).where("cache_path IS NOT NULL")
    return found.groupBy("host_kind", "owner", "name", "cache_path").agg(
        F.expr("bool_or(startswith(url, 'https://')) AS has_git"),
        F.expr("max(1704067200 + page_id * 3600) AS modified_s"),
    )


# --- ignore files -----------------------------------------------------------------------

ROOT_IGNORE = "\n".join(
    ["# logs, but not the French ones", "*.log", "!fr_*.log", "/docs/*.md", "lib/", "\\_*", ""]
)
SRC_IGNORE = "\n".join(["*.rs", "!*_*0.rs", "", "target/*.py", "[!e]*.txt"])
CUSTOM_IGNORE = "\n".join(["docs/", "!*.rs", "de_*"])


def _per_corpus(rows: DataFrame, *texts: tuple[str, str]) -> DataFrame:
    files = ", ".join(
        f"struct({quoted(path)} AS path, {quoted(text)} AS content)" for path, text in texts
    )
    return rows.select("corpus").distinct().selectExpr("corpus", f"inline(array({files}))")


def ignore_files(rows: DataFrame) -> DataFrame:
    """Every corpus has an ignore file at its root and one in `src`."""
    return _per_corpus(rows, (".gitignore", ROOT_IGNORE), ("src/.gitignore", SRC_IGNORE))


def custom_ignore_files(rows: DataFrame) -> DataFrame:
    return _per_corpus(rows, (".packignore", CUSTOM_IGNORE))


# --- packs ------------------------------------------------------------------------------

# A corpus without name and one with an empty name, in Spark's words and in the checking database's.
ODD_CORPORA = "CASE corpus WHEN 'src0' THEN '' WHEN 'src1' THEN NULL WHEN 'src2' THEN '%none' ELSE corpus END"
# Rows of the frame that close `docs` in the body of some packs.
PLANTED_FAULT = "section = 2 AND sort_key = concat('0docs', '\x01', '2') AND corpus IN ('src1', 'src3', 'src5')"


def outline(events):
    """Lines of a format of one's own: depth, event, path and characters read."""
    for e in events:
        yield f"{e.depth}|{e.event}|{e.path}|{'' if e.content is None else len(e.content)}"


# --- paths and kinds --------------------------------------------------------------------

OUTPUT_FILE = "./docs/en_20.txt"


def absolute_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths inside a root, the root itself, beside it, and elsewhere."""
    rows = text_rows(spark, folder).selectExpr("*", "concat('/data/', corpus) AS root")
    full = case(
        ("lang = 'en'", "concat(root, '/', path)"),
        ("lang = 'fr'", "concat('/other/', path)"),
        ("lang = 'de'", "root"),
        otherwise="concat(root, 'x/', path)",
    )
    return rows.selectExpr("doc_id", "corpus", "root", f"{full} AS full_path")


def wordy_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Long paths with letters of any width: the words of a text as folders."""
    path = r"regexp_replace(text, '[\\n ]+', if(doc_id % 5 = 0, '-', '/'))"
    return parquet(spark, folder, "documents").selectExpr("doc_id", f"{path} AS path")


def mixed_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Files with links and other entries among them, by the language in the name."""
    name = "regexp_extract(path, '([a-z]{2})_[0-9]', 1)"
    kind = case((f"{name} = 'de'", "'symlink'"), (f"{name} = 'es'", "'other'"), otherwise="'file'")
    target = f"if({name} = 'de', concat('../ziel/ö/', path), NULL)"
    return files(spark, folder).withColumns({"kind": F.expr(kind), "target": F.expr(target)})


def written_trees(rows: DataFrame, path: str) -> DataFrame:
    """Write a files table as one tree per corpus; returns the roots (corpus, root)."""
    folder = path.removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"trees are written with file calls, which do not reach {path}")

    def write(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                full = os.path.join(folder, row.corpus, row.path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as out:
                    out.write(row.raw)
                os.chmod(full, int(row.permissions, 8))
                os.utime(full, ns=(row.modified_us * 1000, row.modified_us * 1000))
            yield batch[["corpus"]]

    sent = rows.selectExpr(
        "corpus", "path", "raw", "permissions", "unix_micros(modified) AS modified_us"
    )
    corpora = sent.mapInPandas(write, "corpus STRING").distinct()
    written = staged(corpora, "written")
    return written.selectExpr("corpus", f"concat_ws('/', {quoted(folder)}, corpus) AS root")
