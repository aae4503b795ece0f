"""Packs as text files: a folder per corpus whose parts, in order of block and name, are its pack.

    <path>/version=<n>/corpus=<name>/block=<b>/part-...
    <path>/shared/version=<n>/part-...        small packs, where there are very many: rows (corpus, value) in order
    <path>/manifests/version=<n>/part-...     the parts of that version, written last

A folder and a file cost more than a small pack's bytes. Of more than `FOLDERS` corpora only those of `FOLDER_BYTES` and more
have a folder of their own, so their number follows the bytes; the packs of the others lie whole behind each other in
shared files, sorted by corpus. Readers find both alike.

A pack is what the newest manifest lists. A run that fails leaves files no manifest names; the pack before stays, and the
next run takes a version of its own. Spark numbers parts with five digits at least, so names of 100 000 parts and more
do not sort. Parts lie in blocks of BLOCK_PARTS, whose padded numbers do.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import case, paths, quoted
from folio.operators import balance, content, prefix_sums, render, writers
from folio.options import FORMATS, PackOptions
from folio.plans.scratch import staged

ORDER = ("corpus", "section", "sort_key")
BLOCK_PARTS = 50_000
# Corpora that each have a folder, whatever their sizes; of more than these, the bytes that a pack with a folder has.
FOLDERS = 1000
FOLDER_BYTES = 16 * 1024 * 1024
SHARED = "shared"
PART_BYTES = 256 * 1024 * 1024
# What a leaf prints besides its content, in bytes, for the weight of a part.
LEAF_BYTES = 100

BLOCK = f"lpad(cast(part div {BLOCK_PARTS} AS STRING), 9, '0')"
_MANIFEST = "corpus STRING, block STRING, part STRING, bytes BIGINT, lines BIGINT, hash BIGINT"


def parts_for(total_bytes: int, at_least: int) -> int:
    """Partitions that keep a part near PART_BYTES."""
    return max(at_least, -(-total_bytes // PART_BYTES))


def corpus_folder(corpus: str) -> str:
    """Name of a corpus as a folder: none, the empty one and the name that Spark gives both are told apart."""
    return case(
        (f"{corpus} IS NULL", "'%none'"),
        (f"{corpus} = ''", "'%empty'"),
        (f"startswith({corpus}, '%') OR startswith({corpus}, '__HIVE_')", f"concat('%', {corpus})"),
        otherwise=corpus,
    )


def corpus_of(folder: str) -> str:
    """The corpus of a folder."""
    return case(
        (f"{folder} = '%none'", "NULL"),
        (f"{folder} = '%empty'", "''"),
        (f"startswith({folder}, '%')", f"substring({folder}, 2)"),
        otherwise=folder,
    )


# Parts hold ranges of this key; the rows of a corpus follow each other in it as in ORDER.
_KEY = f"concat_ws('\\u0000', {corpus_folder('corpus')}, cast(section AS STRING), sort_key)"


def _weights(files: DataFrame, frame: DataFrame) -> DataFrame:
    """(name, key, weight) of all rows of a pack, from names and sizes; `name` is the folder of the corpus."""
    leaf = f"size + 4 * octet_length(path) + {LEAF_BYTES}"
    leaves = files.selectExpr("corpus", f"{render.BODY} AS section", f"{paths.file_key('path')} AS sort_key", f"{leaf} AS weight")
    printed = "octet_length(fragment)" if "fragment" in frame.columns else f"2 * octet_length(path) + {LEAF_BYTES}"
    rest = frame.selectExpr("corpus", "section", "sort_key", f"coalesce({printed}, {LEAF_BYTES}) AS weight")
    name = f"{corpus_folder('corpus')} AS name"
    return leaves.unionByName(rest).selectExpr(name, f"{_KEY} AS key", "cast(coalesce(weight, 0) AS BIGINT) AS weight")


def in_order(
    files: DataFrame, frame: DataFrame, options: PackOptions, partitions: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Rows of packs, files classified and read, in their order over all partitions; `part` is the partition.

    Parts are cut by bytes: a prefix sum of the sizes in pack order gives the first key of each, so a corpus that holds
    a third of all bytes fills that share of the parts, and a few large files do not share one. Files travel once, as
    they are, and are tested, read and printed behind the shuffle. `sizes` (corpus, path, size) are those
    files' printed sizes, where a table without contents has them.
    """
    frame = staged(frame, "frame")
    if partitions is None:
        partitions = files.sparkSession.sparkContext.defaultParallelism
    if sizes is None:
        sizes = staged(files.select("corpus", "path", "size"), "sizes")
    cuts = prefix_sums.cut_keys(_weights(sizes, frame).select("key", "weight"), partitions)
    body = files.selectExpr("*", f"{render.BODY} AS section", f"{paths.file_key('path')} AS sort_key")
    rows = body.unionByName(frame, allowMissingColumns=True)
    part = prefix_sums.part_of(_KEY, cuts)
    dealt = rows.repartitionById(max(1, len(cuts)), F.expr(part)).sortWithinPartitions(*ORDER)
    if "fragment" in dealt.columns:
        dealt = dealt.withColumnRenamed("fragment", "framed")
    read = content.with_content(content.classify(dealt, options), options)
    return read.withColumn("part", F.spark_partition_id())


def ordered(
    files: DataFrame, frame: DataFrame, options: PackOptions, partitions: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Pack rows (corpus, section, sort_key, fragment, part) of a built-in format, in order."""
    read = in_order(files, frame, options, partitions, sizes)
    # Spark moves no filter past a column that depends on the task. Without it, the test for
    # leaves that print nothing would be evaluated ahead of the shuffle, by printing them.
    placed = read.selectExpr(*ORDER, f"coalesce(framed, {render.leaf(options)}) AS fragment", "part")
    return placed.where("part >= 0 AND fragment IS NOT NULL")


def lines(
    files: DataFrame, frame: DataFrame, options: PackOptions, partitions: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """(corpus, part, fragment) of packs in the format of the options, a registered one included."""
    if options.format in FORMATS:
        return ordered(files, frame, options, partitions, sizes).select("corpus", "part", "fragment")
    return writers.written(writers.described(in_order(files, frame, options, partitions, sizes)), options.format)


# --- versions -----------------------------------------------------------------------------


def write_pack(
    files: DataFrame,
    frame: DataFrame,
    options: PackOptions,
    path: str,
    partitions: int | None = None,
    sizes: DataFrame | None = None,
    checksums: bool = False,
) -> int:
    """Write packs as a new version and publish it; returns the version."""
    spark, version = files.sparkSession, time.time_ns()
    if sizes is None:
        sizes = staged(files.select("corpus", "path", "size"), "sizes")
    with_folder = _with_folders(sizes, frame)

    def written(how: str | None) -> DataFrame:
        some = [rows if how is None else _of_corpora(rows, with_folder, how) for rows in (files, frame, sizes)]
        return lines(*some[:2], options, partitions, some[2])

    if with_folder is None:
        _write_folders(written(None), path, version)
    else:
        _write_shared(written("left_anti"), path, version)
        if not with_folder.isEmpty():
            _write_folders(written("left_semi"), path, version)
    publish(spark, path, version, checksums)
    return version


def _with_folders(sizes: DataFrame, frame: DataFrame) -> DataFrame | None:
    """Corpora (folder name) whose packs get a folder, or None for all of them."""
    counted = _weights(sizes, frame).groupBy("name").agg(F.sum("weight").alias("bytes"))
    corpora = staged(counted, "corpora")
    if corpora.count() <= FOLDERS:
        return None
    return corpora.where(f"bytes >= {FOLDER_BYTES}").select("name")


def _of_corpora(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """Rows of the corpora with a folder, or of the others; these are few, a folder for `FOLDER_BYTES`, and sent to the rows."""
    return rows.join(F.broadcast(names), F.expr(corpus_folder("corpus")) == F.col("name"), how)


def _write_folders(placed: DataFrame, path: str, version: int) -> None:
    named = placed.selectExpr(f"{corpus_folder('corpus')} AS corpus", f"{BLOCK} AS block", "fragment AS value")
    named.write.partitionBy("corpus", "block").text(f"{path}/version={version}")


def _write_shared(placed: DataFrame, path: str, version: int) -> None:
    named = placed.selectExpr(f"{corpus_folder('corpus')} AS corpus", "fragment AS value")
    named.write.parquet(f"{path}/{SHARED}/version={version}")


# --- reading ------------------------------------------------------------------------------


def listing(spark: SparkSession, path: str, version: int, checksums: bool = False) -> DataFrame:
    """The parts of a version as they lie there: their bytes, and with `checksums` their lines and an order-free hash of these.

    A small pack's part is what a shared file holds of it.
    """
    own, shared = _listed_folders(spark, path, version, checksums), _shared(spark, path, version)
    if own is None and shared is None:
        return spark.createDataFrame([], _MANIFEST)
    if shared is None:
        return own
    sums = [F.expr("sum(octet_length(value) + 1L) AS bytes"), *[F.lit(None).cast("bigint").alias(c) for c in ("lines", "hash")]]
    if checksums:
        read = _as_lines(shared).groupBy("corpus", "block", "part")
        # A line's end is a byte that its value does not hold.
        sums = [sums[0], F.count("*").alias("lines"), F.expr("bit_xor(xxhash64(value)) AS hash")]
    else:
        read = shared.groupBy("corpus", "block", "part")
    found = read.agg(*sums)
    return found if own is None else own.unionByName(found)


def _found(load) -> DataFrame | None:
    """What `load` reads, or None where its folder is not there."""
    try:
        return load()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _listed_folders(spark: SparkSession, path: str, version: int, checksums: bool) -> DataFrame | None:
    folder = f"{path}/version={version}"
    names = [f"url_decode(replace(regexp_extract(path, {quoted(f'/{k}=([^/]*)/')}, 1), '+', '%2B')) AS {k}" for k in ("corpus", "block")]
    part = "substring_index(path, '/', -1) AS part"
    found = _found(lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
    if found is None:
        return None
    found = found.where("length > 0").selectExpr(*names, part, "length AS bytes")
    if not checksums:
        return found.selectExpr("*", "cast(NULL AS BIGINT) AS lines", "cast(NULL AS BIGINT) AS hash")
    # One group for each file; tasks send one row of each they read.
    read = _in_folders(spark, path, version).groupBy("corpus", "block", "part")
    sums = read.agg(F.count("*").alias("lines"), F.expr("bit_xor(xxhash64(value)) AS hash"))
    return found.join(sums, ["corpus", "block", "part"], "left")


def publish(spark: SparkSession, path: str, version: int, checksums: bool = False) -> None:
    """Make a written version the current one. The manifest is one file, which appears whole or not at all."""
    listing(spark, path, version, checksums).coalesce(1).write.parquet(f"{path}/manifests/version={version}")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Parts (corpus, block, part, bytes, lines, hash) of a published version, the newest one unless given."""
    try:
        published = spark.read.schema(_MANIFEST + ", version BIGINT").parquet(f"{path}/manifests")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST + ", version BIGINT")
    if version is None:
        version = published.agg(F.max("version")).first()[0]
    return published.where(F.col("version") == F.lit(version))


def current_version(spark: SparkSession, path: str) -> int | None:
    return manifest(spark, path).agg(F.max("version")).first()[0]


def _in_folders(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    read = spark.read.schema("value STRING, corpus STRING, block STRING").option("lineSep", "\n")
    rows = _found(lambda: read.text(f"{path}/version={version}"))
    return rows and rows.selectExpr("corpus", "block", "_metadata.file_name AS part", "_metadata.file_block_start AS start", "value")


def _shared(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """Fragments of the packs of a version that share files, if there are any."""
    rows = _found(lambda: spark.read.schema("corpus STRING, value STRING").parquet(f"{path}/{SHARED}/version={version}"))
    named = ("corpus", f"'{SHARED}' AS block", "_metadata.file_name AS part", "_metadata.file_block_start AS start", "value")
    return rows and rows.selectExpr(*named)


def _as_lines(fragments: DataFrame) -> DataFrame:
    """The lines that a text file of the fragments has."""
    return fragments.selectExpr("corpus", "block", "part", "start", "explode(split(value, '\\n')) AS value")


def _stored(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Lines (corpus, block, part, start, value) of a version, in the order of each split."""
    own, shared = _in_folders(spark, path, version), _shared(spark, path, version)
    some = [rows for rows in (own, shared and _as_lines(shared)) if rows is not None]
    return some[0] if len(some) == 1 else some[0].unionByName(some[1])


def read_pack(spark: SparkSession, path: str, corpus: str | None) -> DataFrame:
    """Lines (part, value) of one published pack; no rows where nothing is published."""
    name = "cast(NULL AS STRING)" if corpus is None else quoted(corpus)
    return _published(spark, path, f"corpus = {corpus_folder(name)}").select("part", "value")


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (corpus, part, value) of all published packs."""
    return _published(spark, path, "true")


def _published(spark: SparkSession, path: str, condition: str) -> DataFrame:
    """Lines of published packs whose folder name meets a condition, which leaves other folders and shared files unread."""
    listed = manifest(spark, path)
    version = listed.agg(F.max("version")).first()[0]
    if version is None:
        return spark.createDataFrame([], "corpus STRING, part STRING, value STRING")
    parts = listed.where(condition).select("corpus", "block", "part")
    kept = _stored(spark, path, version).where(condition).join(parts, ["corpus", "block", "part"], "left_semi")
    return kept.selectExpr(f"{corpus_of('corpus')} AS corpus", "concat_ws('/', block, part) AS part", "value")


def pack_faults(spark: SparkSession, path: str) -> DataFrame:
    """Where the elements of published XML packs do not nest: (corpus, fault), the fault NULL for a sound pack."""
    version = current_version(spark, path)
    if version is None:
        return spark.createDataFrame([], "corpus STRING, fault STRING")
    found = balance.pack_faults(_stored(spark, path, version))
    return found.selectExpr(f"{corpus_of('corpus')} AS corpus", "fault")


def damaged_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parts of the published version that are missing or differ from the manifest: (corpus, block, part)."""
    listed = manifest(spark, path)
    version = listed.agg(F.max("version")).first()[0]
    if version is None:
        return listed.select("corpus", "block", "part")
    with_sums = listed.where("hash IS NOT NULL").limit(1).count() > 0
    there = listing(spark, path, version, with_sums).select("corpus", "block", "part", "bytes", "lines", "hash")
    keys = ["corpus", "block", "part"]
    sound = listed.alias("l").join(there.alias("t"), keys, "left")
    differs = " OR ".join(f"NOT (l.{c} <=> t.{c})" for c in ("bytes", "lines", "hash"))
    return sound.where(f"t.bytes IS NULL OR {differs}").select(*keys)
