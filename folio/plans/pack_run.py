"""A whole run: files in, packs and reports out, for all corpora at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import paths, quoted
from folio.operators import content, filters, ignore_rules, largest, render, tokens, totals, tree, writers
from folio.operators.console import console_report, duration_text
from folio.options import PackOptions
from folio.plans.scratch import staged
from folio.sources import packs
from folio.sources.tree import scan_trees


@dataclass(frozen=True)
class PackRun:
    """What a run leaves: per-file facts, totals and report rows, all small next to the data."""

    measured: DataFrame
    totals: DataFrame
    files: DataFrame
    summary: DataFrame
    report: DataFrame
    fresh_cache: DataFrame | None
    rejects: DataFrame  # corpus, reason, entries: what the pack does not hold, or holds as an error
    details: DataFrame  # one row per reported path
    outputs: DataFrame  # corpus, output: where the pack of a repository belongs, or of any other corpus by its name


def select(files: DataFrame, options: PackOptions, rules: DataFrame | None = None) -> DataFrame:
    """Files that pass the name filters and, in ignore-file mode, the rules.

    The excluded files are written first: they are few, and with their number known Spark
    can broadcast them instead of moving contents.
    """
    kept = filters.select_files(files, options)
    if rules is None:
        return kept
    ignored = ignore_rules.ignored_files(kept.select("corpus", "path"), rules)
    return ignore_rules.drop_ignored(kept, staged(ignored, "ignored"))


def count_tokens(
    measured: DataFrame, files: DataFrame, cache: DataFrame, options: PackOptions
) -> DataFrame:
    """Entries counted in this run, to be added to the cache.

    The misses are written first: with their number known, Spark sends few of them to the files.
    """
    live = tokens.cache_expire(cache, options.now_s)
    misses = staged(tokens.cache_misses(measured, live, options.model_id), "misses")
    how = (options.counter, options.model_id, options.now_s, options)
    return staged(tokens.count_misses(files, misses, *how), "fresh")


def left_out(files: DataFrame, measured: DataFrame) -> DataFrame:
    """Entries by corpus and reason that are no file or could not be opened, and files whose text could not be read."""
    failed = measured.where("read_status IN ('open_error', 'read_error', 'oversize')")
    failed = failed.groupBy("corpus", F.col("read_status").alias("reason")).agg(F.count("*").alias("entries"))
    return content.rejects(files).unionByName(failed)


def run(
    files: DataFrame,
    options: PackOptions,
    output: str,
    rules: DataFrame | None = None,
    cache: DataFrame | None = None,
    repos: DataFrame | None = None,
    folders: DataFrame | None = None,
    seconds: float = 0.0,
    partitions: int | None = None,
) -> PackRun:
    """Pack all corpora of a files table into `output`.

    Contents are read for the measures and for the pack; everything between works on the
    measured table, which is written once and holds no contents.
    """
    kept = select(files, options, rules)
    packable = content.accepted(kept)
    measured = staged(content.measured(packable, options), "measured")

    details = totals.file_details(measured, repos)
    fresh = None
    no_count = F.lit(None).cast("bigint")
    if options.model_id is not None:
        known = cache if cache is not None else files.sparkSession.createDataFrame(
            [], tokens.CACHE_SCHEMA
        )
        fresh = count_tokens(measured, packable, known, options)
        live = tokens.cache_expire(known, options.now_s)
        counted = live.unionByName(fresh)
        base = tokens.corpus_summary(measured, live, fresh, options.model_id)
        # The shown files are few, so the cache is cut to their hashes before it is grouped.
        top = staged(largest.largest_files(details), "top")
        wanted = top.select("hash").distinct()
        entries = counted.join(wanted, "hash", "left_semi")
        shown = tokens.cache_lookup(top, entries, options.model_id)
    else:
        base = totals.corpus_totals(measured).withColumns(
            {c: no_count for c in ("tokens", "hits", "lookups")}
        )
        shown = largest.largest_files(details).withColumn("tokens", no_count)

    base = staged(base, "totals")
    file_rows = staged(largest.files_report(shown), "files")
    summary = totals.summary_report(base, options.output_name, duration_text(seconds))

    if options.format == "txt":
        frame = render.txt_frame(base.select("corpus"), options, repos)
    else:
        dirs = staged(tree.directories(measured, folders), "dirs")
        dir_metadata = None if folders is None else folders.withColumnRenamed("path", "dir")
        if options.format == "xml":
            frame = render.xml_frame(measured, dirs, options, repos, dir_metadata)
        else:
            frame = writers.event_frame(base.select("corpus"), dirs)
    sizes = measured.selectExpr("corpus", "path", "if(read_status = 'ok', size, 0L) AS size")
    if partitions is None:
        total = sizes.agg(F.sum("size")).first()[0]
        partitions = packs.parts_for(total or 0, files.sparkSession.sparkContext.defaultParallelism)
    packs.write_pack(packable, frame, options, output, partitions, sizes)
    placed = paths.output_path(quoted(options.output_name), "coalesce(corpus, '')")
    outputs = base.selectExpr("corpus", f"{placed} AS output")
    report = console_report(file_rows, summary)
    return PackRun(measured, base, file_rows, summary, report, fresh, left_out(files, measured), details, outputs)


def run_trees(
    spark: SparkSession,
    roots: DataFrame,
    options: PackOptions,
    output: str,
    cache: DataFrame | None = None,
    repos: DataFrame | None = None,
    seconds: float = 0.0,
) -> PackRun:
    """Scan trees (corpus, root) and pack them."""
    files, folders, rule_files = scan_trees(roots, options)
    files = staged(files, "files")
    rules = None
    if options.respect_gitignore or options.custom_ignore_name:
        texts = rule_files.withColumn("content", F.expr("make_valid_utf8(cast(raw AS STRING))"))
        rules = spark.createDataFrame([], ignore_rules.RULES_SCHEMA)
        if options.respect_gitignore:
            for name, rank in ((".gitignore", ignore_rules.GIT_RANK), (".ignore", ignore_rules.PLAIN_RANK)):
                found = ignore_rules.ignore_files_in(texts, name)
                rules = rules.unionByName(ignore_rules.rules_from(found, rank=rank))
        if options.custom_ignore_name:
            own = ignore_rules.ignore_files_in(texts, options.custom_ignore_name)
            rules = rules.unionByName(ignore_rules.rules_from(own, custom=True))
    return run(files, options, output, rules, cache, repos, folders, seconds)
