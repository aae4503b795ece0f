"""One query per operator over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import case, paths, urls
from folio.functions import text as txt
from folio.operators import (
    chunks,
    content,
    filters,
    ignore_rules,
    largest,
    render,
    repos,
    tokens,
    totals,
    tree,
    writers,
)
from folio.operators.console import console_report, duration_text
from folio.operators.skew import hot_keys
from folio.options import TEXT_LIMIT_BYTES, PackOptions
from folio.plans import driver_tables as given
from folio.plans import pack_run, rerun
from folio.plans.scratch import new_path, staged
from folio.sources import packs, tables, token_cache
from folio.sources import tree_source
from folio.sources.tree import scan_trees
from folio.streaming.incremental import incremental_tokens

NAMES_ONLY = PackOptions(respect_gitignore=False)
COUNTED = PackOptions(model_id=given.MODEL, now_s=given.NOW_S)
# Here the limits are the feature.
LIMITED = PackOptions(inline_limit=8192, text_limit=TEXT_LIMIT_BYTES)
DESCRIBED = PackOptions(
    include_metadata=True,
    timestamp="2024-01-09T00:00:00+00:00",
    hostname="host<1>",
)
IGNORE_GLOBS = ("*.log", "fr_*[02468].py", "{de,es}_?[!5]*.rs")
INCLUDE_GLOBS = ("*.md", "*.rs", "s*")
CORPUS_SECONDS = 1.25
# Batches in which files arrive at the stream.
ARRIVALS = 3
RAW_HASH = txt.content_hash("cast(raw AS STRING)")
MODIFIED = f"{txt.rfc3339('modified')} AS modified"

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _content(spark, folder, options=COUNTED):
    files = filters.select_files(given.files(spark, folder), options)
    return content.with_content(content.classify(content.accepted(files), options), options)


def _measured(spark, folder, options=COUNTED):
    return content.measured(filters.select_files(given.files(spark, folder), options), options)


def _keys(spark, folder):
    return _measured(spark, folder).select("corpus", "path", "hash")


def _live_cache(spark, folder):
    return tokens.cache_expire(given.token_cache(spark, folder), given.NOW_S)


# --- sources ----------------------------------------------------------------------------


def _as_rows(files: DataFrame) -> DataFrame:
    return files.selectExpr("corpus", "path", "size", f"{RAW_HASH} AS hash")


@query
def files_from_documents(spark, folder):
    return _as_rows(tables.from_documents(given.parquet(spark, folder, "documents")))


@query
def files_from_pages(spark, folder):
    return _as_rows(tables.from_pages(given.parquet(spark, folder, "pages")))


@query
def files_from_conversations(spark, folder):
    return _as_rows(tables.from_conversations(given.parquet(spark, folder, "conversations")))


@query
def resolve_inputs(spark, folder):
    """URLs of pages and names of document sources, as inputs of a run."""
    pages = given.parquet(spark, folder, "pages").selectExpr("url AS input")
    sources = given.parquet(spark, folder, "documents").selectExpr(
        "concat('/data/', source) AS input"
    )
    return repos.resolve_inputs(pages.unionByName(sources).distinct())


@query
def file_metadata(spark, folder):
    rows = tables.metadata(given.files(spark, folder))
    return rows.selectExpr("corpus", "path", "kind", "size", "permissions", MODIFIED)


@query
def scan_tree(spark, folder):
    """The files written out as real trees, one per corpus, and scanned back."""
    roots = given.written_trees(given.files(spark, folder), new_path(spark, "trees"))
    files, _, _ = scan_trees(roots, NAMES_ONLY)
    return files.selectExpr(
        "corpus", "path", "kind", "size", "permissions", MODIFIED, f"{RAW_HASH} AS hash"
    )


def _by_first_folder(entries):
    """Files of trees that lie side by side, each a corpus."""
    return entries.where("kind = 'file'").selectExpr(
        "substring_index(path, '/', 1) AS corpus", "substring(path, instr(path, '/') + 1) AS path",
        "kind", "size", "permissions", MODIFIED, f"{RAW_HASH} AS hash",
    )


@query
def tree_format(spark, folder):
    """The same trees read as a source of Spark, with their contents."""
    base = new_path(spark, "trees")
    given.written_trees(given.files(spark, folder), base)
    tree_source.register(spark)
    entries = spark.read.format("tree").option("content", "true").load(base.removeprefix("file:"))
    # Hidden and listed names are left out by the query here, not by the scan.
    return filters.select_files(_by_first_folder(entries), NAMES_ONLY)


@query
def tree_stream(spark, folder):
    """The same trees read as a stream of files as they arrive, until nothing new is there."""
    base, arrived = new_path(spark, "trees"), new_path(spark, "arrived")
    given.written_trees(given.files(spark, folder), base)
    tree_source.register(spark)
    entries = spark.readStream.format("tree").options(content="true", settle="0").load(base.removeprefix("file:"))
    stream = entries.writeStream.format("parquet").trigger(availableNow=True)
    stream.option("checkpointLocation", new_path(spark, "stream")).start(arrived).awaitTermination()
    return filters.select_files(_by_first_folder(spark.read.parquet(arrived)), NAMES_ONLY)


@query
def cache_roundtrip(spark, folder):
    """Live entries, and all of them, saved as two writes and read back."""
    cache = given.token_cache(spark, folder)
    path = new_path(spark, "cache")
    token_cache.save_version(tokens.cache_expire(cache, given.NOW_S), path)
    token_cache.save_version(cache, path)
    return token_cache.load(spark, path, given.NOW_S)


@query
def cache_compacted(spark, folder):
    """Writes of single days, merged by size, and the contents of one language looked up among them."""
    cache = staged(given.token_cache(spark, folder), "writes")
    path = new_path(spark, "cache")
    for part in range(token_cache.FANOUT + 1):
        token_cache.save_version(cache.where(f"pmod(ts, {token_cache.FANOUT + 1}) = {part}"), path)
    token_cache.compact(spark, path)
    english = given.text_rows(spark, folder).where("lang = 'en' AND text <> ''")
    return token_cache.load_for(english.selectExpr(f"{txt.content_hash('text')} AS hash"), path, given.NOW_S)


@query
def count_files(spark, folder):
    return filters.count_files(given.files(spark, folder), PackOptions())


@query
def count_files_by_name(spark, folder):
    return filters.count_files(given.files(spark, folder), PackOptions(), by_name_only=True)


# --- filters and paths ------------------------------------------------------------------


@query
def ignore_defaults(spark, folder):
    """The default list on the names of all files and folders."""
    files = given.files(spark, folder).select("corpus", "path")
    dirs = tree.directories(files).where("dir <> ''")
    entries = files.unionByName(dirs.withColumnRenamed("dir", "path"))
    name = paths.name_of("path")
    return entries.selectExpr(
        "corpus",
        "path",
        f"{filters.is_default_ignored(name)} AS ignored",
        f"{filters.is_default_ignored(name, with_globs=True)} AS ignored_with_globs",
    )


@query
def ignore_globs(spark, folder):
    options = PackOptions(ignore_patterns=IGNORE_GLOBS, respect_gitignore=False)
    return filters.select_files(given.files(spark, folder), options).select("corpus", "path")


@query
def include_globs(spark, folder):
    files = given.files(spark, folder)
    loose = PackOptions(include_patterns=INCLUDE_GLOBS, respect_gitignore=False)
    strict = PackOptions(
        include_patterns=INCLUDE_GLOBS, include_dirs=True, respect_gitignore=False
    )
    return files.selectExpr(
        "corpus",
        "path",
        f"{filters.keep_path('path', loose)} AS kept",
        f"{filters.keep_path('path', strict)} AS kept_with_dirs",
    )


@query
def prune_dirs(spark, folder):
    return filters.prune_dirs(given.files(spark, folder), NAMES_ONLY).select("corpus", "path")


@query
def exclude_output(spark, folder):
    """One document's file stands for the pack's own output."""
    own = filters.is_output_file("path", PackOptions(output_file=given.OUTPUT_FILE))
    return given.files(spark, folder).where(f"NOT {own}").select("corpus", "path")


@query
def skip_hidden(spark, folder):
    files = given.files(spark, folder)
    shown = filters.select_files(files, PackOptions())
    return shown.select("corpus", "path")


@query
def gitignore_filter(spark, folder):
    files = staged(given.files(spark, folder).select("corpus", "path"), "paths")
    rules = ignore_rules.rules_from(given.ignore_files(files))
    ignored = ignore_rules.ignored_files(files, rules)
    return ignore_rules.drop_ignored(files, ignored)


@query
def gitignore_custom(spark, folder):
    files = staged(given.files(spark, folder).select("corpus", "path"), "paths")
    rules = ignore_rules.rules_from(given.ignore_files(files)).unionByName(
        ignore_rules.rules_from(given.custom_ignore_files(files), custom=True)
    )
    return ignore_rules.drop_ignored(files, ignore_rules.ignored_files(files, rules))


@query
def path_parts(spark, folder):
    return given.files(spark, folder).selectExpr(
        "corpus",
        "path",
        f"{paths.name_of('path')} AS name",
        f"{paths.ext_of('path')} AS ext",
        f"{paths.dir_of('path')} AS dir",
        f"{paths.depth_of('path')} AS depth",
    )


@query
def normalize_path(spark, folder):
    rows = given.absolute_paths(spark, folder)
    relative = paths.relative_to("full_path", "root")
    return rows.selectExpr("doc_id", "full_path", f"{relative} AS relative_path")


@query
def report_path(spark, folder):
    rows = given.absolute_paths(spark, folder)
    shown = paths.report_path("full_path", "root", "'owner'", "corpus")
    return rows.selectExpr("doc_id", "full_path", f"{shown} AS report_path")


@query
def display_path(spark, folder):
    rows = given.wordy_paths(spark, folder)
    return rows.selectExpr("doc_id", "path", f"{paths.display_path('path')} AS display_path")


@query
def output_path(spark, folder):
    """Where each repository's pack goes: bare names, relative and absolute paths."""
    output = case(
        ("policy = 'always_pull'", "'pack.xml'"),
        ("policy = 'force_clone'", "'out/pack.xml'"),
        otherwise="'/tmp/pack.xml'",
    )
    rows = given.repos(spark, folder).where("cache_path IS NOT NULL")
    wanted = rows.selectExpr("url", "cache_path", f"{output} AS output")
    return wanted.selectExpr("url", f"{paths.output_path('output', 'cache_path')} AS output_path")


@query
def sanitize_path(spark, folder):
    rows = given.wordy_paths(spark, folder)
    return rows.selectExpr("doc_id", f"{paths.sanitize_path('path')} AS file_name")


# --- classification and content ---------------------------------------------------------


@query
def classify_text(spark, folder):
    files = given.files(spark, folder)
    trimmed = PackOptions(trim_partial_char=True)
    return files.selectExpr(
        "corpus",
        "path",
        f"{content.entry_kind(PackOptions())} AS kind",
        f"{content.entry_kind(trimmed)} AS kind_if_trimmed",
    )


@query
def kind_dispatch(spark, folder):
    """Entries of every kind, by language: files, links and other things."""
    files = given.mixed_kinds(spark, folder)
    kinds = content.classify(content.accepted(files), PackOptions())
    kept = kinds.groupBy("corpus", "kind").agg(F.expr("count(1) AS entries"))
    rejected = content.rejects(files).withColumnRenamed("reason", "kind")
    return kept.unionByName(rejected)


@query
def symlinks(spark, folder):
    files = content.accepted(given.mixed_kinds(spark, folder))
    options = PackOptions(record_symlinks=True)
    rows = content.with_measures(content.with_content(content.classify(files, options), options))
    printed = f"{render.txt_fragment(options)} AS printed"
    links = rows.where("kind = 'symlink'")
    return links.selectExpr("corpus", "path", "target", "lines", "chars", printed)


@query
def bounded_content(spark, folder):
    files = content.classify(given.files(spark, folder), LIMITED)
    return content.with_content(files, LIMITED).select("corpus", "path", "read_status", "content")


@query
def read_failures(spark, folder):
    """Files with a broken byte at the end; it is only met where the head does not reach."""
    files = given.files(spark, folder)
    broken = files.withColumns({"raw": F.expr("concat(raw, X'FF')"), "size": F.expr("size + 1")})
    options = PackOptions()
    rows = content.with_content(content.classify(broken, options), options)
    return rows.select("corpus", "path", "kind", "read_status", "content")


@query
def run_rejects(spark, folder):
    """What a run leaves out: other things than files, files that do not open, and texts broken past their head."""
    denied = "kind = 'file' AND permissions = '755'"
    files = given.mixed_kinds(spark, folder).withColumns(
        {
            "raw": F.expr(f"if({denied}, NULL, concat(raw, X'FF'))"),
            "size": F.expr("size + 1"),
            "open_error": F.expr(f"if({denied}, 'denied', NULL)"),
        }
    )
    return pack_run.left_out(files, content.measured(content.accepted(files), PackOptions()))


@query
def size_text(spark, folder):
    size = "n_chars * cast(pow(2, doc_id % 24) AS BIGINT) AS size"
    sizes = given.parquet(spark, folder, "documents").selectExpr("doc_id", size)
    return sizes.selectExpr("doc_id", f"{txt.size_text('size')} AS size_text")


@query
def count_text(spark, folder):
    count = "if(doc_id % 2 = 0, n_chars * 50, n_chars * doc_id) AS n"
    counts = given.parquet(spark, folder, "documents").selectExpr("doc_id", count)
    return counts.selectExpr("doc_id", f"{txt.count_text('n')} AS count_text")


# --- measures ---------------------------------------------------------------------------


@query
def line_count(spark, folder):
    rows = given.text_rows(spark, folder)
    return rows.selectExpr("doc_id", f"{txt.line_count('text')} AS lines")


@query
def char_count(spark, folder):
    rows = given.text_rows(spark, folder)
    return rows.selectExpr("doc_id", f"{txt.char_count('text')} AS chars")


@query
def token_estimate(spark, folder):
    chars = f"{txt.char_count('text')} AS chars"
    rows = given.text_rows(spark, folder).selectExpr("corpus", chars)
    return rows.groupBy("corpus").agg(
        F.expr(f"sum({txt.token_estimate('chars')}) AS sum_of_files"),
        F.expr(f"{txt.token_estimate('sum(chars)')} AS of_total"),
    )


@query
def content_hash(spark, folder):
    rows = given.text_rows(spark, folder)
    return rows.selectExpr("doc_id", f"{txt.content_hash('text')} AS hash")


@query
def count_tokens(spark, folder):
    """A cold run: every distinct content is missing and gets counted."""
    files = filters.select_files(given.files(spark, folder), COUNTED)
    empty = spark.createDataFrame([], tokens.CACHE_SCHEMA)
    misses = staged(tokens.cache_misses(_measured(spark, folder), empty, given.MODEL), "misses")
    return tokens.count_misses(files, misses, "pieces", given.MODEL, given.NOW_S, COUNTED)


@query
def count_missing_tokens(spark, folder):
    """A warm run: only contents that the cache does not hold are read again and counted."""
    files = filters.select_files(given.files(spark, folder), COUNTED)
    cache = _live_cache(spark, folder)
    misses = staged(tokens.cache_misses(_measured(spark, folder), cache, given.MODEL), "misses")
    return tokens.count_misses(files, misses, "pieces", given.MODEL, given.NOW_S, COUNTED)


@query
def count_with_hook(spark, folder):
    """A counter of the caller's own, over batches of texts, as a model's vocabulary would be plugged in."""
    tokens.register_counter("blank_runs", lambda texts: texts.str.count(r"[ \n]+"))
    rows = given.text_rows(spark, folder)
    return rows.select("doc_id", "path", tokens.counter("blank_runs")("text").alias("tokens"))


@query
def repeated_paths(spark, folder):
    """Totals of a cold and of a warm run where every file occurs twice under one path, with different contents."""
    files = given.files(spark, folder)
    other = files.withColumns({"raw": F.expr("encode(concat(cast(raw AS STRING), 'x'), 'utf-8')"), "size": F.expr("size + 1")})
    both = filters.select_files(files.unionByName(other), COUNTED)
    facts = staged(content.measured(both, COUNTED), "measured")
    parts = []
    for name, cache in (("cold", spark.createDataFrame([], tokens.CACHE_SCHEMA)), ("warm", _live_cache(spark, folder))):
        misses = staged(tokens.cache_misses(facts, cache, given.MODEL), "misses")
        fresh = staged(tokens.count_misses(both, misses, "pieces", given.MODEL, given.NOW_S, COUNTED), "fresh")
        summed = tokens.corpus_summary(facts, cache, fresh, given.MODEL)
        parts.append(summed.selectExpr("corpus", f"'{name}' AS run", "files", "lines", "chars", "tokens", "lookups"))
    return parts[0].unionByName(parts[1])


@query
def chunked_measures(spark, folder):
    """Files read in chunks, as those are that no row can hold: the measures and hash of the whole."""
    parts = chunks.chunks_of(given.files(spark, folder), 1000)
    found = chunks.measures(chunks.states(parts)).join(chunks.hashes(parts), ["corpus", "path"])
    return found.select("corpus", "path", "size", "lines", "chars", "hash")


# --- cache and models -------------------------------------------------------------------


@query
def cache_lookup(spark, folder):
    """Per file. The keys are written first, so that finding hot contents reads no contents."""
    keys = staged(_keys(spark, folder), "keys").where("hash IS NOT NULL")
    hot = hot_keys(keys, "hash")
    return tokens.cache_lookup(keys, _live_cache(spark, folder), given.MODEL, hot)


@query
def cache_misses(spark, folder):
    misses = tokens.cache_misses(_keys(spark, folder), _live_cache(spark, folder), given.MODEL)
    return misses.select("hash")


@query
def cache_upsert(spark, folder):
    cache = given.token_cache(spark, folder)
    fresh = cache.where(f"model = '{given.MODEL}'").selectExpr(
        "hash", "model", "tokens + 1 AS tokens", f"{given.NOW_S}L AS ts"
    )
    return tokens.cache_upsert(cache, fresh)


@query
def cache_expire(spark, folder):
    return _live_cache(spark, folder)


@query
def cache_hit_rate(spark, folder):
    return tokens.cache_hit_rate(_keys(spark, folder), _live_cache(spark, folder), given.MODEL)


@query
def token_total(spark, folder):
    """From the cache alone; NULL for a corpus none of whose contents is there."""
    return tokens.cached_token_total(
        _keys(spark, folder), _live_cache(spark, folder), given.MODEL
    )


@query
def token_label(spark, folder):
    return totals.token_label(
        tokens.corpus_summary(
            _measured(spark, folder), _live_cache(spark, folder), None, given.MODEL
        )
    )


@query
def context_fit(spark, folder):
    sums = totals.corpus_totals(_measured(spark, folder))
    return tokens.context_fit(
        sums.selectExpr("corpus", f"{txt.token_estimate('chars')} AS tokens")
    )


@query
def model_catalog(spark, folder):
    used = given.token_cache(spark, folder).withColumnRenamed("model", "model_id")
    return tokens.model_catalog(used.groupBy("model_id").agg(F.expr("count(1) AS entries")))


# --- totals and reports -----------------------------------------------------------------


@query
def corpus_totals(spark, folder):
    return totals.corpus_totals(_measured(spark, folder))


@query
def file_details(spark, folder):
    """Details with the counted tokens of the cache."""
    details = staged(totals.file_details(_measured(spark, folder)), "details")
    hot = hot_keys(details.where("hash IS NOT NULL"), "hash")
    found = tokens.cache_lookup(details, _live_cache(spark, folder), given.MODEL, hot)
    return found.select("corpus", "report_path", "lines", "chars", "tokens")


@query
def largest_files(spark, folder):
    ranked = largest.largest_files(totals.file_details(_measured(spark, folder)))
    return ranked.select("corpus", "rank", "report_path", "lines", "chars", "title")


@query
def largest_files_small_corpora(spark, folder):
    """The same over conversations, which are small enough to be shown whole."""
    files = tables.from_conversations(given.parquet(spark, folder, "conversations"))
    ranked = largest.largest_files(totals.file_details(content.measured(files, COUNTED)))
    return ranked.select("corpus", "rank", "report_path", "lines", "chars", "title")


def _report_rows(spark, folder):
    ranked = largest.largest_files(totals.file_details(_measured(spark, folder)))
    return largest.files_report(
        tokens.cache_lookup(ranked, _live_cache(spark, folder), given.MODEL)
    )


@query
def files_report(spark, folder):
    return _report_rows(spark, folder)


def _summary(spark, folder):
    base = tokens.corpus_summary(
        _measured(spark, folder), _live_cache(spark, folder), None, given.MODEL
    )
    return totals.summary_report(base, COUNTED.output_name, duration_text(CORPUS_SECONDS))


@query
def summary_report(spark, folder):
    return _summary(spark, folder)


@query
def console_report_text(spark, folder):
    return console_report(_report_rows(spark, folder), _summary(spark, folder))


QUERIES["console_report"] = QUERIES.pop("console_report_text")


# --- tree and rendering -----------------------------------------------------------------


@query
def pack_order(spark, folder):
    return tree.pack_order(given.files(spark, folder))


@query
def directories(spark, folder):
    return tree.directory_rows(tree.directories(given.files(spark, folder)))


@query
def txt_fragments(spark, folder):
    return render.txt_fragments(_content(spark, folder), COUNTED)


@query
def metadata_block(spark, folder):
    """Leaves of both formats with their metadata."""
    rows = _content(spark, folder, DESCRIBED)
    xml = render.metadata_xml("'    '")
    return rows.selectExpr("corpus", "path", f"{render.metadata_txt()} AS txt", f"{xml} AS xml")


@query
def xml_events(spark, folder):
    rows = _content(spark, folder, DESCRIBED)
    return render.xml_events(rows, tree.directories(rows), DESCRIBED)


@query
def xml_overview(spark, folder):
    files = filters.select_files(given.files(spark, folder), COUNTED)
    return render.xml_overview(files, tree.directories(files))


@query
def xml_escape(spark, folder):
    rows = given.text_rows(spark, folder)
    return rows.selectExpr(
        "doc_id", f"{txt.xml_escape('text')} AS escaped", f"{txt.cdata('text')} AS section"
    )


def _repo_corpora(spark, folder):
    """Pages as corpora of their repositories; pages outside any repository by host."""
    rows = given.repos(spark, folder)
    corpora = rows.selectExpr(
        "coalesce(cache_path, concat('page/', page_id)) AS corpus",
        "if(cache_path IS NULL, NULL, url) AS repo_url",
        "host AS repo_host",
        "owner AS repo_owner",
        "name AS repo_name",
    )
    keys = ("corpus", "repo_host", "repo_owner", "repo_name")
    return corpora.groupBy(*keys).agg(F.min("repo_url").alias("repo_url"))


@query
def pack_header(spark, folder):
    corpora = _repo_corpora(spark, folder)
    both = [
        render.headers(corpora, replace(DESCRIBED, format=name)).selectExpr("*", f"'{name}' AS format")
        for name in ("txt", "xml")
    ]
    return both[0].unionByName(both[1])


@query
def pack_txt(spark, folder):
    files = content.accepted(filters.select_files(given.files(spark, folder), COUNTED))
    frame = render.txt_frame(files.select("corpus").distinct(), COUNTED)
    return packs.ordered(files, frame, COUNTED).drop("part")


@query
def pack_xml(spark, folder):
    options = PackOptions(format="xml")
    files = content.accepted(filters.select_files(given.files(spark, folder), options))
    dirs = tree.directories(files)
    frame = render.xml_frame(files, dirs, options)
    return packs.ordered(files, frame, options).drop("part")


def _written_packs(spark, folder, options, renamed="corpus", damaged=False):
    """Packs of all files, written and published; corpora by an expression, and on request with closings missing."""
    files = content.accepted(filters.select_files(given.files(spark, folder), options))
    files = files.withColumn("corpus", F.expr(renamed))
    path = new_path(spark, "packs")
    dirs = tree.directories(files)
    corpora = dirs.where("dir = ''").select("corpus")
    if options.format == "txt":
        frame = render.txt_frame(corpora, options)
    elif options.format == "xml":
        frame = render.xml_frame(files, dirs, options)
    else:
        frame = writers.event_frame(corpora, dirs)
    if damaged:
        frame = frame.where(f"NOT ({given.PLANTED_FAULT})")
    packs.write_pack(files, frame, options, path, checksums=True)
    return path


@query
def pack_published(spark, folder):
    """Packs as a reader finds them, those of a corpus without name and of one with an empty name apart."""
    path = _written_packs(spark, folder, COUNTED, given.ODD_CORPORA)
    listed = packs.manifest(spark, path).groupBy("corpus").agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))
    return listed.selectExpr(f"{packs.corpus_of('corpus')} AS corpus", "bytes", "lines")


@query
def pack_balance(spark, folder):
    """The nesting of written XML packs, some of which lost the end of a folder."""
    path = _written_packs(spark, folder, PackOptions(format="xml"), damaged=True)
    return packs.pack_faults(spark, path)


@query
def pack_with_hook(spark, folder):
    """A format of the caller's own: one line for each event, with the size of what is read."""
    writers.register_writer("outline", given.outline)
    path = _written_packs(spark, folder, PackOptions(format="outline"))
    corpora = given.files(spark, folder).select("corpus").distinct()
    stored = packs.stored_lines(spark, path)
    return stored.join(corpora, "corpus", "left_semi").select("corpus", "value")


@query
def full_run(spark, folder):
    """A whole run with rules and a cache: packs written, and the totals it reports."""
    files = given.files(spark, folder)
    rules = ignore_rules.rules_from(given.ignore_files(files.select("corpus", "path")))
    result = pack_run.run(
        files, COUNTED, new_path(spark, "packs"), rules, given.token_cache(spark, folder)
    )
    return result.totals.select("corpus", "files", "lines", "chars", "tokens", "hits", "lookups")


@query
def rerun_totals(spark, folder):
    """Totals after French files changed, German ones went and Spanish ones came, from those of the run before."""
    files = filters.select_files(given.files(spark, folder), COUNTED)
    lang = "regexp_extract(path, '([a-z]{2})_[0-9]', 1)"
    first = content.accepted(files.where(f"{lang} <> 'es'"))
    snapshot = staged(content.measured(first, COUNTED), "snapshot")
    french = f"{lang} = 'fr'"
    second = files.where(f"{lang} <> 'de'").withColumns(
        {
            "raw": F.expr(f"if({french}, concat(raw, X'78'), raw)"),
            "size": F.expr(f"if({french}, size + 1, size)"),
            "modified": F.expr(f"if({french}, modified + INTERVAL 1 DAY, modified)"),
        }
    )
    found = rerun.rerun_files(second, snapshot, rerun.contributions(snapshot), COUNTED)
    return found.totals.select("corpus", "files", "lines", "chars")


@query
def run_of_repos(spark, folder):
    """A run over repositories: how their files are reported, and where each pack belongs."""
    pages = given.parquet(spark, folder, "pages").select("page_id", "html")
    known = given.repos(spark, folder).where("cache_path IS NOT NULL")
    rows = known.join(pages, "page_id")
    files = tables.files_from_texts(rows, "cache_path", "concat('src/page', page_id, '.html')", "html")
    owned = _repo_corpora(spark, folder).where("repo_url IS NOT NULL")
    result = pack_run.run(files, NAMES_ONLY, new_path(spark, "packs"), repos=staged(owned, "repos"))
    return result.details.join(result.outputs, "corpus").select("corpus", "report_path", "lines", "chars", "output")


# --- repositories -----------------------------------------------------------------------


def _urls(spark, folder):
    """Page URLs, and SSH and HTTP forms of repositories made from their parts."""
    known = "element_at(array('github.com', 'gitlab.com', 'bitbucket.org'), cast(page_id % 3 AS INT) + 1)"
    pages = given.parquet(spark, folder, "pages").selectExpr(
        "page_id", "url", "split(url, '/')[2] AS host", f"{known} AS known"
    )
    forms = (
        "url",
        "concat('git@', host, ':team/r', page_id, '.git')",
        "concat('git@', known, ':team/r', page_id)",
        "concat('https://', known, '/team/r', page_id, '.git')",
        "concat('http://user@', known, ':8080/a/b/r', page_id, '.git.git')",
        "concat('https://', known, '/', page_id)",
        "concat('ssh://git@', known, '/team/r', page_id)",
    )
    return pages.selectExpr(f"explode(array({', '.join(forms)})) AS url").distinct()


@query
def is_repo_url(spark, folder):
    return _urls(spark, folder).selectExpr("url", f"{urls.is_repo_url('url')} AS is_repo")


def _parsed(spark, folder, *columns):
    return repos.with_repo(_urls(spark, folder)).select("url", *columns)


@query
def parse_repo_url(spark, folder):
    return _parsed(spark, folder, "host", "owner", "name")


@query
def host_kind(spark, folder):
    return _parsed(spark, folder, "host_kind")


@query
def repo_cache_path(spark, folder):
    return _parsed(spark, folder, "cache_path")


@query
def repo_display(spark, folder):
    return _parsed(spark, folder, "display")


@query
def refresh_plan(spark, folder):
    rows = given.repos(spark, folder)
    return repos.refresh_plan(rows, given.snapshots(spark, folder))


@query
def snapshot_retention(spark, folder):
    return repos.snapshot_retention(given.snapshots(spark, folder), 5, given.NOW_S)


# --- streaming --------------------------------------------------------------------------


@query
def incremental_tokens_run(spark, folder):
    """The files arrive in several batches; the cache they leave."""
    arrived, cache = new_path(spark, "arrived"), new_path(spark, "cache")
    files = filters.select_files(given.files(spark, folder), COUNTED)
    # So many batches at any size; all together are as many files as tasks read the table.
    each = -(-files.rdd.getNumPartitions() // ARRIVALS)
    files.repartition(ARRIVALS * each, "corpus", "path").write.parquet(arrived)
    stream = (
        spark.readStream.schema(tables.FILES_SCHEMA).option("maxFilesPerTrigger", each).parquet(arrived)
    )
    incremental_tokens(stream, cache, new_path(spark, "stream"), COUNTED).awaitTermination()
    return token_cache.load(spark, cache)


QUERIES["incremental_tokens"] = QUERIES.pop("incremental_tokens_run")
