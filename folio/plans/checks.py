"""SQL that computes each query on the checking database, by other means where there are any.

A few queries over the same view are written once as common table expressions:

    f   files view          corpus, path, permissions, modified_s, text, doc_id, lang
    k   with path parts     + name, dir, parts, hidden, listed (some folder or name is listed)
    c   with classification + size, kind
    m   kept and measured   + status, lines, chars, hash (default filters)
"""

from __future__ import annotations

from folio.functions.text import PIECES
from folio.operators.content import READ_FAILED, TOO_LARGE
from folio.options import DEFAULT_IGNORE, MODELS
from folio.plans import driver_tables as given
from folio.plans.driver_tables import FILES_SQL, MODEL, NOW_S

FILES = FILES_SQL.format(documents="documents", edges=given.CHECK_EDGES)


def _text_list(values) -> str:
    return "[" + ", ".join("'" + value.replace("'", "''") + "'" for value in values) + "]"


LISTED = _text_list(sorted(set(DEFAULT_IGNORE)))
GLOBS = sorted({entry.rstrip("/") for entry in DEFAULT_IGNORE if set(entry) & set("*/")})
NAME_IS_GLOBBED = " OR ".join(f"name GLOB '{glob}'" for glob in GLOBS)
LINES = (
    "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) "
    "- CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END"
)
CHARS = (
    "CASE WHEN text = '' THEN 0 ELSE length(text) "
    "- len(regexp_extract_all(text, '\\r\\n')) "
    "+ CASE WHEN suffix(text, chr(10)) THEN 0 ELSE 1 END END"
)
PIECE_COUNT = f"len(regexp_extract_all(text, '{PIECES}'))"
FEW_CONTROLS = (
    "len(regexp_extract_all(text, '[\\x00-\\x08\\x0E-\\x1F]')) * 10 < least(strlen(text), 8192)"
)
CUT_INSIDE = "substr(hex(encode(text)), 16385, 1) IN ('8', '9', 'A', 'B')"


def size_words(size: str) -> str:
    return (
        f"CASE WHEN {size} >= 1073741824 THEN printf('%.2f GB', {size} / 1073741824.0::DOUBLE) "
        f"WHEN {size} >= 1048576 THEN printf('%.2f MB', {size} / 1048576.0::DOUBLE) "
        f"WHEN {size} >= 1024 THEN printf('%.2f KB', {size} / 1024.0::DOUBLE) "
        f"ELSE CAST({size} AS VARCHAR) || ' bytes' END"
    )


def count_words(count: str) -> str:
    return (
        f"CASE WHEN {count} >= 1000000 THEN printf('%.1fM', CAST({count} AS DOUBLE) / 1000000.0::DOUBLE) "
        f"WHEN {count} >= 1000 THEN printf('%.1fK', CAST({count} AS DOUBLE) / 1000.0::DOUBLE) "
        f"ELSE CAST({count} AS VARCHAR) END"
    )


def moment(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


def escaped(text: str) -> str:
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("''", "&apos;"), ('"', "&quot;"),
    ):
        text = f"replace({text}, '{char}', '{entity}')"
    return text


def cleaned(text: str) -> str:
    return (
        f"regexp_replace({text}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]', "
        f"chr(65533), 'g')"
    )


def section(text: str) -> str:
    return f"'<![CDATA[' || replace({cleaned(text)}, ']]>', ']]]]><![CDATA[>') || ']]>'"


F_ = f"f AS ({FILES})"
# The files of the second of two runs.
RERUN_FILES = (
    "SELECT corpus, path, permissions, modified_s, CASE WHEN lang = 'fr' THEN text || 'x' ELSE text END AS text, doc_id, lang "
    f"FROM ({FILES}) WHERE lang <> 'de'"
)
K_ = f"""{F_}, k AS (
  SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name,
         array_to_string(string_split(path, '/')[:-2], '/') AS dir,
         len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) > 0 AS hidden,
         len(list_filter(string_split(path, '/'), lambda x: list_contains({LISTED}, x))) > 0 AS listed
  FROM f)"""
C_ = f"""{K_}, c AS (
  SELECT *, CAST(strlen(text) AS BIGINT) AS size,
         CASE WHEN text <> '' AND NOT {CUT_INSIDE} AND {FEW_CONTROLS}
              THEN 'text' ELSE 'binary' END AS kind
  FROM k)"""
M_ = f"""{C_}, m AS (
  SELECT corpus, path, name, parts, permissions, modified_s, text, size, kind, status,
         CASE WHEN status = 'ok' THEN {LINES} ELSE 0 END AS lines,
         CASE WHEN status = 'ok' THEN {CHARS} ELSE 0 END AS chars,
         CASE WHEN status = 'ok' THEN sha256(text) END AS hash
  FROM (SELECT *, CASE WHEN kind <> 'text' THEN kind ELSE 'ok' END AS status
        FROM c WHERE NOT hidden AND NOT listed))"""
# The stored writes, the live ones, and the live entries of the model in question.
CACHE_ = f"""writes AS (
  SELECT sha256(text) AS hash, CASE WHEN lang = 'en' THEN '{MODEL}' ELSE '{given.OTHER_MODEL}' END AS model,
         CAST({PIECE_COUNT} AS BIGINT) AS tokens, {NOW_S} - (doc_id * 6007) % 1209600 AS ts
  FROM f WHERE text <> ''),
live AS (SELECT * FROM writes WHERE {NOW_S} - ts < 604800),
known AS (SELECT hash, arg_max(tokens, ts) AS tokens FROM live WHERE model = '{MODEL}' GROUP BY hash)"""
TOTALS_ = """t AS (
  SELECT corpus, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines,
         CAST(sum(chars) AS BIGINT) AS chars FROM m GROUP BY corpus)"""
# One file after the other, in path order: a hit is a known content or one seen before.
LOOKUPS_ = """lookups AS (
  SELECT m.corpus, known.hash IS NOT NULL
         OR row_number() OVER (PARTITION BY m.corpus, m.hash ORDER BY m.path) > 1 AS hit,
         known.tokens
  FROM m LEFT JOIN known ON m.hash = known.hash WHERE m.status = 'ok'),
rates AS (
  SELECT corpus, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
         count(*) AS lookups, CAST(sum(tokens) AS BIGINT) AS tokens FROM lookups GROUP BY corpus)"""
RANKED_ = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY chars DESC, path) AS rank,
         count(*) OVER (PARTITION BY corpus) AS n FROM m)"""
SHOWN = "WHERE n <= 15 OR rank <= 10"
TITLE = (
    "CASE WHEN n > 15 THEN 'TOP 10 LARGEST FILES BY CHARACTER COUNT' "
    "ELSE 'PROCESSED FILES' END AS title"
)
DIRS_ = """dirs AS (
  SELECT DISTINCT corpus, array_to_string(p[1:i], '/') AS dir, i AS depth
  FROM (SELECT corpus, parts[:-2] AS p, unnest(range(0, len(parts))) AS i FROM {source}))"""
DIR_KEY = (
    "CASE WHEN dir = '' THEN '' ELSE array_to_string(list_transform(string_split(dir, '/'), "
    "lambda x: '0' || x), chr(1)) || chr(1) END"
)
FILE_KEY = (
    "array_to_string(list_transform(parts, lambda x, i: "
    "CASE WHEN i = len(parts) THEN '1' ELSE '0' END || x), chr(1))"
)
DIR_NAME = "CASE WHEN dir = '' THEN corpus ELSE string_split(dir, '/')[-1] END"
DIR_PATH = "CASE WHEN dir = '' THEN corpus ELSE corpus || '/' || dir END"
EXT = "regexp_extract(name, '(?s)^.+\\.([^.]*)$', 1)"
CONTENT = f"CASE WHEN status = 'ok' THEN text WHEN status = 'oversize' THEN '{TOO_LARGE}' || {size_words('size')} END"
NL = "chr(10)"
META_TXT = (
    f"'  Size: ' || size || {NL} || '  Modified: ' || {moment('modified_s')} || {NL} || "
    f"'  Permissions: ' || permissions"
)


def meta_xml(pad: str) -> str:
    return (
        f"{pad} || '<metadata>' || {NL} || {pad} || '  <size>' || size || '</size>' || {NL} || "
        f"{pad} || '  <modified>' || {moment('modified_s')} || '</modified>' || {NL} || "
        f"{pad} || '  <permissions>' || permissions || '</permissions>' || {NL} || "
        f"{pad} || '</metadata>'"
    )


FENCED = (
    f"{NL} || repeat('=', 48) || {NL} || corpus || '/' || path || {NL} || repeat('=', 48) || {NL} || "
    f"{NL} || '```' || {EXT} || {NL} || {CONTENT} || {NL} || '```'"
)
# Leaves of the XML body; {meta} is the metadata block with its newline, or nothing.
XML_LEAF = (
    "CASE WHEN kind = 'text' THEN {pad} || '<file name=\"' || " + escaped("name") + " || '\" path=\"' || "
    + escaped("corpus || '/' || path") + " || '\">' || chr(10) || {meta} || {pad} || '  <content>' || "
    + section("content").replace("{", "{{").replace("}", "}}")
    + " || '</content>' || chr(10) || {pad} || '</file>' "
    "ELSE {pad} || '<binary name=\"' || " + escaped("name") + " || '\" path=\"' || "
    + escaped("corpus || '/' || path") + " || '\">' || chr(10) || {meta} || {pad} || '</binary>' END"
)
LEAF_PAD = "repeat(' ', len(parts) * 4 + 2)"
DIR_PAD = "repeat(' ', depth * 4 + 2)"
META_IN_LEAF = meta_xml(f"({LEAF_PAD} || '  ')") + f" || {NL}"


def xml_body(with_metadata: bool, columns: str = "corpus, section, sort_key, fragment") -> str:
    meta = META_IN_LEAF if with_metadata else "''"
    leaf = XML_LEAF.format(pad=LEAF_PAD, meta=meta)
    return f"""
SELECT corpus, 2 AS section, {FILE_KEY} AS sort_key, {leaf} AS fragment
FROM (SELECT *, {CONTENT} AS content FROM m)
UNION ALL
SELECT corpus, 2, {DIR_KEY}, {DIR_PAD} || '<directory name="' || {escaped(DIR_NAME)} || '" path="' ||
       {escaped(DIR_PATH)} || '">' || {NL} || {DIR_PAD} || '  <contents>' FROM dirs
UNION ALL
SELECT corpus, 2, {DIR_KEY} || '2', {DIR_PAD} || '  </contents>' || {NL} || {DIR_PAD} || '</directory>'
FROM dirs"""


OVERVIEW = f"""
SELECT corpus, 1 AS section, {FILE_KEY} AS sort_key,
       repeat(' ', len(parts) * 2 + 4) || '<file name="' || {escaped('name')} || '"/>' AS fragment FROM m
UNION ALL
SELECT corpus, 1, {DIR_KEY}, repeat(' ', depth * 2 + 4) || '<directory name="' || {escaped(DIR_NAME)} || '">'
FROM dirs
UNION ALL
SELECT corpus, 1, {DIR_KEY} || '2', repeat(' ', depth * 2 + 4) || '</directory>' FROM dirs"""

# URLs of the repository queries, and their parts found with list functions.
URLS_ = """u AS (
  SELECT DISTINCT unnest([url,
    'git@' || host || ':team/r' || page_id || '.git',
    'git@' || known || ':team/r' || page_id,
    'https://' || known || '/team/r' || page_id || '.git',
    'http://user@' || known || ':8080/a/b/r' || page_id || '.git.git',
    'https://' || known || '/' || page_id,
    'ssh://git@' || known || '/team/r' || page_id]) AS url
  FROM (SELECT *, string_split(url, '/')[3] AS host,
               CASE page_id % 3 WHEN 0 THEN 'github.com' WHEN 1 THEN 'gitlab.com'
                                ELSE 'bitbucket.org' END AS known FROM pages))"""


def parsed(source: str, url: str = "url", keep: str = "") -> str:
    """CTEs that end in `r`: the rows of `source` with host, owner, name, kind and paths."""
    return f"""cut AS (
  SELECT *, starts_with({url}, 'http://') OR starts_with({url}, 'https://') AS http,
         string_split({url}, '/') AS s, string_split(string_split({url}, '?')[1], '#')[1] AS bare
  FROM {source}),
p AS (
  SELECT *, CASE
      WHEN http AND len(s) >= 5 AND s[-1] <> '' AND s[-2] <> '' THEN
        [lower(string_split(string_split(string_split(bare, '/')[3], '@')[-1], ':')[1]),
         string_split(bare, '/')[4], string_split(bare, '/')[5]]
      WHEN starts_with({url}, 'git@') AND len(string_split({url}, ':')) >= 2 AND len(s) = 2 THEN
        [substr(string_split({url}, ':')[1], 5), string_split(s[1], ':')[2], s[2]]
    END AS x
  FROM cut),
r AS (
  SELECT *, x[1] AS host, x[2] AS owner,
         CASE WHEN suffix(x[3], '.git') THEN left(x[3], length(x[3]) - 4) ELSE x[3] END AS name,
         CASE WHEN x IS NULL THEN NULL WHEN x[1] = 'github.com' THEN 'github'
              WHEN x[1] = 'gitlab.com' THEN 'gitlab' WHEN x[1] = 'bitbucket.org' THEN 'bitbucket'
              ELSE 'git' END AS host_kind
  FROM p),
q AS (
  SELECT *, CASE WHEN x IS NULL THEN NULL ELSE host_kind || '/' ||
              CASE WHEN host_kind = 'git' THEN host || '/' ELSE '' END || owner || '/' || name END
            AS cache_path,
         CASE host_kind WHEN 'github' THEN 'GitHub' WHEN 'gitlab' THEN 'GitLab'
              WHEN 'bitbucket' THEN 'Bitbucket' ELSE host END || '/' || owner || '/' || name AS display
  FROM r)"""


REPOS_ = parsed("pages") + """,
repos AS (
  SELECT page_id, url, host, owner, name, host_kind, cache_path,
         CASE WHEN suffix(host, '.com') THEN 'always_pull' WHEN suffix(host, '.net') THEN 'force_clone'
              ELSE 'use_cache' END AS policy
  FROM q),
snapshots AS (
  SELECT host_kind, cache_path, bool_or(starts_with(url, 'https://')) AS has_git,
         max(1704067200 + page_id * 3600) AS modified_s
  FROM repos WHERE cache_path IS NOT NULL GROUP BY ALL)"""

# The rules of the two ignore files and the custom one, written out by hand.
RULES_ = f"""{K_}, d AS (
  SELECT *, list_contains(parts[:-2], 'lib') AS in_lib, parts[1] = 'src' AND len(parts) > 1 AS in_src,
         parts[1:2] = ['src', 'target'] AND len(parts) > 2 AS in_target,
         parts[1] = 'docs' AND len(parts) > 1 AS in_docs,
         (suffix(name, '.log') AND NOT name GLOB 'fr_*.log')
           OR (dir = 'docs' AND suffix(name, '.md')) OR starts_with(name, '_') AS root_out,
         name GLOB 'fr_*.log' AND NOT starts_with(name, '_') AS root_in
  FROM k),
e AS (
  SELECT *, CASE
      WHEN in_src AND length(name) > 4 AND suffix(name, '.txt') AND NOT starts_with(name, 'e') THEN true
      WHEN in_target AND dir = 'src/target' AND suffix(name, '.py') THEN true
      WHEN in_src AND name GLOB '*_*0.rs' THEN false
      WHEN in_src AND suffix(name, '.rs') THEN true
      WHEN root_out THEN true ELSE false END AS own_out
  FROM d)"""

MODEL_ROWS = ", ".join(
    f"('{name}', '{model_id}', '{provider}', CAST({window} AS BIGINT))"
    for name, model_id, provider, window in MODELS
)
MODELS_ = f"models AS (SELECT * FROM (VALUES {MODEL_ROWS}) v(name, model_id, provider, context_window))"
WORDY = """w AS (
  SELECT doc_id, regexp_replace(text, '[\\n ]+', CASE WHEN doc_id % 5 = 0 THEN '-' ELSE '/' END, 'g') AS path
  FROM documents)"""
ABSOLUTE = """a AS (
  SELECT doc_id, corpus, '/data/' || corpus AS root,
         CASE lang WHEN 'en' THEN '/data/' || corpus || '/' || path WHEN 'fr' THEN '/other/' || path
                   WHEN 'de' THEN '/data/' || corpus ELSE '/data/' || corpus || 'x/' || path END AS full_path
  FROM f)"""
KINDS_ = f"""{C_}, x AS (
  SELECT corpus, path, CASE regexp_extract(path, '([a-z]{{2}})_[0-9]', 1)
           WHEN 'de' THEN 'symlink' WHEN 'es' THEN 'other' ELSE kind END AS kind
  FROM c)"""
SUMMARY_ = f"""s AS (
  SELECT t.corpus, unnest([
    {{'row': 1, 'metric': 'Output File', 'value': '.context.md'}},
    {{'row': 2, 'metric': 'Process Time', 'value': '1.2500s'}},
    {{'row': 3, 'metric': 'Files Processed', 'value': {count_words('files')}}},
    {{'row': 4, 'metric': 'Total Lines', 'value': {count_words('lines')}}},
    {{'row': 5, 'metric': 'LLM Tokens', 'value': CASE WHEN tokens IS NULL
        THEN {count_words('chars // 4')} || ' tokens (estimated)'
        ELSE {count_words('tokens')} || ' tokens (counted)' END}},
    {{'row': 6, 'metric': 'Cache Hit Rate', 'value': printf('%.1f', hits::DOUBLE / lookups * 100.0::DOUBLE)
        || '% (' || hits || ' hits / ' || lookups || ' total)'}}], recursive := true)
  FROM t LEFT JOIN rates ON t.corpus = rates.corpus)"""
FILE_ROWS_ = f"""reported AS (
  SELECT ranked.corpus, CAST(rank AS INTEGER) AS rank, {TITLE}, corpus || '/' || path AS display_path,
         {count_words('lines')} AS lines, {count_words('coalesce(known.tokens, chars // 4)')} AS tokens
  FROM ranked LEFT JOIN known ON ranked.hash = known.hash {SHOWN})"""

CHECKS = {
    "files_from_documents": """
SELECT source AS corpus, lang || '/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size,
       sha256(text) AS hash FROM documents""",
    "files_from_pages": """
SELECT string_split(string_split(url, '?')[1], '/')[3] AS corpus,
       array_to_string(list_filter(string_split(split_part(split_part(url, '?', 1), '#', 1), '/')[4:],
                                   lambda x: x <> ''), '/') || '/' || page_id || '.html' AS path,
       CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS hash FROM pages""",
    "files_from_conversations": """
SELECT CAST(conv_id AS VARCHAR) AS corpus, role || '/' || printf('%06d', turn) || '.txt' AS path,
       CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash FROM conversations""",
    "resolve_inputs": f"""
WITH i AS (SELECT url AS input FROM pages UNION SELECT '/data/' || source FROM documents),
{parsed('i', 'input')}
SELECT input, x IS NOT NULL AS is_repo, coalesce(cache_path, input) AS root, host, owner, name FROM q""",
    "file_metadata": f"""
WITH {F_} SELECT corpus, path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS size, permissions,
       {moment('modified_s')} AS modified FROM f""",
    "scan_tree": f"""
WITH {K_} SELECT corpus, path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS size, permissions,
       {moment('modified_s')} AS modified, sha256(text) AS hash FROM k WHERE NOT listed""",
    "tree_format": f"""
WITH {K_} SELECT corpus, path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS size, permissions,
       {moment('modified_s')} AS modified, sha256(text) AS hash FROM k WHERE NOT listed""",
    "tree_stream": f"""
WITH {K_} SELECT corpus, path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS size, permissions,
       {moment('modified_s')} AS modified, sha256(text) AS hash FROM k WHERE NOT listed""",
    "cache_roundtrip": f"""
WITH {F_}, {CACHE_} SELECT hash, model, arg_max(tokens, ts) AS tokens, max(ts) AS ts
FROM live GROUP BY hash, model""",
    "chunked_measures": f"""
WITH {F_} SELECT corpus, path, CAST(strlen(text) AS BIGINT) AS size, CAST({LINES} AS BIGINT) AS lines,
       CAST({CHARS} AS BIGINT) AS chars, sha256(text) AS hash FROM f""",
    "cache_compacted": f"""
WITH {F_}, {CACHE_}, english AS (SELECT DISTINCT sha256(text) AS hash FROM f WHERE lang = 'en' AND text <> '')
SELECT hash, model, arg_max(tokens, ts) AS tokens, max(ts) AS ts FROM live JOIN english USING (hash) GROUP BY hash, model""",
    "count_files": f"""
WITH {K_} SELECT corpus, count(*) AS files FROM k WHERE NOT hidden AND NOT listed GROUP BY corpus""",
    "count_files_by_name": f"""
WITH {K_} SELECT corpus, count(*) AS files FROM k
WHERE NOT starts_with(name, '.') AND NOT list_contains({LISTED}, name) GROUP BY corpus""",
    "ignore_defaults": f"""
WITH {K_}, {DIRS_.format(source='k')}, e AS (
  SELECT corpus, path, name FROM k
  UNION ALL SELECT corpus, dir, string_split(dir, '/')[-1] FROM dirs WHERE dir <> '')
SELECT corpus, path, list_contains({LISTED}, name) AS ignored,
       list_contains({LISTED}, name) OR {NAME_IS_GLOBBED} AS ignored_with_globs FROM e""",
    "ignore_globs": f"""
WITH {K_} SELECT corpus, path FROM k WHERE NOT listed AND NOT (
  suffix(name, '.log') OR name GLOB 'fr_*[02468].py' OR
  (length(name) >= 8 AND name[1:3] IN ('de_', 'es_') AND name[5] <> '5' AND suffix(name, '.rs')))""",
    "include_globs": f"""
WITH {K_} SELECT corpus, path,
  NOT listed AND (suffix(name, '.md') OR suffix(name, '.rs') OR starts_with(name, 's')) AS kept,
  NOT listed AND (suffix(name, '.md') OR suffix(name, '.rs') OR starts_with(name, 's'))
    AND len(list_filter(parts[:-2], lambda x: NOT starts_with(x, 's'))) = 0 AS kept_with_dirs FROM k""",
    "prune_dirs": f"""
WITH {K_} SELECT corpus, path FROM k
WHERE len(list_filter(parts[:-2], lambda x: list_contains({LISTED}, x))) = 0""",
    "exclude_output": f"""
WITH {K_} SELECT corpus, path FROM k WHERE parts[-2:] <> ['docs', 'en_20.txt']""",
    "skip_hidden": f"WITH {K_} SELECT corpus, path FROM k WHERE NOT hidden AND NOT listed",
    "gitignore_filter": f"""
WITH {RULES_} SELECT corpus, path FROM e WHERE NOT in_lib AND NOT own_out""",
    "gitignore_custom": f"""
WITH {RULES_} SELECT corpus, path FROM e WHERE NOT in_lib AND NOT in_docs AND
  CASE WHEN starts_with(name, 'de_') THEN false WHEN suffix(name, '.rs') THEN true ELSE NOT own_out END""",
    "path_parts": f"""
WITH {K_} SELECT corpus, path, name, {EXT} AS ext, dir, CAST(len(parts) AS INTEGER) AS depth FROM k""",
    "normalize_path": f"""
WITH {F_}, {ABSOLUTE} SELECT doc_id, full_path, CASE
  WHEN full_path = root THEN '' WHEN starts_with(full_path, root || '/')
  THEN array_to_string(string_split(full_path, '/')[4:], '/') ELSE full_path END AS relative_path FROM a""",
    "report_path": f"""
WITH {F_}, {ABSOLUTE} SELECT doc_id, full_path, CASE
  WHEN full_path = root THEN 'owner/' || corpus WHEN starts_with(full_path, root || '/')
  THEN 'owner' || substr(full_path, 6) ELSE full_path END AS report_path FROM a""",
    "display_path": f"""
WITH {WORDY}, tails AS (
  SELECT doc_id, path, string_split(path, '/') AS s FROM w),
best AS (
  SELECT doc_id, max_by(tail, strlen(tail)) AS tail FROM (
    SELECT doc_id, '/' || array_to_string(s[i:], '/') AS tail
    FROM (SELECT *, unnest(range(2, len(s) + 1)) AS i FROM tails)) WHERE strlen(tail) <= 57
  GROUP BY doc_id)
SELECT t.doc_id, path, CASE WHEN strlen(path) <= 60 THEN path WHEN len(s) <= 2 THEN '...' || right(path, 57)
  ELSE '...' || coalesce(tail, '') END AS display_path FROM tails t LEFT JOIN best USING (doc_id)""",
    "output_path": f"""
WITH {REPOS_} SELECT url, CASE policy WHEN 'always_pull' THEN cache_path || '/pack.xml'
  WHEN 'force_clone' THEN 'out/pack.xml' ELSE '/tmp/pack.xml' END AS output_path
FROM repos WHERE cache_path IS NOT NULL""",
    "sanitize_path": f"""
WITH {WORDY} SELECT doc_id, array_to_string(list_transform(string_split(path, ''),
  lambda x: CASE WHEN regexp_full_match(x, '[\\p{{L}}\\p{{N}}_.-]') THEN x ELSE '_' END), '') AS file_name
FROM w""",
    "classify_text": f"""
WITH {C_} SELECT corpus, path, kind, CASE WHEN text <> '' AND {FEW_CONTROLS} THEN 'text' ELSE 'binary' END
  AS kind_if_trimmed FROM c""",
    "kind_dispatch": f"WITH {KINDS_} SELECT corpus, kind, count(*) AS entries FROM x GROUP BY corpus, kind",
    "symlinks": f"""
WITH {KINDS_} SELECT corpus, path, '../ziel/ö/' || path AS target, CAST(0 AS BIGINT) AS lines,
  CAST(length(path) + 10 AS BIGINT) AS chars,
  '[S] ' || corpus || '/' || path || ' -> ../ziel/ö/' || path AS printed FROM x WHERE kind = 'symlink'""",
    "bounded_content": f"""
WITH {C_}, b AS (SELECT *, CASE WHEN kind <> 'text' THEN kind WHEN size > 8192 THEN 'oversize' ELSE 'ok' END
  AS status FROM c) SELECT corpus, path, status AS read_status, {CONTENT} AS content FROM b""",
    "read_failures": f"""
WITH {C_} SELECT corpus, path, CASE WHEN kind = 'text' AND size >= 8192 THEN 'text' ELSE 'binary' END AS kind,
  CASE WHEN kind = 'text' AND size >= 8192 THEN 'read_error' ELSE 'binary' END AS read_status,
  CASE WHEN kind = 'text' AND size >= 8192 THEN '{READ_FAILED}' END AS content FROM c""",
    "run_rejects": f"""
WITH {KINDS_}, r AS (
  SELECT c.corpus, CASE WHEN x.kind = 'other' THEN 'other' WHEN x.kind = 'symlink' THEN NULL
           WHEN permissions = '755' THEN 'unreadable' WHEN x.kind = 'text' AND size >= 8192 THEN 'read_error' END AS reason
  FROM c JOIN x USING (corpus, path))
SELECT corpus, reason, count(*) AS entries FROM r WHERE reason IS NOT NULL GROUP BY corpus, reason""",
    "size_text": f"""
SELECT doc_id, {size_words('size')} AS size_text
FROM (SELECT doc_id, n_chars * (CAST(1 AS BIGINT) << CAST(doc_id % 24 AS INTEGER)) AS size FROM documents)""",
    "count_text": f"""
SELECT doc_id, {count_words('n')} AS count_text
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars * 50 ELSE n_chars * doc_id END AS n FROM documents)""",
    "line_count": f"WITH {F_} SELECT doc_id, CAST({LINES} AS BIGINT) AS lines FROM f",
    "char_count": f"WITH {F_} SELECT doc_id, CAST({CHARS} AS BIGINT) AS chars FROM f",
    "token_estimate": f"""
WITH {F_}, n AS (SELECT corpus, {CHARS} AS chars FROM f)
SELECT corpus, CAST(sum(chars // 4) AS BIGINT) AS sum_of_files, CAST(sum(chars) // 4 AS BIGINT) AS of_total
FROM n GROUP BY corpus""",
    "content_hash": f"WITH {F_} SELECT doc_id, sha256(text) AS hash FROM f",
    "count_tokens": f"""
WITH {M_} SELECT DISTINCT hash, '{MODEL}' AS model, CAST({PIECE_COUNT} AS BIGINT) AS tokens,
  CAST({NOW_S} AS BIGINT) AS ts FROM m WHERE status = 'ok'""",
    "count_missing_tokens": f"""
WITH {M_}, {CACHE_} SELECT DISTINCT m.hash, '{MODEL}' AS model, CAST({PIECE_COUNT} AS BIGINT) AS tokens,
  CAST({NOW_S} AS BIGINT) AS ts FROM m LEFT JOIN known ON m.hash = known.hash
WHERE status = 'ok' AND known.hash IS NULL""",
    "cache_lookup": f"""
WITH {M_}, {CACHE_} SELECT m.corpus, m.path, m.hash, known.tokens, known.hash IS NOT NULL AS cached
FROM m LEFT JOIN known ON m.hash = known.hash WHERE status = 'ok'""",
    "cache_misses": f"""
WITH {M_}, {CACHE_} SELECT hash FROM m WHERE status = 'ok' EXCEPT SELECT hash FROM known""",
    "cache_upsert": f"""
WITH {F_}, {CACHE_}, both_ AS (
  SELECT * FROM writes
  UNION ALL SELECT hash, model, tokens + 1, {NOW_S} FROM writes WHERE model = '{MODEL}')
SELECT hash, model, tokens, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY hash, model ORDER BY ts DESC, tokens DESC) AS rn FROM both_)
WHERE rn = 1""",
    "cache_expire": f"WITH {F_}, {CACHE_} SELECT hash, model, tokens, ts FROM live",
    "cache_hit_rate": f"""
WITH {M_}, {CACHE_}, {LOOKUPS_} SELECT corpus, hits, misses, lookups,
  hits::DOUBLE / lookups::DOUBLE * 100.0::DOUBLE AS hit_rate FROM rates""",
    "token_total": f"""
WITH {M_}, {CACHE_}, {LOOKUPS_} SELECT corpus, tokens FROM rates""",
    "token_label": f"""
WITH {M_}, {CACHE_}, {LOOKUPS_}, {TOTALS_} SELECT t.corpus, coalesce(tokens, chars // 4) AS tokens,
  CASE WHEN tokens IS NULL THEN 'estimated' ELSE 'counted' END AS token_source
FROM t LEFT JOIN rates USING (corpus)""",
    "context_fit": f"""
WITH {M_}, {TOTALS_}, {MODELS_} SELECT corpus, chars // 4 AS tokens, model_id, context_window,
  chars // 4 <= context_window AS fits FROM t CROSS JOIN models""",
    "model_catalog": f"""
WITH {F_}, {CACHE_}, {MODELS_} SELECT model_id, count(*) AS entries, name, provider, context_window
FROM writes LEFT JOIN models ON writes.model = models.model_id GROUP BY ALL""",
    "corpus_totals": f"WITH {M_}, {TOTALS_} SELECT * FROM t",
    "file_details": f"""
WITH {M_}, {CACHE_} SELECT corpus, corpus || '/' || path AS report_path, lines, chars, known.tokens
FROM m LEFT JOIN known ON m.hash = known.hash""",
    "largest_files": f"""
WITH {M_}, {RANKED_} SELECT corpus, CAST(rank AS INTEGER) AS rank, corpus || '/' || path AS report_path,
  lines, chars, {TITLE} FROM ranked {SHOWN}""",
    "largest_files_small_corpora": f"""
WITH m AS (
  SELECT *, CASE WHEN ok THEN {LINES} ELSE 0 END AS lines, CASE WHEN ok THEN {CHARS} ELSE 0 END AS chars
  FROM (SELECT CAST(conv_id AS VARCHAR) AS corpus, role || '/' || printf('%06d', turn) || '.txt' AS path, text,
               text <> '' AND {FEW_CONTROLS} AS ok FROM conversations)),
{RANKED_} SELECT corpus, CAST(rank AS INTEGER) AS rank, corpus || '/' || path AS report_path,
  lines, chars, {TITLE} FROM ranked {SHOWN}""",
    "files_report": f"WITH {M_}, {CACHE_}, {RANKED_}, {FILE_ROWS_} SELECT * FROM reported",
    "summary_report": f"""
WITH {M_}, {CACHE_}, {LOOKUPS_}, {TOTALS_}, {SUMMARY_}
SELECT corpus, CAST(row AS INTEGER) AS row, metric, value FROM s""",
    "console_report": f"""
WITH {M_}, {CACHE_}, {LOOKUPS_}, {TOTALS_}, {RANKED_}, {FILE_ROWS_}, {SUMMARY_},
labelled AS (
  SELECT *, CASE row WHEN 1 THEN '📂' WHEN 2 THEN '⏱️' WHEN 3 THEN '📄' WHEN 4 THEN '📝' WHEN 5 THEN '📦'
            ELSE '🔄' END || ' ' || metric AS label FROM s),
sized AS (
  SELECT corpus, CAST(greatest(9, max(length(display_path))) AS INTEGER) AS a,
         CAST(greatest(5, max(length(lines))) AS INTEGER) AS b,
         CAST(greatest(11, max(length(tokens))) AS INTEGER) AS c FROM reported GROUP BY corpus),
widths AS (
  SELECT corpus, CAST(max(length(metric) + 3) AS INTEGER) AS d,
         CAST(greatest(5, max(length(value))) AS INTEGER) AS e FROM s GROUP BY corpus),
listed AS (
  SELECT corpus, any_value(title) AS title, string_agg('│ ' || rpad(display_path, a, ' ') || ' │ ' ||
           rpad(lines, b, ' ') || ' │ ' || rpad(tokens, c, ' ') || ' │', chr(10) ORDER BY rank) AS body
  FROM reported JOIN sized USING (corpus) GROUP BY corpus),
counted AS (
  SELECT corpus, string_agg('│ ' || label || repeat(' ', d - length(metric) - 3) || ' │ ' ||
           rpad(value, e, ' ') || ' │', chr(10) ORDER BY row) AS body
  FROM labelled JOIN widths USING (corpus) GROUP BY corpus)
SELECT l.corpus, '📋  ' || title || CASE WHEN starts_with(title, 'TOP') THEN '  📋' ELSE '' END || {NL} ||
  '╭' || repeat('─', a + 2) || '┬' || repeat('─', b + 2) || '┬' || repeat('─', c + 2) || '╮' || {NL} ||
  '│ ' || rpad('File Path', a, ' ') || ' │ ' || rpad('Lines', b, ' ') || ' │ ' || rpad('Est. Tokens', c, ' ') || ' │' || {NL} ||
  '├' || repeat('─', a + 2) || '┼' || repeat('─', b + 2) || '┼' || repeat('─', c + 2) || '┤' || {NL} || l.body || {NL} ||
  '╰' || repeat('─', a + 2) || '┴' || repeat('─', b + 2) || '┴' || repeat('─', c + 2) || '╯' || {NL} || {NL} ||
  '✅  EXTRACTION COMPLETE' || {NL} ||
  '╭' || repeat('─', d + 2) || '┬' || repeat('─', e + 2) || '╮' || {NL} ||
  '│ ' || rpad('Metric', d, ' ') || ' │ ' || rpad('Value', e, ' ') || ' │' || {NL} ||
  '├' || repeat('─', d + 2) || '┼' || repeat('─', e + 2) || '┤' || {NL} || k.body || {NL} ||
  '╰' || repeat('─', d + 2) || '┴' || repeat('─', e + 2) || '╯' AS report
FROM listed l JOIN counted k USING (corpus) JOIN sized USING (corpus) JOIN widths USING (corpus)""",
    "pack_order": f"WITH {K_} SELECT corpus, path, {FILE_KEY} AS sort_key FROM k",
    "directories": f"""
WITH {K_}, {DIRS_.format(source='k')} SELECT corpus, dir, {DIR_NAME} AS name, {DIR_PATH} AS packed_path,
  CAST(depth AS INTEGER) AS depth FROM dirs""",
    "txt_fragments": f"""
WITH {M_} SELECT corpus, 2 AS section, {FILE_KEY} AS sort_key, {FENCED} AS fragment
FROM m WHERE kind = 'text'""",
    "metadata_block": f"""
WITH {M_} SELECT corpus, path, {META_TXT} AS txt, {meta_xml("'    '")} AS xml FROM m""",
    "xml_events": f"WITH {M_}, {DIRS_.format(source='m')} {xml_body(with_metadata=True)}",
    "xml_overview": f"WITH {M_}, {DIRS_.format(source='m')} {OVERVIEW}",
    "xml_escape": f"""
WITH {F_} SELECT doc_id, {escaped(cleaned('text'))} AS escaped, {section('text')} AS section FROM f""",
    "pack_header": f"""
WITH {REPOS_}, g AS (
  SELECT coalesce(cache_path, 'page/' || page_id) AS corpus, host, owner, name,
         min(CASE WHEN cache_path IS NOT NULL THEN url END) AS url
  FROM repos GROUP BY ALL)
SELECT corpus, 0 AS section, '' AS sort_key, 'txt' AS format,
  '=================== SYSTEM INFO ===================' || {NL} || 'Hostname: host<1>' || {NL} ||
  'OS: linux' || {NL} || 'Kernel: unix' || {NL} || {NL} ||
  CASE WHEN url IS NULL THEN '' ELSE '=================== REPOSITORY ===================' || {NL} ||
    'URL: ' || url || {NL} || 'Host: ' || host || {NL} || 'Owner: ' || owner || {NL} ||
    'Repository: ' || name || {NL} || {NL} END ||
  '<codebase name="' || corpus || '">' AS fragment FROM g
UNION ALL
SELECT corpus, 0, '', 'xml',
  '<?xml version="1.0" encoding="UTF-8"?>' || {NL} ||
  '<directory_scan timestamp="2024-01-09T00:00:00+00:00">' || {NL} || '  <system_info>' || {NL} ||
  '    <hostname>host&lt;1&gt;</hostname>' || {NL} || '    <os>linux</os>' || {NL} ||
  '    <kernel>unix</kernel>' || {NL} ||
  CASE WHEN url IS NULL THEN '' ELSE '    <git_repository>' || {NL} ||
    '      <url>' || {escaped('url')} || '</url>' || {NL} || '      <host>' || {escaped('host')} || '</host>' || {NL} ||
    '      <owner>' || {escaped('owner')} || '</owner>' || {NL} ||
    '      <name>' || {escaped('name')} || '</name>' || {NL} || '    </git_repository>' || {NL} END ||
  '  </system_info>' || {NL} || '  <overview>' FROM g""",
    "pack_txt": f"""
WITH {M_} SELECT corpus, 2 AS section, {FILE_KEY} AS sort_key, {FENCED} AS fragment FROM m WHERE kind = 'text'
UNION ALL SELECT DISTINCT corpus, 0, '', '<codebase name="' || corpus || '">' FROM m
UNION ALL SELECT DISTINCT corpus, 3, '', '</codebase>' FROM m""",
    "pack_xml": f"""
WITH {M_}, {DIRS_.format(source='m')} {OVERVIEW}
UNION ALL {xml_body(with_metadata=False)}
UNION ALL SELECT DISTINCT corpus, 0, '', '<?xml version="1.0" encoding="UTF-8"?>' || {NL} ||
  '<directory_scan timestamp="1970-01-01T00:00:00+00:00">' || {NL} || '  <system_info>' || {NL} ||
  '    <hostname>unknown</hostname>' || {NL} || '    <os>linux</os>' || {NL} ||
  '    <kernel>unix</kernel>' || {NL} || '  </system_info>' || {NL} || '  <overview>' FROM m
UNION ALL SELECT DISTINCT corpus, 1, '3', '  </overview>' FROM m
UNION ALL SELECT DISTINCT corpus, 3, '', '</directory_scan>' FROM m""",
    "pack_published": f"""
WITH {M_}, o AS (SELECT *, {given.ODD_CORPORA} AS o FROM m), lines AS (
  SELECT o, {FENCED.replace("corpus || '/' || path", "CASE WHEN o IS NULL THEN path ELSE o || '/' || path END")} AS fragment
  FROM o WHERE kind = 'text'
  UNION ALL SELECT DISTINCT o, '<codebase name="' || coalesce(o, '') || '">' FROM o
  UNION ALL SELECT DISTINCT o, '</codebase>' FROM o)
SELECT o AS corpus, CAST(sum(strlen(fragment) + 1) AS BIGINT) AS bytes,
       CAST(sum(len(string_split(fragment, chr(10)))) AS BIGINT) AS lines
FROM lines GROUP BY o""",
    "pack_balance": f"""
WITH {M_}, {DIRS_.format(source='m')}
SELECT corpus, CASE WHEN corpus IN ('src1', 'src3', 'src5') AND bool_or(dir = 'docs')
                    THEN '</directory_scan> closes <contents>' END AS fault
FROM dirs GROUP BY corpus""",
    "pack_with_hook": f"""
WITH {M_}, {DIRS_.format(source='m')}
SELECT corpus, len(parts) || '|' || kind || '|' || corpus || '/' || path || '|' ||
       CASE WHEN kind = 'text' THEN CAST(length(text) AS VARCHAR) ELSE '' END AS value FROM m
UNION ALL SELECT corpus, depth || '|' || unnest(['open', 'close']) || '|' || {DIR_PATH} || '|' FROM dirs
UNION ALL SELECT corpus, '0|' || unnest(['begin', 'end']) || '|' || corpus || '|' FROM dirs WHERE dir = ''
""",
    "rerun_totals": f"""
WITH {M_.replace(FILES, RERUN_FILES)}, {TOTALS_} SELECT * FROM t""",
    "run_of_repos": f"""
WITH {REPOS_}, h AS (
  SELECT cache_path, owner, name, page_id, html AS text, html <> '' AND NOT {CUT_INSIDE.replace("text", "html")}
         AND {FEW_CONTROLS.replace("text", "html")} AS ok
  FROM repos JOIN pages USING (page_id) WHERE cache_path IS NOT NULL)
SELECT cache_path AS corpus, owner || '/' || name || '/src/page' || page_id || '.html' AS report_path,
       CAST(CASE WHEN ok THEN {LINES} ELSE 0 END AS BIGINT) AS lines,
       CAST(CASE WHEN ok THEN {CHARS} ELSE 0 END AS BIGINT) AS chars, cache_path || '/.context.md' AS output
FROM h""",
    "is_repo_url": f"WITH {URLS_}, {parsed('u')} SELECT url, x IS NOT NULL AS is_repo FROM q",
    "parse_repo_url": f"WITH {URLS_}, {parsed('u')} SELECT url, host, owner, name FROM q",
    "host_kind": f"WITH {URLS_}, {parsed('u')} SELECT url, host_kind FROM q",
    "repo_cache_path": f"WITH {URLS_}, {parsed('u')} SELECT url, cache_path FROM q",
    "repo_display": f"WITH {URLS_}, {parsed('u')} SELECT url, display FROM q",
    "refresh_plan": f"""
WITH {REPOS_} SELECT url, repos.cache_path, policy, CASE WHEN s.cache_path IS NULL THEN 'clone'
  WHEN policy = 'force_clone' THEN 'reclone' WHEN policy = 'use_cache' THEN 'use' ELSE 'pull' END AS action
FROM repos LEFT JOIN (SELECT DISTINCT cache_path FROM snapshots WHERE has_git) s USING (cache_path)
WHERE repos.cache_path IS NOT NULL""",
    "snapshot_retention": f"""
WITH {REPOS_} SELECT host_kind, count(*) AS removed FROM snapshots
WHERE has_git AND {NOW_S} - modified_s > 5 * 86400 GROUP BY host_kind""",
    "count_with_hook": f"""
WITH {F_} SELECT doc_id, path, CAST(len(regexp_extract_all(text, '[ \\n]+')) AS BIGINT) AS tokens FROM f""",
    "repeated_paths": f"""
WITH {M_.replace(FILES, "SELECT * FROM (" + FILES + ") UNION ALL SELECT * REPLACE (text || 'x' AS text) FROM (" + FILES + ")")}
SELECT corpus, run, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(chars) AS BIGINT) AS chars,
  CAST(sum({PIECE_COUNT}) FILTER (status = 'ok') AS BIGINT) AS tokens, count(*) FILTER (status = 'ok') AS lookups
FROM m, (SELECT unnest(['cold', 'warm']) AS run) GROUP BY corpus, run""",
    "incremental_tokens": f"""
WITH {M_} SELECT DISTINCT hash, '{MODEL}' AS model, CAST({PIECE_COUNT} AS BIGINT) AS tokens,
  CAST({NOW_S} AS BIGINT) AS ts FROM m WHERE status = 'ok'""",
    "full_run": f"""
WITH {RULES_}, {C_.removeprefix(K_ + ', ')}, m AS (
  SELECT corpus, path, status, CASE WHEN status = 'ok' THEN {LINES} ELSE 0 END AS lines,
         CASE WHEN status = 'ok' THEN {CHARS} ELSE 0 END AS chars, text, size,
         CASE WHEN status = 'ok' THEN sha256(text) END AS hash
  FROM (SELECT c.*, CASE WHEN kind <> 'text' THEN kind ELSE 'ok' END AS status
        FROM c JOIN e USING (corpus, path)
        WHERE NOT c.hidden AND NOT c.listed AND NOT in_lib AND NOT own_out)),
{CACHE_}, {LOOKUPS_}, {TOTALS_},
counted AS (SELECT corpus, CAST(sum({PIECE_COUNT}) AS BIGINT) AS tokens FROM m WHERE status = 'ok' GROUP BY corpus)
SELECT t.corpus, files, lines, chars, counted.tokens, coalesce(hits, 0) AS hits, coalesce(lookups, 0) AS lookups
FROM t LEFT JOIN counted USING (corpus) LEFT JOIN rates ON t.corpus = rates.corpus""",
}
