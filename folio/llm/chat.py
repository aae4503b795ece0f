"""Chat formatting: layouts told by schema fingerprints, canonical turns, and a template that can be read back.

A layout is known by the hash of its nested field paths; fields that no layout knows are left out of the hash, so extra
columns do no harm. The hash selects a declarative mapping: expressions for the conversation id and its turns.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` per turn. Control strings inside texts and roles get a backslash after
their first character (one more, if they have some), which unescaping takes away. Loss spans are the code points of the
assistant's texts, as they stand in the formatted conversation.

Null texts and roles are empty. Turns are ordered by turn, then role and text; null turns come first; repeated rows are
repeated turns. A null conv_id is one conversation. An empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Role names of common layouts and what they are called here.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Control strings of common templates, behind their first character.
_CONTROL = r"\||/?s>|/?INST\]|</?SYS>>"
ESCAPE = rf"([<\[])(\\*)({_CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({_CONTROL})"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: its field paths, the id, and either the turn of a row or an array of all turns (role, text)."""

    paths: tuple[str, ...]
    conv_id: str
    row: tuple[str, str, str] | None = None
    turns: str | None = None


MAPPINGS = (
    Mapping(("conv_id", "turn", "role", "text"), "conv_id", row=("turn", "role", "text")),
    Mapping(
        ("id", "messages[].role", "messages[].content"), "id",
        turns="transform(messages, m -> struct(m.role AS role, m.content AS text))",
    ),
    Mapping(
        ("id", "conversations[].from", "conversations[].value"), "id",
        turns="transform(conversations, m -> struct(m.from AS role, m.value AS text))",
    ),
    Mapping(
        ("id", "instruction", "input", "output"), "id",
        turns="array(struct('user' AS role, concat_ws('\n', instruction, nullif(input, '')) AS text), struct('assistant' AS role, output AS text))",
    ),
    Mapping(
        ("id", "instruction", "output"), "id",
        turns="array(struct('user' AS role, instruction AS text), struct('assistant' AS role, output AS text))",
    ),
    Mapping(
        ("id", "prompt", "completion"), "id",
        turns="array(struct('user' AS role, prompt AS text), struct('assistant' AS role, completion AS text))",
    ),
    Mapping(
        ("id", "prompt", "response"), "id",
        turns="array(struct('user' AS role, prompt AS text), struct('assistant' AS role, response AS text))",
    ),
)


def field_paths(schema: T.DataType, above: str = "") -> list[str]:
    """Paths of all leaves; an array is marked by []."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{above}.{f.name}" if above else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, above + "[]")
    return [above]


def fingerprint(paths) -> str:
    """Hash of the paths that some layout knows."""
    known = {p for m in MAPPINGS for p in m.paths}
    return hashlib.sha256("\n".join(sorted(set(paths) & known)).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def canonical(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout."""
    mapping = BY_FINGERPRINT.get(fingerprint(field_paths(df.schema)))
    if mapping is None:
        raise ValueError(f"no mapping for the fields {field_paths(df.schema)}")
    if mapping.row:
        turn, role, text = mapping.row
        rows = df.selectExpr(f"{mapping.conv_id} AS conv_id", f"cast({turn} AS bigint) AS turn", f"{role} AS role", f"{text} AS text")
    else:
        listed = df.selectExpr(f"{mapping.conv_id} AS conv_id", f"posexplode({mapping.turns}) AS (turn, m)")
        rows = listed.selectExpr("conv_id", "cast(turn AS bigint) AS turn", "m.role AS role", "m.text AS text")
    # Rows by turn are canonical already: their roles are theirs, whatever they are called.
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    renamed = F.col("role") if mapping.row else F.coalesce(names[F.col("role")], F.col("role"))
    role = F.coalesce(renamed, F.lit(""))
    return rows.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def canonical_records(df: DataFrame, record: str = "record") -> DataFrame:
    """The same for JSON records of mixed layouts: each record's own field paths select its mapping.

    Records of no known layout, and texts that are no JSON object, give no turns.
    """
    message = "struct<role:string,content:string>"
    fields = "id:bigint,instruction:string,input:string,output:string,prompt:string,completion:string,response:string"
    schema = f"struct<{fields},messages:array<{message}>,conversations:array<struct<`from`:string,value:string>>>"
    parsed = df.select(F.from_json(record, schema).alias("r")).select("r.*")
    known = sorted({p for m in MAPPINGS if m.turns for p in m.paths})

    def present(path: str) -> F.Column:
        outer, _, inner = path.partition("[].")
        if inner:
            return F.coalesce(F.exists(F.col(outer), lambda m: m[inner].isNotNull()), F.lit(False))
        return F.col(outer).isNotNull()

    paths = F.concat_ws("\n", *[F.when(present(p), F.lit(p)) for p in known])
    marked = parsed.withColumn("__print", F.substring(F.sha2(paths, 256), 1, 16))
    parts = [
        canonical(marked.where(F.col("__print") == mark).select(*dict.fromkeys(p.partition("[].")[0] for p in m.paths)))
        for mark, m in BY_FINGERPRINT.items()
        if m.turns
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def escaped(column: str) -> str:
    return f"regexp_replace({column}, {_sql(ESCAPE)}, {_sql('$1$2' + chr(92) * 2 + '$3')})"


def unescaped(column: str) -> str:
    return f"regexp_replace({column}, {_sql(UNESCAPE)}, '$1$2$3')"


def _escaped_role(column: str) -> str:
    slashed = f"replace(replace({column}, {_sql(chr(92))}, {_sql(chr(92) + 'b')}), {_sql(chr(10))}, {_sql(chr(92) + 'n')})"
    return escaped(slashed)


def _unescaped_role(column: str) -> str:
    lines = f"replace({unescaped(column)}, {_sql(chr(92) + 'n')}, {_sql(chr(10))})"
    return f"replace({lines}, {_sql(chr(92) + 'b')}, {_sql(chr(92))})"


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (from, to: code points of the assistant's texts)."""
    head = f"concat({_sql(OPEN)}, {_escaped_role('role')}, {_sql(chr(10))})"
    parts = turns.selectExpr("conv_id", "struct(turn, role, text) AS at", f"{head} AS head", f"{escaped('text')} AS body")
    listed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "head", "body"))).alias("turns"))
    empty = "cast(array() AS array<struct<start:bigint,stop:bigint>>)"
    n_head, n_body = "cast(char_length(t.head) AS bigint)", "cast(char_length(t.body) AS bigint)"
    span = f"if(t.at.role = 'assistant', array(struct(s.at + {n_head} AS start, s.at + {n_head} + {n_body} AS stop)), {empty})"
    step = f"struct(s.at + {n_head} + {n_body} + {len(CLOSE)}L AS at, concat(s.spans, {span}) AS spans)"
    return listed.selectExpr(
        "conv_id",
        f"array_join(transform(turns, t -> concat(t.head, t.body, {_sql(CLOSE)})), '') AS formatted",
        f"aggregate(turns, struct(0L AS at, {empty} AS spans), (s, t) -> {step}, s -> s.spans) AS loss_spans",
    )


def read_back(df: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both unescaped from the formatted text alone and its loss spans."""
    closing = _sql(CLOSE.replace("|", r"\|"))
    body = f"substring(x, {len(OPEN) + 1})"
    pieces = f"filter(split(formatted, {closing}), x -> x <> '')"
    role, rest = f"split({body}, '\\n', 2)[0]", f"split({body}, '\\n', 2)[1]"
    turn = f"struct({_unescaped_role(role)} AS role, {unescaped(rest)} AS text)"
    inside = unescaped("substring(formatted, cast(s.start AS int) + 1, cast(s.stop - s.start AS int))")
    return df.selectExpr(
        "*",
        f"transform({pieces}, x -> {turn}) AS turns",
        f"array_join(transform(loss_spans, s -> {inside}), '') AS loss_text",
    )
