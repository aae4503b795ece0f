"""Scalar expressions as SQL text: no shuffle, no Python in the data path.

Every function takes SQL expressions, such as a column name, and returns one, for use with
`F.expr` or `selectExpr`. Text composes freely and is parsed by Spark once, where a chain of
column objects costs the driver a call per step.
"""


def quoted(value: str) -> str:
    """SQL literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def case(*branches: tuple[str, str], otherwise: str = "NULL") -> str:
    """CASE with (condition, value) branches."""
    whens = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"(CASE {whens} ELSE {otherwise} END)"


def lines(*parts: str) -> str:
    """Parts joined by newlines; NULL parts are left out."""
    return f"concat_ws('\\n', {', '.join(parts)})"
