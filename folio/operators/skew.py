"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # a key with more rows than this gets split
SPLITS = 64


def hot_keys(
    facts: DataFrame, keys: str | list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The keys with more than `hot_rows` rows: fewer than rows / hot_rows of them, which bounds the broadcast."""
    keys = [keys] if isinstance(keys, str) else keys
    counts = facts.groupBy(*keys).agg(F.expr("count(1) AS n"))
    return counts.where(f"n > {hot_rows}").select(*keys)


def lookup(
    facts: DataFrame,
    table: DataFrame,
    keys: str | list[str],
    spread_by: str | None = None,
    hot: DataFrame | None = None,
    splits: int = SPLITS,
) -> DataFrame:
    """Left join on `keys`, where `table` holds each key once and `facts` may be skewed.

    Without `hot` this is a plain join, whose heavy partitions Spark splits while it runs.
    With the heaviest keys given, their rows are spread over `splits` salts by the expression `spread_by`,
    and the one matching row of the table is repeated for each salt. All other keys keep
    salt 0, so nothing else is copied.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if hot is None:
        return facts.join(table, keys, "left")
    marked = F.broadcast(hot.select(*keys, F.lit(True).alias("is_hot")))
    salt = f"if(is_hot, cast(pmod(xxhash64({spread_by}), {splits}) AS INT), 0)"
    salted = facts.join(marked, keys, "left").withColumn("salt", F.expr(salt)).drop("is_hot")
    copies = f"explode(if(is_hot, sequence(0, {splits - 1}), array(0)))"
    repeated = table.join(marked, keys, "left").withColumn("salt", F.expr(copies))
    return salted.join(repeated.drop("is_hot"), [*keys, "salt"], "left").drop("salt")
