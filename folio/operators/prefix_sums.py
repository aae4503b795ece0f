"""Prefix sums of a column in key order, and where to cut a table so that its parts weigh alike."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import quoted
from folio.plans.scratch import staged


def cut_keys(rows: DataFrame, parts: int) -> list[str]:
    """First keys of parts of rows (key STRING, weight BIGINT) that weigh alike when they lie in key order.

    Rows are dealt to ranges of keys; the ranges' sums, one row each, give what comes before every range, and a running
    sum inside each range the rest. A part's number is its share of the total that comes before, so no part is
    heavier than a share and its last row. One key for each part comes back, whatever the table's size.
    """
    ranges = staged(rows.repartitionByRange("key").selectExpr("key", "weight", "spark_partition_id() AS span"), "weights")
    # One row for each range, so these windows over all of them are small.
    before = "coalesce(sum(weight) OVER (ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before"
    sums = ranges.groupBy("span").agg(F.sum("weight").alias("weight")).selectExpr("span", before, "sum(weight) OVER () AS total")
    ahead = "sum(weight) OVER (PARTITION BY span ORDER BY key ROWS UNBOUNDED PRECEDING) - weight AS ahead"
    placed = ranges.selectExpr("*", ahead).join(F.broadcast(sums), "span")
    # Shares as doubles: bytes times parts may not fit a long. The last bytes may round up to one part more.
    part = f"least(cast(floor((before + ahead) / cast(greatest(total, 1L) AS DOUBLE) * {parts}) AS INT), {parts - 1}) AS part"
    firsts = placed.selectExpr("key", part).groupBy("part").agg(F.min("key").alias("key")).collect()
    return sorted({row.key for row in firsts})


def part_of(key: str, cuts: list[str]) -> str:
    """Expression for the number of the part that holds a key: a binary search among the first keys, inside Spark."""
    if not cuts:
        return "0"
    known = f"from_json({quoted(json.dumps(cuts))}, 'array<string>')"
    middle = "(s.lo + s.hi) div 2"
    step = (
        f"if(s.lo >= s.hi, s, if(get(cuts, cast({middle} AS INT)) <= {key}, "
        f"named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle})))"
    ).replace("get(cuts, ", f"get({known}, ")
    found = (
        f"aggregate(sequence(1, {len(cuts).bit_length() + 1}), named_struct('lo', 0L, 'hi', {len(cuts)}L), "
        f"(s, i) -> {step}, s -> s.lo)"
    )
    return f"cast(greatest({found} - 1, 0L) AS INT)"
