"""Do the elements of XML packs nest? A parallel parenthesis check over the parts of packs.

A stretch of lines is summed up without what comes before: tags that match inside it cancel, which leaves closings without
an opening, then openings without a closing. A stretch may begin inside a CDATA section, so it is summed up for both
cases. Summaries of stretches that follow each other join into one, as if the lines were one stretch; those of a sound
pack are no longer than its tree is deep. So packs are read once, wherever Spark splits them, and nothing is sorted
but one summary for each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!\[CDATA\[|<\?.*?\?>|<(/?)([A-Za-z_][\w.-]*)[^<>]*?(/?)>")
_SUMMARY = "corpus STRING, block STRING, part STRING, start BIGINT, outside STRING, inside STRING"
#: Tags that a summary keeps on each side; a pack with more of them open is told as a fault.
DEEPEST = 10_000


class Summary(NamedTuple):
    """What is left of a stretch: closings, openings, whether it ends inside a section, its first fault."""

    closes: tuple[str, ...] = ()
    opens: tuple[str, ...] = ()
    inside: bool = False
    fault: str = ""


def joined(first: Summary, second: Summary) -> Summary:
    """Summary of two stretches that follow each other; `second` was made for how `first` ends."""
    opens, closes = list(first.opens), list(first.closes)
    fault = first.fault
    for tag in second.closes:
        if not opens:
            closes.append(tag)
        elif (last := opens.pop()) != tag and not fault:
            fault = f"</{tag}> closes <{last}>"
    opens.extend(second.opens)
    fault = fault or second.fault
    if not fault and max(len(opens), len(closes)) > DEEPEST:
        fault = f"more than {DEEPEST} tags open"
    return Summary(tuple(closes[:DEEPEST]), tuple(opens[:DEEPEST]), second.inside, fault)


def summed_up(lines: Iterable[str], inside: bool = False) -> Summary:
    """Summary of lines; `inside` tells whether they begin in a CDATA section."""
    closes: list[str] = []
    opens: list[str] = []
    fault = ""
    for line in lines:
        at = 0
        while True:
            if inside:
                end = line.find("]]>", at)
                if end < 0:
                    break
                inside, at = False, end + 3
            token = _TOKEN.search(line, at)
            if token is None:
                break
            at = token.end()
            closing, tag, empty = token.groups()
            if tag is None:
                inside = token.group().startswith("<!")
            elif closing:
                if not opens:
                    closes.append(tag)
                elif (last := opens.pop()) != tag and not fault:
                    fault = f"</{tag}> closes <{last}>"
            elif not empty:
                opens.append(tag)
    return joined(Summary(), Summary(tuple(closes), tuple(opens), inside, fault))


def _packed(summary: Summary) -> str:
    return "\n".join([summary.fault, "1" if summary.inside else "", " ".join(summary.closes), " ".join(summary.opens)])


def _opened(packed: str) -> Summary:
    fault, inside, closes, opens = packed.split("\n")
    return Summary(tuple(closes.split()), tuple(opens.split()), bool(inside), fault)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split of a part, whatever batches its lines come in."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for key, group in groupby(rows(), key=lambda r: r[:4]):
        outside, inside = Summary(), Summary(inside=True)
        while some := [r[4] for _, r in zip(range(10_000), group)]:
            outside, inside = (joined(s, summed_up(some, s.inside)) for s in (outside, inside))
        values = [*key, _packed(outside), _packed(inside)]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [field.split()[0] for field in _SUMMARY.split(", ")]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=names)


def _verdict(key: tuple, table: pa.Table) -> pa.Table:
    """Splits of a corpus, put in order, as one: balanced when nothing is left over."""
    table = table.sort_by([("block", "ascending"), ("part", "ascending"), ("start", "ascending")])
    whole = Summary()
    for outside, inside in zip(table.column("outside").to_pylist(), table.column("inside").to_pylist()):
        whole = joined(whole, _opened(inside if whole.inside else outside))
    fault = whole.fault
    if not fault and whole.closes:
        fault = f"</{whole.closes[0]}> closes nothing"
    if not fault and whole.opens:
        fault = f"<{whole.opens[-1]}> stays open"
    if not fault and whole.inside:
        fault = "a CDATA section stays open"
    return pa.table({"corpus": pa.array([key[0].as_py()], pa.string()), "fault": pa.array([fault or None], pa.string())})


def pack_faults(stored: DataFrame) -> DataFrame:
    """(corpus, fault) of packs given as lines (corpus, block, part, start, value) in the order they are stored in."""
    spread = stored.select("corpus", "block", "part", F.col("start").cast("bigint").alias("start"), "value")
    splits = spread.mapInArrow(_summaries, _SUMMARY)
    return splits.groupBy("corpus").applyInArrow(_verdict, "corpus STRING, fault STRING")
