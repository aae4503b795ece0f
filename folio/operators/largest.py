"""The largest files of each corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import paths
from folio.functions import text as txt
from folio.options import SHOW_ALL_UP_TO, TOP_FILES

# Headings of the files table.
TITLE_TOP = "TOP 10 LARGEST FILES BY CHARACTER COUNT"
TITLE_ALL = "PROCESSED FILES"

SPLITS = 32


def largest_files(details: DataFrame) -> DataFrame:
    """Top 10 by characters where a corpus has more than 15 files, else all; ties by path.

    Sixteen rows of a corpus tell everything: which files are shown, and by the sixteenth
    whether there are more than fifteen. So every task first keeps its own best sixteen per
    corpus, then each of a few splits does, and only those rows meet in one place. A corpus
    that holds a third of all files never lands in one task, and the input is read once.
    """
    needed = SHOW_ALL_UP_TO + 1

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        by_size = W.partitionBy(*keys).orderBy(F.desc("chars"), "path")
        return rows.withColumn("rank", F.row_number().over(by_size)).where(f"rank <= {needed}")

    split = F.pmod(F.spark_partition_id(), F.lit(SPLITS))
    top = best(best(details.withColumn("split", split), "corpus", "split"), "corpus").drop("split")
    many = (F.max("rank").over(W.partitionBy("corpus")) == needed).alias("many")
    return (
        top.select("*", many)
        .where(f"NOT many OR rank <= {TOP_FILES}")
        .withColumn("title", F.expr(f"if(many, '{TITLE_TOP}', '{TITLE_ALL}')"))
        .drop("many")
    )


def files_report(largest: DataFrame) -> DataFrame:
    """Rows of the files table: short path, lines, and tokens counted or estimated."""
    tokens = f"coalesce(tokens, {txt.token_estimate('chars')})"
    return largest.selectExpr(
        "corpus",
        "rank",
        "title",
        f"{paths.display_path('report_path')} AS display_path",
        f"{txt.count_text('lines')} AS lines",
        f"{txt.count_text(tokens)} AS tokens",
    )
