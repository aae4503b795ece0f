"""What the operators share: the shared folder, staging, input sizes, and names that clash with nothing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: The white space of the dealt contracts, and what trims it.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode without the setting, one of its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folio-llm-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to the shared folder and read back: cuts lineage and fixes what was decided by chance of timing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column, summed where the rows are."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(size: int, target: int) -> int:
    """Parts of about `target` bytes; the number follows the data at every size."""
    return max(1, -(-size // target))


def give_back_memory() -> None:
    """Hand what a finished group has left free in this worker back to the machine, where the platform can."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def crc_of_id(column: str) -> F.Column:
    """crc32 of the decimal text of an id; null for null."""
    return F.crc32(F.encode(F.col(column).cast("string"), "utf-8"))
