"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of every contract: a run of bytes outside space and \t \n \v \f \r.
#: ``bytes.split()`` without arguments splits at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch. Texts may be long, so batches hold few of them.
BATCH_ROWS = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or one of our own where none is set (tests)."""
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here:
        return here
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="trackframe-")
    sc.setCheckpointDir(named)
    return named


#: Rows in one file of a checkpoint whose number of rows is known.
ROWS_PER_FILE = 200_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its lineage.

    ``rows`` is its number of rows or a bound of it. A small table then is a few files, not one for each shuffle partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(1 + rows // ROWS_PER_FILE)).checkpoint()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once: few rows, and few bytes where Spark knows that limit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def utf8(column: str | Column) -> Column:
    """A text column as its UTF-8 bytes, without decoding them in Python."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")
