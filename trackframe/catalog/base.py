"""Registering queries, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BY, ORDER = ["user_id"], ["ts", "event_id"]
IDX = ["frame_idx"]

#: Events as tracks, in SQL: one for each user, in order of time, numbered from 0.
TRACKS = """t AS (
  SELECT user_id, event_id, ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         epoch_us(ts) / 1e6 AS sec
  FROM events
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracks: user_id, event_id, ts, event_type, value, frame_idx and the time in seconds."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    out = windows.index(events, BY, ORDER).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    return out.withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six digits, without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out
