"""Event-time windows, sessions and deduplication on streams; each function works on batches alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 1, glob: str = "events*.parquet") -> DataFrame:
    """Events as files arrive; so many files to a batch is how much is taken in at once. ``ts`` becomes a timestamp, as watermarks need."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def tumbling(df: DataFrame, width: str, by: list[str], aggs: list[Column], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Aggregates of windows that follow each other: start, end, key, aggregates. Rows later than the delay are dropped."""
    return _flat(_late(df, ts, delay).groupBy(F.window(ts, width), *by).agg(*aggs))


def sliding(df: DataFrame, width: str, step: str, by: list[str], aggs: list[Column], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Aggregates of windows that overlap."""
    return _flat(_late(df, ts, delay).groupBy(F.window(ts, width, step), *by).agg(*aggs))


def sessions(df: DataFrame, gap: str, by: list[str], aggs: list[Column], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Aggregates of sessions: events of a key that are less than the gap apart."""
    return _flat(_late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("window"), *by).agg(*aggs))


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *rest)


def deduplicate(df: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key that is not older than the delay; on a batch, one row of each key."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def join_within(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, within: str, delay: str = "1 hour") -> DataFrame:
    """Pairs of rows of two streams with one key and at most ``within`` apart, the right one later."""
    a, b = _late(left, left_ts, delay).alias("a"), _late(right, right_ts, delay).alias("b")
    span = F.expr(f"interval {within}")
    near = (F.col(f"b.{right_ts}") >= F.col(f"a.{left_ts}")) & (F.col(f"b.{right_ts}") <= F.col(f"a.{left_ts}") + span)
    return a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & near)
