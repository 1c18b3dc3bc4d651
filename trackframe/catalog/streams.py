"""Streams that are run over the files that are there; their results are those of the same query on the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.catalog.base import query, r6
from trackframe.streaming import events, running, tracks

def _total() -> list:
    return [F.count("*").alias("n"), r6(F.sum("value"), "total")]


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = events.tumbling(events.read(spark, sf), "1 day", ["event_type"], _total())
    return _ntz(running.to_end(out, "tumbling", "complete"), "start").select("start", "event_type", "n", "total")


@query(
    """WITH e AS (SELECT *, unnest([0, 1]) AS k FROM events), w AS (SELECT date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END - k * INTERVAL 12 HOUR AS start, value FROM e)
SELECT start, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY start"""
)
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = events.sliding(events.read(spark, sf), "1 day", "12 hours", [], _total())
    return _ntz(running.to_end(out, "sliding", "complete"), "start").select("start", "n", "total")


@query(
    """WITH d AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true)::INT AS s FROM events),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, k"""
)
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    out = events.sessions(events.read(spark, sf), "6 hours", ["user_id"], _total())
    return _ntz(running.to_end(out, "session", "complete"), "start").select("user_id", "start", "n", "total")


@query("SELECT event_id, user_id, value FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    raw = events.read(spark, sf)
    twice = raw.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return running.to_end(events.deduplicate(twice, ["event_id"]), "dedup").select("event_id", "user_id", "value")


@query()
def stream_finished_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return running.to_end(tracks.finished_tracks(events.read(spark, sf), "user_id"), "tracks")
