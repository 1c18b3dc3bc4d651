import pytest
from pyspark.sql import functions as F

from trackframe.operators.association import IdentitySettings, TrackerSettings
from trackframe.streaming import events, running, tracks


@pytest.fixture()
def folder(spark, sf, tmp_path):
    """The events as three files, in order of time."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    n = df.count()
    for k in range(3):
        part = df.where((F.col("event_id") >= k * n / 3) & (F.col("event_id") < (k + 1) * n / 3))
        part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            f.rename(tmp_path / f"events{k}.parquet")
    return str(tmp_path)


def test_stream_is_the_same_as_batch(spark, sf, folder):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    aggs = [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")]
    for made, name in (
        (lambda d: events.tumbling(d, "1 day", ["event_type"], aggs), "tumbling"),
        (lambda d: events.sliding(d, "1 day", "6 hours", [], aggs), "sliding"),
        (lambda d: events.sessions(d, "3 hours", ["user_id"], aggs), "sessions"),
    ):
        got = running.to_end(made(events.read(spark, folder)), name, "complete").collect()
        assert sorted(map(str, got)) == sorted(map(str, made(batch).collect())), name


def test_append_leaves_the_last_window_open(spark, folder):
    aggs = [F.count("*").alias("n")]
    days = running.to_end(events.tumbling(events.read(spark, folder), "1 day", [], aggs, delay="0 seconds"), "days").count()
    assert days == 29


def test_repeats_are_dropped_over_batches(spark, folder):
    raw = events.read(spark, folder)
    twice = raw.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    out = running.to_end(events.deduplicate(twice, ["event_id"]), "dedup")
    assert out.count() == out.select("event_id").distinct().count() == raw_count(spark, folder)


def raw_count(spark, folder):
    return spark.read.parquet(f"{folder}/events*.parquet").count()


def test_tracks_end_after_a_gap(spark, folder):
    out = running.to_end(tracks.finished_tracks(events.read(spark, folder), "user_id", gap_seconds=4 * 3600), "finished").collect()
    df = spark.read.parquet(f"{folder}/events*.parquet")
    assert out and sum(x.n for x in out) <= df.count()
    first = min(out, key=lambda x: (x.user_id, x.first))
    rows = df.where(F.col("user_id") == first.user_id).where(F.col("ts").cast("timestamp").between(first.first, first.last)).collect()
    assert len(rows) == first.n and sum(x.value for x in rows) == pytest.approx(first.total)


def test_callbacks_and_statistics(spark, folder):
    seen, ended = [], []
    run = running.Run(events.read(spark, folder)).start(lambda d, k: seen.append(d.count()), done=ended.append, available_now=True)
    assert run.wait(60) and not run.running()
    import time

    for _ in range(50):
        if run.stats.rows == sum(seen) and ended:
            break
        time.sleep(0.2)
    assert sum(seen) == raw_count(spark, folder) == run.stats.rows and run.stats.batches >= 3 and ended == [None]
    run.reset()
    assert run.stats.rows == 0 and run.wait()


def test_tracker_goes_on_between_batches(spark, tmp_path):
    schema = "video string, frame_idx int, det_idx int, bbox struct<x:double,y:double,w:double,h:double,conf:double>, reid array<double>"
    for b in range(3):
        rows = [("v", k, d, (d * 200 + k * 3.0, 0.0, 50.0, 90.0, 0.9), [float(d), 1.0 - d]) for k in range(b * 8, b * 8 + 8) for d in range(2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{b}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b*")
    out = running.to_end(tracks.track(stream, TrackerSettings()), "tracker").collect()
    assert len(out) == 48 and {(x.det_idx, x.track_id) for x in out} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)}) and max(x.hits for x in out) == 24
    again = running.to_end(tracks.identify(stream.withColumn("track_id", F.col("det_idx").cast("long")), IdentitySettings()), "players").collect()
    assert {x.player_id for x in again} == {0, 1}


def test_join_within(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.join_within(df, df.withColumnRenamed("value", "v2"), "user_id", "ts", "ts", "1 hour")
    assert out.count() >= df.count()
