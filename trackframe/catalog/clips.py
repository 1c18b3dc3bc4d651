"""Clips: metadata, quality, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.catalog.base import BY, IDX, TRACKS, query, r6, read, tracks
from trackframe.catalog.sequences import RUNS, VELOCITY, labelled, run_table, with_velocity
from trackframe.operators import aggregates, clips, segments, windows
from trackframe.operators.smoothing import upper_median_of


@query(
    f"""WITH {TRACKS}, v AS (SELECT *, {VELOCITY} FROM t), s AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed FROM v)
SELECT user_id, count(*) AS n_frames, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, round(avg(speed), 6) AS avg_velocity, round(max(speed), 6) AS max_velocity,
  round(avg(vx), 6) AS avg_vx, round((count(*) - 1) / 30.0, 6) AS duration_sec FROM s GROUP BY user_id"""
)
def clip_metadata(spark: SparkSession, sf: str) -> DataFrame:
    out = clips.metadata(with_velocity(spark, sf), BY, ["vx", "vy", "vz"])
    return out.select("user_id", "n_frames", "start_frame", "end_frame", *(r6(c) for c in ("avg_velocity", "max_velocity", "avg_vx", "duration_sec")))


JITTER = f"""WITH {TRACKS}, v AS (SELECT *, {VELOCITY} FROM t), j AS (SELECT *, sqrt(
  power(vx - (lag(vx) OVER w + lead(vx) OVER w) / 2, 2) + power(vy - (lag(vy) OVER w + lead(vy) OVER w) / 2, 2) + power(vz - (lag(vz) OVER w + lead(vz) OVER w) / 2, 2)) AS jitter
  FROM v WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx))
"""


@query(JITTER + "SELECT user_id, round(max(jitter), 6) AS max_jitter FROM j GROUP BY user_id")
def max_jitter(spark: SparkSession, sf: str) -> DataFrame:
    out = clips.jitter(with_velocity(spark, sf), BY, IDX, "vx", "vy", "vz")
    return out.groupBy("user_id").agg(r6(F.max("jitter"), "max_jitter"))


LONGEST = """f AS (SELECT user_id, frame_idx - row_number() OVER (PARTITION BY user_id ORDER BY frame_idx) AS g FROM t WHERE value < 8),
m AS (SELECT user_id, max(k)::BIGINT AS k FROM (SELECT user_id, g, count(*) AS k FROM f GROUP BY user_id, g) GROUP BY user_id)"""


@query(f"WITH {TRACKS}, {LONGEST} SELECT u.user_id, coalesce(k, 0)::BIGINT AS longest_run FROM (SELECT DISTINCT user_id FROM t) u LEFT JOIN m USING (user_id)")
def longest_run(spark: SparkSession, sf: str) -> DataFrame:
    return clips.longest_run(tracks(spark, sf).withColumn("low", F.col("value") < 8), BY, IDX, "low")


@query(
    f"""{JITTER}, {LONGEST}, b AS (SELECT user_id, (count(*) - 1) / 30.0 AS d, avg(value) / 30 AS c, coalesce(max(jitter), 0) AS j FROM j GROUP BY user_id),
q AS (SELECT b.*, coalesce(k, 0) AS miss FROM b LEFT JOIN m USING (user_id))
SELECT user_id, d >= 2.2 AND c >= 0.3 AND j <= 400 AND miss <= 6 AS accepted,
  (d < 2.2)::BIGINT + (c < 0.3)::BIGINT + (j > 400)::BIGINT + (miss > 6)::BIGINT AS n_reasons,
  round(least(greatest(0.3 * c + 0.25 * greatest(1 - j / 400, 0) + 0.25 + 0.2 * (1 - miss / 12.0), 0), 1), 6) AS overall_score FROM q"""
)
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = clips.jitter(with_velocity(spark, sf), BY, IDX, "vx", "vy", "vz")
    base = rows.groupBy("user_id").agg(
        clips.duration(F.count("*")).alias("duration_sec"), (F.avg("value") / 30).alias("avg_confidence"), F.coalesce(F.max("jitter"), F.lit(0.0)).alias("max_jitter")
    )
    gaps = clips.longest_run(rows.withColumn("low", F.col("value") < 8), BY, IDX, "low", "missing_frames")
    out = base.join(gaps, BY).withColumn("limb_consistency", F.lit(1.0))
    out = clips.judge(out, clips.QualityLimits(min_duration=2.2, max_jitter=400.0, max_missing=6))
    return out.select("user_id", "accepted", F.size("rejections").cast("long").alias("n_reasons"), r6("overall_score"))


@query(f"WITH {TRACKS}, l AS (SELECT user_id, list_sort(list(value)) AS s FROM t GROUP BY user_id) SELECT user_id, s[len(s) // 2 + 1] AS upper_median, round(list_median(s), 6) AS median FROM l")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).groupBy("user_id").agg(upper_median_of("value").alias("upper_median"), r6(F.expr("percentile(value, 0.5)"), "median"))


@query(
    f"""WITH {TRACKS}, l AS (SELECT user_id, event_type, value FROM t WHERE value > 0.1), m AS (SELECT user_id, event_type, list_sort(list(value)) AS s FROM l GROUP BY ALL),
n AS (SELECT user_id, event_type, s[len(s) // 2 + 1] AS med, len(s) AS k FROM m), w AS (SELECT l.user_id, max(abs(value - med) / med) AS d FROM l JOIN n USING (user_id, event_type)
  WHERE k >= 2 AND med >= 0.1 GROUP BY l.user_id)
SELECT u.user_id, round(greatest(1 - coalesce(d, 0), 0), 6) AS limb_consistency FROM (SELECT DISTINCT user_id FROM t) u LEFT JOIN w USING (user_id)"""
)
def limb_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return clips.limb_consistency(tracks(spark, sf), BY, "event_type", "value").select("user_id", r6("limb_consistency"))


@query(
    f"""WITH {TRACKS}, s AS (SELECT user_id, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d FROM t WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx))
SELECT user_id, round(coalesce(exp(-0.01 * avg(abs(d))), 0), 6) AS smoothness FROM s GROUP BY user_id"""
)
def smoothness(spark: SparkSession, sf: str) -> DataFrame:
    return clips.smoothness(tracks(spark, sf), BY, [], IDX, ["value"]).select("user_id", r6("smoothness"))


def clip_table(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal labels as clips: motion_type, player_id, n_frames, duration_sec."""
    rows = run_table(spark, sf)
    return rows.select(
        F.col("user_id").alias("player_id"), "run_id", segments.names_of(F.col("label").cast("int")).alias("motion_type"), "n_frames", clips.duration(F.col("n_frames")).alias("duration_sec")
    )


CLIPS = RUNS + """, k AS (SELECT user_id AS player_id, run_id, (['Idle', 'Walk', 'Jog', 'Sprint'])[label + 1] AS motion_type, n_frames, (n_frames - 1) / 30.0 AS duration_sec FROM s)
"""


@query(
    CLIPS + """SELECT count(*) AS total_clips, sum(n_frames)::BIGINT AS total_frames, round(sum(duration_sec), 6) AS total_seconds, count(DISTINCT player_id) FILTER (WHERE player_id >= 0) AS unique_players FROM k"""
)
def db_stats(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.database_stats(clip_table(spark, sf)).withColumn("total_seconds", r6(F.col("total_seconds")))


@query(CLIPS + "SELECT motion_type, count(*) AS n FROM k GROUP BY motion_type")
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.type_counts(clip_table(spark, sf))


@query(
    CLIPS + """, d AS (SELECT unnest(['Idle','Walk','Jog','Sprint','TurnLeft','TurnRight','Decelerate','Jump','Slide','Kick','Tackle','Shield','Receive','Celebrate','Goalkeeper','Unknown']) AS motion_type)
SELECT d.motion_type, count(k.run_id) AS n FROM d LEFT JOIN k USING (motion_type) GROUP BY d.motion_type"""
)
def all_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.counts_by_motion(spark, clip_table(spark, sf))


@query(CLIPS + "SELECT run_id, player_id, n_frames FROM k WHERE motion_type = 'Sprint' AND player_id = 7")
def entries_by_type_and_player(spark: SparkSession, sf: str) -> DataFrame:
    return clip_table(spark, sf).where("motion_type = 'Sprint' and player_id = 7").select("run_id", "player_id", "n_frames")


@query(CLIPS + "SELECT motion_type, player_id, grouping(motion_type, player_id)::BIGINT AS grouping_id, count(*) AS n, sum(n_frames)::BIGINT AS total FROM k GROUP BY ROLLUP (motion_type, player_id)")
def rollup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.rollup(clip_table(spark, sf), ["motion_type", "player_id"], "n_frames").withColumn("grouping_id", F.col("grouping_id").cast("long"))


@query(CLIPS + "SELECT motion_type, player_id, grouping(motion_type, player_id)::BIGINT AS grouping_id, count(*) AS n, sum(n_frames)::BIGINT AS total FROM k GROUP BY CUBE (motion_type, player_id)")
def cube_stats(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.cube(clip_table(spark, sf), ["motion_type", "player_id"], "n_frames").withColumn("grouping_id", F.col("grouping_id").cast("long"))


@query(CLIPS + "SELECT motion_type, NULL::BIGINT AS player_id, CASE WHEN grouping(motion_type) = 0 THEN 1 ELSE 3 END::BIGINT AS grouping_id, count(*) AS n, sum(n_frames)::BIGINT AS total FROM k GROUP BY GROUPING SETS ((motion_type), ())")
def grouping_set_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregates.grouping_sets(clip_table(spark, sf), [["motion_type"], []], ["motion_type", "player_id"], "n_frames")
    return out.withColumn("grouping_id", F.col("grouping_id").cast("long"))


@query()
def approx_players(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.approximate(clip_table(spark, sf), ["motion_type"], "player_id", "n_frames")


@query(
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity, round((l_extendedprice - mp) / sp, 6) + 0.0 AS l_extendedprice FROM lineitem, s"""
)
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return aggregates.zscore(df, ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", r6("l_quantity"), r6("l_extendedprice"))


@query(
    """SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(coalesce(var_samp(l_quantity), 0), 6) AS variance,
  round(sqrt(coalesce(var_samp(l_quantity), 0) + 1e-8), 6) AS scale FROM lineitem GROUP BY l_suppkey"""
)
def var_samp(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.sample_scale(read(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity").select("l_suppkey", r6("mean"), r6("variance"), r6("scale"))


@query(
    f"""WITH {TRACKS}, l AS (SELECT user_id, max(frame_idx) + 1 AS n FROM t GROUP BY user_id),
o AS (SELECT user_id, sum(n) OVER (ORDER BY user_id) - n AS off FROM l)
SELECT t.user_id, event_id, (frame_idx + off)::BIGINT AS frame_idx FROM t JOIN o USING (user_id)"""
)
def concat_clips(spark: SparkSession, sf: str) -> DataFrame:
    df = tracks(spark, sf).withColumn("place", F.col("user_id"))
    return clips.concatenate(df, "user_id", "place").select("user_id", "event_id", F.col("frame_idx").cast("long"))


@query(RUNS + "SELECT true AS accepted, user_id, run_id FROM s WHERE n_frames >= 3 UNION ALL SELECT false, user_id, run_id FROM s WHERE n_frames < 3")
def accepted_rejected(spark: SparkSession, sf: str) -> DataFrame:
    judged = run_table(spark, sf).withColumn("accepted", F.col("n_frames") >= 3)
    good, bad = clips.partition_accepted(judged)
    return good.select("accepted", "user_id", "run_id").unionByName(bad.select("accepted", "user_id", "run_id"))


@query(
    RUNS + """, m AS (SELECT user_id, label, avg(value) AS p FROM r GROUP BY user_id, label), z AS (SELECT user_id, sum(p) AS t FROM m GROUP BY user_id)
SELECT user_id, arg_max(label, p)::BIGINT AS label, round(max(p / t), 6) AS confidence FROM m JOIN z USING (user_id) GROUP BY user_id"""
)
def class_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's label with the greatest mean value, over the sum of the means."""
    rows = labelled(spark, sf)
    means = rows.groupBy("user_id", "label").agg(F.avg("value").alias("p")).withColumn("t", F.sum("p").over(windows.whole(BY)))
    slots = F.array(*(F.when(F.col("label") == k, F.col("p") / F.col("t")).otherwise(0.0) for k in range(4)))
    one = means.withColumn("_a", slots)
    packed = one.groupBy("user_id").agg(F.array(*(F.sum(F.get("_a", F.lit(k))) for k in range(4))).alias("probabilities"))
    out = segments.mean_probabilities(packed, BY, "probabilities")
    return out.select("user_id", F.col("label").cast("long"), r6("confidence"))
