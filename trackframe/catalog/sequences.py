"""Ordered sequences: sampling, differences, filters, contacts, runs, boundaries, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.catalog.base import BY, IDX, TRACKS, query, r6, read, tracks
from trackframe.operators import segments, skeleton, smoothing, windows


@query(f"WITH {TRACKS} SELECT user_id, (frame_idx // 3)::BIGINT AS frame_idx, frame_idx / 30.0 AS ts, event_id FROM t WHERE frame_idx % 3 = 0")
def decimate(spark: SparkSession, sf: str) -> DataFrame:
    out = skeleton.decimate(tracks(spark, sf).drop("ts"), "frame_idx", 30.0, 10.0, BY)
    return out.select("user_id", F.col("frame_idx").cast("long"), "ts", "event_id")


@query(
    f"""WITH RECURSIVE {TRACKS}, s(n, acc) AS (
  SELECT 0, 0.0::DOUBLE UNION ALL SELECT n + 1, acc + 30.0::DOUBLE / 12.5::DOUBLE FROM s WHERE acc < 400
) SELECT user_id, event_id, n::BIGINT AS sample_idx FROM t JOIN s ON ceil(acc)::BIGINT = frame_idx"""
)
def fractional_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = skeleton.sample_fractional(tracks(spark, sf).withColumn("frame_idx", F.col("frame_idx").cast("int")), "frame_idx", 30.0, 12.5)
    return out.select("user_id", "event_id", F.col("sample_idx").cast("long"))


@query("SELECT user_id, event_id, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 65)")
def min_track_filter(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton.long_tracks(read(spark, sf, "events"), BY, 65).select("user_id", "event_id", "value")


@query(
    """SELECT user_id, event_id, value FROM events WHERE user_id IN
  (SELECT user_id FROM events GROUP BY user_id HAVING avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END) >= 0.5)"""
)
def valid_track_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "events").withColumn("ok", F.col("value") > 5)
    return skeleton.valid_tracks(df, BY, "ok").select("user_id", "event_id", "value")


@query("SELECT DISTINCT user_id FROM events")
def distinct_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("user_id").distinct()


@query(
    f"""WITH {TRACKS}, d AS (SELECT *, lag(value) OVER w AS pv, lag(sec) OVER w AS ps FROM t WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx))
SELECT user_id, event_id, round(coalesce((value - pv) / CASE WHEN sec - ps < 1e-6 THEN 1 / 30.0 ELSE sec - ps END, 0), 6) + 0.0 AS velocity FROM d"""
)
def finite_diff(spark: SparkSession, sf: str) -> DataFrame:
    df = tracks(spark, sf)
    out = windows.difference(df, BY, IDX, "value", windows.time_step("sec", BY, IDX))
    return out.select("user_id", "event_id", r6("velocity"))


@query(
    f"""WITH {TRACKS} SELECT user_id, event_id,
  round(coalesce((lead(value) OVER w - lag(value) OVER w) / (2 * (1 / 30.0::DOUBLE)), 0), 6) + 0.0 AS accel FROM t WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)"""
)
def central_accel(spark: SparkSession, sf: str) -> DataFrame:
    return windows.central_acceleration(tracks(spark, sf), BY, IDX, "value").select("user_id", "event_id", r6("accel"))


@query(f"WITH {TRACKS} SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM t")
def moving_avg5(spark: SparkSession, sf: str) -> DataFrame:
    return windows.moving_average(tracks(spark, sf), BY, IDX, "value").select("user_id", "event_id", r6("smooth"))


@query(
    f"""WITH {TRACKS}, d AS (SELECT *, (value - lag(value) OVER (PARTITION BY user_id ORDER BY frame_idx)) * 30 AS step FROM t)
SELECT user_id, event_id, round(coalesce(avg(step) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0), 6) + 0.0 AS smooth_velocity FROM d"""
)
def smoothed_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return windows.smoothed_velocity(tracks(spark, sf), BY, IDX, "value").select("user_id", "event_id", r6("smooth_velocity"))


@query(
    f"""WITH {TRACKS}, d AS (SELECT *, value / 10.0 - lag(value / 10.0) OVER (PARTITION BY user_id ORDER BY frame_idx) AS turn FROM t)
SELECT user_id, event_id, round(coalesce((turn - 2 * pi() * round(turn / (2 * pi()))) * 30, 0), 6) + 0.0 AS turn_rate FROM d"""
)
def turn_rate(spark: SparkSession, sf: str) -> DataFrame:
    df = tracks(spark, sf).withColumn("angle", F.col("value") / 10.0)
    return windows.turn_rate(df, BY, IDX, "angle").select("user_id", "event_id", r6("turn_rate"))


MAD = f"""WITH {TRACKS}, w AS (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n, list(value) OVER c AS l, median(value) OVER c AS m
  FROM t WINDOW c AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
), s AS (SELECT *, list_median(list_transform(l, lambda x: abs(x - m))) * 1.4826 AS s FROM w
), o AS (SELECT *, n >= 7 AND CASE WHEN s > 1e-6 THEN abs(value - m) / s > 3 ELSE abs(value - m) > 1e-4 AND len(l) >= 5 END AS is_outlier FROM s)
"""


@query(MAD + "SELECT user_id, event_id, is_outlier, round(CASE WHEN is_outlier THEN m ELSE value END, 6) AS value FROM o")
def mad_outlier_median(spark: SparkSession, sf: str) -> DataFrame:
    out = smoothing.mad_outliers(tracks(spark, sf), BY, IDX, "value", replace="median")
    return out.select("user_id", "event_id", "is_outlier", r6("value"))


@query(
    MAD + """SELECT user_id, event_id, is_outlier, round(CASE WHEN NOT is_outlier THEN value WHEN s > 1e-6 THEN m + sign(value - m) * 3 * s ELSE m END, 6) AS value FROM o"""
)
def mad_outlier_clamp(spark: SparkSession, sf: str) -> DataFrame:
    out = smoothing.mad_outliers(tracks(spark, sf), BY, IDX, "value", replace="clamp")
    return out.select("user_id", "event_id", "is_outlier", r6("value"))


@query(
    MAD + """, g AS (SELECT *,
  last_value(CASE WHEN NOT is_outlier THEN frame_idx END IGNORE NULLS) OVER p AS ia, last_value(CASE WHEN NOT is_outlier THEN value END IGNORE NULLS) OVER p AS va,
  first_value(CASE WHEN NOT is_outlier THEN frame_idx END IGNORE NULLS) OVER f AS ib, first_value(CASE WHEN NOT is_outlier THEN value END IGNORE NULLS) OVER f AS vb
  FROM o WINDOW p AS (PARTITION BY user_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, is_outlier, round(CASE WHEN NOT is_outlier THEN value WHEN ia IS NOT NULL AND ib IS NOT NULL
  THEN va * (1 - (frame_idx - ia)::DOUBLE / (ib - ia)) + vb * ((frame_idx - ia)::DOUBLE / (ib - ia)) ELSE coalesce(va, vb, value) END, 6) AS value FROM g"""
)
def mad_outlier_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    out = smoothing.mad_outliers(tracks(spark, sf), BY, IDX, "value")
    return out.select("user_id", "event_id", "is_outlier", r6("value"))


@query(MAD + "SELECT user_id, count(*) AS samples, sum(is_outlier::INT)::BIGINT AS outliers, round(max(CASE WHEN is_outlier THEN abs(value - m) ELSE 0 END), 6) AS max_change FROM o GROUP BY user_id")
def outlier_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = smoothing.mad_outliers(tracks(spark, sf), BY, IDX, "value", replace="median", out="clean")
    return smoothing.outlier_stats(out, "value", "clean", BY).select("user_id", "samples", "outliers", r6("max_change"))


def _savgol_sql() -> str:
    c = smoothing.savgol_coefficients(7, 3)
    terms = " + ".join(f"({w!r}) * p[i + {k + 1}]" for k, w in enumerate(c))
    return f"""WITH {TRACKS}, a AS (SELECT user_id, list(value ORDER BY frame_idx) AS x, count(*) AS n FROM t GROUP BY user_id),
b AS (SELECT user_id, n, list_concat(list_concat([2 * x[1] - x[4], 2 * x[1] - x[3], 2 * x[1] - x[2]], x),
  [2 * x[n] - x[n - 1], 2 * x[n] - x[n - 2], 2 * x[n] - x[n - 3]]) AS p FROM a WHERE n >= 7),
r AS (SELECT user_id, p, unnest(range(n)) AS i FROM b)
SELECT user_id, i::BIGINT AS frame_idx, round({terms}, 6) + 0.0 AS value FROM r"""


@query(_savgol_sql())
def savgol7_3(spark: SparkSession, sf: str) -> DataFrame:
    df = skeleton.long_tracks(tracks(spark, sf), BY, 7)
    return smoothing.savgol(df, BY, IDX, "value").select("user_id", "frame_idx", r6("value"))


@query(
    f"""WITH {TRACKS}, a AS (SELECT user_id, list(value ORDER BY frame_idx) AS x FROM t GROUP BY user_id),
r AS (SELECT user_id, x, unnest(range(len(x))) AS i FROM a)
SELECT user_id, i::BIGINT AS frame_idx, list_reduce(x[:i + 1], lambda y, v: y + 0.15::DOUBLE * (v - y)) AS ema FROM r"""
)
def ema_blend(spark: SparkSession, sf: str) -> DataFrame:
    return smoothing.ema(tracks(spark, sf), BY, IDX, "value", 0.15).select("user_id", "frame_idx", "ema")


@query(
    f"""WITH {TRACKS}, a AS (SELECT user_id, list(value ORDER BY frame_idx) AS x, list_sort(list(value) FILTER (WHERE value > 0)) AS s FROM t GROUP BY user_id),
r AS (SELECT user_id, x, s[len(s) // 2 + 1] AS m, unnest(range(len(x))) AS i FROM a)
SELECT user_id, i::BIGINT AS frame_idx,
  list_reduce(list_concat([m], x[:i + 1]), lambda y, v: CASE WHEN v > 1e-6 THEN (1 - 0.05::DOUBLE) * y + 0.05::DOUBLE * v ELSE y END) AS limb_length FROM r"""
)
def limb_ema(spark: SparkSession, sf: str) -> DataFrame:
    return smoothing.limb_ema(tracks(spark, sf), BY, IDX, "value").select("user_id", "frame_idx", "limb_length")


CONTACT = f"""WITH {TRACKS}, d AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame_idx)), 0) AS speed FROM t),
c AS (SELECT *, min((speed < 6 AND value < 12)::INT) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS contact FROM d)
"""


def _contact(spark: SparkSession, sf: str) -> DataFrame:
    df = tracks(spark, sf)
    df = windows.difference(df, BY, IDX, "value", out="speed").withColumn("speed", F.abs("speed"))
    return windows.contact(df, BY, IDX, "speed", "value", 6.0, 12.0)


@query(CONTACT + "SELECT user_id, event_id, contact FROM c")
def contact_stable(spark: SparkSession, sf: str) -> DataFrame:
    return _contact(spark, sf).select("user_id", "event_id", "contact")


@query(
    CONTACT + """, s AS (SELECT *, CASE WHEN contact AND NOT coalesce(lag(contact) OVER (PARTITION BY user_id ORDER BY frame_idx), false) THEN value END AS start FROM c)
SELECT user_id, event_id, CASE WHEN contact THEN last_value(start IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) END AS held FROM s"""
)
def hold_last(spark: SparkSession, sf: str) -> DataFrame:
    return windows.hold(_contact(spark, sf), BY, IDX, "contact", "value").select("user_id", "event_id", "held")


@query(CONTACT + "SELECT user_id, round(avg(contact::INT), 6) AS contact_ratio FROM c GROUP BY user_id")
def contact_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _contact(spark, sf).groupBy("user_id").agg(r6(F.avg(F.col("contact").cast("double")), "contact_ratio"))


@query(
    f"""WITH {TRACKS} SELECT user_id, event_id, coalesce(value > lag(value) OVER w AND value > lead(value) OVER w AND value > 5, false) AS peak
FROM t WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)"""
)
def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return windows.peaks(tracks(spark, sf), BY, IDX, "value").select("user_id", "event_id", "peak")


@query(
    f"""WITH {TRACKS}, a AS (SELECT *, value > avg(value) OVER (PARTITION BY user_id) AS above FROM t),
b AS (SELECT user_id, (above <> lag(above) OVER (PARTITION BY user_id ORDER BY frame_idx))::INT AS crossed FROM a),
c AS (SELECT user_id, count(*) AS n, sum(coalesce(crossed, 0))::BIGINT AS crossings FROM b GROUP BY user_id)
SELECT *, round(CASE WHEN n >= 10 AND (n - 1) / 30.0 >= 0.1 THEN crossings / 2.0 / ((n - 1) / 30.0) ELSE 0 END, 6) AS stride_frequency FROM c"""
)
def mean_crossings(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.stride_frequency(windows.mean_crossings(tracks(spark, sf), BY, IDX, "value"))
    return out.select("user_id", "n", "crossings", r6("stride_frequency"))


#: A row's label in SQL and in the queries below: idle, walk, jog or sprint by value.
LABEL = "CASE WHEN value < 5 THEN 0 WHEN value < 12 THEN 1 WHEN value < 25 THEN 2 ELSE 3 END"
RUNS = f"""WITH {TRACKS}, l AS (SELECT *, {LABEL} AS label FROM t),
c AS (SELECT *, (label <> lag(label) OVER (PARTITION BY user_id ORDER BY frame_idx))::INT AS changed FROM l),
r AS (SELECT *, sum(coalesce(changed, 0)) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM c),
s AS (SELECT user_id, run_id, any_value(label)::BIGINT AS label, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS n_frames, avg(value) AS avg_value FROM r GROUP BY ALL)
"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    df = tracks(spark, sf)
    return df.withColumn("label", segments.speed_label(F.col("value"), 5, 12, 25).cast("long"))


def run_table(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.runs(labelled(spark, sf), BY, IDX, "label")
    return segments.run_stats(out, BY, "label", means=["value"]).withColumn("run_id", F.col("run_id").cast("long"))


@query(
    RUNS.replace("GROUP BY ALL)\n", "GROUP BY user_id, run_id)\n") + "SELECT user_id, run_id, label, start_frame, end_frame, n_frames, round(avg_value, 6) AS avg_value FROM s"
)
def run_segments(spark: SparkSession, sf: str) -> DataFrame:
    return run_table(spark, sf).select("user_id", "run_id", "label", "start_frame", "end_frame", "n_frames", r6("avg_value"))


RUNS = RUNS.replace("GROUP BY ALL)\n", "GROUP BY user_id, run_id)\n")


@query(
    RUNS + """, k AS (SELECT *, (n_frames >= 3 OR row_number() OVER (PARTITION BY user_id ORDER BY start_frame) = 1)::INT AS kept FROM s),
g AS (SELECT *, sum(kept) OVER (PARTITION BY user_id ORDER BY start_frame ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS seg FROM k)
SELECT user_id, seg AS run_id, arg_min(label, start_frame) AS label, min(start_frame) AS start_frame, max(end_frame) AS end_frame,
  sum(n_frames)::BIGINT AS n_frames, round(sum(avg_value * n_frames) / sum(n_frames), 6) AS avg_value FROM g GROUP BY user_id, seg"""
)
def merge_short(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.merge_short(run_table(spark, sf), BY, 3, means=["avg_value"])
    return out.select("user_id", F.col("run_id").cast("long"), "label", "start_frame", "end_frame", "n_frames", r6("avg_value"))


@query(RUNS + "SELECT user_id, run_id, label, start_frame, end_frame FROM s WHERE n_frames >= 3")
def drop_short(spark: SparkSession, sf: str) -> DataFrame:
    return segments.drop_short(run_table(spark, sf), 3).select("user_id", "run_id", "label", "start_frame", "end_frame")


@query(RUNS + "SELECT label, count(*) AS segments, sum(n_frames)::BIGINT AS frames, round(avg(n_frames), 6) AS mean_length FROM s GROUP BY label")
def segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    return run_table(spark, sf).groupBy("label").agg(F.count("*").alias("segments"), F.sum("n_frames").alias("frames"), r6(F.avg("n_frames"), "mean_length"))


#: Root velocity of an event in SQL and here: along x, up and across.
VELOCITY = "value * 10 AS vx, (value - 8) AS vy, (event_id % 7) * 20.0 AS vz"
BOUNDARY = f"""WITH {TRACKS}, v AS (SELECT *, {VELOCITY}, count(*) OVER (PARTITION BY user_id) AS n FROM t),
a AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed FROM v),
b AS (SELECT *, avg(speed) OVER p AS v0, avg(speed) OVER f AS v1, atan2(sum(vz) OVER p, sum(vx) OVER p) AS d0, atan2(sum(vz) OVER f, sum(vx) OVER f) AS d1 FROM a
  WINDOW p AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
c AS (SELECT *, degrees(CASE WHEN abs(d1 - d0) > pi() THEN 2 * pi() - abs(d1 - d0) ELSE abs(d1 - d0) END) AS turn FROM b),
e AS (SELECT *, frame_idx >= 3 AND frame_idx < n - 3 AND (abs(v1 - v0) > 150 OR (turn > 45 AND v0 > 30) OR abs(vy) > 100 OR (v0 > 50 AND v1 < 10)) AS boundary FROM c)
"""


def with_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).withColumns({"vx": F.col("value") * 10, "vy": F.col("value") - 8, "vz": (F.col("event_id") % 7) * 20.0})


def _bounded(spark: SparkSession, sf: str) -> DataFrame:
    return windows.boundaries(with_velocity(spark, sf), BY, IDX, ("vx", "vy", "vz"))


@query(BOUNDARY + "SELECT user_id, event_id, boundary FROM e")
def boundary_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _bounded(spark, sf).select("user_id", "event_id", "boundary")


THIN = (
    BOUNDARY
    + """, q AS (SELECT user_id, frame_idx FROM e WHERE boundary OR frame_idx = 0 OR frame_idx = n - 1),
l AS (SELECT user_id, list_sort(list(frame_idx)) AS x FROM q GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(x, lambda v: [v]), lambda a, b: CASE WHEN b[1] - a[-1] >= 8 THEN list_concat(a, b) ELSE a END) AS kept FROM l)
"""
)


@query(THIN + "SELECT user_id, unnest(kept) AS frame_idx FROM k")
def boundary_thin(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bounded(spark, sf).withColumn("n", F.max("frame_idx").over(windows.whole(BY)))
    points = rows.where(F.col("boundary") | (F.col("frame_idx") == 0) | (F.col("frame_idx") == F.col("n"))).select("user_id", "frame_idx")
    return segments.thin(points, BY, "frame_idx", 8)


@query(
    THIN + """, p AS (SELECT user_id, unnest(list_zip(kept[:-2], kept[2:])) AS z FROM k),
s AS (SELECT user_id, z[1] AS a, z[2] AS b FROM p),
m AS (SELECT user_id, a, b, unnest(range(greatest(ceil((b - a) / 20.0)::BIGINT, 1))) AS i FROM s WHERE b - a >= 8),
o AS (SELECT user_id, a + i * 20 AS start_frame, least(a + i * 20 + 20, b) AS end_frame FROM m)
SELECT user_id, start_frame, end_frame, row_number() OVER (PARTITION BY user_id ORDER BY start_frame, end_frame) - 1 AS clip_idx FROM o WHERE end_frame - start_frame >= 8"""
)
def clips_from_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.clips_from_boundaries(_bounded(spark, sf), BY, "boundary", "frame_idx", 8 / 30 + 1e-9, 20 / 30 + 1e-9)
    return out.select("user_id", "start_frame", "end_frame", F.col("clip_idx").cast("long"))


@query(
    RUNS + """, k AS (SELECT *, (n_frames >= 3 OR row_number() OVER (PARTITION BY user_id ORDER BY start_frame) = 1)::INT AS kept FROM s),
g AS (SELECT *, sum(kept) OVER (PARTITION BY user_id ORDER BY start_frame ROWS UNBOUNDED PRECEDING) AS seg FROM k),
h AS (SELECT user_id, min(start_frame) AS a, max(end_frame) AS b FROM g GROUP BY user_id, seg),
m AS (SELECT user_id, a, b, unnest(range(greatest(ceil((b - a) / 6.0)::BIGINT, 1))) AS i FROM h WHERE b - a >= 3),
o AS (SELECT user_id, a + i * 6 AS start_frame, least(a + i * 6 + 6, b) AS end_frame FROM m)
SELECT user_id, start_frame, end_frame FROM o WHERE end_frame - start_frame >= 3"""
)
def split_long(spark: SparkSession, sf: str) -> DataFrame:
    merged = segments.merge_short(run_table(spark, sf), BY, 3)
    return segments.split_long(merged, 3, 6).select("user_id", "start_frame", "end_frame")


def _sliding_sql(short: str) -> str:
    least = {"drop": 33, "pad": 1, "half": 16}[short]
    return f"""WITH {TRACKS}, a AS (SELECT user_id, max(frame_idx) + 1 AS n FROM t GROUP BY user_id),
b AS (SELECT *, CASE WHEN n >= 32 THEN (n - 32) // 16 + 1 ELSE 0 END AS f FROM a),
c AS (SELECT *, f + ((f = 0 OR n > (f - 1) * 16 + 32) AND n - f * 16 >= {least})::INT AS k FROM b),
d AS (SELECT *, unnest(range(k)) AS w FROM c)
SELECT user_id, w::BIGINT AS "window", (w * 16)::BIGINT AS start_frame, (w * 16 + 31)::BIGINT AS end_frame, least(32, n - w * 16)::BIGINT AS n_real FROM d"""


def _sliding(spark: SparkSession, sf: str, short: str) -> DataFrame:
    out = segments.sliding(tracks(spark, sf), BY, "frame_idx", 32, 16, short)
    return out.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("window", "start_frame", "end_frame", "n_real")))


@query(_sliding_sql("half"))
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _sliding(spark, sf, "half")


@query(_sliding_sql("pad"))
def pad_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _sliding(spark, sf, "pad")


@query(_sliding_sql("drop"))
def full_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _sliding(spark, sf, "drop")


@query(
    f"""WITH {TRACKS}, a AS (SELECT user_id, max(frame_idx) + 1 AS n FROM t GROUP BY user_id),
d AS (SELECT user_id, unnest(range((n - 32) // 16 + 1)) AS w FROM a WHERE n >= 32),
g AS (SELECT user_id, w, avg(value / 100) AS c, avg((value > 3)::INT) AS v FROM d JOIN t USING (user_id) WHERE frame_idx BETWEEN w * 16 AND w * 16 + 31 GROUP BY user_id, w)
SELECT user_id, w::BIGINT AS "window", round(c, 9) AS mean_confidence, round(v, 4) AS valid_ratio FROM g WHERE c >= 0.08 AND v >= 0.8"""
)
def window_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = tracks(spark, sf).withColumn("conf", F.col("value") / 100)
    made = segments.window_rows(df, segments.sliding(df, BY, "frame_idx", 32, 16, "drop"), BY)
    g = made.groupBy("user_id", "window").agg(F.avg("conf").alias("c"), F.avg((F.col("value") > 3).cast("double")).alias("v")).where("c >= 0.08 and v >= 0.8")
    return g.select("user_id", F.col("window").cast("long"), F.round("c", 9).alias("mean_confidence"), F.round("v", 4).alias("valid_ratio"))


@query(
    f"""WITH {TRACKS}, a AS (SELECT user_id, list(value ORDER BY frame_idx) AS x FROM t GROUP BY user_id), r AS (SELECT user_id, x, unnest(range(len(x) - 16)) AS i FROM a WHERE len(x) > 16)
SELECT user_id, i::BIGINT AS frame_idx, round(list_sum(x[i + 1:i + 16]), 6) AS input_sum, round(list_sum(x[i + 2:i + 17]), 6) AS target_sum FROM r"""
)
def next_frame_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.next_row_pairs(tracks(spark, sf), BY, IDX, ["value"], 16)
    return out.select("user_id", "frame_idx", *(r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), f"{c}_sum") for c in ("input", "target")))


@query(
    f"""WITH {TRACKS}, o AS (SELECT *, event_id % 5 <> 2 AS ok FROM t), g AS (SELECT *,
  last_value(CASE WHEN ok THEN frame_idx END IGNORE NULLS) OVER p AS ia, last_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER p AS va,
  first_value(CASE WHEN ok THEN frame_idx END IGNORE NULLS) OVER f AS ib, first_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER f AS vb
  FROM o WINDOW p AS (PARTITION BY user_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN ok OR ia IS NULL OR ib IS NULL THEN value
  ELSE va * (1 - (frame_idx - ia)::DOUBLE / (ib - ia)) + vb * ((frame_idx - ia)::DOUBLE / (ib - ia)) END, 6) AS value FROM g"""
)
def gap_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    return windows.fill_gaps(tracks(spark, sf), BY, IDX, "value", F.col("event_id") % 5 != 2).select("user_id", "event_id", r6("value"))


@query(
    f"""WITH {TRACKS}, w AS (SELECT *, min(CASE WHEN value > 60 THEN frame_idx END) OVER p AS lo, max(CASE WHEN value > 60 THEN frame_idx END) OVER p AS hi, count(*) OVER p AS n
  FROM t WINDOW p AS (PARTITION BY user_id))
SELECT user_id, event_id FROM w WHERE lo IS NULL OR n < 3 OR frame_idx BETWEEN lo - 5 AND hi + 5"""
)
def trim_silence(spark: SparkSession, sf: str) -> DataFrame:
    return windows.trim(tracks(spark, sf), BY, IDX, "value", 60.0).select("user_id", "event_id")


@query(
    f"""WITH {TRACKS}, a AS (SELECT user_id, max(frame_idx) AS last FROM t GROUP BY user_id),
g AS (SELECT user_id, last, unnest(range(floor(last / 30.0 * 24)::BIGINT + 1)) AS k FROM a),
s AS (SELECT *, least(floor(k / 24.0 * 30), last)::BIGINT AS lo, k / 24.0::DOUBLE * 30 AS src FROM g)
SELECT s.user_id, k::BIGINT AS frame_idx, round(k / 24.0, 6) AS ts, round(x.value + (coalesce(y.value, x.value) - x.value) * (src - lo), 6) AS value
FROM s JOIN t x ON x.user_id = s.user_id AND x.frame_idx = lo LEFT JOIN t y ON y.user_id = s.user_id AND y.frame_idx = lo + 1"""
)
def resample(spark: SparkSession, sf: str) -> DataFrame:
    df = tracks(spark, sf).drop("ts")
    return windows.resample(df, BY, "frame_idx", 30.0, 24.0, ["value"]).select("user_id", F.col("frame_idx").cast("long"), r6("ts"), r6("value"))


@query(
    f"""WITH {TRACKS}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY frame_idx) AS b FROM t)
SELECT user_id, event_id, event_type FROM l WHERE b IS NULL OR b <> event_type"""
)
def drop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return windows.drop_repeats(tracks(spark, sf), BY, IDX, "event_type").select("user_id", "event_id", "event_type")


@query(
    f"""WITH {TRACKS}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY frame_idx) AS step FROM t),
e AS (SELECT *, count(step) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS k, avg(step) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM d)
SELECT user_id, event_id, round(value + CASE WHEN k >= 2 THEN m ELSE 0 END, 6) AS next_value FROM e"""
)
def predicted_centre(spark: SparkSession, sf: str) -> DataFrame:
    return windows.predicted_centre(tracks(spark, sf), BY, IDX, ["value"]).select("user_id", "event_id", r6("next_value"))


@query(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
d AS (SELECT *, (role <> lag(role) OVER (PARTITION BY conv_id ORDER BY i))::INT AS ch FROM c),
r AS (SELECT *, sum(coalesce(ch, 0)) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM d)
SELECT conv_id, run_id, any_value(role) AS role, count(*) AS n_frames FROM r GROUP BY conv_id, run_id"""
)
def speaker_runs(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "conversations").select("conv_id", "turn", "role")
    out = segments.run_stats(segments.runs(df, ["conv_id"], ["turn"], "role"), ["conv_id"], "role", "turn")
    return out.select("conv_id", F.col("run_id").cast("long"), "role", "n_frames")


_FILTERED = ["user_id", "frame_idx", "value"]


@query()
def butterworth(spark: SparkSession, sf: str) -> DataFrame:
    return smoothing.butterworth_filter(tracks(spark, sf).select(*_FILTERED), BY, IDX, ["value"])


