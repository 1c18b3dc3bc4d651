"""Formulas of one row or one track: detections, angles, matrices, motion rules, feature vectors, on numbers made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.catalog.base import BY, IDX, TRACKS, query, r6, read, tracks
from trackframe.functions import boxes, heatmap, vectors
from trackframe.functions import geometry as g
from trackframe.operators import clips, segments, windows
from trackframe.schema import COCO_PAIRS, MOTION, OKS_SIGMAS

KEYS = ["l_orderkey", "l_linenumber"]
#: Two vectors of an order line, in SQL and here.
PAIR = """p AS (SELECT l_orderkey, l_linenumber, l_partkey % 19 - 9.0::DOUBLE AS ax, l_suppkey % 7 - 3.0::DOUBLE AS ay, l_quantity - 25::DOUBLE AS az,
  l_suppkey % 13 - 6.0::DOUBLE AS bx, l_partkey % 5 - 2.0::DOUBLE AS b2, l_linenumber - 3.5::DOUBLE AS bz FROM lineitem)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    a = g.vec3(F.col("l_partkey") % 19 - 9.0, F.col("l_suppkey") % 7 - 3.0, F.col("l_quantity") - 25)
    b = g.vec3(F.col("l_suppkey") % 13 - 6.0, F.col("l_partkey") % 5 - 2.0, F.col("l_linenumber") - 3.5)
    return _lines(spark, sf).select(*KEYS, a.alias("a"), b.alias("b"))


LENGTHS = "l AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS m, sqrt(bx * bx + b2 * b2 + bz * bz) AS n, ax * bx + ay * b2 + az * bz AS d FROM p)"


@query(
    f"""WITH {PAIR}, {LENGTHS} SELECT l_orderkey, l_linenumber, round(CASE WHEN m >= 1e-8 AND n >= 1e-8 THEN degrees(acos(least(greatest(d / (m * n), -1), 1))) ELSE 0 END, 4) + 0.0 AS angle,
  round(radians(ax * 100) - 2 * pi() * round(radians(ax * 100) / (2 * pi())), 6) + 0.0 AS wrapped, least(greatest(ay, -2.0::DOUBLE), 1.5::DOUBLE) AS clamped FROM l"""
)
def angles(spark: SparkSession, sf: str) -> DataFrame:
    """The angle between two vectors, an angle within half a turn, a value within limits."""
    made = F.round(g.angle_between(F.col("a"), F.col("b")), 4) + F.lit(0.0)
    return _pairs(spark, sf).select(*KEYS, made.alias("angle"), r6(g.wrap_angle(F.radians(F.col("a.x") * 100)), "wrapped"), g.clamp(F.col("a.y"), -2.0, 1.5).alias("clamped"))


@query(
    f"""WITH {PAIR}, u AS (SELECT *, -ax AS ux, -ay AS uy, -az AS uz, bx - 2 * ax AS vx, b2 - 2 * ay AS vy, bz - 2 * az AS vz FROM p),
n AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS m, sqrt(vx * vx + vy * vy + vz * vz) AS n, ux * vx + uy * vy + uz * vz AS d FROM u)
SELECT l_orderkey, l_linenumber, round(CASE WHEN m >= 1e-8 AND n >= 1e-8 THEN degrees(acos(least(greatest(d / (m * n), -1), 1))) ELSE 0 END, 4) + 0.0 AS angle FROM n"""
)
def joint_angles(spark: SparkSession, sf: str) -> DataFrame:
    """The angle at 2a of a limb from a over 2a to b."""
    angle = g.joint_angle(F.col("a"), g.scale(F.col("a"), 2.0), F.col("b"))
    return _pairs(spark, sf).select(*KEYS, (F.round(angle, 4) + F.lit(0.0)).alias("angle"))


@query(
    f"""WITH {PAIR}, {LENGTHS} SELECT l_orderkey, l_linenumber, round(bx / n * m, 5) + 0.0 AS x, round(b2 / n * m, 5) + 0.0 AS y, round(bz / n * m, 5) + 0.0 AS z FROM l"""
)
def rotation_between(spark: SparkSession, sf: str) -> DataFrame:
    """One vector turned by the rotation that takes its direction to another's: it has its own length and the other's direction."""
    turned = _pairs(spark, sf).withColumn("v", g.q_rotate(g.rotation_between(F.col("a"), F.col("b")), F.col("a")))
    return turned.select(*KEYS, *((F.round(F.col("v")[c], 5) + F.lit(0.0)).alias(c) for c in "xyz"))


@query(
    f"""WITH {PAIR} SELECT l_orderkey, l_linenumber, round(ax * (b2 * 4 - bz * 2) - ay * (bx * 4 - bz) + az * (bx * 2 - b2), 6) + 0.0 AS determinant,
  round(ax * ax + ay * bx + az, 6) + 0.0 AS m0, round(ax * ay + ay * b2 + az * 2, 6) + 0.0 AS m1, round(ax * az + ay * bz + az * 4, 6) + 0.0 AS m2, bx AS t1, 1.0::DOUBLE AS t2, az AS t6 FROM p"""
)
def mat3(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix with the rows a, b and (1, 2, 4): its determinant, square and transpose."""
    cells = [F.col("a")[c] for c in "xyz"] + [F.col("b")[c] for c in "xyz"] + [F.lit(1.0), F.lit(2.0), F.lit(4.0)]
    df = _pairs(spark, sf).withColumn("m", F.array(*cells))
    square, turned = g.mat3_mul(F.col("m"), F.col("m")), g.mat3_transpose(F.col("m"))
    return df.select(
        *KEYS, r6(g.mat3_determinant(F.col("m")), "determinant"), *(r6(square[k], f"m{k}") for k in range(3)), turned[1].alias("t1"), turned[2].alias("t2"), turned[6].alias("t6")
    )


@query(
    f"""WITH {PAIR}, {LENGTHS}, h AS (SELECT *, (1 + (l_orderkey + 37 * l_linenumber) % 178)::DOUBLE AS deg FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN m > 0 THEN round(ax / m, 5) + 0.0 ELSE 1 END AS x, CASE WHEN m > 0 THEN round(ay / m, 5) + 0.0 ELSE 0 END AS y,
  CASE WHEN m > 0 THEN round(az / m, 5) + 0.0 ELSE 0 END AS z, CASE WHEN m > 0 THEN deg ELSE 0 END AS degrees FROM h"""
)
def axis_angle(spark: SparkSession, sf: str) -> DataFrame:
    """From axis and angle to a quaternion and back; without an axis that is no turn, about x."""
    deg = (1 + (F.col("l_orderkey") + 37 * F.col("l_linenumber")) % 178).cast("double")
    df = _pairs(spark, sf).withColumn("deg", deg)
    df = df.withColumn("b", g.to_axis_angle(g.from_axis_angle(F.col("a"), F.col("deg"))))
    return df.select(*KEYS, *((F.round(F.col("b.axis")[c], 5) + F.lit(0.0)).alias(c) for c in "xyz"), F.round("b.degrees", 4).alias("degrees"))


SCORES = "(l_partkey % 11) / 10.0 AS s0, (l_suppkey % 7) / 7.0 AS s1, (l_linenumber % 5) / 4.0 AS s2"


@query(
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, {SCORES}, l_quantity * 10 AS cx, l_partkey % 400 AS cy, 20::DOUBLE + l_suppkey % 30 AS w, 40::DOUBLE + l_linenumber AS h FROM lineitem),
b AS (SELECT *, greatest(s0, s1, s2) AS best FROM s), c AS (SELECT *, CASE WHEN s0 = best THEN 0 WHEN s1 = best THEN -1 ELSE 2 END AS class_id FROM b)
SELECT l_orderkey, l_linenumber, class_id::INT AS class_id, round(best, 6) AS conf, round((cx - w / 2) * 1.5, 6) + 0.0 AS x, round((cy - h / 2) * 2, 6) + 0.0 AS y, round(w * 1.5, 6) AS w, round(h * 2, 6) AS h
FROM c WHERE class_id >= 0 AND best >= 0.6"""
)
def decode_detections(spark: SparkSession, sf: str) -> DataFrame:
    """A detector's rows as boxes of known classes, with a confidence of 0.6 or more."""
    c = F.col
    scores = F.array((c("l_partkey") % 11) / 10.0, (c("l_suppkey") % 7) / 7.0, (c("l_linenumber") % 5) / 4.0)
    mapping = boxes.class_mapping(3, {0: 0, 1: -1, 2: 2})
    made = boxes.decode(scores, c("l_quantity") * 10, c("l_partkey") % 400, 20.0 + c("l_suppkey") % 30, 40.0 + c("l_linenumber"), 1.5, 2.0, mapping)
    df = _lines(spark, sf).select(*KEYS, made.alias("d")).where("d is not null and d.conf >= 0.6")
    return df.select(*KEYS, c("d.class_id").cast("int").alias("class_id"), r6("d.conf").alias("conf"), *(r6(c("d.bbox")[k], k) for k in "xywh"))


_OKS_TERMS = ", ".join(
    f"CASE WHEN ((l_partkey + {k}) % 10) / 10.0 >= 0.1 THEN exp(-(power((l_suppkey + {k}) % 5, 2) + power((l_linenumber * {k}) % 4, 2)) / (4 * {s} * {s} * 900.0)) END" for k, s in enumerate(OKS_SIGMAS)
)


@query(
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, [{_OKS_TERMS}] AS t, 0.5 AS iou, (l_linenumber % 3) / 2.0 AS reid FROM lineitem),
o AS (SELECT *, coalesce(list_avg(t), 0) AS oks FROM t)
SELECT l_orderkey, l_linenumber, round(oks, 6) AS oks, round(0.4 * (1 - iou) + 0.3 * (1 - oks) + 0.3 * (1 - reid), 6) + 0.0 AS cost FROM o"""
)
def oks_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Key point similarity of two poses, and the cost of giving one to the other's track."""
    n = F.sequence(F.lit(0), F.lit(len(OKS_SIGMAS) - 1))
    truth = F.transform(n, lambda k: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), ((F.col("l_partkey") + k) % 10 / 10.0).alias("conf")))
    other = F.transform(n, lambda k: F.struct(((F.col("l_suppkey") + k) % 5).cast("double").alias("x"), ((F.col("l_linenumber") * k) % 4).cast("double").alias("y"), F.lit(1.0).alias("conf")))
    df = _lines(spark, sf).select(*KEYS, boxes.oks(truth, other, 900.0).alias("oks"), (F.col("l_linenumber") % 3 / 2.0).alias("reid"))
    return df.select(*KEYS, r6("oks"), r6(boxes.match_cost(F.lit(0.5), F.col("oks"), F.col("reid")), "cost"))


@query(
    """WITH e AS (SELECT vec_id, [x * 4::DOUBLE FOR x IN embedding[1:10]::DOUBLE[]] AS v FROM embeddings), s AS (SELECT vec_id, v, [exp(x - list_max(v)) FOR x IN v] AS e FROM e)
SELECT vec_id, (list_position(v, list_max(v)) - 1)::BIGINT AS best, round(list_max(e) / list_sum(e), 6) AS top, round(e[1] / list_sum(e), 6) AS first, round(e[10] / list_sum(e), 6) AS last FROM s"""
)
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 4).alias("v"))
    df = df.withColumn("p", vectors.softmax(F.col("v")))
    return df.select("vec_id", vectors.argmax(F.col("v")).cast("long").alias("best"), r6(F.array_max("p"), "top"), r6(F.get("p", F.lit(0)), "first"), r6(F.get("p", F.lit(9)), "last"))


@query(
    """WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:6]] AS v FROM embeddings), s AS (SELECT vec_id, v, list_sort(v) AS s FROM e)
SELECT vec_id, round((s[3] + s[4]) / 2, 6) + 0.0 AS middle, round(s[4], 6) + 0.0 AS upper, round(v[5], 6) + 0.0 AS rolled, round(v[6], 6) + 0.0 AS picked, 7::BIGINT AS padded, round(v[3], 6) + 0.0 AS swapped FROM s"""
)
def array_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of six numbers, and what stands where after moving, picking, filling up and reordering."""
    df = read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("v"))
    a = F.col("v")
    return df.select(
        "vec_id",
        r6(vectors.median(a), "middle"),
        r6(vectors.upper_median(a), "upper"),
        r6(F.get(vectors.roll(a, 2), F.lit(0)), "rolled"),
        r6(F.get(vectors.pick(a, 3), F.lit(2)), "picked"),
        F.aggregate(vectors.pad(a, 13, 1.0), F.lit(0), lambda s, x: s + (x == 1.0).cast("int")).cast("long").alias("padded"),
        r6(F.get(vectors.permuted(a, [2, 1, 0]), F.lit(0)), "swapped"),
    )


#: Motion of an event row as rules see it, in SQL and here.
MOVES = """m AS (SELECT user_id, frame_idx, value * 8 AS speed, (event_id % 50) * 5.0 AS vertical, (event_id % 90) * 10.0 - 500 AS accel, (event_id % 37) * 6.0 - 111 AS turn FROM t)"""


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return tracks(spark, sf).select(
        "user_id", "frame_idx", "event_id", (F.col("value") * 8).alias("speed"), ((e % 50) * 5.0).alias("vertical"), ((e % 90) * 10.0 - 500).alias("accel"), ((e % 37) * 6.0 - 111).alias("turn")
    )


@query(
    f"""WITH {TRACKS}, {MOVES} SELECT user_id, frame_idx, (CASE WHEN vertical > 200 THEN {MOTION["Jump"]} WHEN accel < -300 THEN {MOTION["Decelerate"]}
  WHEN abs(turn) > 90 THEN CASE WHEN turn < 0 THEN {MOTION["TurnLeft"]} ELSE {MOTION["TurnRight"]} END
  WHEN speed < 50 THEN {MOTION["Idle"]} WHEN speed < 200 THEN {MOTION["Walk"]} WHEN speed < 500 THEN {MOTION["Jog"]} ELSE {MOTION["Sprint"]} END)::INT AS label FROM m"""
)
def frame_labels(spark: SparkSession, sf: str) -> DataFrame:
    label = segments.frame_label(*(F.col(c) for c in ("speed", "vertical", "accel", "turn")))
    return _moves(spark, sf).select("user_id", "frame_idx", label.cast("int").alias("label"))


@query(
    f"""WITH {TRACKS}, {MOVES}, w AS (SELECT *, speed + 20 AS max_speed, abs(turn) AS aturn, (frame_idx % 40) * 1.0 AS ll, (frame_idx % 17) * 1.0 AS rl, (frame_idx % 45) * 1.0 AS la, (frame_idx % 43) * 1.0 AS ra,
  vertical / 4 AS v4, (frame_idx % 23) * 1.0 AS hr, (frame_idx % 11) * 15.0 AS side FROM m)
SELECT user_id, frame_idx, (CASE WHEN speed < 10 THEN {MOTION["Idle"]} WHEN hr > 15 AND v4 > 30 THEN {MOTION["Jump"]} WHEN side > 100 AND side > 0.6 * speed THEN {MOTION["Slide"]}
  WHEN abs(ll - rl) > 20 AND (ll + rl) / 2 > 25 AND speed > 100 AND hr > 10 THEN {MOTION["Tackle"]} WHEN aturn > 90 AND turn > 0 THEN {MOTION["TurnLeft"]} WHEN aturn > 90 THEN {MOTION["TurnRight"]}
  WHEN accel < -200 AND max_speed > 300 THEN {MOTION["Decelerate"]} WHEN (ll + rl) / 2 > 30 AND speed < 100 AND abs(ll - rl) > 15 THEN {MOTION["Kick"]}
  WHEN (la + ra) / 2 > 25 AND abs(la - ra) < 8 AND (ll + rl) / 2 < 10 AND speed < 80 THEN {MOTION["Shield"]} WHEN (la + ra) / 2 > 20 AND (ll + rl) / 2 < 5 AND speed < 50 THEN {MOTION["Receive"]}
  WHEN (la + ra) / 2 > 35 AND speed < 150 AND (ll + rl) / 2 < 15 THEN {MOTION["Celebrate"]} WHEN la * 2 > 40 AND ra * 2 > 40 AND speed < 100 AND (ll + rl) / 2 > 10 THEN {MOTION["Goalkeeper"]}
  WHEN speed < 120 THEN {MOTION["Walk"]} WHEN speed < 250 THEN {MOTION["Jog"]} ELSE {MOTION["Sprint"]} END)::INT AS label FROM w"""
)
def window_labels(spark: SparkSession, sf: str) -> DataFrame:
    """All fifteen rules of a window's motion type."""
    k = F.col("frame_idx")
    limb = {"left_leg": (k % 40) * 1.0, "right_leg": (k % 17) * 1.0, "left_arm": (k % 45) * 1.0, "right_arm": (k % 43) * 1.0}
    m = limb | {
        "speed": F.col("speed"), "max_speed": F.col("speed") + 20, "turn": F.abs("turn"), "yaw": F.col("turn"), "accel": F.col("accel"), "vertical": F.col("vertical") / 4,
        "lateral": (k % 11) * 15.0, "height_range": (k % 23) * 1.0, "left_arm_rom": limb["left_arm"] * 2, "right_arm_rom": limb["right_arm"] * 2,
    }
    return _moves(spark, sf).select("user_id", "frame_idx", segments.window_label(m).cast("int").alias("label"))


@query(
    f"""WITH {TRACKS}, p AS (SELECT *, sec - lag(sec) OVER w AS gap, value - lag(value) OVER w AS dx, frame_idx > 0 AS later FROM t WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx))
SELECT user_id, frame_idx, round(CASE WHEN later THEN dx / CASE WHEN gap < 1e-6 THEN 1 / 30.0 ELSE gap END ELSE 0 END, 6) + 0.0 AS vx,
  round(CASE WHEN later THEN 2 / CASE WHEN gap < 1e-6 THEN 1 / 30.0 ELSE gap END ELSE 0 END, 6) + 0.0 AS vz FROM p"""
)
def root_velocity(spark: SparkSession, sf: str) -> DataFrame:
    """Velocity of a root by its time stamps."""
    df = tracks(spark, sf).withColumn("root_pos", g.vec3(F.col("value"), F.lit(90.0), F.col("frame_idx") * 2.0)).withColumn("ts", F.col("sec"))
    out = windows.root_velocity(df, BY, IDX)
    return out.select("user_id", "frame_idx", r6("root_vel.x").alias("vx"), r6("root_vel.z").alias("vz"))


@query(
    f"""WITH {TRACKS}, s AS (SELECT user_id, frame_idx, value, frame_idx * 0.01 AS o, unnest([0.5, 1.0, 1.5])::DOUBLE AS dt FROM t)
SELECT user_id, frame_idx, dt, round(10 + (value * cos(o * dt) - 3 * sin(o * dt)) * dt, 6) + 0.0 AS x, round(20 + (value * sin(o * dt) + 3 * cos(o * dt)) * dt, 6) + 0.0 AS z, round(0.25 + o * dt, 6) AS facing FROM s"""
)
def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """Places and headings half a second, one and one and a half ahead."""
    made = windows.predict_trajectory(g.vec3(10, 0, 20), g.vec3(F.col("value"), 0.0, 3.0), F.lit(0.25), F.col("frame_idx") * 0.01)
    df = tracks(spark, sf).select("user_id", "frame_idx", F.explode(made).alias("p"))
    return df.select("user_id", "frame_idx", "p.dt", r6("p.pos.x").alias("x"), r6("p.pos.z").alias("z"), r6("p.facing").alias("facing"))


@query(
    f"""WITH {TRACKS}, w AS (SELECT user_id, frame_idx AS s, value AS v FROM t WHERE frame_idx % 4 = 0), c AS (
  SELECT user_id, s + k AS frame_idx, j, v / 10 * (j + 1) - k * j / 7.0 AS x FROM w, range(6) a(k), range(3) b(j)
), m AS (SELECT user_id, frame_idx, j, avg(x) AS x FROM c GROUP BY user_id, frame_idx, j), e AS (
  SELECT user_id, frame_idx, list(exp(x) ORDER BY j) AS e FROM m GROUP BY user_id, frame_idx
)
SELECT user_id, frame_idx::BIGINT AS frame_idx, (list_position(e, list_max(e)) - 1)::INT AS label, round(list_max(e) / list_sum(e), 6) AS confidence FROM e"""
)
def vote_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes over windows of six rows that overlap by two: mean logits, then softmax."""
    logits = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: F.col("value") / 10 * (j + 1) - k * j / 7.0))
    rows = tracks(spark, sf).where("frame_idx % 4 = 0").select("user_id", "frame_idx", logits.alias("logits")).withColumnRenamed("frame_idx", "start")
    out = segments.vote(rows, BY, "start", "logits")
    return out.select("user_id", F.col("frame_idx").cast("long"), "label", r6("confidence"))


_JOINTS = 22


def _joints() -> Column:
    """Joints of a row whose angles and places follow from its number, value and the joint's."""
    n = F.sequence(F.lit(0), F.lit(_JOINTS - 1))
    at = lambda j: (F.col("frame_idx") * (j + 1)) % 90
    return F.transform(
        n,
        lambda j: F.struct(
            g.vec3(at(j).cast("double"), (at(j) / 2).cast("double"), F.lit(0.0)).alias("euler"),
            g.vec3(F.col("value"), (j * 1.0).cast("double"), F.col("frame_idx").cast("double")).alias("pos"),
        ),
    )


@query(
    f"""WITH {TRACKS}, f AS (SELECT user_id, frame_idx, value, [((frame_idx * (j + 1)) % 90)::DOUBLE FOR j IN range(22)] AS a FROM t),
l AS (SELECT *, lag(a) OVER (PARTITION BY user_id ORDER BY frame_idx) AS b FROM f)
SELECT user_id, frame_idx, 70::BIGINT AS n, 140::BIGINT AS extended, round(a[3] / 180, 6) AS ex, round(a[22] / 360, 6) AS ey, round(value / 800, 8) AS vx, round(5 / 360.0, 6) AS turn,
  round(coalesce(a[3] - b[3], 0) / 180, 6) + 0.0 AS change, 132::BIGINT AS flat, 21.0::DOUBLE AS last_y FROM l"""
)
def feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """70 numbers of a row, 140 with their changes, and joint places as 132."""
    df = tracks(spark, sf).withColumn("joints", _joints())
    df = df.withColumn("f", clips.frame_features(F.col("joints"), g.vec3(F.col("value"), 0.0, 0.0), g.vec3(0.0, 3.0, 4.0)))
    df = clips.with_deltas(df, BY, IDX, "f").withColumn("p", clips.flat_positions(F.col("joints"), wide=True))
    at = lambda c, k: F.get(c, F.lit(k))
    return df.select(
        "user_id", "frame_idx", F.size("f").cast("long").alias("n"), F.size("extended").cast("long").alias("extended"), r6(at("f", 6), "ex"), r6(at("f", 64), "ey"), F.round(at("f", 66), 8).alias("vx"), r6(at("f", 69), "turn"),
        r6(at("extended", 76), "change"), F.size("p").cast("long").alias("flat"), at("p", 64).alias("last_y"),
    )


@query(
    f"""WITH {TRACKS}, c AS (SELECT user_id, frame_idx, unnest(range(6, 10)) AS j, value FROM t), a AS (SELECT user_id, frame_idx, j, (frame_idx * (j + 1)) % 90 AS e FROM c),
l AS (SELECT *, lag(e) OVER (PARTITION BY user_id, j ORDER BY frame_idx) AS b FROM a), s AS (SELECT user_id, frame_idx, avg(sqrt(power(e - b, 2) + power((e - b) / 2.0, 2))) AS activity FROM l GROUP BY user_id, frame_idx),
r AS (SELECT user_id, sum(span) * 1.5 / 4 AS rom FROM (SELECT user_id, j, max(e) - min(e) AS span FROM a GROUP BY user_id, j) GROUP BY user_id)
SELECT user_id, round(avg(activity), 6) AS activity, round(any_value(rom), 6) AS rom FROM s JOIN r USING (user_id) GROUP BY user_id"""
)
def body_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Mean activity and range of motion of the left arm."""
    df = tracks(spark, sf).withColumn("joints", _joints())
    part = {"left_arm": clips.PARTS["left_arm"]}
    active = clips.part_activity(df, BY, IDX, part).groupBy(*BY).agg(r6(F.avg("left_arm"), "activity"))
    return active.join(clips.part_range(df, BY, part), BY).select("user_id", "activity", r6("left_arm_rom").alias("rom"))


@query(
    """SELECT vec_id, 78::BIGINT AS n, round(embedding[1]::DOUBLE, 6) + 0.0 AS vx, round(label::DOUBLE, 6) AS action, round(embedding[2]::DOUBLE, 6) + 0.0 AS style0, round(embedding[40]::DOUBLE, 6) + 0.0 AS style38, 0.0::DOUBLE AS last FROM embeddings"""
)
def condition_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A motion condition as 78 numbers."""
    x = lambda k: F.get("embedding", F.lit(k)).cast("double")
    names = ("speed", "direction", "target_direction", "ball_distance", "fatigue")
    style = F.transform(F.slice("embedding", 2, 63), lambda e: e.cast("double")).alias("style")
    c = F.struct(g.vec3(x(0), 0.0, 0.0).alias("velocity"), *(F.lit(0.5).alias(n) for n in names), g.vec3(0, 0, 0).alias("ball"), F.col("label").alias("action"), F.lit(1).alias("archetype"), style)
    df = read(spark, sf, "embeddings").select("vec_id", c.alias("c")).withColumn("v", clips.condition_vector(F.col("c")))
    at = lambda k: F.get("v", F.lit(k))
    return df.select("vec_id", F.size("v").cast("long").alias("n"), r6(at(0), "vx"), r6(at(10), "action"), r6(at(13), "style0"), r6(at(51), "style38"), at(77).alias("last"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT *, list_max(v) AS top, list_position(v, list_max(v)) AS p FROM e),
c AS (SELECT *, (p - 1) % 8 AS x, (p - 1) // 8 AS y, coalesce(v[p - 1], 0) AS l, coalesce(v[p + 1], 0) AS r, coalesce(v[greatest(p - 8, 0)], 0) AS u, coalesce(v[p + 8], 0) AS d FROM t)
SELECT vec_id, round(top, 6) AS conf, round(x + CASE WHEN x BETWEEN 1 AND 6 AND abs(2 * top - l - r) > 1e-6 THEN least(greatest((r - l) / (2 * (2 * top - l - r)), -0.5), 0.5) ELSE 0 END, 6) + 0.0 AS x,
  round(y + CASE WHEN y BETWEEN 1 AND 6 AND abs(2 * top - u - d) > 1e-6 THEN least(greatest((d - u) / (2 * (2 * top - u - d)), -0.5), 0.5) ELSE 0 END, 6) + 0.0 AS y FROM c"""
)
def heatmap_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of 64 as maps of 8 by 8: the peak between their cells."""
    df = read(spark, sf, "embeddings").select("vec_id", heatmap.peak(F.transform("embedding", lambda x: x.cast("double")), 8).alias("p"))
    return df.select("vec_id", *(r6(F.col("p")[c], c) for c in ("conf", "x", "y")))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 2100 - 60 + (20 + l_suppkey % 90) / 2.0::DOUBLE AS cx, l_quantity * 24 - 40 + (30 + l_linenumber * 20) / 2.0::DOUBLE AS cy,
  (20 + l_suppkey % 90) * 1.4::DOUBLE AS w, (30 + l_linenumber * 20) * 1.4::DOUBLE AS h FROM lineitem),
g AS (SELECT *, CASE WHEN w / h > 0.75 THEN w ELSE h * 0.75::DOUBLE END AS gw, CASE WHEN w / h > 0.75 THEN w / 0.75::DOUBLE ELSE h END AS gh FROM b),
c AS (SELECT l_orderkey, l_linenumber, greatest(trunc(cx - gw / 2)::INT, 0) AS x1, greatest(trunc(cy - gh / 2)::INT, 0) AS y1, least(trunc(cx + gw / 2)::INT, 1920) AS x2, least(trunc(cy + gh / 2)::INT, 1080) AS y2 FROM g)
SELECT *, round((x1 + 6.37::DOUBLE * (x2 - x1) / 48) / 1920, 6) AS px, round((y1 + 60.11::DOUBLE * (y2 - y1) / 64) / 1080, 6) AS py FROM c WHERE x2 > x1 AND y2 > y1"""
)
def crop_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows around boxes, some of them outside the frame, and a peak of each window's map in the frame."""
    c = F.col
    box = boxes.box(c("l_partkey") % 2100 - 60.0, c("l_quantity") * 24 - 40, 20.0 + c("l_suppkey") % 90, 30.0 + c("l_linenumber") * 20)
    df = _lines(spark, sf).select(*KEYS, heatmap.crop_window(box, 1920, 1080).alias("w")).where("w is not null")
    peak = F.struct(F.lit(6.37).alias("x"), F.lit(60.11).alias("y"), F.lit(1.0).alias("conf"))
    df = df.withColumn("p", heatmap.to_frame(peak, c("w"), 48, 64, 1920, 1080))
    return df.select(*KEYS, "w.x1", "w.y1", "w.x2", "w.y2", r6("p.x").alias("px"), r6("p.y").alias("py"))


_FLIPPED = list(range(17))
for _a, _b in COCO_PAIRS:
    _FLIPPED[_a], _FLIPPED[_b] = _b, _a


@query(
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), o AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {j})" for k, j in enumerate(_FLIPPED))
    + """) AS o(k, j))
SELECT vec_id, k::BIGINT AS point, round((v[k + 1] + 1 - v[j + 18]) / 2, 6) + 0.0 AS x, round((v[k + 2] + v[j + 19]) / 2, 6) + 0.0 AS y, 0.75::DOUBLE AS conf FROM e, o"""
)
def flip_average(spark: SparkSession, sf: str) -> DataFrame:
    """Key points of an image and of its mirror image, averaged."""
    n = F.sequence(F.lit(0), F.lit(16))
    x = lambda k: F.get("embedding", k).cast("double")
    points = lambda shift, conf: F.transform(n, lambda k: F.struct(x(k + shift).alias("x"), x(k + shift + 1).alias("y"), F.lit(conf).alias("conf")))
    df = read(spark, sf, "embeddings").select("vec_id", points(0, 1.0).alias("a"), points(17, 0.5).alias("b"))
    df = df.select("vec_id", F.posexplode(heatmap.averaged(F.col("a"), heatmap.mirrored(F.col("b"), 17, COCO_PAIRS))).alias("point", "p"))
    return df.select("vec_id", F.col("point").cast("long"), r6("p.x").alias("x"), r6("p.y").alias("y"), "p.conf")
