"""Rotations, kinematics and noise schedules, on angles made from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.catalog.base import query, r6, read
from trackframe.functions import geometry as g
from trackframe.functions import noise
from trackframe.operators import skeleton
from trackframe.schema import COCO_COUNT, JOINT_COUNT, JOINT_PARENT, REST_OFFSETS

KEYS = ["l_orderkey", "l_linenumber"]

#: Angles of an order line in degrees, in SQL and here; the middle one stays within a quarter turn.
ANGLES = "a AS (SELECT l_orderkey, l_linenumber, l_partkey % 360 - 180.0 AS ex, l_suppkey % 170 - 85.0 AS ey, l_quantity * 7 - 175 AS ez FROM lineitem)"
HALF = "h AS (SELECT *, cos(radians(ex) / 2) AS cx, sin(radians(ex) / 2) AS sx, cos(radians(ey) / 2) AS cy, sin(radians(ey) / 2) AS sy, cos(radians(ez) / 2) AS cz, sin(radians(ez) / 2) AS sz FROM a)"
QUAT = f"""{ANGLES}, {HALF}, q AS (SELECT l_orderkey, l_linenumber, ex, ey, ez, cx * cy * cz + sx * sy * sz AS w, sx * cy * cz - cx * sy * sz AS x,
  cx * sy * cz + sx * cy * sz AS y, cx * cy * sz - sx * sy * cz AS z FROM h)"""


def _angles(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "lineitem")
    e = g.vec3(F.col("l_partkey") % 360 - 180.0, F.col("l_suppkey") % 170 - 85.0, F.col("l_quantity") * 7 - 175)
    return df.select(*KEYS, e.alias("e"))


def _quats(spark: SparkSession, sf: str) -> DataFrame:
    return _angles(spark, sf).withColumn("q", g.euler_to_quat(F.col("e")))


@query(f"WITH {QUAT} SELECT l_orderkey, l_linenumber, round(w, 6) + 0.0 AS w, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM q")
def euler_to_quat(spark: SparkSession, sf: str) -> DataFrame:
    return _quats(spark, sf).select(*KEYS, *(r6(F.col("q")[c], c) for c in "wxyz"))


def _whole_turns(c: str) -> str:
    return f"CASE WHEN {c} <= -180 THEN {c} + 360 ELSE {c} END AS {c}"


@query(
    f"""WITH {QUAT}, b AS (SELECT l_orderkey, l_linenumber, round(degrees(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), 4) + 0.0 AS x,
  round(degrees(asin(least(greatest(2 * (w * y - z * x), -1), 1))), 4) + 0.0 AS y, round(degrees(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))), 4) + 0.0 AS z FROM q)
SELECT l_orderkey, l_linenumber, {_whole_turns("x")}, y, {_whole_turns("z")} FROM b"""
)
def quat_roundtrip_all(spark: SparkSession, sf: str) -> DataFrame:
    """Angles to a quaternion and back, with half a turn as 180 degrees whichever way it went."""
    back = _quats(spark, sf).withColumn("b", g.quat_to_euler(F.col("q")))
    out = back.select(*KEYS, *((F.round(F.col("b")[c], 4) + F.lit(0.0)).alias(c) for c in "xyz"))
    return out.selectExpr(*KEYS, _whole_turns("x"), "y", _whole_turns("z"))


@query(
    f"""WITH {QUAT} SELECT l_orderkey, l_linenumber, round(1 - 2 * (y * y + z * z), 6) + 0.0 AS r0, round(2 * (x * y + w * z), 6) + 0.0 AS r1, round(2 * (x * z - w * y), 6) + 0.0 AS r2,
  round(2 * (x * y - w * z), 6) + 0.0 AS r3, round(1 - 2 * (x * x + z * z), 6) + 0.0 AS r4, round(2 * (y * z + w * x), 6) + 0.0 AS r5 FROM q"""
)
def rot6d(spark: SparkSession, sf: str) -> DataFrame:
    six = _quats(spark, sf).withColumn("r", g.quat_to_rot6d(F.col("q")))
    return six.select(*KEYS, *(r6(F.get("r", F.lit(k)), f"r{k}") for k in range(6)))


#: The sign that makes the first number of a quaternion positive which is not zero: both signs are one rotation.
SIGN = "CASE WHEN abs(w) > 1e-5 THEN sign(w) WHEN abs(x) > 1e-5 THEN sign(x) WHEN abs(y) > 1e-5 THEN sign(y) ELSE sign(z) END"


@query(
    f"""WITH {QUAT}, s AS (SELECT *, {SIGN} AS s FROM q)
SELECT l_orderkey, l_linenumber, round(w * s, 6) + 0.0 AS w, round(x * s, 6) + 0.0 AS x, round(y * s, 6) + 0.0 AS y, round(z * s, 6) + 0.0 AS z FROM s"""
)
def rot6d_roundtrip_all(spark: SparkSession, sf: str) -> DataFrame:
    """Six numbers back to the same rotation, half turns included."""
    df = _quats(spark, sf).withColumn("b", g.rot6d_to_quat(g.quat_to_rot6d(F.col("q")))).select(*KEYS, "b.*")
    return df.withColumn("s", F.expr(SIGN)).select(*KEYS, *(r6(F.col(c) * F.col("s"), c) for c in "wxyz"))


@query(
    f"""WITH {QUAT} SELECT l_orderkey, l_linenumber, round(10 * (1 - 2 * (y * y + z * z)) + 20 * 2 * (x * y - w * z) + 30 * 2 * (x * z + w * y), 6) + 0.0 AS x,
  round(10 * 2 * (x * y + w * z) + 20 * (1 - 2 * (x * x + z * z)) + 30 * 2 * (y * z - w * x), 6) + 0.0 AS y,
  round(10 * 2 * (x * z - w * y) + 20 * 2 * (y * z + w * x) + 30 * (1 - 2 * (x * x + y * y)), 6) + 0.0 AS z FROM q"""
)
def rotate_vector(spark: SparkSession, sf: str) -> DataFrame:
    df = _quats(spark, sf).withColumn("v", g.q_rotate(F.col("q"), g.vec3(10, 20, 30)))
    return df.select(*KEYS, *(r6(F.col("v")[c], c) for c in "xyz"))


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, radians(l_partkey % 300 - 150.0) AS t, 0.25 AS k FROM lineitem), s AS (SELECT *, t * k AS u FROM a)
SELECT l_orderkey, l_linenumber, round(cos(u / 2), 5) AS w, round(sin(u / 2), 5) + 0.0 AS y FROM s"""
)
def quat_slerp(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the way from no turn to a turn about the vertical axis."""
    turn = g.from_axis_angle(g.vec3(0, 1, 0), F.col("l_partkey") % 300 - 150.0)
    df = read(spark, sf, "lineitem").select(*KEYS, g.slerp(g.identity(), turn, 0.25).alias("q"))
    return df.select(*KEYS, F.round("q.w", 5).alias("w"), (F.round("q.y", 5) + F.lit(0.0)).alias("y"))


def _rest() -> list[tuple[float, float, float]]:
    out: list[tuple[float, float, float]] = []
    for j, p in enumerate(JOINT_PARENT):
        base = out[p] if p >= 0 else (0.0, 0.0, 0.0)
        out.append(tuple(float(a) + b for a, b in zip(REST_OFFSETS[j], base)) if p >= 0 else (0.0, 0.0, 0.0))
    return out


def _turned(orders: DataFrame) -> DataFrame:
    turn = g.from_axis_angle(g.vec3(0, 1, 0), (F.col("o_custkey") % 360).cast("double"))
    df = orders.select("o_orderkey", turn.alias("q"))
    still = F.array_repeat(g.identity(), JOINT_COUNT)
    places = skeleton.fk_column(g.vec3(1, 90, 2), F.col("q"), still)
    out = df.select("o_orderkey", F.posexplode(places).alias("joint", "p"))
    return out.select("o_orderkey", F.col("joint").cast("long"), *(r6(F.col("p")[c], c) for c in "xyz"))


@query(
    "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(_rest())) + """) AS r(joint, x, y, z)),
a AS (SELECT o_orderkey, radians(o_custkey % 360) AS t FROM orders)
SELECT o_orderkey, joint::BIGINT AS joint, round(x * cos(t) + z * sin(t) + 1, 6) + 0.0 AS x, round(y + 90, 6)::DOUBLE AS y, round(z * cos(t) - x * sin(t) + 2, 6) + 0.0 AS z FROM a, r"""
)
def fk_chain_all(spark: SparkSession, sf: str) -> DataFrame:
    """Joint places of a skeleton in rest pose that is turned about the vertical axis, one turn for each order."""
    return _turned(read(spark, sf, "orders"))


@query(
    f"""WITH {ANGLES} SELECT l_orderkey, l_linenumber, least(greatest(ex, 0), 150)::DOUBLE AS x, least(greatest(ey, -10), 10)::DOUBLE AS y, least(greatest(ez, -90), 90)::DOUBLE AS z FROM a"""
)
def joint_limits(spark: SparkSession, sf: str) -> DataFrame:
    df = _angles(spark, sf).withColumn("c", skeleton.clamp_euler(F.col("e"), "LeftForeArm"))
    return df.select(*KEYS, *(F.col("c")[a].alias(a) for a in "xyz"))


@query(
    """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), k AS (SELECT vec_id, e, abs((e[6] + e[7]) / 2 - (e[12] + e[13]) / 2) AS torso, (e[12] + e[13]) / 2 AS hip FROM p),
s AS (SELECT *, 50 / CASE WHEN torso < 1e-4 THEN 0.3 ELSE torso END AS f FROM k)
SELECT vec_id, unnest(range(17))::BIGINT AS point, round(unnest(list_transform(e[1:17], lambda y: -(y - hip) * f)), 4) + 0.0 AS y,
  round(unnest(list_transform(e[1:17], lambda y: (y - hip) * f * 0.1)), 4) + 0.0 AS z FROM s"""
)
def lift_keypoints(spark: SparkSession, sf: str) -> DataFrame:
    """Key points whose heights are numbers of a vector, lifted to three dimensions."""
    e = F.col("embedding").cast("array<double>")
    kp = F.transform(F.slice(e, 1, COCO_COUNT), lambda y: F.struct(F.lit(0.5).alias("x"), y.alias("y"), F.lit(1.0).alias("conf")))
    out = read(spark, sf, "embeddings").select("vec_id", F.posexplode(skeleton.lift(kp)).alias("point", "p"))
    return out.select("vec_id", F.col("point").cast("long"), (F.round("p.y", 4) + F.lit(0.0)).alias("y"), (F.round("p.z", 4) + F.lit(0.0)).alias("z"))


@query(
    """WITH b AS (SELECT t, 0.0001::DOUBLE + (0.02::DOUBLE - 0.0001::DOUBLE) * t / 999 AS beta FROM range(1000) r(t)),
c AS (SELECT *, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS ab FROM b)
SELECT t::BIGINT AS t, round(beta, 6) AS beta, round(ab, 6) AS alpha_bar, round(sqrt(ab), 6) AS sqrt_alpha_bar, round(10 * log10(ab / (1 - ab)), 4) AS snr_db FROM c"""
)
def noise_schedule(spark: SparkSession, sf: str) -> DataFrame:
    df = noise.schedule(spark)
    return df.select(F.col("t").cast("long"), r6("beta"), r6("alpha_bar"), r6("sqrt_alpha_bar"), F.round("snr_db", 4).alias("snr_db"))


@query("SELECT i::BIGINT AS pos, least(floor((49 - i) * (1000 / 50.0))::BIGINT, 999) AS t FROM range(50) r(i)")
def ddim_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return noise.ddim_schedule(spark, 50).select(F.col("pos").cast("long"), F.col("t").cast("long"))


@query(
    """WITH s AS (SELECT DISTINCT least(floor(power(i / 50.0, 2) * 1000)::BIGINT, 999) AS t FROM range(50) r(i))
SELECT row_number() OVER (ORDER BY t DESC) - 1 AS pos, t FROM s"""
)
def ddim_schedule_quadratic(spark: SparkSession, sf: str) -> DataFrame:
    return noise.ddim_schedule(spark, 50, quadratic=True).select(F.col("pos").cast("long"), F.col("t").cast("long"))


@query(
    """SELECT vec_id, unnest(range(64))::BIGINT AS dim, round(unnest(list_transform(embedding::DOUBLE[], lambda x: sqrt(0.7::DOUBLE) * x + sqrt(1 - 0.7::DOUBLE) * 0.5)), 6) + 0.0 AS x FROM embeddings"""
)
def add_noise(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "embeddings")
    noisy = noise.add_noise(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.5), 64), F.lit(0.7))
    out = df.select("vec_id", F.posexplode(noisy).alias("dim", "x"))
    return out.select("vec_id", F.col("dim").cast("long"), r6("x"))


@query("SELECT vec_id, unnest(range(64))::BIGINT AS dim, round(unnest(embedding::DOUBLE[]), 6) + 0.0 AS x FROM embeddings")
def noise_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """What was there before noise was added, from the noise."""
    e, n, a = F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.5), 64), F.lit(0.7)
    back = noise.predict_start(noise.add_noise(e, n, a), n, a)
    out = read(spark, sf, "embeddings").select("vec_id", F.posexplode(back).alias("dim", "x"))
    return out.select("vec_id", F.col("dim").cast("long"), r6("x"))
