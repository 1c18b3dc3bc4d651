"""Clips: metadata, quality, fingerprints, features, mirroring, concatenation.

Frame tables have a row per (clip, frame) with structs for the root and an array of joints; see ``schema.FRAMES``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as g
from trackframe.functions import vectors as v
from trackframe.operators.smoothing import upper_median_of
from trackframe.operators.windows import Names, over, whole
from trackframe.schema import JOINT, JOINT_COUNT, JOINT_PARENT, MAX_TURN_RATE, MIRRORED, MOTION, SPRINT_SPEED

#: The limbs whose lengths must hold still.
LIMBS = tuple(
    (JOINT[a], JOINT[b])
    for side in ("Left", "Right")
    for a, b in (
        (f"{side}Arm", f"{side}ForeArm"),
        (f"{side}ForeArm", f"{side}Hand"),
        (f"{side}UpLeg", f"{side}Leg"),
        (f"{side}Leg", f"{side}Foot"),
    )
)


def joint(name: str, joints: str = "joints") -> Column:
    return F.get(F.col(joints), F.lit(JOINT[name]))


def duration(n: Column, fps: float | Column = 30.0) -> Column:
    """Seconds from the first frame to the last."""
    return F.when(n > 0, (n - 1) / fps).otherwise(0.0)


def metadata(frames: DataFrame, by: Names, vel: Names, fps: float = 30.0, idx: str = "frame_idx") -> DataFrame:
    """Per clip: frames, duration, first and last frame, mean and greatest speed, mean velocity."""
    speed = F.sqrt(sum((F.col(c) * F.col(c) for c in vel), F.lit(0.0)))
    out = frames.withColumn("_s", speed).groupBy(*by).agg(
        F.count("*").alias("n_frames"),
        F.min(idx).alias("start_frame"),
        F.max(idx).alias("end_frame"),
        F.avg("_s").alias("avg_velocity"),
        F.max("_s").alias("max_velocity"),
        *(F.avg(c).alias(f"avg_{c}") for c in vel),
    )
    return out.withColumn("duration_sec", duration(F.col("n_frames"), fps))


@dataclass(frozen=True)
class QualityLimits:
    min_duration: float = 0.5
    min_confidence: float = 0.3
    max_jitter: float = 50.0
    limb_tolerance: float = 0.3
    max_missing: int = 5
    missing_below: float = 0.1


def jitter(rows: DataFrame, by: Names, order: Names, x: str, y: str, z: str, out: str = "jitter") -> DataFrame:
    """How far a point is from the middle of its neighbours in time; null at the ends."""
    w = over(by, order)
    off = [F.col(c) - (F.lag(c).over(w) + F.lead(c).over(w)) / 2 for c in (x, y, z)]
    return rows.withColumn(out, F.sqrt(sum((d * d for d in off), F.lit(0.0))))


def longest_run(rows: DataFrame, by: Names, order: Names, flag: str, out: str = "longest_run") -> DataFrame:
    """Per track: the most rows in a row where ``flag`` holds."""
    w = over(by, order)
    count = F.row_number().over(w)
    kept = rows.withColumn("_all", count).where(F.coalesce(F.col(flag), F.lit(False)))
    kept = kept.withColumn("_g", F.col("_all") - F.row_number().over(w))
    longest = kept.groupBy(*by, "_g").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max("_n").alias(out))
    return rows.select(*by).distinct().join(longest, [*by], "left").fillna(0, [out])


def limb_consistency(lengths: DataFrame, by: Names, limb: str, length: str) -> DataFrame:
    """Per track: 1 less the greatest relative deviation from a limb's upper median, over the worst limb; 1 without measures.

    Lengths up to 0.1 are no measures, and a limb needs two.
    """
    seen = lengths.where(F.col(length) > 0.1)
    middle = seen.groupBy(*by, limb).agg(upper_median_of(length).alias("_m"), F.count("*").alias("_n")).where("_n >= 2 and _m >= 0.1")
    worst = seen.join(middle, [*by, limb]).groupBy(*by).agg(F.max(F.abs(F.col(length) - F.col("_m")) / F.col("_m")).alias("_d"))
    out = lengths.select(*by).distinct().join(worst, [*by], "left")
    return out.select(*by, F.greatest(1 - F.coalesce("_d", F.lit(0.0)), F.lit(0.0)).alias("limb_consistency"))


def limb_lengths(frames: DataFrame, by: Names, joints: str = "joints") -> DataFrame:
    """A row for each frame and limb: limb, length."""
    each = [
        F.struct(F.lit(k).alias("limb"), g.length(g.sub(F.get(F.col(joints), F.lit(b))["pos"], F.get(F.col(joints), F.lit(a))["pos"])).alias("length"))
        for k, (a, b) in enumerate(LIMBS)
    ]
    return frames.select(*by, F.explode(F.array(*each)).alias("_l")).select(*by, "_l.limb", "_l.length")


def bone_medians(frames: DataFrame, by: Names, joints: str = "joints") -> DataFrame:
    """Upper median distance of each joint from its parent, over frames where it is above 0: joint, length."""
    each = [
        F.struct(F.lit(k).alias("joint"), g.length(g.sub(F.get(F.col(joints), F.lit(k))["pos"], F.get(F.col(joints), F.lit(p))["pos"])).alias("length"))
        for k, p in enumerate(JOINT_PARENT)
        if p >= 0
    ]
    rows = frames.select(*by, F.explode(F.array(*each)).alias("_l")).select(*by, "_l.joint", "_l.length").where("length > 0")
    return rows.groupBy(*by, "joint").agg(upper_median_of("length").alias("length"))


def judge(df: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Reasons against each clip, whether it is accepted, and a score from 0 to 1.

    Needs duration_sec, avg_confidence, max_jitter, limb_consistency and missing_frames. Reasons are structs (reason, value, threshold).
    """
    c = limits
    checks = [
        ("TooShort", "duration_sec", c.min_duration, F.col("duration_sec") < c.min_duration),
        ("LowConfidence", "avg_confidence", c.min_confidence, F.col("avg_confidence") < c.min_confidence),
        ("ExcessiveJitter", "max_jitter", c.max_jitter, F.col("max_jitter") > c.max_jitter),
        ("InconsistentLimbs", "limb_consistency", 1 - c.limb_tolerance, F.col("limb_consistency") < 1 - c.limb_tolerance),
        ("MissingJoints", "missing_frames", float(c.max_missing), F.col("missing_frames") > c.max_missing),
    ]
    reasons = [
        F.when(failed, F.struct(F.lit(name).alias("reason"), F.col(value).cast("double").alias("value"), F.lit(limit).alias("threshold")))
        for name, value, limit, failed in checks
    ]
    score = (
        0.30 * F.col("avg_confidence")
        + 0.25 * F.greatest(1 - F.col("max_jitter") / c.max_jitter, F.lit(0.0))
        + 0.25 * F.col("limb_consistency")
        + 0.20 * (1 - F.col("missing_frames") / float(max(1, 2 * c.max_missing)))
    )
    out = df.withColumn("rejections", F.array_compact(F.array(*reasons)))
    return out.withColumn("accepted", F.size("rejections") == 0).withColumn("overall_score", g.clamp(score, 0, 1))


def quality(frames: DataFrame, by: Names, limits: QualityLimits = QualityLimits(), fps: float = 30.0, idx: str = "frame_idx", joints: str = "joints") -> DataFrame:
    """Measures and judgement of each clip from its joint confidences and positions."""
    conf = F.transform(joints, lambda j: j["conf"])
    missing = F.exists(conf, lambda c: c < limits.missing_below)
    points = frames.select(*by, idx, F.posexplode(joints).alias("joint", "_j"))
    points = points.select(*by, idx, "joint", *(F.col(f"_j.pos.{a}").alias(a) for a in "xyz"), F.col("_j.conf").alias("conf"))
    moved = jitter(points, [*by, "joint"], [idx], "x", "y", "z")
    base = moved.groupBy(*by).agg(
        F.avg("conf").alias("avg_confidence"),
        F.coalesce(F.max("jitter"), F.lit(0.0)).alias("max_jitter"),
        (F.count("*") / JOINT_COUNT).cast("long").alias("n_frames"),
    )
    gaps = longest_run(frames.withColumn("_miss", missing), by, [idx], "_miss", "missing_frames")
    limbs = limb_consistency(limb_lengths(frames, by, joints), by, "limb", "length")
    out = base.join(gaps, [*by]).join(limbs, [*by]).withColumn("duration_sec", duration(F.col("n_frames"), fps))
    return judge(out, limits)


def partition_accepted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return judged.where("accepted"), judged.where("not accepted")


def smoothness(points: DataFrame, by: Names, point: Names, order: Names, cols: Names) -> DataFrame:
    """exp(-0.01 * mean second difference) per track, over all points: 1 is smooth; 0 with under three rows."""
    w = over([*by, *point], order)
    second = [F.col(c) - 2 * F.lag(c).over(w) + F.lag(c, 2).over(w) for c in cols]
    made = points.withColumn("_a", F.sqrt(sum((d * d for d in second), F.lit(0.0))))
    return made.groupBy(*by).agg(F.coalesce(g.clamp(F.exp(-0.01 * F.avg("_a")), 0, 1), F.lit(0.0)).alias("smoothness"))


FINGERPRINT = (
    "avg_velocity", "peak_velocity", "avg_acceleration", "avg_turn_rate", "peak_turn_rate", "stride_length",
    "stride_frequency", "knee_bend", "hip_rotation", "arm_swing", "spine_flexion", "vertical_range", "head_stability",
    "duration_sec", "frame_count", "left_contact", "right_contact",
)


def fingerprint(frames: DataFrame, by: Names, fps: float = 30.0, idx: str = "frame_idx", joints: str = "joints", width: int = 5, least_peak: float = 5.0) -> DataFrame:
    """17 measures of each clip and the 18-number vector that search compares (the last is 0).

    A clip of one frame has its length and zeros. Duration is frames / fps here. ``left_contact`` and ``right_contact`` are shares of
    frames with the contact flags of those names, where the table has them.
    """
    w = over(by, [idx])
    pos = {n: joint(n, joints)["pos"] for n in JOINT}
    up = {n: F.when(F.col(n), 1.0).otherwise(0.0) if n in frames.columns else F.lit(None).cast("double") for n in ("left_contact", "right_contact")}

    def bend(a: str, b: str, c: str) -> Column:
        return g.joint_angle(pos[a], pos[b], pos[c])

    ahead = g.let(lambda a: g.vec3(a.x, 0, a.z), g.q_rotate(F.col("root_rot"), g.vec3(0, 0, 1)))
    df = frames.select(
        *by,
        idx,
        F.col("root_pos").alias("p"),
        ahead.alias("ahead"),
        (180 - (bend("LeftUpLeg", "LeftLeg", "LeftFoot") + bend("RightUpLeg", "RightLeg", "RightFoot")) / 2).alias("knee_bend"),
        g.angle_between(g.sub(pos["LeftUpLeg"], pos["Hips"]), g.sub(pos["RightUpLeg"], pos["Hips"])).alias("hip_rotation"),
        ((bend("LeftShoulder", "LeftArm", "LeftForeArm") + bend("RightShoulder", "RightArm", "RightForeArm")) / 2).alias("arm_swing"),
        bend("Hips", "Spine1", "Spine2").alias("spine_flexion"),
        g.angle_between(g.sub(pos["Head"], pos["Neck"]), g.sub(pos["Spine2"], pos["Spine"])).alias("head_stability"),
        g.length(g.sub(pos["LeftFoot"], pos["RightFoot"])).alias("feet"),
        *(c.alias(n) for n, c in up.items()),
    )
    df = df.withColumns(
        {
            "v": F.coalesce(g.length(g.sub(F.col("p"), F.lag("p").over(w))) * fps, F.lit(0.0)),
            "turn": F.coalesce(g.angle_between(F.lag("ahead").over(w), F.col("ahead")) * fps, F.lit(0.0)),
            "peak": (F.col("feet") > F.lag("feet").over(w)) & (F.col("feet") > F.lead("feet").over(w)) & (F.col("feet") > least_peak),
        }
    )
    df = df.withColumn("sv", F.avg("v").over(w.rowsBetween(-(width // 2), width // 2)))
    df = df.withColumn("acc", F.abs(F.col("sv") - F.lag("sv").over(w)) * fps)
    n = F.count("*")
    stride = F.when(F.col("peak"), F.col("feet"))
    out = df.groupBy(*by).agg(
        F.avg("sv").alias("avg_velocity"),
        F.max("sv").alias("peak_velocity"),
        F.coalesce(F.avg("acc"), F.lit(0.0)).alias("avg_acceleration"),
        F.avg("turn").alias("avg_turn_rate"),
        F.max("turn").alias("peak_turn_rate"),
        F.coalesce(F.avg(stride), F.lit(0.0)).alias("stride_length"),
        (F.count(stride) / (n / fps)).alias("stride_frequency"),
        *(F.avg(c).alias(c) for c in ("knee_bend", "hip_rotation", "arm_swing", "spine_flexion")),
        (F.max("p.y") - F.min("p.y")).alias("vertical_range"),
        F.avg("head_stability").alias("head_stability"),
        (n / fps).alias("duration_sec"),
        n.cast("double").alias("frame_count"),
        *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in up),
    )
    alone = F.col("frame_count") < 2
    still = [c for c in FINGERPRINT if c not in ("duration_sec", "frame_count", "left_contact", "right_contact")]
    out = out.withColumns({c: F.when(alone, 0.0).otherwise(F.col(c)) for c in still})
    return out.withColumn("vector", F.array(*(F.col(c) for c in FINGERPRINT), F.lit(0.0)))


FEATURES = (
    "avg_velocity", "max_velocity", "avg_turn_rate", "stride_frequency", "knee_bend", "hip_rotation", "arm_swing", "vertical_range",
)


def cluster_features(frames: DataFrame, by: Names, fps: float = 30.0, idx: str = "frame_idx", joints: str = "joints") -> DataFrame:
    """The eight measures of a clip that clustering uses."""
    ahead = g.q_rotate(F.col("root_rot"), g.vec3(0, 0, 1))

    def turned(*names: str) -> Column:
        return sum((g.length(joint(n, joints)["euler"]) for n in names), F.lit(0.0)) / len(names)

    df = frames.select(
        *by, idx, g.length(F.col("root_vel")).alias("v"), F.col("root_pos.y").alias("y"), ahead.x.alias("ax"), ahead.z.alias("az"),
        turned("LeftLeg", "RightLeg").alias("knee"), turned("LeftUpLeg", "RightUpLeg").alias("hip"), turned("LeftArm", "RightArm").alias("arm"),
        joint("LeftFoot", joints)["pos"]["y"].alias("foot"),
    )
    return feature_steps(df, by, fps, idx).groupBy(*by).agg(*feature_aggs(fps))


def feature_steps(df: DataFrame, by: Names, fps: float = 30.0, idx: str = "frame_idx") -> DataFrame:
    """Add what a frame's ``ax``, ``az`` and ``foot`` are beside those of the frame before: turn, _up and _x."""
    w = over(by, [idx])
    dot = F.lag("ax").over(w) * F.col("ax") + F.lag("az").over(w) * F.col("az")
    df = df.withColumn("turn", F.degrees(F.acos(g.clamp(dot, -1, 1))) * fps).withColumn("_up", F.col("foot") > F.avg("foot").over(whole(by)))
    return df.withColumn("_x", F.coalesce(F.col("_up") != F.lag("_up").over(w), F.lit(False)).cast("int"))


def feature_aggs(fps: float = 30.0) -> list[Column]:
    n = F.count("*")
    seconds = (n - 1) / fps
    return [
        F.avg("v").alias("avg_velocity"),
        F.max("v").alias("max_velocity"),
        F.coalesce(F.avg("turn"), F.lit(0.0)).alias("avg_turn_rate"),
        F.when((n >= 10) & (seconds >= 0.1), F.sum("_x") / 2 / seconds).otherwise(0.0).alias("stride_frequency"),
        *(F.when(n < 2, 0.0).otherwise(F.avg(a)).alias(b) for a, b in (("knee", "knee_bend"), ("hip", "hip_rotation"), ("arm", "arm_swing"))),
        (F.max("y") - F.min("y")).alias("vertical_range"),
    ]


def measures(frames: DataFrame, by: Names, limits: QualityLimits = QualityLimits(), fps: float = 30.0, idx: str = "frame_idx", source: str = "source_frame") -> DataFrame:
    """What ``metadata``, ``quality`` and ``cluster_features`` say of each clip, in one aggregate over frames with the columns of ``passes.CLIP_COLUMNS``.

    Velocities are there once, as those of the features are the same. The frames of a clip are adjacent frames of its track.
    """
    w = over(by, [idx])
    ahead = g.q_rotate(g.quat(F.col("rw"), F.col("rx"), F.col("ry"), F.col("rz")), g.vec3(0, 0, 1))
    df = frames.withColumns({"ax": ahead.x, "az": ahead.z, "v": F.sqrt(sum((F.col(c) * F.col(c) for c in ("vx", "vy", "vz")), F.lit(0.0)))})
    df = feature_steps(df, by, fps, idx)
    inside = F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull()
    row, gone = F.row_number().over(w), F.coalesce(F.col("least_conf") < limits.missing_below, F.lit(False))
    df = df.withColumns({"_off": F.when(inside, F.col("jitter")), "_row": row, "_gone": gone})
    seen = F.max(F.when(~F.col("_gone"), F.col("_row"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_run", F.col("_row") - F.coalesce(seen, F.lit(0)))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_frames"),
        F.min(source).alias("start_frame"),
        F.max(source).alias("end_frame"),
        *(F.avg(c).alias(f"avg_{c}") for c in ("vx", "vy", "vz")),
        (F.sum("conf") / F.sum("conf_n")).alias("avg_confidence"),
        F.coalesce(F.max("_off"), F.lit(0.0)).alias("max_jitter"),
        F.max("_run").cast("long").alias("missing_frames"),
        F.collect_list("limbs").alias("_l"),
        *feature_aggs(fps),
    )
    limbs = F.transform(F.sequence(F.lit(0), F.lit(len(LIMBS) - 1)), lambda k: F.filter(F.transform("_l", lambda row: F.get(row, k)), lambda x: x > 0.1))

    def worst(sizes: Column) -> Column:
        middle = F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))
        ends = F.greatest(F.abs(F.get(sizes, F.lit(0)) - middle), F.abs(F.element_at(sizes, -1) - middle))
        return F.when((F.size(sizes) >= 2) & (middle >= 0.1), ends / middle)

    off = F.array_max(F.transform(F.transform(limbs, lambda x: F.sort_array(x)), worst))
    out = out.withColumn("limb_consistency", F.greatest(1 - F.coalesce(off, F.lit(0.0)), F.lit(0.0))).drop("_l")
    return judge(out.withColumn("duration_sec", duration(F.col("n_frames"), fps)), limits)


def fallback_embedding(frames: DataFrame, by: Names, idx: str = "frame_idx", joints: str = "joints", length: int = 64, dim: int = 128) -> DataFrame:
    """A deterministic embedding: summed joint places about the hips over every n/length-th frame, the mean speed, unit length.

    Clips of one frame have all zeros.
    """
    hips = joint("Hips", joints)["pos"]
    places = F.flatten(F.transform(joints, lambda j: F.array(j["pos"]["x"] - hips["x"], j["pos"]["y"] - hips["y"], j["pos"]["z"] - hips["z"])))
    df = frames.select(*by, idx, places.alias("_p"), g.length(F.col("root_vel")).alias("_v")).withColumn("_n", F.count("*").over(whole(by)))
    step = F.greatest(F.floor(F.col("_n") / length), F.lit(1))
    df = df.withColumn("_p", F.when(F.col(idx) % step == 0, F.col("_p")))
    speed = df.groupBy(*by).agg((F.avg("_v") / 500).alias("_s"), F.count("*").alias("_n"))
    cells = df.where("_p is not null").select(*by, F.posexplode("_p").alias("_d", "_x")).groupBy(*by, "_d").agg(F.sum("_x").alias("_x"))
    packed = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"]).alias("_p"))
    full = v.pad(F.concat(F.slice(F.col("_p"), 1, 66), F.array(F.col("_s"))), dim)
    out = packed.join(speed, [*by])
    return out.select(*by, F.when(F.col("_n") >= 2, v.normalized(full)).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("embedding"))


def model_input(frames: DataFrame, by: Names, idx: str = "frame_idx", joints: str = "joints") -> DataFrame:
    """Joint places about the hips over the clip's mean height from hips to head, as 66 numbers a frame."""
    hips, head = joint("Hips", joints)["pos"], joint("Head", joints)["pos"]
    df = frames.withColumn("_h", F.avg(g.length(g.sub(head, hips))).over(whole(by)))
    height = F.when(F.col("_h") < 1e-6, 1.0).otherwise(F.col("_h"))
    places = F.flatten(
        F.transform(joints, lambda j: F.array((j["pos"]["x"] - hips["x"]) / height, (j["pos"]["y"] - hips["y"]) / height, (j["pos"]["z"] - hips["z"]) / height))
    )
    return df.withColumn("features", places).drop("_h")


def frame_features(joints: Column, vel: Column, ang: Column) -> Column:
    """70 numbers of a frame: joint angles / 180, root velocity / 800, turn rate / 360."""
    angles = F.flatten(F.transform(joints, lambda j: F.array(j["euler"]["x"] / 180, j["euler"]["y"] / 180, j["euler"]["z"] / 180)))
    return F.concat(angles, F.array(vel.x / SPRINT_SPEED, vel.y / SPRINT_SPEED, vel.z / SPRINT_SPEED, g.length(ang) / MAX_TURN_RATE))


def with_deltas(df: DataFrame, by: Names, order: Names, col: str, out: str = "extended") -> DataFrame:
    """A feature array followed by its change since the row before (zeros in the first row)."""
    before = F.coalesce(F.lag(col).over(over(by, order)), F.col(col))
    return df.withColumn(out, F.concat(F.col(col), F.zip_with(F.col(col), before, lambda a, b: a - b)))


def style_features(frames: DataFrame, by: Names, order: Names, joints: str = "joints", out: str = "style_input") -> DataFrame:
    """201 numbers a frame: 132 of joint rotations, 3 of root velocity, 66 of angle changes / 360."""
    angles = F.flatten(F.transform(joints, lambda j: F.array(j["euler"]["x"], j["euler"]["y"], j["euler"]["z"])))
    df = frames.withColumn("_e", angles)
    before = F.coalesce(F.lag("_e").over(over(by, order)), F.col("_e"))
    turned = F.zip_with(F.col("_e"), before, lambda a, b: (a - b) / MAX_TURN_RATE)
    vel = F.array(*(F.col(f"root_vel.{a}") / SPRINT_SPEED for a in "xyz"))
    return df.withColumn(out, F.concat(skeleton_vector(F.col(joints)), vel, turned)).drop("_e")


def skeleton_vector(joints: Column) -> Column:
    """132 numbers: the six rotation numbers of all joints."""
    return F.flatten(F.transform(joints, lambda j: j["rot6d"]))


def vector_to_joints(vector: Column, joints: Column) -> Column:
    """Joints with the rotations of a 132-number vector and the places and confidences they had."""

    def one(j: Column, k: Column) -> Column:
        six = F.slice(vector, k * 6 + 1, F.lit(6))

        def made(q: Column) -> Column:
            return F.struct(q.alias("rot"), g.quat_to_euler(q).alias("euler"), six.alias("rot6d"), j["pos"].alias("pos"), j["conf"].alias("conf"))

        return g.let(made, g.rot6d_to_quat(six))

    return F.transform(joints, one)


def condition_vector(c: Column) -> Column:
    """A motion condition struct as 78 numbers: 13 scalars, 64 of style, a zero."""
    scalars = [
        c["velocity"]["x"], c["velocity"]["y"], c["velocity"]["z"], c["speed"], c["direction"], c["target_direction"],
        c["ball"]["x"], c["ball"]["y"], c["ball"]["z"], c["ball_distance"], c["action"].cast("double"), c["fatigue"], c["archetype"].cast("double"),
    ]
    return F.concat(F.array(*scalars), v.pad(c["style"], 64), F.array(F.lit(0.0)))


def flat_positions(joints: Column, wide: bool = False) -> Column:
    """66 numbers of joint places, or 132 with zeros behind them."""
    flat = F.flatten(F.transform(joints, lambda j: F.array(j["pos"]["x"], j["pos"]["y"], j["pos"]["z"])))
    return F.concat(flat, F.array_repeat(F.lit(0.0), 66)) if wide else flat


def joint_state(q: Column, euler: Column, pos: Column, conf: Column) -> Column:
    def made(q: Column) -> Column:
        return F.struct(q.alias("rot"), euler.alias("euler"), g.quat_to_rot6d(q).alias("rot6d"), pos.alias("pos"), conf.alias("conf"))

    return g.let(made, q)


def mirror(frames: DataFrame, joints: str = "joints") -> DataFrame:
    """Left and right exchanged: x of places and velocities negated, joints swapped, the y and z angles negated."""

    def flip(j: Column) -> Column:
        e = g.vec3(j["euler"]["x"], -j["euler"]["y"], -j["euler"]["z"])
        p = g.vec3(-j["pos"]["x"], j["pos"]["y"], j["pos"]["z"])
        return joint_state(g.euler_to_quat(e), e, p, j["conf"])

    def flipped(c: str) -> Column:
        return g.vec3(-F.col(c)["x"], F.col(c)["y"], F.col(c)["z"])

    r = F.col("root_rot")
    swapped = F.transform(v.permuted(F.col(joints), MIRRORED), flip)
    return frames.withColumns(
        {"root_pos": flipped("root_pos"), "root_vel": flipped("root_vel"), "root_rot": g.quat(r["w"], r["x"], -r["y"], -r["z"]), joints: swapped}
    )


def mirror_segments(segments: DataFrame, label: str = "type", direction: str = "avg_direction") -> DataFrame:
    left, right = F.lit(MOTION["TurnLeft"]), F.lit(MOTION["TurnRight"])
    turned = F.when(F.col(label) == left, right).when(F.col(label) == right, left).otherwise(F.col(label))
    out = segments.withColumn(label, turned)
    d = F.col(direction)
    return out.withColumn(direction, g.vec3(-d["x"], d["y"], d["z"])) if direction in segments.columns else out


def concatenate(frames: DataFrame, clip: str, order: str, idx: str = "frame_idx") -> DataFrame:
    """Clips one after another, in the order of column ``order``: frames are numbered on.

    The offset is a running sum of lengths over clips, a small table that is joined to the frames.
    """
    lengths = frames.groupBy(clip).agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
    w = Window.orderBy("_o", clip)
    offsets = lengths.select(clip, (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    return frames.join(offsets, clip).withColumn(idx, F.col(idx) + F.col("_off")).drop("_off")


def resample_segments(segments: DataFrame, fps: float, target: float, last: str = "n_frames") -> DataFrame:
    """Segment ends at another frame rate; ``last`` is the column with the new number of frames."""
    def moved(c: str) -> Column:
        return F.floor(F.col(c) * target / fps).cast("int")

    return segments.withColumns({"start_frame": moved("start_frame"), "end_frame": F.least(moved("end_frame"), F.col(last) - 1)})


def part_activity(frames: DataFrame, by: Names, order: Names, parts: dict[str, tuple[int, ...]], joints: str = "joints") -> DataFrame:
    """Per row and body part: mean turn of its joints since the row before (degrees), as columns named after the parts."""
    w = over(by, order)
    df = frames.withColumn("_b", F.lag(joints).over(w))
    for name, members in parts.items():
        turned = [g.length(g.sub(F.get(F.col(joints), F.lit(k))["euler"], F.get(F.col("_b"), F.lit(k))["euler"])) for k in members]
        df = df.withColumn(name, sum(turned, F.lit(0.0)) / len(members))
    return df.drop("_b")


def part_range(frames: DataFrame, by: Names, parts: dict[str, tuple[int, ...]], joints: str = "joints") -> DataFrame:
    """Per track and body part: range of motion, the summed angle ranges of its joints over their number."""
    aggs = []
    for name, members in parts.items():
        spans = [
            F.max(F.get(F.col(joints), F.lit(k))["euler"][a]) - F.min(F.get(F.col(joints), F.lit(k))["euler"][a]) for k in members for a in "xyz"
        ]
        aggs.append((sum(spans, F.lit(0.0)) / len(members)).alias(f"{name}_rom"))
    return frames.groupBy(*by).agg(*aggs)


#: The joints of each body part.
PARTS = {
    "torso": tuple(range(6)),
    "left_arm": tuple(range(6, 10)),
    "right_arm": tuple(range(10, 14)),
    "left_leg": tuple(range(14, 18)),
    "right_leg": tuple(range(18, 22)),
}
