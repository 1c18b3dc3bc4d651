"""Skeletons: from key points to joints, lifting, normalising, kinematics, canonical motion, limits and retargeting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackframe.functions import geometry as g
from trackframe.operators.smoothing import dot, slerp_np, smooth_quaternions, zero_phase
from trackframe.operators.windows import Names, over, root_angular_velocity, root_velocity, whole
from trackframe.schema import COCO, COCO_COUNT, FRAMES, JOINT, JOINT_COUNT, JOINT_NAMES, JOINT_PARENT, REST_OFFSETS

# Key points to the 22 joints


def decimate(df: DataFrame, idx: str, video_fps: float, target_fps: float, by: Names = ()) -> DataFrame:
    """Every n-th frame, n the rounded ratio of the rates (1 if the video is no faster); frames are numbered anew and timed by their place in the video."""
    step = max(1, round(video_fps / target_fps)) if video_fps > target_fps else 1
    kept = df.where(F.col(idx) % step == 0)
    return kept.withColumns({"ts": F.col(idx) / max(1.0, video_fps), idx: (F.col(idx) / step).cast("int")})


def sample_fractional(df: DataFrame, idx: str, source_fps: float, target_fps: float, max_frames: int | None = None) -> DataFrame:
    """Frames at a rate that need not divide the video's: the n-th is the first at or after n steps of source / min(target, source).

    Steps are added up one by one, as a decoder does, so that rounding falls alike; the sums are a table with a row for each frame kept.
    """
    spark = df.sparkSession
    step = source_fps / min(target_fps, source_fps)
    last = df.agg(F.max(idx)).first()[0]
    if last is None:
        return df.withColumn("sample_idx", F.lit(0))
    at, total, places = 0, 0.0, []
    while True:
        at = int(np.ceil(total))
        if at > last or (max_frames is not None and len(places) >= max_frames):
            break
        places.append(at)
        total += step
    table = spark.createDataFrame([(p, n) for n, p in enumerate(places)], f"{idx} int, sample_idx int")
    return df.join(table, idx)


def mask_keypoints(kp: Column, least: float = 0.3) -> Column:
    """Key points below a confidence become zeros."""
    zero = F.lit(0.0)
    return F.transform(kp, lambda p: F.when(p["conf"] < least, F.struct(zero.alias("x"), zero.alias("y"), zero.alias("conf"))).otherwise(p))


def enough_keypoints(kp: Column, least: int = 6, confidence: float = 0.1) -> Column:
    return F.size(F.filter(kp, lambda p: p["conf"] > confidence)) >= least


def long_tracks(df: DataFrame, by: Names, least: int) -> DataFrame:
    """Rows of tracks with at least ``least`` rows: a count by track and a semi-join, so no track is sorted."""
    return df.join(df.groupBy(*by).count().where(F.col("count") >= least), list(by), "left_semi")


def valid_tracks(df: DataFrame, by: Names, valid: str, share: float = 0.5) -> DataFrame:
    """Rows of tracks of which at least this share of rows is valid."""
    good = df.groupBy(*by).agg(F.avg(F.col(valid).cast("double")).alias("_v")).where(F.col("_v") >= share)
    return df.join(good, list(by), "left_semi")


def lift(kp: Column, torso: float = 50.0) -> Column:
    """Normalised 2-D key points to 3-D about the hips: scaled so that the torso is 50 cm, depth a tenth of the height difference."""

    def at(name: str) -> Column:
        return F.get(kp, F.lit(COCO[name]))

    shoulders = (at("left_shoulder")["y"] + at("right_shoulder")["y"]) / 2
    hip_y = (at("left_hip")["y"] + at("right_hip")["y"]) / 2
    hip_x = (at("left_hip")["x"] + at("right_hip")["x"]) / 2
    size = F.abs(shoulders - hip_y)
    k = torso / F.when(size < 1e-4, 0.3).otherwise(size)
    return F.transform(
        kp,
        lambda p: F.struct(
            ((p["x"] - hip_x) * k).alias("x"), (-(p["y"] - hip_y) * k).alias("y"), ((p["y"] - hip_y) * k * 0.1).alias("z"), p["conf"].alias("conf")
        ),
    )


#: Which key point each joint stands on; two names mean the middle between them.
ON_KEYPOINT = {
    "Hips": ("left_hip", "right_hip"), "Spine2": ("left_shoulder", "right_shoulder"), "Head": ("nose",),
    "LeftShoulder": ("left_shoulder",), "LeftArm": ("left_shoulder",), "LeftForeArm": ("left_elbow",), "LeftHand": ("left_wrist",),
    "RightShoulder": ("right_shoulder",), "RightArm": ("right_shoulder",), "RightForeArm": ("right_elbow",), "RightHand": ("right_wrist",),
    "LeftUpLeg": ("left_hip",), "LeftLeg": ("left_knee",), "LeftFoot": ("left_ankle",),
    "RightUpLeg": ("right_hip",), "RightLeg": ("right_knee",), "RightFoot": ("right_ankle",),
}


def joint_positions(kp: Column) -> Column:
    """22 joint places from 17 key points in 3-D: on them, in between, and toes 3 below and 8 before the ankles."""
    at = {n: F.get(kp, F.lit(k)) for n, k in COCO.items()}
    made = {j: at[names[0]] if len(names) == 1 else g.midpoint(at[names[0]], at[names[1]]) for j, names in ON_KEYPOINT.items()}
    made["Spine"] = g.lerp(made["Hips"], made["Spine2"], 0.33)
    made["Spine1"] = g.lerp(made["Hips"], made["Spine2"], 0.66)
    made["Neck"] = g.midpoint(made["Spine2"], made["Head"])
    for side in ("Left", "Right"):
        made[f"{side}ToeBase"] = g.add(made[f"{side}Foot"], g.vec3(0, -3, 8))
    return F.array(*(g.vec3(made[n].x, made[n].y, made[n].z) for n in JOINT_NAMES))


def joint_confidences(kp: Column) -> Column:
    """The confidence of the key point a joint stands on, or the lesser of the two; the back has those of hips and shoulders."""
    at = {n: F.get(kp, F.lit(k))["conf"] for n, k in COCO.items()}
    made = {j: at[names[0]] if len(names) == 1 else F.least(at[names[0]], at[names[1]]) for j, names in ON_KEYPOINT.items()}
    made["Spine"] = made["Spine1"] = made["Hips"]
    made["Neck"] = made["Spine2"]
    for side in ("Left", "Right"):
        made[f"{side}ToeBase"] = made[f"{side}Foot"]
    return F.array(*(made[n] for n in JOINT_NAMES))


def body_rotation(kp: Column) -> Column:
    """Root rotation from the hip and shoulder lines of key points."""
    at = {n: F.get(kp, F.lit(COCO[n])) for n in ("left_hip", "right_hip", "left_shoulder", "right_shoulder")}
    up = g.normalized(g.sub(g.midpoint(at["left_shoulder"], at["right_shoulder"]), g.midpoint(at["left_hip"], at["right_hip"])))
    right = g.normalized(g.sub(at["right_hip"], at["left_hip"]))

    def basis(right: Column, forward: Column) -> Column:
        return g.mat3_from_columns(right, g.normalized(g.cross(forward, right)), forward)

    return g.mat3_to_quat(g.let(lambda right: g.let(lambda f: basis(right, f), g.normalized(g.cross(right, up))), right))


#: Joints of the 2-D mapping; those that are absent are made from others.
FLAT_ON_KEYPOINT = {
    "Hips": ("left_hip", "right_hip"), "Spine": ("left_hip", "right_hip"), "Neck": ("left_shoulder", "right_shoulder"), "Head": ("nose",),
    "LeftArm": ("left_shoulder",), "LeftForeArm": ("left_elbow",), "LeftHand": ("left_wrist",),
    "RightArm": ("right_shoulder",), "RightForeArm": ("right_elbow",), "RightHand": ("right_wrist",),
    "LeftUpLeg": ("left_hip",), "LeftLeg": ("left_knee",), "LeftFoot": ("left_ankle",),
    "RightUpLeg": ("right_hip",), "RightLeg": ("right_knee",), "RightFoot": ("right_ankle",),
}


def normalise_flat(kp: np.ndarray, least: float = 0.3, reference: str = "torso") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """T frames of 17 (x, y, confidence) to (T, 22, 3) places of unit size about the hips, confidences, and which frames are valid.

    A frame needs both hips and something to measure its size by: the shoulders (or one), or with 'full' ankles and nose.
    """
    kp = np.asarray(kp, float)
    xy, conf = kp[..., :2].copy(), kp[..., 2]
    seen = conf >= least
    col = lambda n: COCO[n]
    valid = seen[:, col("left_hip")] & seen[:, col("right_hip")]
    centre = (xy[:, col("left_hip")] + xy[:, col("right_hip")]) / 2
    xy = np.where(seen[..., None], xy - centre[:, None], 0.0)
    ls, rs = col("left_shoulder"), col("right_shoulder")
    size = np.where(seen[:, ls], np.linalg.norm(xy[:, ls], axis=1), np.where(seen[:, rs], np.linalg.norm(xy[:, rs], axis=1), np.nan))
    if reference == "torso":
        size = np.where(seen[:, ls] & seen[:, rs], np.linalg.norm((xy[:, ls] + xy[:, rs]) / 2, axis=1), size)
    else:
        la, ra, nose = col("left_ankle"), col("right_ankle"), col("nose")
        full = np.linalg.norm(xy[:, nose] - (xy[:, la] + xy[:, ra]) / 2, axis=1)
        size = np.where(seen[:, la] & seen[:, ra] & seen[:, nose], full, size)
    size = size + 1e-6
    valid &= np.isfinite(size) & (size >= 1e-6)
    xy = xy / np.where(valid, size, 1.0)[:, None, None]
    pos, out = np.zeros((len(kp), JOINT_COUNT, 3)), np.zeros((len(kp), JOINT_COUNT))
    for name, points in FLAT_ON_KEYPOINT.items():
        at = [COCO[p] for p in points]
        n = seen[:, at].sum(1)
        pos[:, JOINT[name], :2] = (xy[:, at] * seen[:, at, None]).sum(1) / np.maximum(n, 1)[:, None]
        out[:, JOINT[name]] = (conf[:, at] * seen[:, at]).sum(1) / np.maximum(n, 1)

    def make(name: str, a: str, b: str, t: float, strength) -> None:
        i, j = JOINT[a], JOINT[b]
        both = (out[:, i] > 0) & (out[:, j] > 0)
        pos[both, JOINT[name]] = (pos[:, i] + (pos[:, j] - pos[:, i]) * t)[both]
        out[both, JOINT[name]] = strength(out[:, i], out[:, j])[both]

    mean = lambda a, b: (a + b) / 2
    make("Spine1", "Hips", "Neck", 1 / 3, mean)
    make("Spine2", "Hips", "Neck", 2 / 3, mean)
    for side in ("Left", "Right"):
        make(f"{side}Shoulder", "Neck", f"{side}Arm", 0.5, mean)
        make(f"{side}ToeBase", f"{side}Leg", f"{side}Foot", 1.2, lambda a, b: 0.8 * np.minimum(a, b))
    pos[~valid], out[~valid] = 0.0, 0.0
    return pos, out, valid


def fill_joints(pos: np.ndarray, conf: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joints that are missing in some frames, linearly between the frames that have them; before the first and after the last nothing changes."""
    pos, conf, t = pos.copy(), conf.copy(), np.arange(len(pos))
    for j in range(pos.shape[1]):
        have = np.flatnonzero(valid & (conf[:, j] > 0))
        if len(have) < 2:
            continue
        gap = np.setdiff1d(t[have[0] : have[-1] + 1], have)
        for a in range(pos.shape[2]):
            pos[gap, j, a] = np.interp(gap, have, pos[have, j, a])
        conf[gap, j] = np.interp(gap, have, conf[have, j])
    return pos, conf


def normalise_tracks(df: DataFrame, by: Names, order: Names, kp: str = "kp2d", least: float = 0.3, reference: str = "torso", interpolate: bool = True) -> DataFrame:
    """Key, order, ``positions`` (22 places), ``confidence`` (22) and ``valid`` of every frame; a grouped map over tracks."""
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*df.select(*by, *order).schema])
    schema = schema.add("positions", T.ArrayType(numbers)).add("confidence", numbers).add("valid", T.BooleanType())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable")
        points = np.array([[[p["x"], p["y"], p["conf"]] for p in r] for r in rows[kp]], float).reshape(len(rows), COCO_COUNT, 3)
        pos, conf, valid = normalise_flat(points, least, reference)
        if interpolate and len(rows) > 1:
            pos, conf = fill_joints(pos, conf, valid)
        return rows[[*by, *order]].assign(positions=pos.tolist(), confidence=conf.tolist(), valid=valid)

    return df.select(*by, *order, kp).groupBy(*by).applyInPandas(run, schema)


def normalise_by_track(df: DataFrame, by: Names, points: str, centre: Column, size: Column, out: str | None = None) -> DataFrame:
    """Points (array of structs x, y[, z]) about a centre, over the track's mean size (1 where that is below 1e-6)."""
    df = df.withColumn("_s", F.avg(size).over(whole(by)))
    k = F.when(F.col("_s") < 1e-6, 1.0).otherwise(F.col("_s"))
    fields = [f.name for f in df.schema[points].dataType.elementType]
    moved = F.transform(
        points, lambda p: F.struct(*(((p[f] - centre[f]) / k if f in "xyz" else p[f]).alias(f) for f in fields))
    )
    return df.withColumn(out or points, moved).drop("_s")


# Kinematics on whole tracks (numpy): time is axis 0, joints the last axis but one; tracks of one length may lie between

PARENT = np.array(JOINT_PARENT)
REST = np.array(REST_OFFSETS, float)


def cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """As np.cross over the last axis, which takes much longer for three numbers."""
    out = np.empty(np.broadcast_shapes(u.shape, v.shape))
    for k, (i, j) in enumerate(((1, 2), (2, 0), (0, 1))):
        out[..., k] = u[..., i] * v[..., j] - u[..., j] * v[..., i]
    return out


def q_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w, u, x, v = a[..., :1], a[..., 1:], b[..., :1], b[..., 1:]
    return np.concatenate([w * x - dot(u, v), w * v + x * u + cross(u, v)], -1)


def q_conj(q: np.ndarray) -> np.ndarray:
    return q * np.array([1.0, -1, -1, -1])


def q_rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    u = q[..., 1:]
    return v + 2 * cross(u, cross(u, v) + q[..., :1] * v)


def unit(v: np.ndarray, rest: np.ndarray | float = 0.0) -> np.ndarray:
    n = np.sqrt(dot(v, v))
    return np.where(n > 1e-8, v / np.maximum(n, 1e-300), rest)


def q_unit(q: np.ndarray) -> np.ndarray:
    return unit(q, np.array([1.0, 0, 0, 0]))


def q_from_matrix(m: np.ndarray) -> np.ndarray:
    """From (..., 3, 3): of the four ways to write each, the one with the greatest divisor."""
    x, y, z = m[..., 0, 0], m[..., 1, 1], m[..., 2, 2]
    t = x + y + z
    s = np.stack([1 + t, 1 - t + 2 * x, 1 - t + 2 * y, 1 - t + 2 * z])
    best = np.argmax(s, axis=0)
    a = (m[..., 2, 1] - m[..., 1, 2], m[..., 0, 2] - m[..., 2, 0], m[..., 1, 0] - m[..., 0, 1])
    e = (m[..., 1, 0] + m[..., 0, 1], m[..., 0, 2] + m[..., 2, 0], m[..., 2, 1] + m[..., 1, 2])
    rows = ((s[0], *a), (a[0], s[1], e[0], e[1]), (a[1], e[0], s[2], e[2]), (a[2], e[1], e[2], s[3]))
    q = np.empty((*best.shape, 4))
    is_x, is_y, is_z = best == 1, best == 2, best == 3
    for k in range(4):
        q[..., k] = np.where(is_x, rows[1][k], np.where(is_y, rows[2][k], np.where(is_z, rows[3][k], rows[0][k])))
    q = q_unit(q)
    return np.where(q[..., :1] < 0, -q, q)


def q_matrix(q: np.ndarray) -> np.ndarray:
    w, x, y, z = np.moveaxis(q, -1, 0)
    return np.stack(
        [
            np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], -1),
            np.stack([2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], -1),
            np.stack([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], -1),
        ],
        -2,
    )


def q_six(q: np.ndarray) -> np.ndarray:
    w, x, y, z = np.moveaxis(q, -1, 0)
    out = np.empty((*q.shape[:-1], 6))
    out[..., 0], out[..., 1], out[..., 2] = 1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)
    out[..., 3], out[..., 4], out[..., 5] = 2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)
    return out


def six_q(six: np.ndarray) -> np.ndarray:
    a = unit(six[..., :3])
    b = six[..., 3:]
    b = unit(b - a * dot(a, b))
    return q_from_matrix(np.stack([a, b, cross(a, b)], -1))


def q_euler(q: np.ndarray) -> np.ndarray:
    w, x, y, z = np.moveaxis(q, -1, 0)
    s = 2 * (w * y - z * x)
    return np.degrees(
        np.stack(
            [
                np.arctan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)),
                np.where(np.abs(s) >= 1, np.sign(s) * np.pi / 2, np.arcsin(np.clip(s, -1, 1))),
                np.arctan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)),
            ],
            -1,
        )
    )


def q_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shortest rotation between directions."""
    a, b = unit(a), unit(b)
    d = (a * b).sum(-1, keepdims=True)
    q = np.concatenate([1 + d, np.cross(a, b)], -1)
    side = np.cross(np.array([1.0, 0, 0]), a)
    side = np.where((side**2).sum(-1, keepdims=True) < 1e-7, np.cross(np.array([0, 1.0, 0]), a), side)
    turned = np.concatenate([np.zeros_like(d), unit(side)], -1)
    still = np.broadcast_to(np.array([1.0, 0, 0, 0]), q.shape)
    return np.where(d > 1 - 1e-7, still, np.where(d < -1 + 1e-7, turned, q_unit(q)))


def forward_kinematics(root_pos: np.ndarray, root_rot: np.ndarray, local: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
    """World places (T, ..., 22, 3) from local rotations; offsets are the rest pose's or, per frame, measured ones."""
    offsets = np.broadcast_to(REST if offsets is None else offsets, (*local.shape[:-1], 3))
    pos, rot = np.zeros((*local.shape[:-1], 3)), np.zeros_like(local)
    for j, p in enumerate(JOINT_PARENT):
        if p < 0:
            rot[..., j, :], pos[..., j, :] = q_mul(root_rot, local[..., j, :]), root_pos
        else:
            rot[..., j, :] = q_mul(rot[..., p, :], local[..., j, :])
            pos[..., j, :] = pos[..., p, :] + q_rotate(rot[..., p, :], offsets[..., j, :])
    return pos


def _basis(y: np.ndarray, across: np.ndarray) -> np.ndarray:
    y = unit(y)
    x = unit(across - y * (y * across).sum(-1, keepdims=True))
    return np.stack([x, y, unit(np.cross(x, y))], -1)


def inverse_kinematics(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root places, root rotations and local rotations (T, 22, 4) that point every bone as in the given places."""
    spine, left, right = JOINT["Spine"], JOINT["LeftUpLeg"], JOINT["RightUpLeg"]
    rest = _basis(REST[spine], REST[right] - REST[left])
    world = _basis(pos[:, spine] - pos[:, 0], pos[:, right] - pos[:, left])
    root = q_from_matrix(world @ rest.T)
    rot, local = np.zeros((len(pos), JOINT_COUNT, 4)), np.zeros((len(pos), JOINT_COUNT, 4))
    rot[:, 0], local[..., 0] = root, 1.0
    for j, p in enumerate(JOINT_PARENT):
        if p < 0:
            continue
        bone, still = unit(pos[:, j] - pos[:, p]), q_rotate(rot[:, p], np.broadcast_to(unit(REST[j]), (len(pos), 3)))
        known = ((bone**2).sum(-1, keepdims=True) > 1e-7) & ((still**2).sum(-1, keepdims=True) > 1e-7)
        rot[:, j] = np.where(known, q_mul(q_between(still, bone), rot[:, p]), rot[:, p])
        local[:, j] = q_unit(q_mul(q_conj(rot[:, p]), rot[:, j]))
    return pos[:, 0], root, local


def root_orientation(pos: np.ndarray) -> np.ndarray:
    """Rotation of the pelvis from the hip line and the direction of the spine."""
    up = unit(pos[..., JOINT["Spine"], :] - pos[..., 0, :], np.array([0, 1.0, 0]))
    across = unit(pos[..., JOINT["RightUpLeg"], :] - pos[..., JOINT["LeftUpLeg"], :], np.array([1.0, 0, 0]))
    forward = unit(np.cross(across, up), np.array([0, 0, 1.0]))
    return q_from_matrix(np.stack([unit(np.cross(up, forward)), up, forward], -1))


def stable_lengths(local: np.ndarray, lengths: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """Local places with their directions kept and their lengths running from ``lengths`` towards what is measured."""
    out, now = local.copy(), np.asarray(lengths, float).copy()
    size = np.linalg.norm(local, axis=-1)
    for t in range(len(local)):
        measured = (size[t] > 1e-6) & (PARENT >= 0)
        now = np.where(measured, (1 - alpha) * now + alpha * size[t], now)
        out[t] = np.where(measured[..., None], unit(local[t]) * now[..., None], local[t])
    return out


def upper_median_above(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Over axis 0: element n/2 (from 0) of the n sorted values above 0, or ``rest`` where there are none."""
    n = (x > 0).sum(0)
    middle = np.take_along_axis(np.sort(np.where(x > 0, x, np.inf), axis=0), np.minimum(n // 2, len(x) - 1)[None], 0)[0]
    return np.where(n > 0, middle, rest)


def canonical(pos: np.ndarray, rot: np.ndarray, fps: float = 30.0, targets: np.ndarray | None = None, alpha: float = 0.05, solve_root: bool = True, root_rot: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Motion in the skeleton's own terms: root path, turn rates, local rotations and steadied local places.

    ``pos`` and ``rot`` are joint places and rotations; ``targets`` fixes limb lengths (0: as measured).
    """
    root = root_orientation(pos) if solve_root or root_rot is None else root_rot
    parent = np.maximum(PARENT, 0)
    local_rot = q_unit(np.where((PARENT < 0)[:, None], q_mul(q_conj(root)[..., None, :], rot), q_mul(q_conj(rot[..., parent, :]), rot)))
    bones = pos - pos[..., parent, :]
    local_pos = np.where((PARENT < 0)[:, None], REST, bones)
    measured = upper_median_above(np.linalg.norm(bones, axis=-1), np.linalg.norm(REST, axis=-1))
    lengths = measured if targets is None else np.where(targets > 0, targets, measured)
    vel = np.zeros_like(pos[..., 0, :])
    vel[1:] = np.diff(pos[..., 0, :], axis=0) * fps
    turn = q_unit(q_mul(root[1:], q_conj(root[:-1])))
    yaw = np.zeros(pos.shape[:-2])
    yaw[1:] = np.where(turn[..., 2] >= 0, 1, -1) * 2 * np.arccos(np.clip(np.abs(turn[..., 0]), 0, 1)) * fps
    return {
        "root_pos": pos[..., 0, :],
        "root_rot": root,
        "root_vel": vel,
        "yaw_rate": yaw,
        "local_rot": local_rot,
        "local_pos": stable_lengths(local_pos, lengths, alpha),
        "limb_lengths": lengths,
    }


# Frames as arrays, and the signal stages on all channels of a track


def pack(rows: pd.DataFrame, a: dict[str, np.ndarray]) -> pd.DataFrame:
    """Arrays back to frames; angles and six-number rotations follow the rotations."""

    def structs(x: np.ndarray, names: str) -> list[dict]:
        return [dict(zip(names, r)) for r in x.tolist()]

    euler, six = q_euler(a["rot"]), q_six(a["rot"])
    joints = [
        [
            {"rot": q, "euler": e, "rot6d": s, "pos": p, "conf": c}
            for q, e, s, p, c in zip(structs(a["rot"][t], "wxyz"), structs(euler[t], "xyz"), six[t].tolist(), structs(a["pos"][t], "xyz"), a["conf"][t].tolist())
        ]
        for t in range(len(rows))
    ]
    return rows.assign(
        root_pos=structs(a["root_pos"], "xyz"),
        root_rot=structs(a["root_rot"], "wxyz"),
        root_vel=structs(a["root_vel"], "xyz"),
        root_ang_vel=structs(a["root_ang_vel"], "xyz"),
        joints=joints,
    )


Arrays = dict[str, np.ndarray]
#: What the stages read of a frame, as numbers in a row: name, fields, and whether each joint has them.
CHANNELS = (
    ("root_pos", "xyz", False), ("root_rot", "wxyz", False), ("root_vel", "xyz", False), ("root_ang_vel", "xyz", False),
    ("pos", "xyz", True), ("rot", "wxyz", True), ("conf", "", True),
)
CHANNEL_COUNT = sum(max(1, len(names)) * (JOINT_COUNT if each else 1) for _, names, each in CHANNELS)


def channels_of(out: str = "_a") -> Column:
    """The numbers of CHANNELS as one array, which goes to Python without nested rows."""
    parts = []
    for name, names, each in CHANNELS:
        if each:
            parts += [F.col(f"joints.{name}.{a}") for a in names] or [F.col(f"joints.{name}")]
        else:
            parts.append(F.array(*(F.col(f"{name}.{a}") for a in names)))
    return F.concat(*parts).alias(out)


def arrays_of(flat: np.ndarray) -> Arrays:
    """Rows of numbers (..., CHANNEL_COUNT) by name."""
    out, at = {}, 0
    for name, names, each in CHANNELS:
        width, joints = max(1, len(names)), JOINT_COUNT if each else 1
        x = flat[..., at : at + width * joints]
        at += width * joints
        if each:
            x = np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:-1], width, joints), -2, -1)) if names else x
        out[name] = x
    return out


def numbers(x: np.ndarray) -> pa.Array:
    """Doubles, null where they are not a number."""
    return pa.array(np.ascontiguousarray(x).ravel(), pa.float64(), from_pandas=True)


def structs(x: np.ndarray, names: str) -> pa.Array:
    return pa.StructArray.from_arrays([numbers(x[..., k]) for k in range(len(names))], names=list(names))


def lists(values: pa.Array, size: int) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, size, dtype=np.int32), values)


def frame_columns(a: Arrays) -> dict[str, pa.Array]:
    """Arrays back to columns of frames; angles and six-number rotations follow the rotations."""
    state = {
        "rot": structs(a["rot"], "wxyz"), "euler": structs(q_euler(a["rot"]), "xyz"), "rot6d": lists(numbers(q_six(a["rot"])), 6),
        "pos": structs(a["pos"], "xyz"), "conf": numbers(a["conf"]),
    }
    joints = lists(pa.StructArray.from_arrays(list(state.values()), names=list(state)), JOINT_COUNT)
    return {n: structs(a[n], names) for n, names, each in CHANNELS if not each} | {"joints": joints}


def over_tracks(frames: DataFrame, by: Names, keep: Names, change: Callable[[Arrays], Arrays], columns: Callable[[Arrays], dict[str, pa.Array]], schema: T.StructType, order: str = "frame_idx", least: int = 1, at_once: int = 40_000) -> DataFrame:
    """``columns(change(arrays))`` of whole tracks beside the columns ``keep``: one shuffle, all channels together.

    Tracks of under ``least`` rows are left out. A partition's tracks are read in order, ``at_once`` rows or one longer track at a time, and those of one
    length go through ``change`` together, with time as axis 0 and tracks as axis 1, so that its steps along time are few.
    """
    keys, kept = list(by), list(keep)
    names = [f.name for f in schema]

    def codes(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy() for k in keys], -1)

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n, track = table.num_rows, codes(table)
        starts = np.flatnonzero(np.append(True, (track[1:] != track[:-1]).any(1)))
        sizes = np.diff(np.append(starts, n))
        listed = table.column("_a").combine_chunks()
        flat = listed.flatten()
        if len(flat) != n * CHANNEL_COUNT:
            raise ValueError(f"a frame needs {JOINT_COUNT} joints")
        flat = flat.to_numpy(zero_copy_only=False).reshape(n, CHANNEL_COUNT)
        rest = table.select(kept).combine_chunks()
        for size in np.unique(sizes[sizes >= least]):
            first = starts[sizes == size]
            step = max(1, 4096 // size)
            for k in range(0, len(first), step):
                rows = (first[k : k + step] + np.arange(size)[:, None]).ravel()
                a = change(arrays_of(flat[rows].reshape(size, -1, CHANNEL_COUNT)))
                out = columns(a)
                took = rest.take(pa.array(rows))
                cells = [out[c] if c in out else took.column(c).combine_chunks() for c in names]
                yield pa.RecordBatch.from_arrays(cells, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, due = [], 0, at_once
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < due:
                continue
            table = pa.Table.from_batches(held)
            # the last track may go on in the next batch
            track = codes(table)
            other = np.flatnonzero((track != track[-1]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from made(table.slice(0, cut))
            held, n = table.slice(cut).to_batches(), n - cut
            due = max(at_once, 2 * n)
        if n:
            yield from made(pa.Table.from_batches(held))

    dealt = frames.select(*dict.fromkeys([*keys, order, *kept]), channels_of())
    return dealt.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def on_tracks(frames: DataFrame, by: Names, change: Callable[[Arrays], Arrays], order: str = "frame_idx") -> DataFrame:
    """Apply a function on arrays (see arrays_of; time is axis 0) to the frames of every track."""
    changed = {n for n, _, each in CHANNELS if not each} | {"joints"}
    schema = T.StructType([FRAMES[f.name] if f.name in changed else f for f in frames.schema])
    return over_tracks(frames, by, [c for c in frames.columns if c not in changed], change, frame_columns, schema, order)


#: Exchanges after which the middle one of seven is their median.
MEDIAN_OF_7 = ((0, 5), (0, 3), (1, 6), (2, 4), (0, 1), (3, 5), (2, 6), (2, 3), (3, 6), (4, 5), (1, 4), (1, 3), (3, 4))


def median_of(rows: list[np.ndarray]) -> np.ndarray:
    """Median of arrays of one shape, place by place; none may have NaN."""
    if len(rows) != 7:
        return np.median(np.stack(rows), axis=0)
    rows, spare = [r.copy() for r in rows], np.empty_like(rows[0])
    for i, j in MEDIAN_OF_7:
        np.minimum(rows[i], rows[j], out=spare)
        np.maximum(rows[i], rows[j], out=rows[j])
        rows[i], spare = spare, rows[i]
    return rows[3]


def window_medians(x: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the window around each row, cut off at the ends, and the median distance from it."""
    n = len(x)
    if np.isnan(x).any():
        padded = np.full((n + 2 * half, x.shape[1]), np.nan)
        padded[half : half + n] = x
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=0)
        middle = np.nanmedian(windows, axis=-1)
        return middle, np.nanmedian(np.abs(windows - middle[..., None]), axis=-1)
    middle, spread = np.empty_like(x), np.empty_like(x)
    parts = [(t, t + 1) for t in (*range(min(half, n)), *range(max(half, n - half), n))] + [(half, n - half)] * (n > 2 * half)
    for s, e in parts:
        step = max(1, 8192 // (e - s))  # channels of which the copies stay in the cache
        for c in range(0, x.shape[1], step):
            near = [x[s + k : e + k, c : c + step] for k in range(-half, half + 1) if 0 <= s + k < n]
            middle[s:e, c : c + step] = m = median_of(near)
            spread[s:e, c : c + step] = median_of([np.abs(w - m) for w in near])
    return middle, spread


def mad_clean(x: np.ndarray, width: int = 7, threshold: float = 3.0, mode: str = "interpolate") -> np.ndarray:
    """Outliers of every channel (axes 1 and on) replaced, as ``smoothing.mad_outliers`` does for one column."""
    n, shape = len(x), x.shape
    if n < width:
        return x
    x = x.reshape(n, -1)
    half, there = width // 2, ~np.isnan(x)
    middle, spread = window_medians(x, half)
    spread = spread * 1.4826
    t = np.arange(n)
    first, last = np.maximum(t - half, 0), np.minimum(t + half + 1, n)
    count = (last - first)[:, None]
    if not there.all():
        sums = np.concatenate([np.zeros((1, x.shape[1]), int), np.cumsum(there, axis=0)])
        count = sums[last] - sums[first]
    off = np.abs(x - middle)
    bad = np.where(spread > 1e-6, off > threshold * spread, (off > 1e-4) & (count >= 5))
    if mode == "median":
        out = np.where(bad, middle, x)
    elif mode == "clamp":
        near = np.where(spread > 1e-6, middle + np.sign(x - middle) * threshold * spread, middle)
        out = np.where(bad, near, x)
    else:
        out = between_good(x, bad)
    return out.reshape(shape)


def between_good(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Bad rows of each channel on the line between the good ones around them, or as the nearest good one; a channel without any stays."""
    out = x.copy()
    some = np.flatnonzero(bad.any(0) & ~bad.all(0))
    bad = bad[:, some]
    t, k = np.nonzero(bad)
    if not len(t):
        return out
    at, c = np.arange(len(x), dtype=np.int32)[:, None], some[k]
    before = np.maximum.accumulate(np.where(bad, np.int32(-1), at), axis=0)[t, k]
    after = np.minimum.accumulate(np.where(bad, np.int32(len(x)), at)[::-1], axis=0)[::-1][t, k]
    i, j = np.where(before < 0, after, before), np.where(after == len(x), before, after)
    slope = (x[j, c] - x[i, c]) / np.maximum(j - i, 1)
    out[t, c] = slope * (t - i) * (j > i) + x[i, c]
    return out


def savgol_clean(x: np.ndarray, width: int = 7, degree: int = 3) -> np.ndarray:
    """Savitzky-Golay over axis 0 with point-reflected ends, as ``smoothing.savgol`` does for one column."""
    from trackframe.operators.smoothing import savgol_coefficients

    n = len(x)
    width = min(width, n - 1 + n % 2)
    if width < 3:
        return x
    half = width // 2
    padded = np.concatenate([2 * x[0] - x[half:0:-1], x, 2 * x[-1] - x[-2 : -half - 2 : -1]])
    weights = savgol_coefficients(width, min(degree, width - 1))
    return sum(w * padded[k : k + n] for k, w in enumerate(weights))


def filter_channels(a: Arrays, change: Callable[[np.ndarray], np.ndarray]) -> Arrays:
    """A filter over the 204 channels of a track; rotations are filtered as six numbers and made rotations again."""
    lead = a["pos"].shape[:-2]
    parts = [a["pos"].reshape(*lead, -1), q_six(a["rot"]).reshape(*lead, -1), a["root_pos"], a["root_vel"]]
    ends = np.cumsum([0, *(p.shape[-1] for p in parts)])
    flat = change(np.concatenate(parts, axis=-1))
    pos, six, root, vel = (flat[..., s:e] for s, e in zip(ends[:-1], ends[1:]))
    return a | {"pos": pos.reshape(*lead, JOINT_COUNT, 3), "rot": six_q(six.reshape(*lead, JOINT_COUNT, 6)), "root_pos": root, "root_vel": vel}


def butterworth_clean(x: np.ndarray, degree: int = 4, body: float = 12.0, extremity: float = 8.0, rate: float = 30.0) -> np.ndarray:
    from trackframe.operators.smoothing import joint_cutoffs

    per_joint = joint_cutoffs(body, extremity)
    limit = np.array([per_joint[j] for j in range(JOINT_COUNT) for _ in range(3)] + [per_joint[j] for j in range(JOINT_COUNT) for _ in range(6)] + [body] * 6)
    out = x.copy()
    for f in (body, extremity):
        out[..., limit == f] = zero_phase(x[..., limit == f], degree, f, rate)
    return out


def smooth_all_rotations(a: dict[str, np.ndarray], alpha: float = 0.3, root_alpha: float = 0.3, window: int = 1, max_step: float = 0.0) -> dict[str, np.ndarray]:
    return a | {
        "rot": smooth_quaternions(a["rot"], alpha, window, max_step),
        "root_rot": smooth_quaternions(a["root_rot"], root_alpha, window, max_step / 2),
    }


def lock_feet(a: dict[str, np.ndarray], fast: float = 2.0, high: float = 5.0, alpha: float = 0.1, ground: float = 0.0, fps: float = 30.0) -> dict[str, np.ndarray]:
    """While a foot is slow and low it is drawn to where it touched down, and its toe to the ground."""
    pos = a["pos"].copy()
    if len(pos) < 2:
        return a
    for side in ("Left", "Right"):
        foot, toe = JOINT[f"{side}Foot"], JOINT[f"{side}ToeBase"]
        path = a["pos"][..., foot, :]
        speed = np.zeros(path.shape[:-1])
        speed[1:] = np.linalg.norm(np.diff(path, axis=0), axis=-1) * fps
        down = (speed < fast) & (path[..., 1] - ground < high)
        blend, held = down[0].astype(float), path[0].copy()
        for t in range(len(pos)):
            if t:
                blend = blend + (down[t] - blend) * alpha
                held = np.where((down[t] & ~down[t - 1])[..., None], path[t], held)
            goal = np.stack([held[..., 0], np.full_like(held[..., 0], ground), held[..., 2]], -1)
            moved = pos[t, ..., foot, :] * (1 - blend)[..., None] + goal * blend[..., None]
            lifted = ground + np.maximum(0.0, pos[t, ..., toe, 1] - moved[..., 1]) * (1 - blend)
            pos[t, ..., foot, :] = np.where(down[t][..., None], moved, pos[t, ..., foot, :])
            pos[t, ..., toe, 1] = np.where(down[t], lifted, pos[t, ..., toe, 1])
    return a | {"pos": pos}


def to_canonical(a: dict[str, np.ndarray], fps: float = 30.0) -> dict[str, np.ndarray]:
    """Frames rebuilt from their canonical motion, with steady limb lengths."""
    c = canonical(a["pos"], a["rot"], fps)
    pos = forward_kinematics(c["root_pos"], c["root_rot"], c["local_rot"], c["local_pos"])
    return a | {"pos": pos, "rot": c["local_rot"], "root_rot": c["root_rot"], "root_vel": c["root_vel"]}


# Frames from persons


def frames_from_persons(persons: DataFrame, by: Names = ("track_id",), fps: float = 30.0) -> DataFrame:
    """Skeleton frames of tracked persons (track_id, frame_idx, ts, kp3d): joints on key points, rotations by inverse kinematics, root velocities."""
    rows = persons.select(
        *by, F.col("frame_idx").alias("source_frame"), "ts", joint_positions(F.col("kp3d")).alias("_p"), joint_confidences(F.col("kp3d")).alias("_c")
    )
    fields = [f for f in rows.select(*by).schema if f.name not in FRAMES.fieldNames()]
    schema = T.StructType([*fields, *(T.StructField("track_id", T.LongType()) if f.name == "track_id" else f for f in FRAMES)])

    def run(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values("source_frame", kind="stable").reset_index(drop=True)
        n = len(track)
        pos = np.array([[[j[a] for a in "xyz"] for j in r] for r in track["_p"]], float).reshape(n, JOINT_COUNT, 3)
        root, turn, local = inverse_kinematics(pos)
        zero = np.zeros((n, 3))
        a = {"root_pos": root, "root_rot": turn, "root_vel": zero, "root_ang_vel": zero, "pos": pos, "rot": local, "conf": np.array(track["_c"].tolist(), float).reshape(n, JOINT_COUNT)}
        out = pack(track.assign(frame_idx=np.arange(n, dtype="int32")), a)
        return out[[f.name for f in schema]]

    made = rows.groupBy(*by).applyInPandas(run, schema)
    made = root_velocity(made, by, ["frame_idx"], fps=fps)
    return root_angular_velocity(made, by, ["frame_idx"], fps=fps)


# Limits and retargeting

#: Least and greatest angle of each joint about x, y, z in degrees.
JOINT_LIMITS = (
    ((-60, 60), (-60, 60), (-60, 60)), ((-30, 60), (-30, 30), (-30, 30)), ((-30, 50), (-30, 30), (-30, 30)), ((-30, 40), (-40, 40), (-30, 30)),
    ((-60, 60), (-70, 70), (-40, 40)), ((-50, 50), (-60, 60), (-30, 30)), ((-20, 20), (-10, 10), (-40, 20)), ((-180, 60), (-90, 90), (-90, 90)),
    ((0, 150), (-10, 10), (-90, 90)), ((-70, 70), (-30, 30), (-80, 80)), ((-20, 20), (-10, 10), (-20, 40)), ((-180, 60), (-90, 90), (-90, 90)),
    ((0, 150), (-10, 10), (-90, 90)), ((-70, 70), (-30, 30), (-80, 80)), ((-120, 30), (-45, 45), (-45, 45)), ((0, 150), (-10, 10), (-10, 10)),
    ((-40, 50), (-20, 30), (-20, 20)), ((-30, 60), (-10, 10), (-10, 10)), ((-120, 30), (-45, 45), (-45, 45)), ((0, 150), (-10, 10), (-10, 10)),
    ((-40, 50), (-20, 30), (-20, 20)), ((-30, 60), (-10, 10), (-10, 10)),
)


def limit_joints(frames: DataFrame, joints: str = "joints") -> DataFrame:
    """Joint angles within their limits, with the rotations that follow from them."""
    table = F.array(*(F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in axes)) for axes in JOINT_LIMITS))

    def one(j: Column, k: Column) -> Column:
        limits = F.get(table, k)
        e = g.vec3(*(F.least(F.greatest(j["euler"][a], F.get(F.get(limits, F.lit(i)), F.lit(0))), F.get(F.get(limits, F.lit(i)), F.lit(1))) for i, a in enumerate("xyz")))

        def made(q: Column) -> Column:
            return F.struct(q.alias("rot"), e.alias("euler"), g.quat_to_rot6d(q).alias("rot6d"), j["pos"].alias("pos"), j["conf"].alias("conf"))

        return g.let(made, g.euler_to_quat(e))

    return frames.withColumn(joints, F.transform(joints, one))


def clamp_euler(e: Column, joint: str) -> Column:
    (ax, bx), (ay, by_), (az, bz) = JOINT_LIMITS[JOINT[joint]]
    return g.vec3(g.clamp(e.x, ax, bx), g.clamp(e.y, ay, by_), g.clamp(e.z, az, bz))


def retarget(frames: DataFrame, scale: float = 1.0, keep_root: bool = True, joint_scale: dict[str, float] | None = None, joints: str = "joints") -> DataFrame:
    """Root path scaled (or taken out) and the places of some joints scaled, for another skeleton."""
    zero = g.vec3(0, 0, 0)
    root = {c: g.scale(F.col(c), scale) if keep_root else zero for c in ("root_pos", "root_vel")}
    sizes = F.array(*(F.lit(float((joint_scale or {}).get(n, 1.0))) for n in JOINT_NAMES))

    def one(j: Column, k: Column) -> Column:
        return j.withField("pos", g.scale(j["pos"], F.get(sizes, k)))

    return frames.withColumns({**root, joints: F.transform(joints, one)})


def ground_feet(points: DataFrame, by: Names, order: Names, fast: float = 2.0, high: float = 5.0, fps: float = 30.0) -> DataFrame:
    """Points (x, y, z) of a foot that hardly moves and is low stand on the ground (y = 0); the first row of a track stays."""
    w = over(by, order)
    step = [F.col(c) - F.lag(c).over(w) for c in "xyz"]
    speed = F.sqrt(sum((d * d for d in step), F.lit(0.0))) * fps
    return points.withColumn("_s", speed).withColumn("y", F.when((F.col("_s") < fast) & (F.col("y") < high), 0.0).otherwise(F.col("y"))).drop("_s")


def local_rotations(world: Column) -> Column:
    """World rotations of 22 joints to rotations relative to the parents; the root's stays."""
    parents = F.array(*map(F.lit, JOINT_PARENT))

    def one(q: Column, k: Column) -> Column:
        p = F.get(parents, k)
        return F.when(p < 0, q).otherwise(g.q_normalized(g.q_mul(g.q_conjugate(F.get(world, F.greatest(p, F.lit(0)))), q)))

    return F.transform(world, one)


def fk_column(root_pos: Column, root_rot: Column, local: Column) -> Column:
    """World places of the joints as one expression: a fold over the skeleton, parents first."""
    parents, offsets = F.array(*map(F.lit, JOINT_PARENT)), F.array(*(g.vec3(*o) for o in REST_OFFSETS))
    first = F.array(F.struct(g.q_mul(root_rot, F.get(local, F.lit(0))).alias("q"), g.vec3(root_pos.x, root_pos.y, root_pos.z).alias("p")))

    def step(done: Column, k: Column) -> Column:
        def placed(up: Column) -> Column:
            return F.struct(g.q_mul(up["q"], F.get(local, k)).alias("q"), g.add(up["p"], g.q_rotate(up["q"], F.get(offsets, k))).alias("p"))

        return F.array_append(done, F.get(F.transform(F.array(F.get(done, F.get(parents, k))), placed), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(JOINT_COUNT - 1)), first, step, lambda done: F.transform(done, lambda d: d["p"]))


def blend_frames(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Rotations between two sets, along the arc."""
    return slerp_np(a, b, t)


