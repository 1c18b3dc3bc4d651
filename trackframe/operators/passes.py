"""Numbers of a frame that labels and clip measures are made of, from arrays of whole tracks: frames in, a few plain columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackframe.operators import skeleton as sk
from trackframe.operators.clips import LIMBS, PARTS
from trackframe.operators.segments import MEASURES
from trackframe.operators.skeleton import Arrays
from trackframe.operators.windows import Names
from trackframe.schema import JOINT

#: What ``clips.measures`` needs of a frame, beside the array ``limbs``.
CLIP_COLUMNS = ("vx", "vy", "vz", "rw", "rx", "ry", "rz", "y", "conf", "conf_n", "least_conf", "jitter", "knee", "hip", "arm", "foot")


def length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(v[..., 0] * v[..., 0] + v[..., 1] * v[..., 1] + v[..., 2] * v[..., 2])


def near(x: np.ndarray, first: int, last: int) -> Iterator[np.ndarray]:
    """The row that is ``first`` away, and so on to ``last``; NaN, which stands for null, beyond the ends."""
    n = len(x)
    for k in range(first, last + 1):
        out = np.full(x.shape, np.nan)
        out[max(0, -k) : max(0, n - k)] = x[max(0, k) : max(0, n + k)]
        yield out


def total(x: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of a window's values, added up in order."""
    s, n = np.zeros(x.shape), np.zeros(x.shape)
    for row in near(x, first, last):
        there = ~np.isnan(row)
        s += np.where(there, row, 0.0)
        n += there
    return s, n


def mean(x: np.ndarray, first: int, last: int) -> np.ndarray:
    s, n = total(x, first, last)
    return np.where(n > 0, s / np.maximum(n, 1), np.nan)


def greatest(x: np.ndarray, first: int, last: int) -> np.ndarray:
    return reduce(np.fmax, near(x, first, last))


def least(x: np.ndarray, first: int, last: int) -> np.ndarray:
    return reduce(np.fmin, near(x, first, last))


def label_measures(a: Arrays, euler: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """MEASURES of the window around each frame, as ``segments.label_windows`` takes them; limbs as in ``clips.part_activity``."""
    half = width // 2
    frame, wide = (-half, half - 1), (-half, half)
    vel, turn, height = a["root_vel"], a["root_ang_vel"], a["root_pos"][..., 1]
    speed, at = length(vel), np.arange(len(vel))
    first, last = np.maximum(at - half, 0), np.minimum(at + half - 1, len(at) - 1)
    steps = (last - first).reshape(-1, *[1] * (speed.ndim - 1))
    yaw, count = total(turn[..., 1], *frame)
    out = {
        "speed": mean(speed, *frame),
        "max_speed": greatest(speed, *frame),
        "turn": mean(length(turn), *frame),
        "yaw": np.where(count > 0, yaw, np.nan),
        "accel": np.where(steps > 0, (speed[last] - speed[first]) / np.maximum(steps, 1), 0.0),
        "vertical": mean(np.abs(vel[..., 1]), *frame),
        "lateral": mean(np.abs(vel[..., 0]), *frame),
        "height_range": np.fmax(greatest(height, *frame), 0.0) - least(height, *frame),
    }
    turned = np.full(euler.shape[:-1], np.nan)
    turned[1:] = length(euler[1:] - euler[:-1])
    for limb in ("left_leg", "right_leg", "left_arm", "right_arm"):
        activity = sum(turned[..., j] for j in PARTS[limb]) / len(PARTS[limb])
        out[limb] = np.nan_to_num(mean(activity, -half + 1, half))
    for arm in ("left_arm", "right_arm"):
        angles = euler[..., list(PARTS[arm]), :]
        spans = greatest(angles, *wide) - least(angles, *wide)
        out[f"{arm}_rom"] = sum(spans[..., j, k] for j in range(spans.shape[-2]) for k in range(3)) / len(PARTS[arm])
    return out


def clip_columns(a: Arrays, euler: np.ndarray) -> dict[str, np.ndarray]:
    """CLIP_COLUMNS and ``limbs``: how far the joint that shakes most is from the middle of its neighbours in time, limb lengths, bends."""
    pos, conf = a["pos"], a["conf"]
    shake = np.full(pos.shape[:-2], np.nan)
    shake[1:-1] = np.fmax.reduce(length(pos[1:-1] - (pos[:-2] + pos[2:]) / 2), axis=-1)
    bent = length(euler)

    def both(name: str) -> np.ndarray:
        return (bent[..., JOINT[f"Left{name}"]] + bent[..., JOINT[f"Right{name}"]]) / 2

    there = ~np.isnan(conf)
    out = {f"v{c}": a["root_vel"][..., k] for k, c in enumerate("xyz")} | {f"r{c}": a["root_rot"][..., k] for k, c in enumerate("wxyz")}
    return out | {
        "y": a["root_pos"][..., 1],
        "conf": np.where(there, conf, 0.0).sum(-1),
        "conf_n": there.sum(-1).astype(float),
        "least_conf": np.fmin.reduce(conf, axis=-1),
        "jitter": shake,
        "knee": both("Leg"), "hip": both("UpLeg"), "arm": both("Arm"),
        "foot": pos[..., JOINT["LeftFoot"], 1],
        "limbs": np.stack([length(pos[..., q, :] - pos[..., p, :]) for p, q in LIMBS], -1),
    }


def measured(frames: DataFrame, by: Names, change: Callable[[Arrays], Arrays] | None, width: int = 10, least: int = 1, order: str = "frame_idx") -> DataFrame:
    """Key, ``order``, MEASURES, CLIP_COLUMNS and ``limbs`` of the frames after ``change``, without those of tracks of under ``least`` frames."""

    def columns(a: Arrays) -> dict[str, pa.Array]:
        euler = sk.q_euler(a["rot"])
        cells = {f"m_{k}": x for k, x in label_measures(a, euler, width).items()} | clip_columns(a, euler)
        limbs = sk.lists(sk.numbers(cells.pop("limbs")), len(LIMBS))
        return {k: sk.numbers(x) for k, x in cells.items()} | {"limbs": limbs}

    schema = T.StructType([*frames.select(*by, order).schema])
    for name in (*(f"m_{k}" for k in MEASURES), *CLIP_COLUMNS):
        schema = schema.add(name, T.DoubleType())
    schema = schema.add("limbs", T.ArrayType(T.DoubleType()))
    return sk.over_tracks(frames, by, [*by, order], change or (lambda a: a), columns, schema, order, least)
