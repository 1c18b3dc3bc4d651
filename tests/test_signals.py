import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import scan, segments, smoothing, windows
from trackframe.operators import skeleton as sk


def channel(spark, x, track=1):
    return spark.createDataFrame([(track, k, float(v)) for k, v in enumerate(x)], "track int, frame_idx int, value double")


def run(df, col="value"):
    return [r[col] for r in df.orderBy("track", "frame_idx").collect()]


def test_outliers(spark):
    x = np.full(50, 10.0)
    x[25] = 1000
    for mode in ("median", "interpolate", "clamp"):
        out = smoothing.mad_outliers(channel(spark, x), ["track"], ["frame_idx"], "value", replace=mode)
        assert run(out) == pytest.approx([10.0] * 50) and run(out, "is_outlier").count(True) == 1
    ramp = smoothing.mad_outliers(channel(spark, np.arange(30)), ["track"], ["frame_idx"], "value")
    assert run(ramp) == pytest.approx(list(range(30)))
    short = smoothing.mad_outliers(channel(spark, [0, 0, 900, 0]), ["track"], ["frame_idx"], "value")
    assert run(short) == [0, 0, 900, 0]
    r = np.random.default_rng(3)
    noise = r.normal(size=80) + (r.random(80) < 0.1) * 40
    for mode in ("median", "interpolate", "clamp"):
        out = smoothing.mad_outliers(channel(spark, noise), ["track"], ["frame_idx"], "value", replace=mode)
        assert run(out) == pytest.approx(sk.mad_clean(noise[:, None], mode=mode)[:, 0].tolist())


def test_savgol(spark):
    c = smoothing.savgol_coefficients(7, 3)
    assert sum(c) == pytest.approx(1) and c == pytest.approx(c[::-1])
    x = np.sin(np.arange(100) / 8) + np.random.default_rng(1).normal(scale=0.1, size=100)
    out = run(smoothing.savgol(channel(spark, x), ["track"], ["frame_idx"], "value"))
    assert np.mean((np.array(out) - np.sin(np.arange(100) / 8)) ** 2) < 0.02
    assert out == pytest.approx(sk.savgol_clean(x[:, None])[:, 0].tolist())
    for n in (1, 2, 3, 4, 5, 6, 7, 8):
        y = np.arange(n) ** 2.0
        got = run(smoothing.savgol(channel(spark, y), ["track"], ["frame_idx"], "value"))
        assert got == pytest.approx(sk.savgol_clean(y[:, None])[:, 0].tolist())
    assert run(smoothing.savgol(channel(spark, [42.0] * 20), ["track"], ["frame_idx"], "value")) == pytest.approx([42.0] * 20)


def test_butterworth(spark):
    b, a = smoothing.butterworth(4, 5.0, 30.0)
    assert b.sum() / a.sum() == pytest.approx(1) and np.abs(np.roots(a)).max() < 1
    w = np.exp(-1j * 2 * np.pi * 5 / 30)
    assert abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w)) == pytest.approx(np.sqrt(0.5))
    step = np.repeat([0.0, 1.0], 50)
    out = run(smoothing.butterworth_filter(channel(spark, step), ["track"], ["frame_idx"], ["value"], cutoff=5.0))
    assert abs(out[0]) < 0.1 and abs(out[-1] - 1) < 0.1 and -0.1 < out[50] < 1.1
    assert smoothing.zero_phase(np.full(40, 7.5), 4, 5.0, 30.0) == pytest.approx(np.full(40, 7.5))
    assert smoothing.zero_phase(np.arange(2.0), 4, 5.0, 30.0).tolist() == [0, 1] and (smoothing.zero_phase(step, 4, 20.0, 30.0) == step).all()


def test_quaternion_smoothing(spark):
    r = np.random.default_rng(2)
    angle = np.cumsum(r.normal(scale=0.05, size=60))
    q = np.stack([np.cos(angle / 2), 0 * angle, np.sin(angle / 2), 0 * angle], 1)
    q[::7] *= -1
    for options in ({}, {"window": 5}, {"max_step": 1.0}):
        out = smoothing.smooth_quaternions(q, **options)
        assert np.allclose(np.linalg.norm(out, axis=1), 1) and ((out[1:] * out[:-1]).sum(1) > 0).all()
        assert smoothing.angular_step(out).mean() < smoothing.angular_step(smoothing.same_hemisphere(q)).mean()
    limited = smoothing.smooth_quaternions(q, 0.0, max_step=1.0)
    assert smoothing.angular_step(limited).max() <= 1.0 + 1e-4
    df = spark.createDataFrame([(1, k, tuple(map(float, x))) for k, x in enumerate(q)], "track int, frame_idx int, q struct<w:double,x:double,y:double,z:double>")
    got = smoothing.smooth_rotations(df, ["track"], ["frame_idx"], "q").orderBy("frame_idx").collect()
    assert np.allclose([[x.q[n] for n in "wxyz"] for x in got], smoothing.smooth_quaternions(q))
    assert smoothing.roughness(df, ["track"], ["frame_idx"], "q").first().jumps == 0


def test_recurrence_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = channel(spark, range(50)).unionByName(channel(spark, range(30), 2))
        out = smoothing.ema(df, ["track"], ["frame_idx"], "value", 0.5)
        y = 0.0
        expected = []
        for x in range(50):
            y += 0.5 * (x - y)
            expected.append(y)
        assert run(out, "ema") == expected + expected[:30]
        assert scan.recurrence(df.limit(0), ["track"], ["frame_idx"], ["value"], "o", "double", lambda s, r: (s, 0.0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_foot_lock_holds_the_place(spark):
    rows = [(1, k, float(k), 3.0, k in (3, 4, 5), 1.0) for k in range(8)]
    df = spark.createDataFrame(rows, "track int, frame_idx int, x double, y double, down boolean, blend double")
    out = windows.foot_lock(df, ["track"], ["frame_idx"], "down", "blend", ["x"], "y").orderBy("frame_idx").collect()
    assert [r.x for r in out] == [0, 1, 2, 3, 3, 3, 6, 7] and [r.y for r in out] == [3, 3, 3, 0, 0, 0, 3, 3]


def test_segments_cover_all_rows(spark):
    r = np.random.default_rng(4)
    labels = np.repeat(r.integers(0, 4, 40), r.integers(1, 9, 40))
    df = spark.createDataFrame([(1, k, int(v), 1.0) for k, v in enumerate(labels)], "track int, frame_idx int, label int, m double")
    stats = segments.run_stats(segments.runs(df, ["track"], ["frame_idx"], "label"), ["track"], "label", means=["m"])
    for least in (1, 4, 12):
        merged = segments.merge_short(stats, ["track"], least, means=["avg_m"]).orderBy("start_frame").collect()
        assert merged[0].start_frame == 0 and merged[-1].end_frame == len(labels) - 1 and sum(x.n_frames for x in merged) == len(labels)
        assert all(a.end_frame + 1 == b.start_frame for a, b in zip(merged, merged[1:])) and all(x.n_frames >= least for x in merged[1:])
        # the fold that it stands for
        fold = []
        for x in stats.orderBy("start_frame").collect():
            if x.n_frames < least and fold:
                fold[-1][1] = x.end_frame
            else:
                fold.append([x.start_frame, x.end_frame, x.label])
        assert [[x.start_frame, x.end_frame, x.label] for x in merged] == fold


def test_vote_averages_overlaps(spark):
    df = spark.createDataFrame([(1, 0, [[0.0, 2.0], [0.0, 0.0]]), (1, 1, [[4.0, 0.0], [1.0, 1.0]])], "track int, start int, logits array<array<double>>")
    out = {x.frame_idx: x for x in segments.vote(df, ["track"], "start", "logits").collect()}
    assert (out[0].label, out[1].label, out[2].label) == (1, 0, 0) and out[1].probabilities[0] == pytest.approx(1 / (1 + np.exp(-2)))


def test_window_rules(spark):
    def label(**m):
        base = dict.fromkeys(segments.MEASURES, 0.0) | m
        return spark.range(1).select(segments.window_label({k: F.lit(float(x)) for k, x in base.items()}).alias("l")).first().l

    from trackframe.schema import MOTION

    cases = {
        "Idle": {}, "Walk": {"speed": 50}, "Jog": {"speed": 200}, "Sprint": {"speed": 600}, "Jump": {"speed": 50, "height_range": 20, "vertical": 40},
        "Slide": {"speed": 150, "lateral": 120}, "TurnLeft": {"speed": 20, "turn": 100, "yaw": 5}, "TurnRight": {"speed": 20, "turn": 100, "yaw": -5},
        "Decelerate": {"speed": 200, "accel": -300, "max_speed": 400}, "Kick": {"speed": 50, "left_leg": 60, "right_leg": 10},
        "Shield": {"speed": 20, "left_arm": 30, "right_arm": 30}, "Tackle": {"speed": 150, "left_leg": 60, "right_leg": 10, "height_range": 12},
        "Receive": {"speed": 20, "left_arm": 34, "right_arm": 14}, "Celebrate": {"speed": 100, "left_arm": 50, "right_arm": 30, "left_leg": 6, "right_leg": 6},
        "Goalkeeper": {"speed": 20, "left_arm_rom": 50, "right_arm_rom": 50, "left_leg": 15, "right_leg": 15},
    }
    for name, m in cases.items():
        assert label(**m) == MOTION[name], name
    frame = [segments.frame_label(*map(F.lit, x)) for x in ((0.0, 300.0, 0.0, 0.0), (0.0, 0.0, -400.0, 0.0), (0.0, 0.0, 0.0, -95.0), (300.0, 0.0, 0.0, 0.0))]
    row = spark.range(1).select(*(f.alias(str(k)) for k, f in enumerate(frame))).first()
    assert list(row) == [MOTION[n] for n in ("Jump", "Decelerate", "TurnLeft", "Jog")]


def test_blocks_for_models():
    import pandas as pd

    parts = [pd.DataFrame({"a": range(k)}) for k in (3, 5, 1, 8)]
    assert [len(b) for b in smoothing.batches_of(iter(parts), 8)] == [8, 8, 1]
    assert len(smoothing.channels()) == 204
