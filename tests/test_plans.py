import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe import models
from trackframe.operators import aggregates, clips, clustering, segments, windows
from trackframe.plans import config as settings
from trackframe.plans import match, signals
from trackframe.plans.database import ClipDatabase
from trackframe.schema import COCO_COUNT, JOINT, MOTION, joints, motion_types
from trackframe.sources import readers, writers


def test_config_round_trip(tmp_path):
    c = settings.parse('{"fps": 25, "signal": {"savgol": false}, "tracker": {"weights": [1, 0, 0]}, "unknown": 1, "clip": 3}')
    assert c.fps == 25 and not c.signal.savgol and c.signal.butterworth and c.tracker.weights == (1, 0, 0) and c.clip.min_seconds == 0.5
    assert settings.parse(settings.dump(c)) == c and settings.parse("") is None and settings.parse("[1]") is None
    assert settings.save(c, str(tmp_path / "a.json")) and settings.load(str(tmp_path / "a.json")) == c
    assert settings.load(str(tmp_path / "none.json")) is None and not settings.save(c, str(tmp_path / "no" / "a.json"))


def test_stages_can_be_left_out():
    names = [n for n, _ in signals.stages(settings.SignalConfig())]
    assert names == ["outliers", "savgol", "butterworth", "rotations", "foot_contact"]
    assert [n for n, _ in signals.stages(settings.SignalConfig(savgol=False, rotations=False))] == ["outliers", "butterworth", "foot_contact"]


def test_signal_stages_clean_noise(spark):
    clean = readers.walker(spark, 60, 120.0)
    noisy = readers.spike(readers.noisy(clean, 2.0), 30, JOINT["Head"])
    out = signals.process(noisy, config=settings.SignalConfig(foot_contact=False)).orderBy("frame_idx").collect()

    def off(rows):
        truth = clean.orderBy("frame_idx").collect()
        return np.mean([abs(a.joints[5].pos.y - b.joints[5].pos.y) for a, b in zip(rows, truth)])

    assert len(out) == 60 and off(out) < 0.5 * off(noisy.orderBy("frame_idx").collect())
    assert signals.process(clean, config=settings.SignalConfig(False, False, False, False, False)) is clean


@pytest.fixture(scope="module")
def built(spark):
    ahead = [(0.0, 90.0)]  # along z: a fast walk along x is a slide
    frames = readers.walker(spark, 120, 60.0, speeds=[(0.5, 600.0)], turns=ahead).unionByName(readers.walker(spark, 60, 200.0, track=2, turns=ahead))
    c = settings.Config(cluster=settings.ClusterConfig(k=2, iterations=3))
    smooth, found, ranges = match.build(frames, c)
    return c, smooth, found, match.database(smooth, ranges, c)


def test_segments_of_a_change_of_pace(built):
    _, smooth, found, _ = built
    rows = found.where("track_id = 1").orderBy("start_frame").collect()
    assert rows[0].type == MOTION["Walk"] and rows[-1].type == MOTION["Sprint"] and rows[0].start_frame == 0 and rows[-1].end_frame == 119
    assert all(a.end_frame + 1 == b.start_frame for a, b in zip(rows, rows[1:]))
    assert {"left_contact", "trajectory"} <= set(smooth.columns) and len(smooth.first().trajectory) == 3


def test_database(built, spark, tmp_path):
    c, _, _, db = built
    rows = db.clips.collect()
    assert rows and all(x.accepted for x in rows) and {x.player_id for x in rows} == {1, 2} and all(0 <= x.cluster < 2 for x in rows)
    assert db.by_player(2).count() + db.by_player(1).count() == len(rows) and db.by_type("Sprint").count() >= 1
    stats = db.stats().first()
    assert stats.total_clips == len(rows) and stats.unique_players == 2
    assert sum(x.n for x in db.counts().collect()) == len(rows)
    assert json.loads(db.summary().first().json)["totalClips"] == len(rows)
    assert db.similar(list(rows[0].vector), 1).first().clip_id == rows[0].clip_id
    db.views("t_")
    assert spark.sql("SELECT count(*) FROM t_clips").first()[0] == len(rows)
    assert db.add(ClipDatabase(db.clips.limit(1), db.frames.limit(1))).clips.count() == len(rows) + 1
    assert db.accepted().frames.count() == db.frames.count()
    path = str(tmp_path / "db")
    assert db.export(path) == len(rows)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/bvh").select("path").collect()
    assert len([f for f in files if "stem=clip_0000" in f.path]) == 1 and len(files) == len(rows)
    assert writers.directories(spark).count() == 16


def test_analyse_persons(spark):
    rows = []
    for k in range(60):
        for d in range(2):
            x = 100 + k * 5.0 if d == 0 else 900 - k * 3.0
            kp = [(x / 1920 + (p % 2) * 0.02, 0.2 + 0.03 * p, 0.9) for p in range(COCO_COUNT)]
            rows.append(("v", k, (k + 1) / 30, d, d, (x, 100.0, 60.0, 160.0, 0.9), kp))
    df = spark.createDataFrame(
        rows, "video string, frame_idx int, ts double, det_idx int, person_id int, bbox struct<x:double,y:double,w:double,h:double,conf:double>, kp2d array<struct<x:double,y:double,conf:double>>"
    )
    from trackframe.operators.skeleton import lift

    df = df.withColumn("kp3d", F.transform(lift(F.col("kp2d")), lambda p: p.withField("x", p["x"] + F.col("bbox.x") / 4)))
    c = settings.Config(cluster=settings.ClusterConfig(enabled=False), signal=settings.SignalConfig(foot_contact=False))
    tracked = match.analyse(df, c)
    plain = match.analyse(df, settings.overlay(c, {"track": False}))
    assert tracked.clips.select("player_id").distinct().count() == plain.clips.select("player_id").distinct().count() == 2


def test_resample_doubles_the_rate(spark):
    frames = readers.walker(spark, 31, 90.0).select("track_id", "frame_idx", F.col("root_pos.x").alias("x"), "root_rot")
    out = windows.resample(frames, ["track_id"], "frame_idx", 30.0, 60.0, ["x"], ["root_rot"]).orderBy("frame_idx").collect()
    assert len(out) == 61 and out[1].x == pytest.approx(1.5) and out[60].x == pytest.approx(90) and out[7].root_rot.w == 1
    seg = spark.createDataFrame([(0, 15, 61)], "start_frame int, end_frame int, n_frames int")
    assert clips.resample_segments(seg, 30, 60).first().end_frame == 30


def test_kmeans(spark):
    r = np.random.default_rng(1)
    rows = [(k, float(r.normal(10 * (k % 3))), float(k % 3)) for k in range(90)]
    members, info = clustering.cluster(spark.createDataFrame(rows, "clip_id long, a double, b double"), "clip_id", ["a", "b"], 3)
    found = {x.clip_id: x.cluster for x in members.collect()}
    assert all(len({found[k] for k in range(j, 90, 3)}) == 1 for j in range(3)) and {x.label for x in info.collect()} == {"cluster_01", "cluster_02", "cluster_03"}
    empty = clustering.lloyd(spark.createDataFrame([(k, [0.0, 0.0]) for k in range(3)], "k int, v array<double>"), "k", "v", 2)
    assert empty.count() == 2


def test_probabilities_and_masks(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8]), (1, [0.6, 0.4]), (2, [0.5, 0.5])], "clip int, p array<double>")
    out = {x.clip: x for x in segments.mean_probabilities(df, ["clip"], "p").collect()}
    assert out[1].label == 1 and out[1].confidence == pytest.approx(0.6) and out[2].label == 0
    masks = aggregates.pair_masks(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, l string"), "k", "l").collect()
    assert {(x.anchor, x.positives, x.negatives) for x in masks} == {(1, 1, 1), (2, 1, 1), (3, 0, 2)}


def test_losses(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [0.0, 1.0])], "k int, l string, e array<double>")
    anchors = aggregates.contrastive(df, "k", "l", "e", smoothing=0.1)
    batch = aggregates.batch_loss(anchors).first()
    assert batch.anchors_with_positives == 2 and batch.positive_pairs == 2 and batch.loss > 0 and batch.hardest_positive > batch.hardest_negative
    assert aggregates.batch_loss(aggregates.contrastive(df, "k", "l", "e", margin=0.2)).first().loss < 0.01
    assert aggregates.batch_loss(aggregates.contrastive(df.where("k = 1"), "k", "l", "e")).first().loss == 0
    assert {x.triplet for x in aggregates.triplet_loss(anchors).collect()} == {0.0}


def test_model_hook(spark):
    df = spark.createDataFrame([(k, [[float(k)] * 3] * (k + 1)) for k in range(10)], "k int, x array<array<double>>")
    out = models.infer(df, "x", lambda: lambda a: a.sum(axis=(1, 2))[:, None], batch=4).orderBy("k").collect()
    assert [x.output[0] for x in out] == [3.0 * k * (k + 1) for k in range(10)]
    flat = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert models.infer(flat, "v", lambda: lambda a: a * 2).first().output == [2.0, 4.0]


def test_windows_and_dimensions(spark):
    df = spark.createDataFrame([(t, k, k / 10) for t, n in ((1, 70), (2, 15), (3, 16), (4, 32)) for k in range(n)], "t int, frame_idx int, v double")
    count = {s: {x.t: x["count"] for x in segments.sliding(df, ["t"], "frame_idx", 32, 16, s).groupBy("t").count().collect()} for s in ("drop", "half", "pad")}
    assert count == {"drop": {1: 3, 4: 1}, "half": {1: 4, 3: 1, 4: 1}, "pad": {1: 4, 2: 1, 3: 1, 4: 1}}
    assert motion_types(spark).count() == 16 and joints(spark).where("parent is null").count() == 1
    ranges = spark.createDataFrame([(1, 0, 2, 300), (1, 1, 65, 66)], "t int, clip_idx int, start_frame int, end_frame int")
    got = segments.frames_of(df, ranges, ["t"], block=8).groupBy("clip_idx").agg(F.count("*"), F.min("frame_idx")).collect()
    assert {tuple(x) for x in got} == {(0, 68, 0), (1, 2, 0)}


def test_command_line(tmp_path, spark):
    from trackframe.__main__ import main

    assert main(["config"]) == 0 and main(["config", str(tmp_path / "none")]) == 1
    spark.createDataFrame([(k, [float(k == j) for j in range(4)]) for k in range(4)], "clip_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    assert main(["index", str(tmp_path / "v"), str(tmp_path / "i")]) == 0 and main(["search", str(tmp_path / "i"), "[1, 0, 0, 0]", "-k", "2"]) == 0
    spark.createDataFrame([("Walk", 1, 30, 1.0)], "motion_type string, player_id int, n_frames int, duration_sec double").write.parquet(str(tmp_path / "c"))
    assert main(["stats", str(tmp_path / "c")]) == 0 and main(["analyse", "x", "y", "--dry-run"]) == 0


def test_library_does_not_need_the_optional_subpackage(tmp_path):
    """Without trackframe/llm and corpus_pipeline.py everything else imports."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "trackframe", tmp_path / "trackframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'merge_short' in n and 'pipeline' not in n and not any(x.startswith('op') and x[2].isdigit() for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
