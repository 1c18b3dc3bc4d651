import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import association, clips, search
from trackframe.operators import skeleton as sk
from trackframe.schema import COCO, JOINT, JOINT_PARENT, MIRRORED, MOTION
from trackframe.sources import readers, writers


def rest(n=5):
    still = np.tile([1.0, 0, 0, 0], (n, 22, 1))
    return sk.forward_kinematics(np.tile([0.0, 90, 0], (n, 1)), still[:, 0], still)


def test_kinematics_round_trip():
    r = np.random.default_rng(1)
    local = sk.q_unit(np.concatenate([np.ones((20, 22, 1)), r.normal(scale=0.2, size=(20, 22, 3))], -1))
    local[:, 0] = [1, 0, 0, 0]
    root = sk.q_unit(r.normal(size=(20, 4)))
    pos = sk.forward_kinematics(r.normal(size=(20, 3)) * 50, root, local)
    p, q, back = sk.inverse_kinematics(pos)
    again = sk.forward_kinematics(p, q, back)
    # hips and their children have one rotation for three bones, so those above and below follow exactly
    spine = [JOINT[n] for n in ("Hips", "Spine")]
    assert np.allclose(again[:, spine], pos[:, spine], atol=1e-6)
    for j, parent in enumerate(JOINT_PARENT):
        if parent >= 0:
            assert np.allclose(np.linalg.norm(again[:, j] - again[:, parent], axis=1), np.linalg.norm(pos[:, j] - pos[:, parent], axis=1))
    turned = sk.inverse_kinematics(rest())
    assert np.allclose(np.abs(turned[1][:, 0]), 1)


def test_fold_is_the_same_as_numpy(spark):
    r = np.random.default_rng(2)
    local, root = sk.q_unit(r.normal(size=(3, 22, 4))), sk.q_unit(r.normal(size=(3, 4)))
    rows = [(k, [dict(zip("wxyz", x)) for x in local[k].tolist()], dict(zip("wxyz", root[k].tolist()))) for k in range(3)]
    q = "struct<w:double,x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"k int, l array<{q}>, r {q}")
    from trackframe.functions import geometry as g

    out = df.select("k", sk.fk_column(g.vec3(1, 2, 3), F.col("r"), F.col("l")).alias("p")).orderBy("k").collect()
    got = np.array([[[j[a] for a in "xyz"] for j in x.p] for x in out])
    assert np.allclose(got, sk.forward_kinematics(np.tile([1.0, 2, 3], (3, 1)), root, local))


def test_canonical_keeps_the_motion_and_steadies_limbs():
    pos = rest(40)
    pos += np.arange(40)[:, None, None] * np.array([3.0, 0, 0])
    pos[20, JOINT["LeftHand"]] += [30, 0, 0]
    rot = np.tile([1.0, 0, 0, 0], (40, 22, 1))
    c = sk.canonical(pos, rot)
    assert np.allclose(c["root_vel"][1:], [90, 0, 0]) and np.allclose(c["root_vel"][0], 0) and np.allclose(c["yaw_rate"], 0, atol=1e-5)
    hand = np.linalg.norm(c["local_pos"][:, JOINT["LeftHand"]], axis=1)
    assert np.ptp(hand) < 4 and c["limb_lengths"][JOINT["LeftHand"]] == pytest.approx(23)
    a = {"pos": pos, "rot": rot, "root_pos": pos[:, 0], "root_rot": rot[:, 0], "root_vel": c["root_vel"], "root_ang_vel": c["root_vel"] * 0, "conf": np.ones((40, 22))}
    out = sk.to_canonical(a)
    assert np.allclose(out["pos"][:10], pos[:10], atol=1e-6)


def test_flat_normalising_and_gaps():
    kp = np.zeros((6, 17, 3))
    kp[..., 2] = 0.9
    kp[:, COCO["left_hip"], :2], kp[:, COCO["right_hip"], :2] = [-1, 0], [1, 0]
    kp[:, COCO["left_shoulder"], :2], kp[:, COCO["right_shoulder"], :2] = [-1, 4], [1, 4]
    kp[:, COCO["nose"], :2] = np.arange(6)[:, None] * [0.0, 1.0] + [0, 5]
    kp[2:4, COCO["nose"], 2] = 0.1
    kp[5, COCO["left_hip"], 2] = 0.0
    pos, conf, valid = sk.normalise_flat(kp)
    assert valid.tolist() == [True] * 5 + [False] and np.allclose(pos[0, JOINT["Neck"], :2], [0, 1], atol=1e-5)
    assert np.allclose(pos[0, JOINT["Spine1"], 1], 1 / 3, atol=1e-5) and conf[2, JOINT["Head"]] == 0
    filled, c = sk.fill_joints(pos, conf, valid)
    assert np.allclose(filled[:5, JOINT["Head"], 1], (np.arange(5) + 5) / 4, atol=1e-4) and (c[:5, JOINT["Head"]] > 0).all()
    assert (filled[5] == 0).all()


def test_normalised_tracks(spark):
    kp = [(float(p % 2), float(p), 0.9) for p in range(17)]
    df = spark.createDataFrame([(1, k, kp) for k in range(3)], "track_id int, frame_idx int, kp2d array<struct<x:double,y:double,conf:double>>")
    out = sk.normalise_tracks(df, ["track_id"], ["frame_idx"]).collect()
    assert len(out) == 3 and all(x.valid and len(x.positions) == 22 for x in out)


def test_frames_from_persons_and_lift(spark):
    rows = [(1, k, k / 30, [(0.5 + k * 0.01 + (p % 2) * 0.05, 0.2 + p * 0.04, 0.9) for p in range(17)]) for k in range(8)]
    df = spark.createDataFrame(rows, "track_id int, frame_idx int, ts double, kp array<struct<x:double,y:double,conf:double>>")
    df = df.withColumn("kp3d", sk.lift(F.col("kp")))
    first = df.first()
    hip = [(first.kp3d[COCO["left_hip"]][a] + first.kp3d[COCO["right_hip"]][a]) / 2 for a in "xyz"]
    assert hip == pytest.approx([0, 0, 0], abs=1e-9)
    out = sk.frames_from_persons(df).orderBy("frame_idx").collect()
    assert len(out) == 8 and len(out[0].joints) == 22 and out[0].root_vel.x == 0 and out[0].joints[5].conf == 0.9


def test_mirror_twice_is_the_same(spark):
    frames = readers.walker(spark, 6, 120.0)
    twice = clips.mirror(clips.mirror(frames))
    a, b = (x.orderBy("frame_idx").collect() for x in (frames, twice))
    assert [[j.pos for j in r.joints] for r in a] == [[j.pos for j in r.joints] for r in b]
    once = clips.mirror(frames).first()
    assert once.joints[JOINT["LeftHand"]].pos.x == -frames.first().joints[JOINT["RightHand"]].pos.x and MIRRORED[MIRRORED[7]] == 7
    seg = spark.createDataFrame([(MOTION["TurnLeft"],), (MOTION["Walk"],)], "type int")
    assert [x.type for x in clips.mirror_segments(seg).collect()] == [MOTION["TurnRight"], MOTION["Walk"]]


def test_quality_reasons(spark):
    frames = readers.walker(spark, 40, 100.0)
    good = clips.quality(frames, ["track_id"]).first()
    assert good.accepted and good.limb_consistency == pytest.approx(1) and good.rejections == []
    short = clips.quality(frames.where("frame_idx < 10"), ["track_id"]).first()
    assert [x.reason for x in short.rejections] == ["TooShort"]
    spiked = clips.quality(readers.spike(frames, 15, JOINT["Head"]), ["track_id"]).first()
    assert "ExcessiveJitter" in [x.reason for x in spiked.rejections] and spiked.max_jitter == pytest.approx(500 * np.sqrt(3), rel=0.01)
    faint = frames.withColumn("joints", F.transform("joints", lambda j: j.withField("conf", F.lit(0.05))))
    assert {x.reason for x in clips.quality(faint, ["track_id"]).first().rejections} == {"LowConfidence", "MissingJoints"}


def test_fingerprints_find_the_same_speed(spark):
    parts = [readers.walker(spark, 60, s, track=k) for k, s in enumerate((50.0, 100.0, 200.0, 400.0))]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    prints = clips.fingerprint(df, ["track_id"])
    rows = {x.track_id: x for x in prints.collect()}
    assert rows[2].avg_velocity == pytest.approx(200, rel=0.03) and rows[2].duration_sec == 2 and rows[2].vertical_range == 0
    found = search.knn(prints, list(rows[1].vector), 2, "track_id", "vector", "euclidean").collect()
    assert found[0].track_id == 1 and found[0].distance == 0
    one = clips.fingerprint(df.where("frame_idx = 0"), ["track_id"]).first()
    assert one.avg_velocity == 0 and one.frame_count == 1
    feature = clips.cluster_features(df, ["track_id"]).where("track_id = 3").first()
    assert feature.avg_velocity == pytest.approx(400) and feature.avg_turn_rate == pytest.approx(0, abs=1e-4)
    e = clips.fallback_embedding(df, ["track_id"]).first().embedding
    assert len(e) == 128 and np.linalg.norm(e) == pytest.approx(1)


def test_limits_retarget_and_features(spark):
    frames = readers.walker(spark, 4, 120.0)
    wild = frames.withColumn("joints", F.transform("joints", lambda j: j.withField("euler", F.struct(F.lit(500.0).alias("x"), F.lit(-500.0).alias("y"), F.lit(0.0).alias("z")))))
    j = sk.limit_joints(wild).first().joints[JOINT["LeftLeg"]]
    assert (j.euler.x, j.euler.y) == (150, -10)
    moved = sk.retarget(frames, 2.0, joint_scale={"Head": 0.5}).orderBy("frame_idx").collect()[2]
    assert moved.root_pos.x == pytest.approx(16) and moved.joints[JOINT["Head"]].pos.y == pytest.approx(frames.first().joints[JOINT["Head"]].pos.y / 2)
    assert sk.retarget(frames, keep_root=False).first().root_pos.y == 0
    f = frames.select(clips.frame_features(F.col("joints"), F.col("root_vel"), F.col("root_ang_vel")).alias("f"), "track_id", "frame_idx")
    assert len(f.first().f) == 70 and f.first().f[66] == pytest.approx(120 / 800)
    wide = clips.with_deltas(f, ["track_id"], ["frame_idx"], "f").first().extended
    assert len(wide) == 140 and len(clips.style_features(frames, ["track_id"], ["frame_idx"]).first().style_input) == 201
    assert len(frames.select(clips.flat_positions(F.col("joints"), True).alias("p")).first().p) == 132
    back = frames.select(clips.vector_to_joints(clips.skeleton_vector(F.col("joints")), F.col("joints")).alias("j")).first().j
    assert back[3].rot.w == pytest.approx(1) and len(back) == 22


def brute(cost):
    from itertools import permutations

    c = np.asarray(cost)
    flip = c.shape[0] > c.shape[1]
    c = c.T if flip else c
    return min(sum(c[i, j] for i, j in enumerate(p)) for p in permutations(range(c.shape[1]), c.shape[0]))


def test_assignment_is_the_cheapest():
    r = np.random.default_rng(5)
    for _ in range(150):
        c = r.integers(0, 9, size=(r.integers(1, 6), r.integers(1, 6))).astype(float)
        pairs = association.assign(c)
        assert len(pairs) == min(c.shape) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert sum(c[i, j] for i, j in pairs) == pytest.approx(brute(c))
    assert association.assign(np.zeros((0, 3))) == []


def walkers(spark, n=30):
    rows = []
    for k in range(n):
        for d, (x, y) in enumerate(((k * 4.0, 0.0), (200 - k * 4.0, 80.0), (60.0, 300.0))):
            if not (d == 2 and 10 <= k < 14):
                rows.append(("v", k, d, (x, y, 50.0, 100.0, 0.9), [1.0 if i == d else 0.0 for i in range(4)]))
    return spark.createDataFrame(rows, "video string, frame_idx int, det_idx int, bbox struct<x:double,y:double,w:double,h:double,conf:double>, reid array<double>")


def test_trackers_keep_ids(spark):
    for settings in (association.TrackerSettings(), association.TrackerSettings("greedy"), association.TrackerSettings(predict=True)):
        out = association.track(walkers(spark), settings).collect()
        ids = {}
        for x in out:
            ids.setdefault(x.det_idx, set()).add(x.track_id)
        assert all(len(v) == 1 for v in ids.values()) and len({min(v) for v in ids.values()}) == 3
    brief = association.track(walkers(spark), association.TrackerSettings(max_age=2))
    again = association.identify(brief).collect()
    assert len({x.track_id for x in again if x.det_idx == 2}) == 2 and len({x.player_id for x in again if x.det_idx == 2}) == 1
    few = association.identify(brief, association.IdentitySettings(max_players=2)).collect()
    assert {x.player_id for x in few if x.det_idx == 2} == {None}


def test_bvh(spark):
    frames = readers.walker(spark, 3, 120.0)
    text = writers.bvh_clips(frames, ["track_id"]).first().bvh
    lines = text.split("\n")
    assert lines[0] == "HIERARCHY" and lines[1] == "ROOT Hips" and text.count("JOINT") == 21 and text.count("End Site") == 5
    at = lines.index("MOTION")
    assert lines[at + 1] == "Frames: 3" and lines[at + 2] == "Frame Time: 0.033333" and len(lines[at + 3].split()) == writers.channels() == 69
    assert text.count("{") == text.count("}") and sorted(writers.traversal()) == list(range(22))
    assert writers.bvh_problems(frames, ["track_id"]).first().valid and not writers.bvh_problems(frames, ["track_id"], fps=0).first().valid
    from trackframe.functions import geometry as g

    axis = {"X": np.array([1.0, 0, 0]), "Y": np.array([0, 1.0, 0]), "Z": np.array([0, 0, 1.0])}
    q = np.array([0.7, 0.3, -0.5, 0.2])
    q /= np.linalg.norm(q)
    for order in writers.ORDERS:
        e = spark.range(1).select(writers.euler_for(g.quat(*map(float, q)), order).alias("e")).first().e
        back = np.array([1.0, 0, 0, 0])
        for a in order:  # about fixed axes, first listed first
            h = np.radians(e[a.lower()]) / 2
            back = sk.q_mul(np.array([np.cos(h), *(np.sin(h) * axis[a])]), back)
        assert abs(back @ q) == pytest.approx(1), order


def test_json_round_trip(spark, tmp_path):
    frames = readers.noisy(readers.walker(spark, 5, 120.0), 2.0)
    made = writers.json_clips(frames, ["track_id"], F.lit("walk"))
    made.select(F.col("json").alias("value")).coalesce(1).write.text(str(tmp_path / "out"))
    (tmp_path / "out" / "broken.txt").write_text("{ no json")
    read = readers.clips(spark, str(tmp_path / "out" / "*.txt"))
    assert read.count() == 1 and readers.broken_clips(spark, str(tmp_path / "out" / "*.txt")).count() == 1
    back = readers.frames_of_clips(read).orderBy("frame_idx").collect()
    for a, b in zip(frames.orderBy("frame_idx").collect(), back):
        assert a.root_pos == b.root_pos and [j.pos for j in a.joints] == [j.pos for j in b.joints]
    assert readers.clips(spark, str(tmp_path / "out" / "*.txt"), least_frames=6).count() == 0


def test_arrays_index_and_styles(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.ones((3, 4)))
    np.save(tmp_path / "b.npy", np.ones(3))
    rows = readers.arrays(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].n_rows == 3 and len(rows[0].rows[0]) == 4
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(k, r.normal(size=8).tolist()) for k in range(400)], "clip_id long, e array<double>")
    index = search.VectorIndex.build(df, "clip_id", "e", cells=6)
    index.save(str(tmp_path / "index"))
    loaded = search.VectorIndex.load(spark, str(tmp_path / "index"), "clip_id", "e")
    query = df.where("clip_id = 7").first().e
    exact = [x.clip_id for x in search.VectorIndex.build(df, "clip_id", "e").search(query, 10).collect()]
    assert [x.clip_id for x in loaded.search(query, 10, probes=6).collect()] == exact and exact[0] == 7
    assert loaded.add(spark.createDataFrame([(9000, query)], "clip_id long, e array<double>")).search(query, 2, 6).count() == 2
    style = spark.createDataFrame([("p", "P", [1.0, 0.0])], "player_id string, player_name string, embedding array<double>")
    writers.styles(style, str(tmp_path / "styles"))
    assert readers.styles(spark, str(tmp_path / "styles")).first().stride_length_scale == 1.0
