import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.functions import boxes, noise, text
from trackframe.functions import geometry as g
from trackframe.functions import vectors as v
from trackframe.functions.registry import register_all
from trackframe.operators import skeleton as sk


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def values(row, names="xyz"):
    return [row[n] for n in names]


def test_rotations_round_trip(spark):
    r = np.random.default_rng(1)
    q = r.normal(size=(300, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, tuple(map(float, x))) for k, x in enumerate(q)], "k int, q struct<w:double,x:double,y:double,z:double>")
    out = df.select(
        "k", g.quat_to_euler(F.col("q")).alias("e"), g.quat_to_rot6d(F.col("q")).alias("six"), g.quat_to_mat3(F.col("q")).alias("m"),
        g.mat3_to_quat(g.quat_to_mat3(F.col("q"))).alias("back"), g.q_angle(F.col("q"), g.euler_to_quat(g.quat_to_euler(F.col("q")))).alias("off"),
        g.mat3_determinant(g.quat_to_mat3(F.col("q"))).alias("det"), g.q_angle(F.col("q"), g.rot6d_to_quat(g.quat_to_rot6d(F.col("q")))).alias("off6"),
    ).orderBy("k").collect()
    assert max(x.off for x in out) < 1e-3 and max(x.off6 for x in out) < 1e-3 and all(abs(x.det - 1) < 1e-9 for x in out)
    assert np.allclose(np.abs([(a * np.array(values(x.back, "wxyz"))).sum() for a, x in zip(q, out)]), 1)
    # the same in numpy
    assert np.allclose([x.m for x in out], sk.q_matrix(q).reshape(-1, 9))
    assert np.allclose([x.six for x in out], sk.q_six(q)) and np.allclose([values(x.e) for x in out], sk.q_euler(q))
    assert np.allclose(np.abs((sk.six_q(sk.q_six(q)) * q).sum(1)), 1)


def test_vectors_and_guards(spark):
    x = one(
        spark,
        n=g.normalized(g.vec3(0, 0, 0)), c=g.cross(g.vec3(1, 0, 0), g.vec3(0, 1, 0)), a=g.angle_between(g.vec3(1, 0, 0), g.vec3(0, 2, 0)),
        z=g.angle_between(g.vec3(0, 0, 0), g.vec3(0, 2, 0)), t=g.to_axis_angle(g.identity()), same=g.rotation_between(g.vec3(0, 3, 0), g.vec3(0, 1, 0)),
        flip=g.q_rotate(g.rotation_between(g.vec3(1, 0, 0), g.vec3(-1, 0, 0)), g.vec3(1, 0, 0)), w=g.wrap_angle(F.lit(7.0)),
        turn=g.q_rotate(g.rotation_between(g.vec3(1, 2, 3), g.vec3(0, 0, 1)), g.vec3(1, 2, 3)), look=g.q_rotate(g.look_rotation(g.vec3(1, 0, 0), g.vec3(0, 1, 0)), g.vec3(0, 0, 1)),
    )
    assert values(x.n) == [0, 0, 0] and values(x.c) == [0, 0, 1] and x.a == pytest.approx(90) and x.z == 0
    assert x.t.degrees == 0 and values(x.same, "wxyz") == [1, 0, 0, 0] and values(x.flip) == pytest.approx([-1, 0, 0])
    assert x.w == pytest.approx(7 - 2 * np.pi) and values(x.turn) == pytest.approx([0, 0, np.sqrt(14)]) and values(x.look) == pytest.approx([1, 0, 0])


def test_slerp_takes_the_short_way(spark):
    a, b = g.from_axis_angle(g.vec3(0, 1, 0), 10.0), g.from_axis_angle(g.vec3(0, 1, 0), 70.0)
    x = one(spark, half=g.to_axis_angle(g.slerp(a, b, 0.5)), other=g.to_axis_angle(g.slerp(a, g.q_scale(b, -1.0), 0.5)), near=g.q_norm(g.slerp(a, a, 0.3)))
    assert x.half.degrees == pytest.approx(40) and x.other.degrees == pytest.approx(40) and x.near == pytest.approx(1)


def test_arrays(spark):
    a = F.array(*map(F.lit, (3.0, 1.0, 2.0, 10.0)))
    x = one(
        spark, m=v.median(a), u=v.upper_median(a), p=v.pad(a, 6), r=v.roll(a, 1), k=v.pick(a, 2), s=v.softmax(a), g=v.argmax(a), n=v.normalized(F.array(F.lit(0.0))),
        c=v.cosine(a, v.scale(a, -2.0)), e=v.median(F.array().cast("array<double>")), q=v.slerp(a, a, 0.5), z=v.cosine(a, v.scale(a, 0.0)),
    )
    assert (x.m, x.u, x.g, x.e, x.z) == (2.5, 3.0, 3, None, 0.0) and x.p == [3, 1, 2, 10, 0, 0] and x.r == [10, 3, 1, 2] and x.k == [3, 10]
    assert sum(x.s) == pytest.approx(1) and x.n == [0] and x.c == pytest.approx(-1) and np.linalg.norm(x.q) == pytest.approx(1)


def test_boxes(spark):
    b = boxes.box(0, 0, 10, 10)
    kp = F.array(*(F.struct(F.lit(float(k)).alias("x"), F.lit(0.0).alias("y"), F.lit(0.9).alias("conf")) for k in range(17)))
    off = F.transform(kp, lambda p: F.struct((p["x"] + 0.01).alias("x"), p["y"].alias("y"), p["conf"].alias("conf")))
    x = one(spark, same=boxes.iou(b, b), none=boxes.iou(b, boxes.box(20, 0, 5, 5)), empty=boxes.iou(boxes.box(0, 0, 0, 0), boxes.box(0, 0, 0, 0)),
            part=boxes.iou(b, boxes.from_corners(5, 0, 15, 10)), o=boxes.oks(kp, kp), p=boxes.oks(kp, off), cost=boxes.match_cost(F.lit(1.0), F.lit(1.0)))
    assert x.same == 1 and x.none == 0 and x.empty == 0 and x.part == pytest.approx(1 / 3) and x.o == 1 and 0 < x.p < 1 and x.cost == pytest.approx(0.3)
    assert boxes.class_mapping(3) == {0: 0, 1: 1, 2: 2} and boxes.class_mapping(80) == {0: 0} and boxes.class_mapping(5, {1: 2, 9: 1}) == {1: 2}
    d = one(spark, a=boxes.decode(F.array(F.lit(0.1), F.lit(0.8)), F.lit(5.0), F.lit(5.0), F.lit(2.0), F.lit(4.0), 2, 3, {1: 0}),
            b=boxes.decode(F.array(F.lit(0.9), F.lit(0.8)), F.lit(5.0), F.lit(5.0), F.lit(2.0), F.lit(4.0), 2, 3, {1: 0, 0: -1}))
    assert (d.a.bbox.x, d.a.bbox.y, d.a.bbox.w, d.a.bbox.h, d.a.conf, d.a.class_id) == (8, 9, 4, 12, 0.8, 0) and d.b is None


def test_text(spark):
    x = one(
        spark, a=text.sanitise(F.lit("a b/c!")), b=text.sanitise(F.lit("!!")), c=text.sanitise(F.lit("a.b/c\\d"), False), n=text.sanitise(F.lit(None).cast("string")),
        s=text.similarity(F.lit("mixamorig:Hips"), F.lit("hips")), t=text.similarity(F.lit("LeftArm"), F.lit("LeftForeArm")), u=text.similarity(F.lit("abc"), F.lit("abd")),
        j=text.json_value(F.lit("no json"), "$.a", "int", 4), k=text.json_value(F.lit('{"a": 7}'), "$.a", "int", 4),
    )
    assert (x.a, x.b, x.c, x.n) == ("a_bc", "unnamed", "a_b_c_d", "unnamed") and x.s == 1 and x.u == pytest.approx(2 / 3) and (x.j, x.k) == (4, 7)
    assert x.t == pytest.approx(1 - 4 / 11)


def test_noise_schedules(spark):
    for kind in noise.KINDS:
        rows = noise.schedule(spark, kind, 100).orderBy("t").collect()
        bars = [r.alpha_bar for r in rows]
        assert all(a > b for a, b in zip(bars, bars[1:])) and all(0 <= r.beta <= 0.999 for r in rows) and rows[0].alpha_bar_prev == 1
        assert all(r.mean_from_start + r.mean_from_now * np.sqrt(r.alpha_bar) == pytest.approx(np.sqrt(r.alpha_bar_prev), abs=1e-6) for r in rows if r.t < 90)
    row = F.struct(*(F.lit(0.5).alias(n) for n in ("alpha_bar", "mean_from_start", "mean_from_now", "posterior_variance")))
    a, n = F.array(F.lit(0.3), F.lit(-0.2)), F.array(F.lit(1.0), F.lit(0.5))
    xt = noise.add_noise(a, n, F.lit(0.5))
    x = one(spark, back=noise.predict_start(xt, n, F.lit(0.5)), eps=noise.predict_noise(xt, a, F.lit(0.5)), d=noise.ddim_step(xt, n, F.lit(0.5), F.lit(1.0)),
            p=noise.ddpm_step(xt, n, noise.Step.of(row)), i=noise.alpha_bar_at(F.array(F.lit(1.0), F.lit(0.5)), F.lit(0.5)))
    assert x.back == pytest.approx([0.3, -0.2]) and x.eps == pytest.approx([1, 0.5]) and x.d.x == pytest.approx([0.3, -0.2]) and x.i == 0.75
    assert x.p == pytest.approx([0.15 + 0.5 * (np.sqrt(0.5) * 1.3), -0.1 + 0.5 * (np.sqrt(0.5) * 0.3)])
    with pytest.raises(ValueError):
        noise.betas("other", 5)


def test_sql_functions(spark):
    names = register_all(spark)
    x = spark.sql("SELECT vec_cosine(array(1D, 0D), array(2D, 0D)) AS a, box_iou(named_struct('x', 0D, 'y', 0D, 'w', 2D, 'h', 2D), named_struct('x', 1D, 'y', 0D, 'w', 2D, 'h', 2D)) AS b, safe_name('a b!') AS c").first()
    assert x.a == 1 and x.b == pytest.approx(1 / 3) and x.c == "a_b" and len(names) > 8
