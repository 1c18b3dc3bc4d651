import pytest
from pyspark.sql import functions as F

from trackframe.functions import augment
from trackframe.sources import datasets, readers


def test_training_sets(spark):
    df = readers.walker(spark, 20, 100.0).unionByName(readers.walker(spark, 20, 200.0, track=2)).unionByName(readers.walker(spark, 3, 50.0, track=3))
    df = df.withColumn("player", F.when(F.col("track_id") == 3, 9).otherwise(7))
    sizes = {n: [(len(x.sequence), len(x.sequence[0])) for x in d.collect()] for n, d in (
        ("d", datasets.diffusion(df, ["track_id"])), ("c", datasets.classifier(df, ["track_id"], label="player")),
        ("s", datasets.styles(df, ["track_id"], "player")), ("m", datasets.motions(df, ["track_id"])),
    )}
    assert sizes == {"d": [(20, 132)] * 2, "c": [(20, 70)] * 2, "s": [(20, 201)] * 2, "m": [(20, 66)] * 2}


def test_augmentations(spark):
    df = spark.createDataFrame([(k, [[float(t), 1.0] for t in range(10)]) for k in range(200)], "k long, f array<array<double>>")
    out = df.select(
        augment.add_noise(F.col("f"), F.col("k"), 0.5).alias("n"), augment.crop(F.col("f"), F.col("k"), 4).alias("c"), augment.crop(F.col("f"), F.col("k"), 12).alias("l"),
        augment.change_speed(F.col("f"), 2.0).alias("s"), augment.roll(F.col("f"), 3).alias("r"), augment.uniform(F.col("k"), 1).alias("u"),
    ).collect()
    noise = [x.n[t][1] - 1 for x in out for t in range(10)]
    assert abs(sum(noise) / len(noise)) < 0.05 and 0.2 < sum(v * v for v in noise) / len(noise) < 0.3
    starts = {x.c[0][0] for x in out}
    assert starts == {float(k) for k in range(7)} and all(len(x.c) == 4 and len(x.l) == 12 and x.l[-1][0] == 9 for x in out)
    assert [r[0] for r in out[0].s] == [0, 2, 4, 6, 8] and [r[0] for r in out[0].r][:4] == [7, 8, 9, 0] and 0.4 < sum(x.u for x in out) / 200 < 0.6
    frames = readers.walker(spark, 2, 60.0).select(F.array(F.flatten(F.transform("joints", lambda j: F.array(j["pos"]["x"], j["pos"]["y"], j["pos"]["z"])))).alias("f"))
    twice = frames.select("f", augment.mirror(augment.mirror(F.col("f"))).alias("m")).first()
    assert twice.m[0] == pytest.approx(twice.f[0])
