"""The clip table in one pass over tracks: the clips of the general way, and nothing as wide as a frame is written."""

import numpy as np
import pytest

from trackframe.catalog import skeletons
from trackframe.operators import skeleton as sk
from trackframe.plans import match
from trackframe.plans.config import ClusterConfig, Config


def test_query_writes_no_frames(spark, sf, monkeypatch):
    seen, plain = [], match.written
    monkeypatch.setattr(match, "written", lambda df, name: seen.append(df.columns) or plain(df, name))
    assert skeletons.skeleton_database(spark, sf).count() > 0
    assert not any("joints" in columns for columns in seen)


def test_clips_are_those_of_build_and_database(spark, sf):
    frames = skeletons.frames(spark, sf).where("track_id < 5")
    config = Config(cluster=ClusterConfig(enabled=False))
    smooth, _, ranges = match.build(frames, config)
    want = match.database(smooth, ranges, config).clips.drop("vector", "embedding", "rejections").orderBy("clip_id").collect()
    got = match.clip_table(frames, config).drop("rejections").orderBy("clip_id").collect()
    assert want and len(got) == len(want)
    for a, b in zip(want, got):
        assert b.asDict() == {k: pytest.approx(v, rel=1e-7, abs=1e-7) if isinstance(v, float) else v for k, v in a.asDict().items()}


def test_tracks_of_one_length_go_together_as_alone():
    rng = np.random.default_rng(3)
    tracks = [
        {
            "root_pos": rng.normal(size=(40, 3)).cumsum(0), "root_rot": sk.q_unit(rng.normal(size=(40, 4))), "root_vel": rng.normal(size=(40, 3)),
            "root_ang_vel": np.zeros((40, 3)), "pos": rng.normal(size=(40, 22, 3)).cumsum(0), "rot": sk.q_unit(rng.normal(size=(40, 22, 4))),
            "conf": rng.uniform(size=(40, 22)),
        }
        for _ in range(3)
    ]
    from trackframe.plans import signals

    change = signals.chain(canonical=True)
    together = change({k: np.stack([t[k] for t in tracks], 1) for k in tracks[0]})
    for n, t in enumerate(tracks):
        for k, x in change(t).items():
            assert np.allclose(together[k][:, n], x, atol=1e-8), k


def test_medians_and_lines_between_good_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 50))
    assert (sk.median_of(list(x[:7])) == np.median(x[:7], axis=0)).all()
    bad = rng.uniform(size=x.shape) < 0.4
    bad[:, 3] = True
    got, t = sk.between_good(x, bad), np.arange(30)
    for c in range(50):
        good = ~bad[:, c]
        assert (got[:, c] == (np.where(good, x[:, c], np.interp(t, t[good], x[good, c])) if good.any() else x[:, c])).all()
