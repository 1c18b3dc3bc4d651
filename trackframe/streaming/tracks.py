"""Tracks with state: trackers that go on from batch to batch, and tracks that are put out once they have ended."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackframe.operators.association import Identities, IdentitySettings, Tracker, TrackerSettings, _detections


def track(persons: DataFrame, settings: TrackerSettings = TrackerSettings(), video: str = "video", frame: str = "frame_idx", order: str = "det_idx") -> DataFrame:
    """Add ``track_id`` and ``hits`` to detections of a stream; the state of each video's tracker is kept between batches.

    Frames of a video must not arrive before earlier ones. Rows with fewer hits than min_hits are the caller's to drop, as a track's later
    hits are not known yet.
    """
    keep = [c for c in persons.columns if c not in ("track_id", "hits")]
    schema = persons.select(*keep).withColumns({"track_id": F.lit(0).cast("long"), "hits": F.lit(0).cast("long")}).schema

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(settings, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(parts)).sort_values([frame, order], kind="stable").reset_index(drop=True)
        rows["track_id"], rows["hits"] = -1, 0
        for _, group in rows.groupby(frame, sort=True):
            ids = tracker.update(_detections(group))
            hits = {t.id: t.hits for t in tracker.tracks}
            rows.loc[group.index, "track_id"] = [-1 if k is None else k for k in ids]
            rows.loc[group.index, "hits"] = [hits.get(k, 0) for k in ids]
        state.update((json.dumps(tracker.state()),))
        yield rows[rows["track_id"] >= 0][[*keep, "track_id", "hits"]]

    return persons.select(*keep).groupBy(video).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def identify(persons: DataFrame, settings: IdentitySettings = IdentitySettings(), video: str = "video", frame: str = "frame_idx", tracklet: str = "track_id") -> DataFrame:
    """Add ``player_id`` to tracked persons of a stream; players are forgotten after ``max_lost`` frames."""
    keep = [c for c in persons.columns if c != "player_id"]
    schema = persons.select(*keep).withColumn("player_id", F.lit(None).cast("long")).schema

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = Identities(settings, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(parts)).sort_values([frame, tracklet], kind="stable")
        out = []
        for at, group in rows.groupby(frame, sort=True):
            looks = group["reid"] if "reid" in group else [None] * len(group)
            ids = known.update(int(at), list(zip(group[tracklet].astype(int), looks)))
            out.append(group.assign(player_id=group[tracklet].map(ids).astype("Int64")))
        state.update((json.dumps(known.state()),))
        yield pd.concat(out)[[*keep, "player_id"]]

    return persons.select(*keep).groupBy(video).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def finished_tracks(df: DataFrame, key: str, ts: str = "ts", value: str = "value", gap_seconds: int = 86_400, delay: str = "0 seconds") -> DataFrame:
    """A row for each track of a stream once no row of it can come any more: key, rows, first, last, sum and range.

    A track ends when the watermark passes its last row by the gap; rows after a longer gap start another one. What is kept is a few
    numbers, not the rows.
    """
    schema = f"{key} long, n long, first timestamp, last timestamp, total double, low double, high double"

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(s: tuple) -> dict:
            return {key: name[0], "n": s[0], "first": pd.Timestamp(s[1], unit="us"), "last": pd.Timestamp(s[2], unit="us"), "total": s[3], "low": s[4], "high": s[5]}

        out: list[dict[str, Any]] = []
        if state.hasTimedOut:
            out.append(row(state.get))
            state.remove()
        else:
            now = state.get if state.exists else None
            rows = pd.concat(list(parts)).sort_values(ts, kind="stable")
            for at, x in zip(rows[ts].to_numpy("datetime64[us]").astype("int64").tolist(), rows[value].tolist()):
                if now is not None and at - now[2] > gap_seconds * 1_000_000:
                    out.append(row(now))
                    now = None
                now = (1, at, at, x, x, x) if now is None else (now[0] + 1, now[1], max(now[2], at), now[3] + x, min(now[4], x), max(now[5], x))
            state.update(now)
            state.setTimeoutTimestamp(max(now[2] // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "n", "first", "last", "total", "low", "high"])

    keyed = df.select(key, ts, value).withWatermark(ts, delay)
    state = "n long, first long, last long, total double, low double, high double"
    return keyed.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
