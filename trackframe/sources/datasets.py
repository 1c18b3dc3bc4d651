"""Training sets from clips: what each model takes in, as rows of arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.operators import association, clips
from trackframe.operators.skeleton import long_tracks
from trackframe.operators.windows import Names


def _packed(rows: DataFrame, by: Names, idx: str, col: str, out: str, keep: Names = ()) -> DataFrame:
    """Frames of each clip in order, as one array."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(idx, col))), lambda r: r[col])
    return rows.groupBy(*by).agg(listed.alias(out), F.count("*").alias("n_frames"), *(F.first(c).alias(c) for c in keep))


def diffusion(frames: DataFrame, by: Names, idx: str = "frame_idx", least: int = 16) -> DataFrame:
    """Joint rotations of clips with ``least`` frames or more: n x 132."""
    rows = long_tracks(frames, by, least).withColumn("_f", clips.skeleton_vector(F.col("joints")))
    return _packed(rows, by, idx, "_f", "sequence")


def classifier(frames: DataFrame, by: Names, idx: str = "frame_idx", least: int = 4, label: str | None = None) -> DataFrame:
    """Features of clips with ``least`` frames or more: n x 70, with the label if there is one."""
    rows = long_tracks(frames, by, least)
    rows = rows.withColumn("_f", clips.frame_features(F.col("joints"), F.col("root_vel"), F.col("root_ang_vel")))
    return _packed(rows, by, idx, "_f", "sequence", [label] if label else [])


def styles(frames: DataFrame, by: Names, player: str, idx: str = "frame_idx", least: int = 16) -> DataFrame:
    """Style input of clips with ``least`` frames or more of players with two such clips or more: n x 201."""
    rows = clips.style_features(long_tracks(frames, by, least), by, [idx])
    packed = _packed(rows, by, idx, "style_input", "sequence", [player])
    return association.with_at_least(packed, player, 2)


def motions(frames: DataFrame, by: Names, idx: str = "frame_idx", least: int = 4) -> DataFrame:
    """Joint places about the hips and by height: n x 66."""
    rows = clips.model_input(long_tracks(frames, by, least), by, idx)
    return _packed(rows, by, idx, "features", "sequence")
