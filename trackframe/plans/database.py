"""The clip database: clips with their frames, quality, fingerprints and clusters as DataFrames and views."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.operators import aggregates
from trackframe.operators.search import VectorIndex
from trackframe.sources import writers


@dataclass
class ClipDatabase:
    """``clips`` has a row for each clip (clip_id, player_id, motion_type, n_frames, duration_sec and more), ``frames`` its frames."""

    clips: DataFrame
    frames: DataFrame

    def add(self, other: ClipDatabase) -> ClipDatabase:
        return ClipDatabase(self.clips.unionByName(other.clips, True), self.frames.unionByName(other.frames, True))

    def by_type(self, motion_type: str) -> DataFrame:
        return self.clips.where(F.col("motion_type") == motion_type)

    def by_player(self, player: int) -> DataFrame:
        return self.clips.where(F.col("player_id") == player)

    def accepted(self) -> ClipDatabase:
        good = self.clips.where("accepted")
        return replace(self, clips=good, frames=self.frames.join(good.select("clip_id"), "clip_id", "left_semi"))

    def stats(self) -> DataFrame:
        return aggregates.database_stats(self.clips)

    def counts(self) -> DataFrame:
        return aggregates.type_counts(self.clips)

    def summary(self) -> DataFrame:
        return writers.summary(self.clips)

    def similar(self, vector: list[float], k: int = 10) -> DataFrame:
        """Clips by distance of their fingerprints."""
        from trackframe.operators.search import knn

        return knn(self.clips, vector, k, "clip_id", "vector", "euclidean")

    def index(self, vector: str = "embedding") -> VectorIndex:
        return VectorIndex.build(self.clips.select("clip_id", vector), "clip_id", vector)

    def views(self, prefix: str = "") -> None:
        """Temporary views for SQL: clips, frames."""
        self.clips.createOrReplaceTempView(f"{prefix}clips")
        self.frames.createOrReplaceTempView(f"{prefix}frames")

    def export(self, path: str, fps: float = 30.0, formats: tuple[str, ...] = ("json", "bvh")) -> int:
        return writers.export_database(self.clips, self.frames, path, fps, formats)
