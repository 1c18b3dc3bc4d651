"""Scans. Schemas are given, never inferred; files that do not follow them become rows that say so, or are left out."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions import geometry as g
from trackframe.schema import FRAMES, JOINT_COUNT, STYLE_SCALARS

TRIPLE = "array<double>"
CLIP_JSON = (
    "schemaVersion string, metadata struct<name:string,fps:double,trackingID:int,numFrames:int>, "
    "frames array<struct<timestamp:double,frameIndex:int,rootPosition:array<double>,rootVelocity:array<double>,"
    "rootRotation:array<double>,joints array<struct<name:string,position:array<double>,quaternion:array<double>,"
    "euler:array<double>,rotation6D:array<double>,confidence:double>>>>, "
    "segments array<struct<type:string,typeIndex:int,startFrame:int,endFrame:int,avgVelocity:double,avgDirection:array<double>,confidence:double>>, "
    "_corrupt string"
).replace("joints array<", "joints:array<")


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".mp4", ".avi", ".mov", ".mkv"), most: int | None = None) -> DataFrame:
    """Files below a directory with one of the extensions, in any case, by path: path, length, modified."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.lower("path")
    any_of = F.lit(False)
    for e in extensions:
        any_of = any_of | name.endswith(e.lower())
    rows = rows.where(any_of).orderBy("path")
    return rows if most is None else rows.limit(most)


def probe(meta: DataFrame) -> DataFrame:
    """Width, height, rate, frames and duration of videos from their metadata (frames / fps; 0 without a rate)."""
    return meta.withColumn("duration_sec", F.when(F.col("fps") > 0, F.col("total_frames") / F.col("fps")).otherwise(0.0))


def _vec(a: Column) -> Column:
    return F.struct(*(F.coalesce(F.get(a, F.lit(k)), F.lit(0.0)).alias(n) for k, n in enumerate("xyz")))


def _quat(a: Column) -> Column:
    return F.struct(*(F.coalesce(F.get(a, F.lit(k)), F.lit(float(k == 0))).alias(n) for k, n in enumerate("wxyz")))


def clips(spark: SparkSession, path: str, least_frames: int = 1) -> DataFrame:
    """JSON clips, one to a file: clip_path, name, fps, tracking_id, frames and segments; broken or short files are left out."""
    raw = (
        spark.read.schema(CLIP_JSON)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .withColumn("clip_path", F.input_file_name())
    )
    ok = raw.where(F.col("_corrupt").isNull() & (F.size("frames") >= least_frames))
    m = F.col("metadata")
    return ok.select(
        "clip_path", m["name"].alias("name"), F.coalesce(m["fps"], F.lit(30.0)).alias("fps"), F.coalesce(m["trackingID"], F.lit(-1)).alias("track_id"), "frames", "segments"
    )


def broken_clips(spark: SparkSession, path: str) -> DataFrame:
    """The files that ``clips`` leaves out because they are no JSON clips."""
    raw = spark.read.schema(CLIP_JSON).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.withColumn("clip_path", F.input_file_name()).where(F.col("_corrupt").isNotNull() | F.col("frames").isNull()).select("clip_path")


def frames_of_clips(read: DataFrame) -> DataFrame:
    """Frames of JSON clips in the schema of skeleton frames, with clip_path and fps."""
    rows = read.select("clip_path", "fps", "track_id", F.explode("frames").alias("f"))

    def joint(j: Column) -> Column:
        q = _quat(j["quaternion"])
        e = F.when(j["euler"].isNotNull(), _vec(j["euler"])).otherwise(g.quat_to_euler(q))
        q = F.when(j["quaternion"].isNotNull(), q).otherwise(g.euler_to_quat(e))
        six = F.coalesce(j["rotation6D"], g.quat_to_rot6d(q))
        return F.struct(q.alias("rot"), e.alias("euler"), six.alias("rot6d"), _vec(j["position"]).alias("pos"), F.coalesce(j["confidence"], F.lit(0.0)).alias("conf"))

    f = F.col("f")
    return rows.select(
        "clip_path",
        "fps",
        "track_id",
        f["frameIndex"].alias("frame_idx"),
        f["timestamp"].alias("ts"),
        _vec(f["rootPosition"]).alias("root_pos"),
        _quat(f["rootRotation"]).alias("root_rot"),
        _vec(f["rootVelocity"]).alias("root_vel"),
        g.vec3(0, 0, 0).alias("root_ang_vel"),
        F.transform(f["joints"], joint).alias("joints"),
    )


def positions_of_clips(read: DataFrame, least_frames: int = 4) -> DataFrame:
    """Joint places of JSON clips as one array for each clip (frames x 22 x 3)."""
    places = F.transform("frames", lambda f: F.transform(f["joints"], lambda j: j["position"]))
    return read.where(F.size("frames") >= least_frames).select("clip_path", "name", "track_id", places.alias("positions"))


def arrays(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """``.npy`` files of two dimensions (or more, flattened to rows): path, rows (array of arrays), n_rows; others are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for where, content in zip(part["path"], part["content"]):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                except ValueError:
                    continue
                a = a.reshape(len(a), -1) if a.ndim > 1 else None
                if a is not None and (width is None or a.shape[1] == width):
                    out.append({"path": where, "n_rows": len(a), "rows": a.astype(float).tolist()})
            yield pd.DataFrame(out, columns=["path", "n_rows", "rows"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content").mapInPandas(run, "path string, n_rows int, rows array<array<double>>")


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequences, labels and cluster ids that ``writers.sequences`` wrote."""
    return spark.read.parquet(path)


def styles(spark: SparkSession, path: str) -> DataFrame:
    """A style library: player_id, player_name, embedding and the scalars (1 or 0 where a file lacks them)."""
    fields = ", ".join(f"{c} double" for c in STYLE_SCALARS)
    raw = spark.read.schema(f"player_id string, player_name string, embedding array<double>, {fields}").json(path)
    still = {"sprint_lean_angle", "turn_lead_body"}
    return raw.withColumns({c: F.coalesce(F.col(c), F.lit(0.0 if c in still else 1.0)) for c in STYLE_SCALARS})


def with_sidecar(vectors: DataFrame, sidecar: DataFrame | None, key: str) -> DataFrame:
    """Vectors with their metadata; an empty map where there is none."""
    empty = F.create_map().cast("map<string,string>")
    if sidecar is None:
        return vectors.withColumn("metadata", empty)
    return vectors.join(sidecar.select(key, "metadata"), key, "left").withColumn("metadata", F.coalesce("metadata", empty))


# Synthetic tracks


def walker(spark: SparkSession, n: int = 60, speed: float = 100.0, fps: float = 30.0, track: int = 1, speeds: list[tuple[float, float]] | None = None, turns: list[tuple[float, float]] | None = None) -> DataFrame:
    """A skeleton in rest pose that walks: frames of one track along x.

    ``speeds`` and ``turns`` are (share of the track from which it holds, value) and change speed and heading (degrees) on the way.
    """
    from trackframe.schema import JOINT_PARENT, REST_OFFSETS

    share = F.col("id") / float(n)

    def stepped(parts: list[tuple[float, float]], rest: float) -> Column:
        out = F.lit(float(rest))
        for start, value in parts:
            out = F.when(share >= start, F.lit(float(value))).otherwise(out)
        return out

    pace, head = stepped(speeds or [], speed), F.radians(stepped(turns or [], 0.0))
    base = spark.range(n).select(F.col("id"), pace.alias("v"), head.alias("h"))
    from pyspark.sql import Window

    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    moved = base.select(
        "id", "v", "h",
        F.coalesce(F.sum(F.col("v") * F.cos("h") / fps).over(w), F.lit(0.0)).alias("x"),
        F.coalesce(F.sum(F.col("v") * F.sin("h") / fps).over(w), F.lit(0.0)).alias("z"),
    )
    rest = np.zeros((JOINT_COUNT, 3))
    for j, p in enumerate(JOINT_PARENT):
        rest[j] = REST_OFFSETS[j] + (rest[p] if p >= 0 else np.array([0.0, 90.0, 0.0]))
    still = g.identity()
    joints = F.array(
        *(
            F.struct(
                still.alias("rot"), g.vec3(0, 0, 0).alias("euler"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))).alias("rot6d"),
                g.vec3(F.col("x") + float(r[0]), F.lit(float(r[1])), F.col("z") + float(r[2])).alias("pos"), F.lit(0.9).alias("conf"),
            )
            for r in rest
        )
    )
    out = moved.select(
        F.lit(track).alias("track_id"),
        F.col("id").cast("int").alias("frame_idx"),
        (F.col("id") / fps).alias("ts"),
        g.vec3(F.col("x"), 90.0, F.col("z")).alias("root_pos"),
        still.alias("root_rot"),
        g.vec3(F.col("v") * F.cos("h"), 0.0, F.col("v") * F.sin("h")).alias("root_vel"),
        g.vec3(0, 0, 0).alias("root_ang_vel"),
        joints.alias("joints"),
    )
    return out.to(FRAMES) if hasattr(out, "to") else out


def demo(spark: SparkSession, fps: float = 30.0) -> DataFrame:
    """195 frames of walking, sprinting, turning, standing and moving on."""
    return walker(spark, 195, 150.0, fps, speeds=[(0.31, 600.0), (0.62, 250.0), (0.77, 0.0), (0.85, 60.0)], turns=[(0.62, 45.0), (0.69, 90.0)])


def spike(frames: DataFrame, frame: int, joint: int, size: float = 500.0, idx: str = "frame_idx") -> DataFrame:
    """One joint of one frame moved away, to test filters with."""
    k = F.col(idx) == frame
    moved = F.transform("joints", lambda j, i: F.when(k & (i == joint), j.withField("pos", g.vec3(j["pos"]["x"] + size, j["pos"]["y"] + size, j["pos"]["z"] + size))).otherwise(j))
    return frames.withColumn("joints", moved)


def noisy(frames: DataFrame, spread: float, seed: int = 42) -> DataFrame:
    """Root and joint places with normal noise of the given spread, from a seed."""
    def off(p: Column, k: Column | int) -> Column:
        h = F.xxhash64(F.col("track_id"), F.col("frame_idx"), k if isinstance(k, Column) else F.lit(k), F.lit(seed))
        u = [(F.pmod(F.xxhash64(h, F.lit(a)), F.lit(1_000_003)) + 0.5) / 1_000_003 for a in range(6)]
        n = [F.sqrt(-2 * F.log(u[2 * a])) * F.cos(2 * F.pi() * u[2 * a + 1]) * spread for a in range(3)]
        return g.vec3(p["x"] + n[0], p["y"] + n[1], p["z"] + n[2])

    return frames.withColumns(
        {"root_pos": off(F.col("root_pos"), -1), "joints": F.transform("joints", lambda j, i: j.withField("pos", off(j["pos"], i)))}
    )
