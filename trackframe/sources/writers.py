"""Sinks: BVH and JSON clips, the clip database as a directory, summaries, windows, indexes and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions import geometry as g
from trackframe.functions import text
from trackframe.operators.segments import names_of
from trackframe.schema import JOINT_COUNT, JOINT_NAMES, JOINT_PARENT, MOTION_TYPES, REST_OFFSETS, SCHEMA_VERSION
from trackframe.session import written

# BVH

ORDERS = ("ZXY", "XYZ", "YZX", "ZYX", "XZY", "YXZ")
#: Sign of the sine's cell for the middle axis, and of all others, by whether the axes are in turn (x to y to z).
_NEXT = {"X": "Y", "Y": "Z", "Z": "X"}


def children(joint: int) -> list[int]:
    return [k for k, p in enumerate(JOINT_PARENT) if p == joint]


def traversal(joint: int = 0) -> list[int]:
    """Joints as the hierarchy lists them: each before its children, depth first."""
    return [joint, *(k for c in children(joint) for k in traversal(c))]


def channels(root_motion: bool = True) -> int:
    return (6 if root_motion else 3) + 3 * (JOINT_COUNT - 1)


def euler_for(q: Column, order: str) -> Column:
    """Degrees about x, y, z that give the rotation when applied about fixed axes in ``order``; where the middle angle is a quarter turn, the last is 0.

    About fixed axes ABC the matrix is C B A. Its cell (C, A) is the sine of the middle angle, with the sign + where ABC is against the
    alphabet's turn, so one formula serves all six orders.
    """
    first, middle, last = order
    at = {a: k for k, a in enumerate("XYZ")}
    turn = -1.0 if _NEXT[first] == middle else 1.0

    def angles(m: Column) -> Column:
        def cell(r: str, c: str) -> Column:
            return m[3 * at[r] + at[c]]

        s = g.clamp(turn * cell(last, first), -1, 1)
        free = F.abs(s) < 0.9999
        angle = {
            middle: F.asin(s),
            first: F.when(free, F.atan2(-turn * cell(last, middle), cell(last, last))).otherwise(F.atan2(turn * cell(middle, last), cell(middle, middle))),
            last: F.when(free, F.atan2(-turn * cell(middle, first), cell(first, first))).otherwise(0.0),
        }
        return g.vec3(*(F.degrees(angle[a]) for a in "XYZ"))

    return g.let(angles, g.quat_to_mat3(q))


def bvh_hierarchy(order: str = "ZXY", root_motion: bool = True, precision: int = 6, end_site: float = 5.0, scale: float = 1.0, names: dict[str, str] | None = None) -> str:
    """The HIERARCHY part; ``names`` overrides bone names."""
    rotations = " ".join(f"{a}rotation" for a in order)

    def offset(v: tuple) -> str:
        return "OFFSET " + " ".join(f"{x * scale:.{precision}f}" for x in v)

    def lines(j: int, depth: int) -> list[str]:
        pad = "  " * depth
        name = (names or {}).get(JOINT_NAMES[j], JOINT_NAMES[j])
        moving = "6 Xposition Yposition Zposition " if j == 0 and root_motion else "3 "
        out = [f"{pad}{'JOINT' if j else 'ROOT'} {name}", f"{pad}{{", f"{pad}  {offset(REST_OFFSETS[j])}", f"{pad}  CHANNELS {moving}{rotations}"]
        inner = [x for c in children(j) for x in lines(c, depth + 1)]
        if not inner:
            inner = [f"{pad}  End Site", f"{pad}  {{", f"{pad}    {offset((0.0, end_site, 0.0))}", f"{pad}  }}"]
        return [*out, *inner, f"{pad}}}"]

    return "\n".join(["HIERARCHY", *lines(0, 0)]) + "\n"


def bvh_line(root_pos: Column, joints: Column, order: str = "ZXY", root_motion: bool = True, precision: int = 6, scale: float = 1.0) -> Column:
    """One frame's line: root place, then each joint's angles in the hierarchy's order."""
    places = F.array(*(F.lit(k) for k in traversal()))

    def number(x: Column) -> Column:
        return F.format_string(f"%.{precision}f", x)

    def one(k: Column) -> Column:
        return g.let(lambda e: F.concat_ws(" ", *(number(e[a.lower()]) for a in order)), euler_for(F.get(joints, k)["rot"], order))

    turned = F.array_join(F.transform(places, one), " ")
    if not root_motion:
        return turned
    return F.concat_ws(" ", *(number(root_pos[a] * scale) for a in "xyz"), turned)


def bvh_clips(frames: DataFrame, by: list[str], fps: float = 30.0, idx: str = "frame_idx", order: str = "ZXY", root_motion: bool = True, precision: int = 6, scale: float = 1.0, names: dict[str, str] | None = None) -> DataFrame:
    """Each clip as a BVH text: key, n_frames, bvh."""
    line = bvh_line(F.col("root_pos"), F.col("joints"), order, root_motion, precision, scale)
    packed = frames.select(*by, idx, line.alias("_l")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(idx, "_l"))).alias("_r"))
    head = F.lit(bvh_hierarchy(order, root_motion, precision, scale=scale, names=names))
    seconds = 1 / fps if fps > 0 else 1 / 30
    motion = F.concat(
        head, F.lit("MOTION\nFrames: "), F.size("_r").cast("string"), F.lit(f"\nFrame Time: {seconds:.{precision}f}\n"),
        F.array_join(F.transform("_r", lambda r: F.concat(r["_l"], F.lit("\n"))), ""),
    )
    return packed.select(*by, F.size("_r").alias("n_frames"), motion.alias("bvh"))


def bvh_problems(frames: DataFrame, by: list[str], fps: float = 30.0, scale: float = 1.0) -> DataFrame:
    """Per clip: errors and warnings (arrays of text), and whether it is valid."""
    p, q = F.col("root_pos"), F.col("root_rot")
    infinite = F.lit(float("inf"))

    def bad(x: Column) -> Column:
        return F.isnan(x) | (F.abs(x) == infinite)

    nan_angle = F.exists("joints", lambda j: F.isnan(j["euler"]["x"]) | F.isnan(j["euler"]["y"]) | F.isnan(j["euler"]["z"]))
    wide = F.exists("joints", lambda j: F.greatest(F.abs(j["euler"]["x"]), F.abs(j["euler"]["y"]), F.abs(j["euler"]["z"])) > 360)
    out = frames.groupBy(*by).agg(
        F.count("*").alias("n_frames"),
        F.bool_or(bad(p["x"]) | bad(p["y"]) | bad(p["z"])).alias("_root"),
        F.bool_or(nan_angle).alias("_angle"),
        F.bool_or(F.abs(g.q_norm(q) - 1) > 0.1).alias("_norm"),
        F.bool_or(wide).alias("_wide"),
    )
    errors = F.array_compact(
        F.array(
            F.when(F.lit(fps <= 0), F.lit("fps is not positive")),
            F.when(F.lit(scale <= 0), F.lit("scale is not positive")),
            F.when(F.col("_root"), F.lit("root place is not finite")),
            F.when(F.col("_angle"), F.lit("an angle is not a number")),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.lit(fps > 0 and not 1 <= fps <= 240), F.lit("unusual fps")),
            F.when(F.col("_norm"), F.lit("root rotation is not of unit length")),
            F.when(F.col("_wide"), F.lit("an angle is beyond 360 degrees")),
        )
    )
    out = out.withColumns({"errors": errors, "warnings": warnings})
    return out.withColumn("valid", F.size("errors") == 0).drop("_root", "_angle", "_norm", "_wide")


# JSON


def _triple(v: Column, names: str = "xyz") -> Column:
    return F.array(*(v[n] for n in names))


def json_clips(frames: DataFrame, by: list[str], name: Column, fps: float = 30.0, idx: str = "frame_idx", segments: DataFrame | None = None, metadata: bool = True, pretty: bool = False) -> DataFrame:
    """Each clip as a JSON text: key, json. Segments (by the same key) are left out of clips that have none."""
    labels = F.array(*map(F.lit, JOINT_NAMES))

    def joint(j: Column, k: Column) -> Column:
        return F.struct(
            F.get(labels, k).alias("name"), _triple(j["pos"]).alias("position"), _triple(j["rot"], "wxyz").alias("quaternion"),
            _triple(j["euler"]).alias("euler"), j["rot6d"].alias("rotation6D"), j["conf"].alias("confidence"),
        )

    frame = F.struct(
        F.col("ts").alias("timestamp"),
        F.col(idx).alias("frameIndex"),
        _triple(F.col("root_pos")).alias("rootPosition"),
        _triple(F.col("root_vel")).alias("rootVelocity"),
        _triple(F.col("root_rot"), "wxyz").alias("rootRotation"),
        F.transform("joints", joint).alias("joints"),
    )
    packed = frames.select(*by, idx, name.alias("_name"), F.col("track_id").alias("_track"), frame.alias("_f")).groupBy(*by).agg(
        F.first("_name").alias("_name"), F.first("_track").alias("_track"), F.transform(F.array_sort(F.collect_list(F.struct(idx, "_f"))), lambda r: r["_f"]).alias("frames")
    )
    parts = [F.lit(SCHEMA_VERSION).alias("schemaVersion")]
    if metadata:
        info = F.struct(
            F.col("_name").alias("name"), F.lit(float(fps)).alias("fps"), F.col("_track").alias("trackingID"), F.size("frames").alias("numFrames"),
            F.lit(JOINT_COUNT).alias("numJoints"), labels.alias("jointNames"), F.array(*map(F.lit, JOINT_PARENT)).alias("hierarchy"),
        )
        parts.append(info.alias("metadata"))
    parts.append(F.col("frames"))
    if segments is not None:
        each = F.struct(
            names_of(F.col("type")).alias("type"), F.col("type").alias("typeIndex"), F.col("start_frame").alias("startFrame"),
            F.col("end_frame").alias("endFrame"), F.col("avg_velocity").alias("avgVelocity"), _triple(F.col("avg_direction")).alias("avgDirection"), F.col("confidence"),
        )
        listed = segments.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_frame", each.alias("s")))), lambda r: r["s"]).alias("segments"))
        packed = packed.join(listed, by, "left")
        parts.append(F.col("segments"))
    return packed.select(*by, F.to_json(F.struct(*parts), {"pretty": str(pretty).lower()}).alias("json"))


def text_files(df: DataFrame, path: str, name: str, content: str) -> None:
    """Write one file for each row: ``content`` at ``path/name`` (names may have directories). Runs on the executors, by Hadoop's file system."""
    conf_path = path.rstrip("/")
    df.select(F.col(name).alias("part"), F.col(content).alias("value")).write.mode("overwrite").partitionBy("part").text(conf_path)


# The clip database


def type_directory(label: Column) -> Column:
    return F.lower(label)


def export_names(clips: DataFrame, label: str = "motion_type", order: str = "clip_id") -> DataFrame:
    """Directory and file stem of each clip: its type in lower case, and clip_0000 and so on by ``order`` over all clips.

    The number is a running count, made from counts of ranges of ids, so that no task orders all clips. The ranges are written
    before they are counted, so both sides of the join see the same ones.
    """
    ranged = clips.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    ranged = written(ranged, "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    numbered = ranged.join(F.broadcast(offsets), "_p").withColumn("_k", F.col("_i") + F.col("_o"))
    return numbered.withColumns({"directory": type_directory(F.col(label)), "stem": text.numbered("clip_", F.col("_k"), 4)}).drop("_p", "_i", "_o", "_k")


def summary(clips: DataFrame, label: str = "motion_type", player: str = "player_id", count_types: bool = True) -> DataFrame:
    """The database summary as one JSON text: totals, players, clips of each type that has any."""
    from trackframe.operators.aggregates import database_stats

    stats = database_stats(clips, player)
    if count_types:
        types = clips.groupBy(label).agg(F.count("*").alias("n")).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), "n")))).alias("clipsByType")
        )
        stats = stats.crossJoin(types)
    fields = [F.lit(SCHEMA_VERSION).alias("schemaVersion")]
    fields += [F.col(a).alias(b) for a, b in (("total_clips", "totalClips"), ("total_frames", "totalFrames"), ("total_seconds", "totalDurationSec"), ("unique_players", "uniquePlayers"))]
    return stats.select(F.to_json(F.struct(*fields, *([F.col("clipsByType")] if count_types else []))).alias("json"))


def export_database(clips: DataFrame, frames: DataFrame, path: str, fps: float = 30.0, formats: tuple[str, ...] = ("json", "bvh")) -> int:
    """Clips as files in a directory for each motion type, with metadata beside them and a summary; returns how many.

    ``clips`` has clip_id, motion_type and whatever metadata, ``frames`` clip_id and the frame columns. Each format is a text table
    partitioned by type and clip, which is a directory tree that any reader of files can walk.
    """
    named = export_names(clips)
    keys = named.select("clip_id", "directory", "stem")
    meta = named.select("directory", "stem", F.to_json(F.struct(*(F.col(c) for c in clips.columns))).alias("value"))
    meta.write.mode("overwrite").partitionBy("directory", "stem").text(f"{path}/meta")
    if "bvh" in formats:
        bvh = bvh_clips(frames, ["clip_id"], fps).join(keys, "clip_id").select("directory", "stem", F.col("bvh").alias("value"))
        bvh.write.mode("overwrite").partitionBy("directory", "stem").text(f"{path}/bvh")
    if "json" in formats:
        made = json_clips(frames, ["clip_id"], F.concat(F.lit("clip_"), F.col("clip_id").cast("string")), fps)
        made = made.join(keys, "clip_id").select("directory", "stem", F.col("json").alias("value"))
        made.write.mode("overwrite").partitionBy("directory", "stem").text(f"{path}/json")
    summary(clips).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{path}/summary")
    return clips.count()


def directories(spark: SparkSession) -> DataFrame:
    """The 16 directories that a database has, whether or not they hold clips."""
    return spark.createDataFrame([(t.lower(),) for t in MOTION_TYPES], "directory string")


# Tables


def windows(rows: DataFrame, path: str) -> None:
    """Feature windows with their metadata, as Parquet."""
    rows.write.mode("overwrite").parquet(path)


def manifest(clips: DataFrame, path: str, label: str = "motion_type") -> None:
    """Clips with counts of each type, as JSON."""
    clips.groupBy(label).agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/counts")
    clips.write.mode("overwrite").json(f"{path}/clips")


def sequences(df: DataFrame, path: str) -> None:
    """Sequences, labels and cluster ids of a training set, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def styles(df: DataFrame, path: str) -> None:
    """A style library, as JSON lines."""
    df.write.mode("overwrite").json(path)
