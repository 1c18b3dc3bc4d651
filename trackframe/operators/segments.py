"""Segments of labelled rows: runs, merging, statistics, clips and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as g
from trackframe.functions import vectors as v
from trackframe.operators.scan import recurrence
from trackframe.operators.windows import Names, over, whole
from trackframe.schema import MOTION, MOTION_TYPES


def runs(df: DataFrame, by: Names, order: Names, label: str, out: str = "run_id") -> DataFrame:
    """Number the runs of equal labels in each track from 0."""
    w = over(by, order)
    before = F.lag(F.struct(label)).over(w)
    changed = before.isNotNull() & ~before[label].eqNullSafe(F.col(label))
    df = df.withColumn("_new", changed.cast("int"))
    return df.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def run_stats(df: DataFrame, by: Names, label: str, idx: str = "frame_idx", run: str = "run_id", means: Names = (), vector: Names = ()) -> DataFrame:
    """A row for each run: label, first and last row, length, means, and the direction of the summed ``vector`` columns."""
    aggs = [
        F.first(label, ignorenulls=True).alias(label),
        F.min(idx).alias("start_frame"),
        F.max(idx).alias("end_frame"),
        F.count("*").alias("n_frames"),
        *(F.avg(c).alias(f"avg_{c}") for c in means),
        *(F.sum(c).alias(f"_s_{c}") for c in vector),
    ]
    out = df.groupBy(*by, run).agg(*aggs)
    if vector:
        size = F.sqrt(sum((F.col(f"_s_{c}") * F.col(f"_s_{c}") for c in vector), F.lit(0.0)))
        for c in vector:
            out = out.withColumn(f"dir_{c}", F.when(size > g.TINY, F.col(f"_s_{c}") / size).otherwise(0.0))
        out = out.drop(*(f"_s_{c}" for c in vector))
    return out


def merge_short(segments: DataFrame, by: Names, least: int = 10, run: str = "run_id", label: str = "label", means: Names = ()) -> DataFrame:
    """Segments shorter than ``least`` join the one before; means are weighted by length, the label stays the earlier one's.

    The first segment has none before and may stay short. A short segment always joins the last that is kept, so
    the groups are a running count of kept segments.
    """
    w = Window.partitionBy(*by).orderBy("start_frame")
    kept = (F.col("n_frames") >= least) | (F.row_number().over(w) == 1)
    df = segments.withColumn("_k", kept.cast("int"))
    df = df.withColumn("_g", F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    out = df.groupBy(*by, "_g").agg(
        F.min_by(label, "start_frame").alias(label),
        F.min("start_frame").alias("start_frame"),
        F.max("end_frame").alias("end_frame"),
        F.sum("n_frames").alias("n_frames"),
        *((F.sum(F.col(c) * F.col("n_frames")) / F.sum("n_frames")).alias(c) for c in means),
    )
    return out.withColumn(run, F.col("_g") - 1).drop("_g")


def drop_short(segments: DataFrame, least: int = 10) -> DataFrame:
    return segments.where(F.col("n_frames") >= least)


def speed_label(speed: Column, walk: float, jog: float, sprint: float) -> Column:
    """Idle, Walk, Jog or Sprint by three limits."""
    names = [F.lit(MOTION[n]) for n in ("Idle", "Walk", "Jog", "Sprint")]
    return F.when(speed < walk, names[0]).when(speed < jog, names[1]).when(speed < sprint, names[2]).otherwise(names[3])


def frame_label(speed: Column, vertical: Column, accel: Column, turn: Column) -> Column:
    """A row's motion type by the first rule that holds: jump, braking, turn, then speed. Speeds in cm/s, turns in degrees/s."""
    m = MOTION
    return (
        F.when(vertical > 200, F.lit(m["Jump"]))
        .when(accel < -300, F.lit(m["Decelerate"]))
        .when(F.abs(turn) > 90, F.when(turn < 0, F.lit(m["TurnLeft"])).otherwise(F.lit(m["TurnRight"])))
        .otherwise(speed_label(speed, 50, 200, 500))
    )


#: Measures of a window that the rules of window_label speak of.
MEASURES = (
    "speed", "max_speed", "turn", "yaw", "accel", "vertical", "lateral", "height_range",
    "left_leg", "right_leg", "left_arm", "right_arm", "left_arm_rom", "right_arm_rom",
)


def window_label(m: dict[str, Column]) -> Column:
    """A window's motion type by the first of fifteen rules that holds; ``m`` has MEASURES. The limits are fixed values.

    Speeds in cm/s, ``turn`` and ``yaw`` in degrees/s, limb activity in degrees per row.
    """
    legs, arms = (m["left_leg"] + m["right_leg"]) / 2, (m["left_arm"] + m["right_arm"]) / 2
    leg_gap, arm_gap = F.abs(m["left_leg"] - m["right_leg"]), F.abs(m["left_arm"] - m["right_arm"])
    speed = m["speed"]
    rules = [
        ("Idle", speed < 10),
        ("Jump", (m["height_range"] > 15) & (m["vertical"] > 30)),
        ("Slide", (m["lateral"] > 100) & (m["lateral"] > 0.6 * speed)),
        ("Tackle", (leg_gap > 20) & (legs > 25) & (speed > 100) & (m["height_range"] > 10)),
        ("TurnLeft", (m["turn"] > 90) & (m["yaw"] > 0)),
        ("TurnRight", m["turn"] > 90),
        ("Decelerate", (m["accel"] < -200) & (m["max_speed"] > 300)),
        ("Kick", (legs > 30) & (speed < 100) & (leg_gap > 15)),
        ("Shield", (arms > 25) & (arm_gap < 8) & (legs < 10) & (speed < 80)),
        ("Receive", (arms > 20) & (legs < 5) & (speed < 50)),
        ("Celebrate", (arms > 35) & (speed < 150) & (legs < 15)),
        ("Goalkeeper", (m["left_arm_rom"] > 40) & (m["right_arm_rom"] > 40) & (speed < 100) & (legs > 10)),
        ("Walk", speed < 120),
        ("Jog", speed < 250),
    ]
    out = F.when(rules[0][1], F.lit(MOTION[rules[0][0]]))
    for name, rule in rules[1:]:
        out = out.when(rule, F.lit(MOTION[name]))
    return out.otherwise(F.lit(MOTION["Sprint"]))


def label_windows(df: DataFrame, by: Names, order: Names, vel: Names, ang: Names, height: str, activity: dict[str, str] | None = None, rom: dict[str, tuple[str, ...]] | None = None, width: int = 10, out: str = "label") -> DataFrame:
    """Label each row by the rules over the window from ``width // 2`` before it to ``width // 2 - 1`` after.

    ``vel`` and ``ang`` are the three columns of root velocity and angular velocity, ``height`` the root's. ``activity`` names
    the columns with the turn of each limb's joints since the row before; ``rom`` the columns whose ranges are summed. Limbs that are
    not given count as still. Limb measures also take in the row after the window, as each is a step between two rows.
    """
    half = width // 2
    w = over(by, order)
    frame, wide = w.rowsBetween(-half, half - 1), w.rowsBetween(-half, half)
    x, y, z = (F.col(c) for c in vel)
    a, b, c = (F.col(k) for k in ang)
    df = df.withColumns({"_sp": F.sqrt(x * x + y * y + z * z), "_tu": F.sqrt(a * a + b * b + c * c)})
    n = F.count("*").over(frame)
    first, last = F.first("_sp").over(frame), F.last("_sp").over(frame)
    zero = F.lit(0.0)
    made = {
        "speed": F.avg("_sp").over(frame),
        "max_speed": F.max("_sp").over(frame),
        "turn": F.avg("_tu").over(frame),
        "yaw": F.sum(ang[1]).over(frame),
        "accel": F.when(n > 1, (last - first) / (n - 1)).otherwise(zero),
        "vertical": F.avg(F.abs(y)).over(frame),
        "lateral": F.avg(F.abs(x)).over(frame),
        "height_range": F.greatest(F.max(height).over(frame), zero) - F.min(height).over(frame),
    }
    for limb in ("left_leg", "right_leg", "left_arm", "right_arm"):
        col = (activity or {}).get(limb)
        # the first step of a window starts at the row before it, which is not in the window
        made[limb] = zero if col is None else F.coalesce(F.avg(col).over(w.rowsBetween(-half + 1, half)), zero)
    for limb in ("left_arm_rom", "right_arm_rom"):
        cols = (rom or {}).get(limb, ())
        made[limb] = sum((F.max(k).over(wide) - F.min(k).over(wide) for k in cols), zero) / max(1, len(cols) // 3)
    df = df.withColumns({f"_m_{k}": col for k, col in made.items()})
    df = df.withColumn(out, window_label({k: F.col(f"_m_{k}") for k in made}))
    return df.drop("_sp", "_tu", *(f"_m_{k}" for k in made))


def vote(windows: DataFrame, by: Names, start: str, logits: str, idx: str = "frame_idx") -> DataFrame:
    """Class probabilities of each row from overlapping windows: the mean of its logits in all windows, then softmax.

    ``logits`` is an array (row in the window) of arrays (class). Returns key, idx, probabilities, label and confidence.
    """
    rows = windows.select(*by, F.posexplode(logits).alias("_t", "_l"), F.col(start).alias("_s"))
    cells = rows.select(*by, (F.col("_s") + F.col("_t")).alias(idx), F.posexplode("_l").alias("_c", "_x"))
    means = cells.groupBy(*by, idx, "_c").agg(F.avg("_x").alias("_x"))
    packed = means.groupBy(*by, idx).agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_x"))), lambda s: s["_x"]).alias("_l"))
    out = packed.withColumn("probabilities", v.softmax(F.col("_l"))).drop("_l")
    return out.withColumn("label", v.argmax(F.col("probabilities")).cast("int")).withColumn("confidence", F.array_max("probabilities"))


def mean_probabilities(rows: DataFrame, by: Names, probabilities: str) -> DataFrame:
    """A clip's class: probabilities averaged over its rows, the greatest wins (the first of equal ones)."""
    cells = rows.select(*by, F.posexplode(probabilities).alias("class", "p"))
    means = cells.groupBy(*by, "class").agg(F.avg("p").alias("p"))
    return means.groupBy(*by).agg(
        F.max(F.struct("p", (-F.col("class")).alias("_c"))).alias("_m"),
        F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda s: s["p"]).alias("probabilities"),
    ).select(*by, (-F.col("_m._c")).alias("label"), F.col("_m.p").alias("confidence"), "probabilities")


def thin(df: DataFrame, by: Names, idx: str, least: int, out: str = "kept") -> DataFrame:
    """Keep a boundary if it is ``least`` rows or more after the last one that was kept; the first is always kept."""

    def step(last: int | None, row: tuple) -> tuple[int, int]:
        take = last is None or row[0] - last >= least
        return (row[0] if take else last), int(take)

    return recurrence(df, by, [idx], [idx], out, "long", step).where(F.col(out) == 1).drop(out)


def split_long(ranges: DataFrame, least: int, most: int, start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """Ranges cut into pieces of ``most`` rows; neighbours share the row between them. What is shorter than ``least`` goes.

    Adds ``piece``. The last piece may be as long as ``most`` or shorter.
    """
    span = F.col(end) - F.col(start)
    pieces = F.greatest(F.ceil(span / most).cast("int"), F.lit(1))
    out = ranges.where(span >= least).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    first = F.col(start) + F.col("piece") * most
    out = out.withColumns({"_a": first, "_b": F.least(first + most, F.col(end))})
    return out.withColumns({start: F.col("_a"), end: F.col("_b")}).drop("_a", "_b").where(F.col(end) - F.col(start) >= least)


def ranges_between(points: DataFrame, by: Names, idx: str) -> DataFrame:
    """From each boundary to the next: start_frame, end_frame."""
    nxt = F.lead(idx).over(over(by, [idx]))
    return points.select(*by, F.col(idx).alias("start_frame"), nxt.alias("end_frame")).where("end_frame is not null")


def limits(min_seconds: float, max_seconds: float, fps: float) -> tuple[int, int]:
    return max(1, int(min_seconds * fps)), int(max_seconds * fps)


def number_clips(ranges: DataFrame, by: Names) -> DataFrame:
    """clip_idx in each track, by place."""
    return ranges.withColumn("clip_idx", F.row_number().over(Window.partitionBy(*by).orderBy("start_frame", "end_frame")) - 1)


def clips_from_boundaries(rows: DataFrame, by: Names, boundary: str, idx: str = "frame_idx", min_seconds: float = 0.5, max_seconds: float = 5.0, fps: float = 30.0) -> DataFrame:
    """Clip ranges of rows with a boundary flag: thinned boundaries, long stretches cut, short ones dropped."""
    least, most = limits(min_seconds, max_seconds, fps)
    last = F.max(idx).over(whole(by))
    ends = (F.col(idx) == 0) | (F.col(idx) == F.col("_last"))
    points = rows.withColumn("_last", last).where(F.col(boundary) | ends).select(*by, idx)
    kept = thin(points, by, idx, least)
    return number_clips(split_long(ranges_between(kept, by, idx), least, most), by)


def clips_from_segments(segments: DataFrame, by: Names, min_seconds: float = 0.5, max_seconds: float = 5.0, fps: float = 30.0) -> DataFrame:
    """Clip ranges of segments: short ones dropped, long ones cut."""
    return number_clips(split_long(segments, *limits(min_seconds, max_seconds, fps)), by)


def frames_of(rows: DataFrame, ranges: DataFrame, by: Names, idx: str = "frame_idx", block: int = 256, keep: Names = ("clip_idx",)) -> DataFrame:
    """Rows of each range (ends included), numbered from 0: a range join that is an equi-join on blocks of rows.

    Each range is listed under every block that it touches and each row under its own, so nothing is compared outside its block.
    """
    names = [c for c in keep if c in ranges.columns]
    wide = ranges.select(
        *by,
        *names,
        F.col("start_frame").alias("_a"),
        F.col("end_frame").alias("_b"),
        F.explode(F.sequence(F.floor(F.col("start_frame") / block), F.floor(F.col("end_frame") / block))).alias("_block"),
    )
    keyed = rows.withColumn("_block", F.floor(F.col(idx) / block))
    out = keyed.join(wide, [*by, "_block"]).where(F.col(idx).between(F.col("_a"), F.col("_b")))
    return out.withColumn("source_frame", F.col(idx)).withColumn(idx, F.col(idx) - F.col("_a")).drop("_a", "_b", "_block")


def overlapping(segments: DataFrame, ranges: DataFrame, by: Names, block: int = 256, keep: Names = ("clip_idx",)) -> DataFrame:
    """Segments that meet each range, cut to it and counted from its start (an interval-overlap join on blocks)."""

    def blocks(a: str, b: str) -> Column:
        return F.sequence(F.floor(F.col(a) / block), F.floor(F.col(b) / block))

    names = [c for c in keep if c in ranges.columns]
    left = segments.withColumn("_block", F.explode(blocks("start_frame", "end_frame")))
    right = ranges.select(
        *by, *names, F.col("start_frame").alias("_a"), F.col("end_frame").alias("_b"), F.explode(blocks("start_frame", "end_frame")).alias("_block")
    )
    met = left.join(right, [*by, "_block"]).where((F.col("end_frame") >= F.col("_a")) & (F.col("start_frame") <= F.col("_b")))
    # a pair meets in several blocks; the one that holds the later start counts
    met = met.where(F.col("_block") == F.floor(F.greatest("start_frame", "_a") / block))
    cut = {
        "start_frame": F.greatest(F.col("start_frame") - F.col("_a"), F.lit(0)),
        "end_frame": F.least("end_frame", "_b") - F.col("_a"),
    }
    return met.withColumns(cut).drop("_a", "_b", "_block")


def sliding(df: DataFrame, by: Names, idx: str = "frame_idx", width: int = 64, stride: int = 32, short: str = "half") -> DataFrame:
    """Windows of each track: window, start_frame, end_frame, n_real (rows that are there).

    ``short`` says what becomes of a rest that does not fill a window: 'drop' it, 'pad' it, or pad it only if it has 'half' of one.
    """
    n = df.groupBy(*by).agg((F.max(idx) + 1).alias("_n"))
    full = F.when(F.col("_n") >= width, F.floor((F.col("_n") - width) / stride).cast("int") + 1).otherwise(0)
    rest = F.col("_n") - F.col("_full") * stride
    fits = (F.col("_full") == 0) | (F.col("_n") > (F.col("_full") - 1) * stride + width)
    least = {"drop": width + 1, "pad": 1, "half": width / 2}[short]
    more = (fits & (rest >= least) & (rest > 0)).cast("int")
    out = n.withColumn("_full", full).withColumn("_count", F.col("_full") + more).where("_count > 0")
    out = out.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    start = F.col("window") * stride
    return out.select(
        *by, "window", start.alias("start_frame"), (start + width - 1).alias("end_frame"), F.least(F.lit(width), F.col("_n") - start).alias("n_real")
    )


def window_rows(df: DataFrame, windows: DataFrame, by: Names, idx: str = "frame_idx", block: int = 64) -> DataFrame:
    """The rows of each window, in place ``pos``; rows beyond the end are not made here, see ``pad``."""
    out = frames_of(df, windows.withColumnRenamed("window", "clip_idx"), by, idx, block)
    return out.withColumnRenamed("clip_idx", "window").withColumnRenamed(idx, "pos").withColumnRenamed("source_frame", idx)


def window_gate(rows: DataFrame, by: Names, confidence: str, least_confidence: float = 0.2, least_valid: float = 0.8) -> DataFrame:
    """Windows whose mean confidence and share of positive confidences are high enough, with both rounded to 4 digits."""
    out = rows.groupBy(*by).agg(F.avg(confidence).alias("_c"), F.avg((F.col(confidence) > 0).cast("double")).alias("_v"))
    out = out.where((F.col("_c") >= least_confidence) & (F.col("_v") >= least_valid))
    return out.select(*by, F.round("_c", 4).alias("mean_confidence"), F.round("_v", 4).alias("valid_ratio"))


def next_row_pairs(df: DataFrame, by: Names, order: Names, cols: Names, context: int = 64) -> DataFrame:
    """Inputs and targets one row later, for every full context: arrays ``input`` and ``target``."""
    row = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
    w = over(by, order)
    df = df.withColumns({"_x": row, "_y": F.lead(row).over(w)}).withColumn("_has", F.lead(F.lit(1)).over(w))
    frame = w.rowsBetween(0, context - 1)
    df = df.withColumns({"input": F.collect_list("_x").over(frame), "target": F.collect_list("_y").over(frame), "_k": F.sum("_has").over(frame)})
    return df.where(F.col("_k") == context).drop("_x", "_y", "_has", "_k")


def names_of(code: Column, names: Sequence[str] = MOTION_TYPES) -> Column:
    return F.get(F.array(*map(F.lit, names)), code)
