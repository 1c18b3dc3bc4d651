"""Operators on ordered sequences that window functions express.

All take ``by`` (the columns that name a track) and ``order``, and add columns. Operators with the same ``by`` and ``order``
share one exchange and one sort when they are chained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackframe.functions import geometry as g

Names = Sequence[str]


def over(by: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def whole(by: Names) -> WindowSpec:
    return Window.partitionBy(*by)


def index(df: DataFrame, by: Names, order: Names, out: str = "frame_idx") -> DataFrame:
    """Position in the track, from 0."""
    return df.withColumn(out, F.row_number().over(over(by, order)) - 1)


def difference(df: DataFrame, by: Names, order: Names, col: str, dt: Column | float = 1.0, out: str = "velocity", first: float | None = 0.0) -> DataFrame:
    """(x - previous x) / dt; ``first`` where there is no previous row."""
    made = (F.col(col) - F.lag(col).over(over(by, order))) / dt
    return df.withColumn(out, made if first is None else F.coalesce(made, F.lit(first)))


def time_step(ts: str, by: Names, order: Names, fps: float = 30.0) -> Column:
    """Seconds since the previous row: from the time stamps if both are positive, else a frame; a frame also where they hardly differ."""
    before = F.lag(ts).over(over(by, order))
    dt = F.when((F.col(ts) > 0) & (before > 0), F.col(ts) - before).otherwise(1 / fps)
    return F.when(dt < 1e-6, 1 / fps).otherwise(dt)


def root_velocity(df: DataFrame, by: Names, order: Names, pos: str = "root_pos", ts: str = "ts", fps: float = 30.0, out: str = "root_vel") -> DataFrame:
    """Velocity vector from positions and time stamps; zero at the start."""
    before = F.lag(pos).over(over(by, order))
    dt = time_step(ts, by, order, fps)
    made = g.scale(g.sub(F.col(pos), before), 1 / dt)
    return df.withColumn(out, F.when(before.isNotNull(), made).otherwise(g.vec3(0, 0, 0)))


def root_angular_velocity(df: DataFrame, by: Names, order: Names, rot: str = "root_rot", ts: str = "ts", fps: float = 30.0, out: str = "root_ang_vel") -> DataFrame:
    """Axis of the turn since the previous row times degrees per second; zero at the start."""
    before = F.lag(rot).over(over(by, order))
    turn = g.to_axis_angle(g.q_mul(F.col(rot), g.q_conjugate(before)))
    made = g.scale(turn["axis"], turn["degrees"] / time_step(ts, by, order, fps))
    return df.withColumn(out, F.when(before.isNotNull(), made).otherwise(g.vec3(0, 0, 0)))


def yaw_rate(df: DataFrame, by: Names, order: Names, rot: str = "root_rot", fps: float = 30.0, out: str = "yaw_rate") -> DataFrame:
    """Angle of the turn since the previous row, in radians per second, with the sign of its vertical part."""
    before = F.lag(rot).over(over(by, order))
    turn = g.q_normalized(g.q_mul(F.col(rot), g.q_conjugate(before)))
    angle = 2 * F.acos(g.clamp(F.abs(turn.w), 0, 1))
    made = F.when(turn.y >= 0, angle).otherwise(-angle) * fps
    return df.withColumn(out, F.coalesce(made, F.lit(0.0)))


def moving_average(df: DataFrame, by: Names, order: Names, col: str, width: int = 5, out: str = "smooth") -> DataFrame:
    """Mean over a centred window that is cut at the ends."""
    half = width // 2
    return df.withColumn(out, F.avg(col).over(over(by, order).rowsBetween(-half, half)))


def smoothed_velocity(df: DataFrame, by: Names, order: Names, col: str, fps: float = 30.0, width: int = 5, out: str = "smooth_velocity", alone: str | Column | None = None) -> DataFrame:
    """Mean of the differences in a centred window; the first row has none, so a track of one row gets ``alone``."""
    half = width // 2
    step = F.col(col) - F.lag(col).over(over(by, order))
    df = df.withColumn("_step", step * fps)
    mean = F.avg("_step").over(over(by, order).rowsBetween(-half, half))
    rest = F.lit(0.0) if alone is None else F.col(alone) if isinstance(alone, str) else alone
    return df.withColumn(out, F.coalesce(mean, rest)).drop("_step")


def central_acceleration(df: DataFrame, by: Names, order: Names, col: str, dt: float = 1 / 30, out: str = "accel") -> DataFrame:
    """(next - previous) / 2 dt; 0 at both ends."""
    w = over(by, order)
    return df.withColumn(out, F.coalesce((F.lead(col).over(w) - F.lag(col).over(w)) / (2 * dt), F.lit(0.0)))


def turn_rate(df: DataFrame, by: Names, order: Names, angle: str, fps: float = 30.0, out: str = "turn_rate") -> DataFrame:
    """Signed change of a heading in radians, wrapped to half a turn, per second; 0 at the start."""
    diff = g.wrap_angle(F.col(angle) - F.lag(angle).over(over(by, order)))
    return df.withColumn(out, F.coalesce(diff * fps, F.lit(0.0)))


def planar_turn_rate(df: DataFrame, by: Names, order: Names, x: str, y: str, dt: float = 1 / 30, out: str = "turn_rate") -> DataFrame:
    """Signed degrees per second between unit vectors of two rows (arc sine of their cross product)."""
    w = over(by, order)
    turned = F.lag(x).over(w) * F.col(y) - F.lag(y).over(w) * F.col(x)
    return df.withColumn(out, F.coalesce(F.degrees(F.asin(g.clamp(turned, -1, 1))) / dt, F.lit(0.0)))


def contact(df: DataFrame, by: Names, order: Names, speed: str, height: str, fast: float = 2.0, high: float = 5.0, width: int = 3, out: str = "contact") -> DataFrame:
    """On the ground: slow and low in this row and all others of a centred window."""
    half = width // 2
    raw = F.coalesce((F.col(speed) < fast) & (F.col(height) < high), F.lit(False))
    df = df.withColumn("_raw", raw)
    return df.withColumn(out, F.min("_raw").over(over(by, order).rowsBetween(-half, half))).drop("_raw")


def hold(df: DataFrame, by: Names, order: Names, active: str, col: str, out: str = "held") -> DataFrame:
    """The value at the start of the current run of ``active`` rows; null outside runs. The first row of a track starts one."""
    w = over(by, order)
    begins = F.col(active) & ~F.coalesce(F.lag(active).over(w), F.lit(False))
    df = df.withColumn("_start", F.when(begins, F.col(col)))
    held = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(F.col(active), held)).drop("_start")


def foot_lock(df: DataFrame, by: Names, order: Names, active: str, blend: str, cols: Names, height: str | None = None, ground: float = 0.0) -> DataFrame:
    """While in contact, values go towards those at its start, by the blend; the height goes to the ground."""
    for c in cols:
        df = hold(df, by, order, active, c, "_held")
        k = F.col(blend)
        df = df.withColumn(c, F.when(F.col(active), F.col(c) * (1 - k) + F.col("_held") * k).otherwise(F.col(c))).drop("_held")
    if height:
        k = F.col(blend)
        df = df.withColumn(height, F.when(F.col(active), F.col(height) * (1 - k) + ground * k).otherwise(F.col(height)))
    return df


def peaks(df: DataFrame, by: Names, order: Names, col: str, least: float = 5.0, out: str = "peak") -> DataFrame:
    """Greater than both neighbours and than ``least``; the ends are no peaks."""
    w = over(by, order)
    x = F.col(col)
    found = (x > F.lag(col).over(w)) & (x > F.lead(col).over(w)) & (x > least)
    return df.withColumn(out, F.coalesce(found, F.lit(False)))


def mean_crossings(df: DataFrame, by: Names, order: Names, col: str) -> DataFrame:
    """Per track: rows, and how often the value goes from at most its mean to above it or back."""
    df = df.withColumn("_above", F.col(col) > F.avg(col).over(whole(by)))
    crossed = F.col("_above") != F.lag("_above").over(over(by, order))
    df = df.withColumn("_cross", F.coalesce(crossed, F.lit(False)).cast("int"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_cross").alias("crossings"))


def stride_frequency(crossings: DataFrame, fps: float = 30.0, out: str = "stride_frequency") -> DataFrame:
    """Crossings to strides per second: two to a stride; 0 for fewer than 10 rows or less than a tenth of a second."""
    seconds = (F.col("n") - 1) / fps
    made = F.when((F.col("n") >= 10) & (seconds >= 0.1), F.col("crossings") / 2 / seconds).otherwise(0.0)
    return crossings.withColumn(out, made)


def boundaries(
    df: DataFrame, by: Names, order: Names, vel: tuple[str, str, str], width: int = 5, speed_change: float = 150.0,
    direction_change: float = 45.0, jump: float = 100.0, stop: float = 10.0, out: str = "boundary",
) -> DataFrame:
    """Where the motion changes: by speed, by direction, by a jump or by a stop, comparing the window before with the one after.

    Each window reaches from the row to ``2 * (width // 2)`` rows away. Rows nearer to an end than ``width // 2 + 1`` are none.
    """
    half = width // 2
    w = over(by, order)
    before, after = w.rowsBetween(-2 * half, 0), w.rowsBetween(0, 2 * half)
    x, y, z = (F.col(c) for c in vel)
    df = df.withColumn("_speed", F.sqrt(x * x + y * y + z * z))
    df = df.withColumn("_n", F.count("*").over(whole(by))).withColumn("_i", F.row_number().over(w) - 1)
    v0, v1 = F.avg("_speed").over(before), F.avg("_speed").over(after)
    d0 = F.atan2(F.sum(vel[2]).over(before), F.sum(vel[0]).over(before))
    d1 = F.atan2(F.sum(vel[2]).over(after), F.sum(vel[0]).over(after))
    df = df.withColumns({"_v0": v0, "_v1": v1, "_d": F.abs(d1 - d0)})
    turned = F.degrees(F.when(F.col("_d") > F.pi(), 2 * F.pi() - F.col("_d")).otherwise(F.col("_d")))
    inside = (F.col("_i") >= half + 1) & (F.col("_i") < F.col("_n") - half - 1)
    found = (
        (F.abs(F.col("_v1") - F.col("_v0")) > speed_change)
        | ((turned > direction_change) & (F.col("_v0") > 30.0))
        | (F.abs(y) > jump)
        | ((F.col("_v0") > 50.0) & (F.col("_v1") < stop))
    )
    return df.withColumn(out, inside & found).drop("_speed", "_n", "_i", "_v0", "_v1", "_d")


def fill_gaps(df: DataFrame, by: Names, order: Names, col: str, valid: str | Column, idx: str = "frame_idx", ends: str = "keep", out: str | None = None) -> DataFrame:
    """Values of rows that are not valid, linearly between the nearest valid rows.

    ``ends`` says what rows before the first or after the last valid one get: 'keep' their value, or 'hold' the nearest valid one.
    Every row keeps its value where none is valid.
    """
    ok = F.col(valid) if isinstance(valid, str) else valid
    w = over(by, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_at", F.when(ok, F.struct(F.col(idx).alias("i"), F.col(col).alias("v"))))
    df = df.withColumn("_a", F.last("_at", ignorenulls=True).over(back)).withColumn("_b", F.first("_at", ignorenulls=True).over(ahead))
    a, b = F.col("_a"), F.col("_b")
    span = F.when(b["i"] > a["i"], b["i"] - a["i"])
    t = (F.col(idx) - a["i"]) / span
    between = F.when(a.isNotNull() & b.isNotNull(), a["v"] * (1 - t) + b["v"] * t)
    edge = F.coalesce(a["v"], b["v"]) if ends == "hold" else F.col(col)
    made = F.when(ok, F.col(col)).otherwise(F.coalesce(between, edge, F.col(col)))
    return df.withColumn(out or col, made).drop("_at", "_a", "_b")


def trim(df: DataFrame, by: Names, order: Names, speed: str, threshold: float = 5.0, margin: int = 5, idx: str = "frame_idx") -> DataFrame:
    """Rows from ``margin`` before the first fast one to ``margin`` after the last; tracks under three rows or without one stay whole."""
    w = whole(by)
    fast = F.when(F.col(speed) > threshold, F.col(idx))
    df = df.withColumns({"_lo": F.min(fast).over(w), "_hi": F.max(fast).over(w), "_n": F.count("*").over(w)})
    keep = F.col("_lo").isNull() | (F.col("_n") < 3) | F.col(idx).between(F.col("_lo") - margin, F.col("_hi") + margin)
    return df.where(keep).drop("_lo", "_hi", "_n")


def resample(df: DataFrame, by: Names, idx: str, fps: float, target: float, linear: Names, spherical: Names = (), held: Names = ()) -> DataFrame:
    """Tracks at another frame rate: numbers in ``linear`` go straight, quaternions in ``spherical`` along the arc, ``held`` stays the earlier row's.

    Returns the key, the new ``idx``, ``ts`` and the columns. ``idx`` must be dense from 0.
    """
    cols = [*linear, *spherical, *held]
    last = df.groupBy(*by).agg(F.max(idx).alias("_last"))
    count = F.floor(F.col("_last") / fps * target).cast("int")
    grid = last.select(*by, "_last", F.explode(F.sequence(F.lit(0), count)).alias("_k"))
    source = F.col("_k") / target * fps
    grid = grid.withColumn("_lo", F.least(F.floor(source).cast("int"), F.col("_last"))).withColumn("_t", source - F.col("_lo"))
    nxt = {f"_n_{c}": F.lead(c).over(over(by, [idx])) for c in (*linear, *spherical)}
    rows = df.withColumns(nxt).select(*by, F.col(idx).cast("int").alias("_lo"), *cols, *nxt)
    out = grid.join(rows, [*by, "_lo"])
    t = F.col("_t")
    made = [F.col(c) + (F.coalesce(F.col(f"_n_{c}"), F.col(c)) - F.col(c)) * t for c in linear]
    made += [F.when(F.col(f"_n_{c}").isNull() | (t <= 0), F.col(c)).otherwise(g.slerp(F.col(c), F.col(f"_n_{c}"), t)) for c in spherical]
    named = [m.alias(c) for m, c in zip(made, [*linear, *spherical])]
    return out.select(*by, F.col("_k").alias(idx), (F.col("_k") / target).alias("ts"), *named, *held)


def predicted_centre(df: DataFrame, by: Names, order: Names, cols: Names, last: int = 5) -> DataFrame:
    """Where a track is expected next: its place plus the mean of its last ``last`` steps, once it has two of them."""
    w = over(by, order)
    for c in cols:
        df = df.withColumn("_step", F.col(c) - F.lag(c).over(w))
        recent = w.rowsBetween(-(last - 1), 0)
        enough = F.count("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= 2
        df = df.withColumn(f"next_{c}", F.col(c) + F.when(enough, F.avg("_step").over(recent)).otherwise(0.0)).drop("_step")
    return df


def drop_repeats(df: DataFrame, by: Names, order: Names, col: str) -> DataFrame:
    """Without rows whose value is that of the row before."""
    before = F.lag(F.struct(col)).over(over(by, order))
    return df.withColumn("_b", before).where(F.col("_b").isNull() | ~F.col("_b")[col].eqNullSafe(F.col(col))).drop("_b")


def predict_trajectory(pos: Column, vel: Column, facing: Column, omega: Column, step: float = 0.5, horizon: float = 1.5) -> Column:
    """Places, velocities and headings ahead at constant speed and turn rate: array of (dt, pos, vel, facing)."""
    times = [step * k for k in range(1, int(horizon / step + 1e-4 / step) + 1)]

    def at(t: Column) -> Column:
        c, s = F.cos(omega * t), F.sin(omega * t)
        v = g.vec3(vel.x * c - vel.z * s, vel.y, vel.x * s + vel.z * c)
        return F.struct(t.alias("dt"), g.add(pos, g.scale(v, t)).alias("pos"), v.alias("vel"), (facing + omega * t).alias("facing"))

    return F.transform(F.array(*map(F.lit, times)), at)
