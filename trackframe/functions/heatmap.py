"""Key points from heat maps: the window that is cut out of a frame, the peak between cells, the mean with a mirrored run.

Pixels and networks stay outside; these are the formulas before and after them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackframe.functions.geometry import clamp, let


def crop_window(box: Column, frame_w: float, frame_h: float, padding: float = 0.2, aspect: float = 0.75) -> Column:
    """The window (x1, y1, x2, y2) of whole pixels around a box: padded on each side, grown to the aspect about its centre, cut at the frame.

    Null where nothing of it is in the frame.
    """

    def window(cx: Column, cy: Column, w: Column, h: Column) -> Column:
        wide = w / F.greatest(h, F.lit(1.0)) > aspect
        half_w, half_h = F.when(wide, w).otherwise(h * aspect) / 2, F.when(wide, w / aspect).otherwise(h) / 2
        low = [F.greatest((c - half).cast("int"), F.lit(0)) for c, half in ((cx, half_w), (cy, half_h))]
        high = [F.least((c + half).cast("int"), F.lit(int(m))) for c, half, m in ((cx, half_w, frame_w), (cy, half_h, frame_h))]
        made = F.struct(low[0].alias("x1"), low[1].alias("y1"), high[0].alias("x2"), high[1].alias("y2"))
        return let(lambda m: F.when((m.x2 > m.x1) & (m.y2 > m.y1), m), made)

    grown = 1 + 2 * padding
    return let(window, box.x + box.w / 2, box.y + box.h / 2, box.w * grown, box.h * grown)


def peak(cells: Column, width: int) -> Column:
    """(x, y, conf) of a map given by rows: its first greatest cell, moved to the top of the parabola through it and its neighbours.

    The move is half a cell at most; there is none at the border or where the three are level.
    """

    def moved(place: Column, last: Column, before: Column, here: Column, after: Column) -> Column:
        bend = 2 * here - before - after
        inside = (place > 0) & (place < last) & (F.abs(bend) > 1e-6)
        return place + F.when(inside, clamp((after - before) / (2 * bend), -0.5, 0.5)).otherwise(0.0)

    def made(cells: Column, top: Column, at: Column) -> Column:
        x, y = at % width, F.floor(at / width)
        rows = F.floor(F.size(cells) / width)
        near = lambda k: F.get(cells, (at + k).cast("int"))
        across = moved(x, F.lit(width - 1), near(-1), top, near(1))
        down = moved(y, rows - 1, near(-width), top, near(width))
        return F.struct(across.cast("double").alias("x"), down.cast("double").alias("y"), top.alias("conf"))

    return let(lambda c: let(lambda top: let(lambda at: made(c, top, at), F.array_position(c, top) - 1), F.array_max(c)), cells)


def to_frame(point: Column, window: Column, map_w: int, map_h: int, frame_w: float, frame_h: float) -> Column:
    """A peak of the window's map as shares of the frame's width and height."""
    x = window.x1 + point.x * (window.x2 - window.x1) / map_w
    y = window.y1 + point.y * (window.y2 - window.y1) / map_h
    return F.struct((x / frame_w).alias("x"), (y / frame_h).alias("y"), point.conf.alias("conf"))


def mirrored(points: Column, n: int, pairs: Sequence[tuple[int, int]]) -> Column:
    """Points of a mirrored image (x as a share of the width) back in the image: x turned, left and right exchanged."""
    order = list(range(n))
    for a, b in pairs:
        order[a], order[b] = order[b], order[a]
    each = [F.get(points, F.lit(k)) for k in order]
    return F.array(*(F.struct((1 - p.x).alias("x"), p.y.alias("y"), p.conf.alias("conf")) for p in each))


def averaged(a: Column, b: Column) -> Column:
    """The means of two runs' points and confidences."""
    mean = lambda p, q: F.struct(*(((p[c] + q[c]) / 2).alias(c) for c in ("x", "y", "conf")))
    return F.zip_with(a, b, mean)
