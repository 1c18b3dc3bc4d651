"""Vectors of any length as array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackframe.functions.geometry import let


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return let(lambda a: F.sqrt(dot(a, a)), a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the product of the norms is not above 1e-8."""
    return let(lambda a, b: let(lambda n: F.when(n > 1e-8, dot(a, b) / n).otherwise(0.0), norm(a) * norm(b)), a, b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalized(a: Column) -> Column:
    """Unit vector; unchanged where the norm is not above 1e-8."""
    return let(lambda a: _with_value(lambda n: F.when(n > 1e-8, F.transform(a, lambda x: x / n)).otherwise(a), norm(a)), a)


def _with_value(fn: Callable[[Column], Column], value: Column) -> Column:
    """``fn(value)`` with the value computed once, however short its text: inside another lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def clip01(t: Column) -> Column:
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def lerp(a: Column, b: Column, t: Column | float, unit: bool = True) -> Column:
    t = clip01(t if isinstance(t, Column) else F.lit(float(t)))
    mixed = F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)
    return normalized(mixed) if unit else mixed


def slerp(a: Column, b: Column, t: Column | float, unit: bool = True) -> Column:
    """Along the arc between two unit vectors; linear where they are less than 1e-6 apart."""
    t = clip01(t if isinstance(t, Column) else F.lit(float(t)))

    def weighted(a: Column, b: Column, w: Column) -> Column:
        mixed = F.zip_with(a, b, lambda x, y: w["a"] * x + w["b"] * y)
        return F.when(w["near"], lerp(a, b, t, unit)).otherwise(normalized(mixed) if unit else mixed)

    def weights(angle: Column) -> Column:
        wa, wb = F.try_divide(F.sin((1 - t) * angle), F.sin(angle)), F.try_divide(F.sin(t * angle), F.sin(angle))
        return F.struct(wa.alias("a"), wb.alias("b"), (angle < 1e-6).alias("near"))

    def arc(a: Column, b: Column) -> Column:
        angle = F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0)))
        return _with_value(lambda w: weighted(a, b, w), _with_value(weights, angle))

    return let(arc, a, b)


def steps(n: int) -> Column:
    """0, 1/n .. 1 as an array, for sequences between two vectors."""
    n = max(1, n)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: k / float(n))


def blend(vectors: list[Column], weights: list[float], unit: bool = True) -> Column:
    """Weighted mean of several vectors; null where there are none or the weights sum to nothing."""
    pairs = list(zip(vectors, weights))
    total = float(sum(weights))
    if not pairs or total < 1e-8:
        return F.lit(None).cast("array<double>")
    out = scale(pairs[0][0], pairs[0][1] / total)
    for v, w in pairs[1:]:
        out = add(out, scale(v, w / total))
    return normalized(out) if unit else out


def argmax(a: Column) -> Column:
    """Position (from 0) of the first greatest element."""
    return F.array_position(a, F.array_max(a)) - 1


def softmax(a: Column) -> Column:
    e = _with_value(lambda top: F.transform(a, lambda x: F.exp(x - top)), F.array_max(a))

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
        return _with_value(lambda t: F.transform(e, lambda x: x / t), total)

    return _with_value(shares, e)


def median(a: Column) -> Column:
    """Mean of the middle two for an even count; null when empty."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2)

    return _with_value(middle, F.array_sort(a))


def upper_median(a: Column) -> Column:
    """Element n/2 (from 0) of the sorted values: the upper one for an even count."""
    return F.when(F.size(a) > 0, F.element_at(F.array_sort(a), F.floor(F.size(a) / 2).cast("int") + 1))


def pad(a: Column, n: int, value: float = 0.0) -> Column:
    """The first n elements, filled up with a value."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(float(value)), n)), 1, n)


def roll(a: Column, k: int) -> Column:
    """Elements moved k places to the right, around the end."""
    n = F.size(a)
    cut = n - F.pmod(F.lit(k), F.greatest(n, F.lit(1)))
    return F.when(n > 0, F.concat(F.slice(a, cut + 1, n), F.slice(a, F.lit(1), cut))).otherwise(a)


def pick(a: Column, n: int) -> Column:
    """n elements at evenly spaced places, first and last included."""
    last = F.size(a) - 1
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(at, lambda k: F.element_at(a, F.floor(k * last / max(1, n - 1)).cast("int") + 1))


def permuted(a: Column, order: list[int] | tuple[int, ...]) -> Column:
    return F.array(*(F.get(a, F.lit(k)) for k in order))
