"""Augmentations of sequences (array of frames, each an array of numbers), random but repeatable from a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackframe.functions import vectors as v
from trackframe.schema import MIRRORED


def uniform(key: Column, salt: int | Column, seed: int = 42) -> Column:
    """A number in (0, 1) for a key: the same wherever and whenever it is computed."""
    h = F.xxhash64(key, salt if isinstance(salt, Column) else F.lit(salt), F.lit(seed))
    return (F.pmod(h, F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(key: Column, salt: Column, seed: int = 42) -> Column:
    """A standard normal number for a key (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(key, salt * 2, seed))) * F.cos(2 * F.pi() * uniform(key, salt * 2 + 1, seed))


def add_noise(frames: Column, key: Column, spread: float, seed: int = 42) -> Column:
    def one(row: Column, t: Column) -> Column:
        return F.transform(row, lambda x, d: x + spread * normal(key, t * 100_000 + d, seed))

    return F.transform(frames, one)


def crop(frames: Column, key: Column, length: int, seed: int = 42) -> Column:
    """``length`` frames from a random place; a shorter sequence is filled up with its last frame."""
    n = F.size(frames)
    start = F.floor(uniform(key, 7, seed) * F.greatest(n - length + 1, F.lit(1))).cast("int")
    at = F.sequence(F.lit(0), F.lit(length - 1))
    return F.transform(at, lambda k: F.element_at(frames, F.least(start + k + 1, n)))


def change_speed(frames: Column, factor: Column | float) -> Column:
    """Frames taken at another pace (the nearest earlier one); above 1 is faster."""
    n = F.size(frames)
    count = F.greatest(F.floor(n / factor).cast("int"), F.lit(1))
    at = F.sequence(F.lit(0), count - 1)
    return F.transform(at, lambda k: F.element_at(frames, F.least(F.floor(k * factor).cast("int"), n - 1) + 1))


def mirror(frames: Column, width: int = 3) -> Column:
    """Left and right joints exchanged in frames of 22 joints with ``width`` numbers each, the first negated."""
    order = [j * width + a for j in MIRRORED for a in range(width)]

    def one(row: Column) -> Column:
        return F.transform(v.permuted(row, order), lambda x, k: F.when(k % width == 0, -x).otherwise(x))

    return F.transform(frames, one)


def roll(frames: Column, steps: int) -> Column:
    """Frames moved in time, around the end."""
    return v.roll(frames, steps)
