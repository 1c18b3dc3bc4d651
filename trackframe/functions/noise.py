"""Noise schedules of diffusion and the steps that use them.

A schedule is a small table (a row for each time step) that plans broadcast; steps are array expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("linear", "cosine", "quadratic", "sigmoid")
EPS = 1e-20


def betas(kind: str, n: int, start: float = 1e-4, end: float = 0.02) -> list[float]:
    """Noise added at each of n steps."""
    frac = [k / (n - 1) if n > 1 else 0.0 for k in range(n)]
    if kind == "linear":
        return [start + (end - start) * x for x in frac]
    if kind == "quadratic":
        return [(math.sqrt(start) + x * (math.sqrt(end) - math.sqrt(start))) ** 2 for x in frac]
    if kind == "sigmoid":
        return [start + (end - start) / (1 + math.exp(6 - 12 * x)) for x in frac]
    if kind == "cosine":

        def level(t: float) -> float:
            return math.cos((t / n + 0.008) / 1.008 * math.pi / 2) ** 2

        return [min(max(1 - level(t + 1) / level(t), 0.0), 0.999) for t in range(n)]
    raise ValueError(f"unknown schedule {kind}; known are {KINDS}")


def schedule(spark: SparkSession, kind: str = "linear", n: int = 1000, start: float = 1e-4, end: float = 0.02) -> DataFrame:
    """t, beta, alpha, cumulative products and everything that the steps derive from them."""
    rows, product = [], 1.0
    for t, beta in enumerate(betas(kind, n, start, end)):
        before, product = product, product * (1 - beta)
        rows.append((t, beta, product, before))
    df = spark.createDataFrame(rows, "t int, beta double, alpha_bar double, alpha_bar_prev double")
    a, prev, beta = F.col("alpha_bar"), F.col("alpha_bar_prev"), F.col("beta")
    rest, safe = F.greatest(1 - a, F.lit(EPS)), F.greatest(a, F.lit(EPS))
    variance = beta * (1 - prev) / rest
    return df.select(
        "t",
        "beta",
        (1 - beta).alias("alpha"),
        "alpha_bar",
        "alpha_bar_prev",
        F.sqrt(a).alias("sqrt_alpha_bar"),
        F.sqrt(1 - a).alias("sqrt_one_minus_alpha_bar"),
        (1 / F.sqrt(safe)).alias("recip_sqrt_alpha_bar"),
        F.sqrt(F.greatest(1 / safe - 1, F.lit(0.0))).alias("sqrt_recip_minus_one"),
        (a / rest).alias("snr"),
        (10 * F.log10(F.greatest(a / rest, F.lit(EPS)))).alias("snr_db"),
        (beta * F.sqrt(prev) / rest).alias("mean_from_start"),
        ((1 - prev) * F.sqrt(1 - beta) / rest).alias("mean_from_now"),
        variance.alias("posterior_variance"),
        F.log(F.greatest(variance, F.lit(EPS))).alias("posterior_log_variance"),
    )


@dataclass(frozen=True)
class Step:
    """Columns of one schedule row, as the steps below use them; ``of`` takes them from a joined schedule."""

    alpha_bar: Column
    mean_from_start: Column
    mean_from_now: Column
    posterior_variance: Column

    @classmethod
    def of(cls, row: Column) -> Step:
        return cls(row["alpha_bar"], row["mean_from_start"], row["mean_from_now"], row["posterior_variance"])


def _combine(a: Column, x: Column, b: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: a * p + b * q)


def _clamped(x: Column) -> Column:
    return F.transform(x, lambda v: F.least(F.greatest(v, F.lit(-5.0)), F.lit(5.0)))


def add_noise(x0: Column, noise: Column, alpha_bar: Column) -> Column:
    return _combine(F.sqrt(alpha_bar), x0, F.sqrt(1 - alpha_bar), noise)


def predict_start(xt: Column, noise: Column, alpha_bar: Column) -> Column:
    safe = F.greatest(alpha_bar, F.lit(EPS))
    return _combine(1 / F.sqrt(safe), xt, -F.sqrt(F.greatest(1 / safe - 1, F.lit(0.0))), noise)


def predict_noise(xt: Column, x0: Column, alpha_bar: Column) -> Column:
    rest = F.greatest(F.sqrt(1 - alpha_bar), F.lit(1e-12))
    return _combine(1 / rest, xt, -F.sqrt(alpha_bar) / rest, x0)


def ddpm_step(xt: Column, noise: Column, step: Step, fresh: Column | None = None) -> Column:
    """One step back; ``fresh`` noise is added with the posterior's spread (none at t = 0, where that is 0)."""
    start = _clamped(predict_start(xt, noise, step.alpha_bar))
    mean = _combine(step.mean_from_start, start, step.mean_from_now, xt)
    return mean if fresh is None else _combine(F.lit(1.0), mean, F.sqrt(step.posterior_variance), fresh)


def ddim_step(xt: Column, noise: Column, now: Column, then: Column, eta: float = 0.0, fresh: Column | None = None) -> Column:
    """From alpha_bar ``now`` to ``then`` (1 at the end): struct(x, x0)."""
    ratio = (1 - then) / F.greatest(1 - now, F.lit(EPS)) * (1 - now / F.greatest(then, F.lit(EPS)))
    sigma = eta * F.sqrt(F.greatest(ratio, F.lit(0.0)))
    root = F.greatest(F.sqrt(now), F.lit(1e-12))
    start = _clamped(_combine(1 / root, xt, -F.sqrt(1 - now) / root, noise))
    ahead = F.sqrt(F.greatest(1 - then - sigma * sigma, F.lit(0.0)))
    moved = _combine(F.sqrt(then), start, ahead, noise)
    if fresh is not None and eta > 0:
        moved = _combine(F.lit(1.0), moved, sigma, fresh)
    return F.struct(moved.alias("x"), start.alias("x0"))


def ddim_schedule(spark: SparkSession, steps: int, n: int = 1000, quadratic: bool = False) -> DataFrame:
    """Time steps from noisy to clean: pos, t. Evenly spaced, or closer together near 0 without repeats."""
    k = F.col("k")
    at = F.pow(k / float(steps), F.lit(2.0)) * n if quadratic else k * (n / steps)
    df = spark.range(steps).select((F.lit(steps - 1) - F.col("id")).alias("k"))
    df = df.select("k", F.least(F.floor(at), F.lit(n - 1)).cast("int").alias("t"))
    if quadratic:  # equal steps are neighbours, so the first of each stays
        df = df.groupBy("t").agg(F.max("k").alias("k"))
    ranked = F.struct(-F.col("k"), F.col("t"))
    listed = df.agg(F.array_sort(F.collect_list(ranked)).alias("l"))  # a schedule has few steps
    return listed.select(F.posexplode(F.transform("l", lambda s: s["t"])).alias("pos", "t"))


def alpha_bar_at(products: Column, t: Column) -> Column:
    """alpha_bar between time steps, linearly, from the array of all."""
    low = F.least(F.greatest(F.floor(t), F.lit(0)), F.size(products) - 1).cast("int")
    high = F.least(low + 1, F.size(products) - 1)
    frac = F.least(F.greatest(t - low, F.lit(0.0)), F.lit(1.0))
    return F.get(products, low) * (1 - frac) + F.get(products, high) * frac
