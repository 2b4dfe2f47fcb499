"""Seasonal, statistical and physical formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def superpose(a1: Column, a2: Column, phi1: Column | float = 0.0, phi2: Column | float = math.pi / 2) -> tuple[Column, Column]:
    """Amplitude and phase of the sum of two sines of one period; the phase gains pi where a1 is negative."""
    p1, p2 = (p if isinstance(p, Column) else F.lit(p) for p in (phi1, phi2))
    amplitude = F.sqrt(F.abs(a1 * a1 + a2 * a2 + 2 * a1 * a2 * F.cos(p1 - p2)))
    up, down = a1 * F.sin(p1) + a2 * F.sin(p2), a1 * F.cos(p1) + a2 * F.cos(p2)
    phase = F.atan(up / F.nullif(down, F.lit(0.0))) + math.pi / 2
    return amplitude, F.when(a1 < 0, phase + math.pi).otherwise(phase)


def logistic_step(t: Column, size: float, start: float, offset: float, duration: float) -> Column:
    """Generalised logistic of an extraction: G / (1 + exp(-k G (t - offset)) (G / start - 1)), k = 5.84 / duration."""
    k = 5.84 / duration
    return F.lit(size) / (1 + F.exp(-k * size * (t - offset)) * (size / start - 1))


def thermal_expansion(length: Column, alpha: Column, delta: Column, e_length: Column, e_alpha: Column, e_delta: Column) -> tuple[Column, Column]:
    """Movement alpha * length * dT and its error from relative errors in quadrature."""
    moved = alpha * length * delta
    return moved, F.abs(moved) * F.sqrt(e_length * e_length + e_alpha * e_alpha + e_delta * e_delta)


def uncertain_mean(stds: Column) -> Column:
    """Error of the mean of values with standard deviations: sqrt(sum s^2) / n."""
    return F.sqrt(F.aggregate(stds, F.lit(0.0), lambda a, s: a + s * s)) / F.size(stds)


def r_squared(df: DataFrame, keys: list[str], data: str, fitted: str, terms: int) -> DataFrame:
    """R2 = 1 - residual / total sum of squares per group, and adjusted for `terms` regressors; one pass of mergeable sums."""
    d, r = F.col(data), F.col(data) - F.col(fitted)
    g = df.groupBy(*keys).agg(F.count(data).alias("n"), F.sum(r * r).alias("ss_res"), (F.var_pop(d) * F.count(d)).alias("ss_tot"))
    r2 = 1 - F.col("ss_res") / F.nullif(F.col("ss_tot"), F.lit(0.0))
    return g.select(*keys, "n", r2.alias("r2"), F.when(F.col("n") > terms + 1, 1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - terms - 1)).alias("adj_r2"))
