"""Correlation and wavelets by Fourier transforms against sums over all pairs: long series, gaps, missing values, repeated steps."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from displace.operators import series

N = 7667


def _pairs(at, x, y):
    out = {}
    for i, p in zip(at, x, strict=True):
        for j, q in zip(at, y, strict=True):
            out[i - j] = out.get(i - j, 0.0) + p * q
    return out


def test_correlate_equals_all_pairs_dense_and_sparse():
    rng = np.random.default_rng(3)
    for at in (np.arange(40), np.sort(rng.choice(60, 35, replace=False)) - 20, np.array([0, 7, 10**15]), np.array([5])):
        x, y = rng.normal(size=(2, len(at)))
        lag, (got, met) = series.correlate(at, [(x, y), (np.ones(len(at)), np.ones(len(at)))])
        want = _pairs(at.tolist(), x, y)
        assert {int(k) for k, m in zip(lag, met, strict=True) if m > 0.5} == set(want)
        assert all(abs(g - want.get(int(k), 0.0)) < 1e-9 for k, g in zip(lag, got, strict=True))


def test_cross_correlation_with_missing_values_and_repeated_steps(spark):
    rows = [(0, 0, 1.0, 2.0), (0, 0, 3.0, None), (0, 1, None, 5.0), (0, 2, float("nan"), -1.0), (0, 5, 4.0, 0.5), (0, None, 9.0, 9.0), (None, 3, 1.0, 1.0), (None, 4, 2.0, 3.0), (1, 7, 2.0, 2.0), (2, 1, None, None)]
    df = spark.createDataFrame(rows, "k int, i long, a double, b double")
    got = {(r.k, r.lag): r.r for r in series.cross_correlation(df, ["k"], "i", "a", "b").collect()}
    a = [(0, 1 - 8 / 3), (0, 3 - 8 / 3), (5, 4 - 8 / 3)]
    b = [(0, 2 - 1.625), (1, 5 - 1.625), (2, -1 - 1.625), (5, 0.5 - 1.625)]
    want = {}
    for i, p in a:
        for j, q in b:
            want[i - j] = want.get(i - j, 0.0) + p * q
    top = max(want.values())
    assert {lag for k, lag in got if k == 0} == {i - j for i in (0, 1, 2, 5) for j in (0, 1, 2, 5)}
    assert all((got[0, lag] is None) == (lag not in want) and (lag not in want or abs(got[0, lag] - want[lag] / top) < 1e-9) for k, lag in got if k == 0)
    assert {lag for k, lag in got if k is None} == {-1, 0, 1} and got[1, 0] is None and got[2, 0] is None
    assert series.cross_correlation(df.limit(0), ["k"], "i", "a", "b").count() == 0


def test_a_series_of_the_usual_length_takes_seconds(spark):
    rng = np.random.default_rng(5)
    a, b = np.cumsum(rng.normal(size=(2, N)), axis=1)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(N), "a": a, "b": b}))
    began = time.perf_counter()
    got = series.cross_correlation(df, ["k"], "i", "a", "b").toPandas().sort_values("lag")
    want = np.correlate(a - a.mean(), b - b.mean(), "full")
    assert len(got) == 2 * N - 1 and np.allclose(got["r"], want / want.max(), atol=1e-9)
    power = series.wavelet_power(df, ["k"], "i", "a", 1 / 12, 85, 8.0)
    assert power.where("power is not null").count() == 85 * N
    assert time.perf_counter() - began < 60
    y = a - np.polyval(np.polyfit(np.arange(N), a, 1), np.arange(N))
    y = y / y.std()
    for r in power.where(F.col("i").isin(0, 17, N // 2, N - 1)).collect():
        x = np.arange(-math.ceil(4 * r.scale), math.ceil(4 * r.scale) + 1)
        own = x[(x + r.i >= 0) & (x + r.i < N)]
        w = (y[own + r.i] * np.exp(-((own / r.scale) ** 2) / 2 + 6j * own / r.scale)).sum()
        assert math.isclose(r.power, abs(w) ** 2 / math.sqrt(math.pi) / r.scale**2, rel_tol=1e-6, abs_tol=1e-9)


def test_wavelets_with_gaps_and_missing_values(spark):
    rng = np.random.default_rng(6)
    at = np.concatenate([np.arange(30), np.arange(50, 70), [10**12]])
    v = rng.normal(size=len(at))
    v[[3, 4, 40]] = np.nan
    rows = [(1, int(i), None if math.isnan(x) else float(x)) for i, x in zip(at, v, strict=True)] + [(2, i, 5.0) for i in range(4)] + [(3, 0, 1.0), (3, 0, 2.0), (4, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, i long, v double")
    named = series.wavelet_power(df.withColumn("s", F.concat(F.lit("s"), "k")), ["s"], "i", "v", 0.5, 5)
    assert named.where("power is not null").select("s").distinct().collect() == [("s1",)]
    got = series.wavelet_power(df, ["k"], "i", "v", 0.5, 5).collect()
    assert all(r.power is None for r in got if r.k != 1) and {r.k for r in got} == {1, 2, 3}
    ok = np.isfinite(v)
    t = at - at[ok].mean()
    y = v - v[ok].mean()
    y = y - t * (t[ok] @ y[ok]) / (t[ok] @ t[ok])
    y = y / y[ok].std()
    own = [r for r in got if r.k == 1]
    assert len(own) == 5 * len(at)
    for r in own:
        near = ok & (np.abs(at - r.i) <= math.ceil(4 * r.scale))
        x = (at[near] - r.i) / r.scale
        w = (y[near] * np.exp(-x * x / 2 + 6j * x)).sum()
        assert (r.power is None) == (not near.any()) and (r.power is None or math.isclose(r.power, abs(w) ** 2 / math.sqrt(math.pi) / r.scale**2, rel_tol=1e-6, abs_tol=1e-9))
