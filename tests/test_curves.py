"""Splines against a dense solve, the median filter with mirrored ends against padded arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from displace.operators import series


def _dense(t, y, q):
    """Piecewise cubics of all intervals by one dense system: values, two derivatives continuous, two third derivatives without a jump."""
    n = len(t) - 1
    rows, right = [], []

    def row(*parts):
        r = np.zeros(4 * n)
        for k, x in parts:
            r[4 * k : 4 * k + 4] += x
        rows.append(r)

    for k in range(n):
        h = t[k + 1] - t[k]
        row((k, [1, 0, 0, 0]))
        row((k, [1, h, h**2, h**3]))
        right += [y[k], y[k + 1]]
        if k < n - 1:
            row((k, [0, 1, 2 * h, 3 * h**2]), (k + 1, [0, -1, 0, 0]))
            row((k, [0, 0, 2, 6 * h]), (k + 1, [0, 0, -2, 0]))
            right += [0, 0]
    row((0, [0, 0, 0, 1]), (1, [0, 0, 0, -1]))
    row((n - 2, [0, 0, 0, 1]), (n - 1, [0, 0, 0, -1]))
    m = np.linalg.solve(np.array(rows), np.array([*right, 0, 0])).reshape(n, 4)
    k = np.clip(np.searchsorted(t, q, "right") - 1, 0, n - 1)
    u = q - t[k]
    return sum(m[k, j] * u**j for j in range(4))


@pytest.mark.parametrize("n", [4, 5, 30])
def test_spline_equals_a_dense_solve(n):
    rng = np.random.default_rng(n)
    t, y = np.cumsum(rng.uniform(0.1, 1, n)), rng.normal(size=n)
    q = np.concatenate([t, rng.uniform(t[0] - 0.2, t[-1] + 0.2, 50)])
    assert np.allclose(series.spline(t, y, q), _dense(t, y, q), atol=1e-8)


def test_spline_of_a_cubic_is_the_cubic_and_of_few_points_their_polynomial():
    q = np.linspace(-1, 5, 40)
    for n in (1, 2, 3, 9):
        f = np.polynomial.Polynomial([2.0, -1.0, 0.5, 0.25][: min(n, 4)])
        t = np.linspace(0, 4, n) ** 1.2
        assert np.allclose(series.spline(t, f(t), q), f(q))


def test_spline_at_with_repeats_missing_values_and_groups_without_any(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 3.0), ("a", 1.0, 4.0), ("a", 2.0, None), ("a", None, 9.0), ("a", 2.0, float("nan")), ("c", 1.0, 1.0)], "g string, t double, v double")
    at = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("a", None), ("b", 1.0)], "g string, t double")
    got = sorted(((r.g, r.t, r.v) for r in series.spline_at(df, at, ["g"], "t", "v").collect()), key=str)
    assert got == [("a", 0.5, 3.0), ("a", 0.5, 3.0), ("a", None, None), ("b", 1.0, None)]
    assert series.spline_at(df.limit(0), at.limit(0), ["g"], "t", "v").count() == 0


@pytest.mark.parametrize("width", [1, 3, 9])
def test_median_filter_mirrors_the_ends(spark, width):
    rng = np.random.default_rng(7)
    groups = {n: rng.normal(size=n) for n in (1, 2, 3, 5, 40)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"g": k, "t": range(k), "v": x, "_own": 1}) for k, x in groups.items()]))
    got = series.median_filter(df, ["g"], ["t"], "v", width)
    assert got.columns == [*df.columns, "smooth"]
    got = got.toPandas().sort_values(["g", "t"])
    for k, x in groups.items():
        pad = np.pad(x, width // 2, mode="symmetric")
        want = [np.median(pad[i : i + width]) for i in range(k)]
        assert np.allclose(got["smooth"][got["g"] == k], want)
    assert series.median_filter(df.limit(0), ["g"], ["t"], "v", width).count() == 0


def test_median_filter_refuses_an_even_width(spark):
    with pytest.raises(ValueError):
        series.median_filter(spark.range(1), [], ["id"], "id", 4)
