"""Whole tables: what queries without SQL give is held against brute force on the smallest tables."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import displace.queries  # noqa: F401
from displace import registry
from displace.operators import cluster, raster, series

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark):
    return {k: registry.view(spark, SF, k).toPandas() for k in ("psi_series", "psi_points", "catalogue", "sites")}


def _weeks(s):
    return (s["ts"] - np.datetime64("2024-01-01")).dt.total_seconds() / (7 * 86400)


def test_event_series_has_every_event_of_the_cut(spark, tables):
    s, p, e = tables["psi_series"].copy(), tables["psi_points"], tables["catalogue"]
    s["w"] = _weeks(s)
    at = s.merge(p[["ps_id", "x", "y"]], on="ps_id")
    want = {}
    for i in e["id"][e["magnitude"].astype(float) >= 2.5].astype(int):
        own = at[(at["x"] - i * 7919 % 10007) ** 2 + (at["y"] - i * 104729 % 10009) ** 2 <= 1e6]
        own = own[own["value"].notna()]
        if len(own) >= 2:
            b, a = np.polyfit(own["w"], own["value"].astype(float), 1)
            want[i] = (len(own), a, b)
    got = {r.id: (r.n, r.m0, r.m1) for r in registry.QUERIES["event_series_all"](spark, SF).collect()}
    assert len(want) > 300 and set(got) == set(want)
    assert all(got[i][0] == n and abs(got[i][1] - a) < 1e-3 and abs(got[i][2] - b) < 1e-3 for i, (n, a, b) in want.items())


def test_well_correlation_has_every_site(spark, tables):
    s, p, w = tables["psi_series"].copy(), tables["psi_points"], tables["sites"]
    s["d"] = s["ts"].dt.date
    level = s[s["direction"] == "click"].groupby("d")["value"].mean().rename("w")
    want = {}
    for r in w.itertuples():
        near = p["ps_id"][(p["x"] - r.cx) ** 2 + (p["y"] - r.cy) ** 2 <= 4e6]
        v = s[(s["direction"] == "view") & s["ps_id"].isin(near)].groupby("d")["value"].median().rename("v")
        j = v.to_frame().join(level, how="inner").dropna()
        if len(j) > 5:
            want[r.grp] = (len(j), j["v"].corr(j["w"]), j["v"].rank().corr(j["w"].rank()))
    got = {r.grp: (r.n, r.pearson, r.spearman) for r in registry.QUERIES["well_correlation_all"](spark, SF).collect()}
    assert any(k % 5 for k in want) and set(got) == set(want)
    assert all(got[k][0] == x[0] and all(math.isclose(a, b, abs_tol=1e-4) for a, b in zip(got[k][1:], x[1:], strict=True)) for k, x in want.items())


def _daily(tables):
    s = tables["psi_series"]
    i = (s["ts"].dt.normalize() - np.datetime64("2024-01-01")).dt.days
    return [s[s["direction"] == k].groupby(i)["value"].mean().reindex(range(i.max() + 1)) for k in ("click", "view")]


def test_cross_correlation_has_every_lag(spark, tables):
    a, b = (x - x.mean() for x in _daily(tables))
    want = np.correlate(a.fillna(0), b.fillna(0), "full")
    got = {r.lag: (r.r, r.best) for r in registry.QUERIES["cross_correlation_full"](spark, SF).collect()}
    n = len(a)
    assert set(got) == set(range(1 - n, n))
    assert all(abs((got[k - n + 1][0] or 0.0) - x) < 1e-4 for k, x in enumerate(want / want.max()))
    assert [k for k, (_, best) in got.items() if best] == [int(want.argmax()) - n + 1]


def test_cross_correlation_finds_a_far_lag(spark):
    df = spark.createDataFrame([(0, i, float(i == 70), float(i == 5)) for i in range(100)], "k int, i long, a double, b double")
    far = series.cross_correlation(df, ["k"], "i", "a", "b")
    assert far.count() == 199 and far.where("r = 1").first().lag == 65
    near = series.cross_correlation(df, ["k"], "i", "a", "b", shown=10)
    assert near.count() == 21 and near.where("r = 1").count() == 0


def test_wavelet_power_has_the_reference_scales_and_cone(spark, tables):
    y = _daily(tables)[0].to_numpy(float)
    i = np.arange(len(y))
    ok = np.isfinite(y)
    d = y - np.polyval(np.polyfit(i[ok], y[ok], 1), i)
    d = np.where(ok, d / d[ok].std(), 0.0)
    rows = registry.QUERIES["wavelet_power_full"](spark, SF).collect()
    scales = 8 * 2 ** (np.arange(85) / 12)
    got = {(r.i, round(12 * math.log2(r.scale / 8))): r for r in rows}
    days = set(tables["psi_series"]["ts"].dt.normalize())
    assert len(got) == len(rows) == len(days) * 85
    flambda = 4 * math.pi / (6 + math.sqrt(38))
    n = len(y)
    for (t, k), r in got.items():
        x = (i - t) / scales[k]
        w = (d * np.exp(-x * x / 2 + 6j * x)).sum()
        cone = 1 / (flambda / math.sqrt(2) * (n / 2 - abs(t - (n - 1) / 2)))
        assert abs(r.scale - scales[k]) < 1e-4 and abs(r.power - abs(w) ** 2 / math.sqrt(math.pi) / scales[k] ** 2) < 1e-3
        assert abs(r.freq - 1 / (flambda * scales[k])) < 1e-4 and abs(r.coi - min(cone, 1 / (flambda * 8))) < 1e-4


def test_adaptive_split_keeps_a_crowded_spot(spark):
    df = spark.range(700).select(F.when(F.col("id") < 500, 12.34).otherwise(F.col("id") % 37 * 1.0).alias("x"), F.when(F.col("id") < 500, 5.67).otherwise(F.col("id") % 41 * 1.0).alias("y"))
    rows = cluster.adaptive_split(df, "x", "y", 80).collect()
    over = [r for r in rows if r.over]
    assert len(over) == 1 and over[0].n == 500 and over[0].minx <= 12.34 <= over[0].maxx and over[0].miny <= 5.67 <= over[0].maxy
    assert all(r.over or r.n <= 80 for r in rows) and sum(r.n for r in rows) >= 700
    cut = cluster.adaptive_split(df, "x", "y", 80, rounds=2).collect()
    assert any(r.over for r in cut) and sum(r.n for r in cut) >= 700


def test_contours_of_a_table_too_wide_for_one_array(spark):
    far = 10**7
    px = spark.createDataFrame([(0, at + i, at + j, 2.0 + i) for at in (0, far) for i in range(3) for j in range(4)], "tile int, r long, c long, v double")
    rows = raster.contours(px, [1.0]).collect()
    assert sorted(round(min(p.x for p in r.ring)) // far for r in rows) == [0, 1]
    assert abs(rows[0].area - rows[1].area) < 1e-6


def test_contours_equal_one_array(spark):
    z = np.random.default_rng(4).normal(size=(12, 15)).round(3)
    px = spark.createDataFrame([(3, i, j, float(z[i, j])) for i in range(12) for j in range(15)], "tile int, r long, c long, v double")
    got = raster.contours(px, [0.4, 1.0], 0.1, 2.0).collect()
    shape = lambda ring: sorted((round(x, 6), round(y, 6)) for x, y in ring)
    want = []
    for level in (-1.0, -0.4, 0.4, 1.0):
        for ring in raster.rings(np.pad(z if level > 0 else -z, 1), abs(level)):
            xy = [((b - 0.5) * 2, (a - 0.5) * 2) for a, b in ring]
            area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(xy, xy[1:] + xy[:1], strict=True))) / 2
            if area > 0.1:
                want.append((level, round(area, 6), shape(xy)))
    assert sorted((r.level, round(r.area, 6), shape((p.x, p.y) for p in r.ring)) for r in got) == sorted(want)
