"""Stencils on blocks and exact percentiles without a task of all values, against whole arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from displace.operators import aggregates, raster


def _table(spark, z, tile=0):
    r, c = np.nonzero(~np.isnan(z))
    return spark.createDataFrame(pd.DataFrame({"tile": tile, "r": r, "c": c, "v": z[r, c]}))


@pytest.mark.parametrize("block", [4, 7, 256])
def test_horn_over_blocks_equals_one_array(spark, block):
    z = np.random.default_rng(1).normal(size=(23, 17))
    z[5, 6] = np.nan
    px = _table(spark, z - 3).withColumn("r", raster.c("r") - 9).withColumn("c", raster.c("c") - 4)
    got = {(x.r + 9, x.c + 4): (x.dx, x.dy) for x in raster.stencil(px, raster.horn(2.0), ["dx", "dy"], block=block).collect()}
    want = {}
    for i in range(1, 22):
        for j in range(1, 16):
            n = z[i - 1 : i + 2, j - 1 : j + 2]
            if not np.isnan(n).any():
                w = np.array([1, 2, 1])
                want[i, j] = ((n[:, 2] - n[:, 0]) @ w / 16, (n[2] - n[0]) @ w / 16)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_central_slope_is_numpys_gradient(spark):
    z = np.random.default_rng(2).normal(size=(300, 270))
    a, b = np.gradient(z)
    want = np.degrees(np.arctan(np.sqrt(a**2 + b**2)))
    got = raster.central_slope(_table(spark, z)).toPandas()
    assert len(got) == z.size and np.allclose(got["slope"], want[got["r"], got["c"]])


def test_stencil_on_repeats_nulls_and_empty_tables(spark):
    rows = [(0, i, j, float(i)) for i in range(3) for j in range(3)] + [(0, 1, 2, -9.0), (0, 0, 0, None), (0, None, 1, 2.0), (None, 1, 1, 1.0), (0, 2, 2, float("nan"))]
    px = spark.createDataFrame(rows, "tile int, r long, c long, v double")
    got = raster.stencil(px, raster.horn(1.0), ["dx", "dy"]).collect()
    assert [(x.tile, x.r, x.c, x.v, x.dx, x.dy) for x in got] == [(0, 1, 1, 1.0, 0.0, 1.0)]
    assert raster.central_slope(px.withColumn("tile", raster.c("tile").cast("string"))).select("tile").distinct().count() == 1
    assert raster.central_slope(px.limit(0)).count() == 0


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_percentiles_of_skewed_groups(spark, accuracy):
    rng = np.random.default_rng(3)
    hot = np.concatenate([rng.normal(size=3000), np.full(3000, 0.25), [1e300, -1e300, 1e-300], rng.normal(size=500) * 1e-12])
    groups = {"hot": hot, "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "same": np.full(400, 7.5), "far": np.exp(rng.normal(size=900) * 40)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"g": k, "v": x}) for k, x in groups.items()] + [pd.DataFrame({"g": ["none", "one", "two"], "v": [None, np.nan, np.inf]})]))
    qs = (0.0, 0.05, 0.5, 0.999, 1.0)
    got = {r.g: (r.n, r.p) for r in aggregates.exact_percentiles(df, ["g"], "v", qs, most=20, bins=16, accuracy=accuracy).collect()}
    assert set(got) == set(groups)
    assert all(got[k][0] == len(x) and np.allclose(got[k][1], np.quantile(x, qs), rtol=1e-12) for k, x in groups.items())


def test_percentiles_without_groups(spark):
    v = np.random.default_rng(4).normal(size=5000).round(2)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    row = aggregates.exact_percentiles(df, [], "v", (0.1, 0.95), most=100, bins=8, accuracy=100).first()
    assert row.n == 5000 and np.allclose(row.p, np.percentile(v, [10, 95]))
    empty = aggregates.exact_percentiles(df.limit(0), [], "v", (0.5,)).collect()
    assert len(empty) == 1 and empty[0].n == 0 and empty[0].p is None
    assert aggregates.exact_percentiles(df.limit(0).selectExpr("1 g", "v"), ["g"], "v", (0.5,)).count() == 0


def test_clip_keeps_rows_without_a_limit(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -5.0), ("a", 2.0), ("b", None), (None, 3.0)], "g string, v double")
    got = sorted(((r.g or "-", r.v if r.v is not None else "-") for r in aggregates.clip_percentile(df, ["v"], 0.5, ["g"]).collect()), key=str)
    assert got == [("-", "-"), ("a", "-"), ("a", 1.0), ("a", 2.0), ("b", "-")]
