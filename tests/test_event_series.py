"""Series near events: every event of the table has its fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

c = F.col


def test_every_event_has_a_fit(spark):
    from displace.queries.series import event_series

    s = spark.createDataFrame([(1, "click", f"2024-01-{d:02}", 2.0 * d) for d in (1, 8, 15)], "ps_id long, direction string, ts string, value double").withColumn("ts", c("ts").cast("timestamp_ntz"))
    p = spark.createDataFrame([(1, 7919.0, 4639.0)], "ps_id long, x double, y double")
    o = spark.createDataFrame([(k, price) for k, price in ((1, 500000.0), (1 + 10007 * 10009, 1000.0), (1 + 2 * 10007 * 10009, None), (5, 495000.0))], "o_orderkey long, o_totalprice double")
    got = {r["id"]: (r["n"], r["m1"]) for r in event_series(s, p, o).collect()}
    assert got == {1 + k * 10007 * 10009: (3, 14.0) for k in range(3)}


def test_sums_of_many_centres_in_a_tile_equal_pairs(spark):
    from displace.operators.regions import _blocks, radius_sums

    rng = np.random.default_rng(3)
    place = lambda n: np.where(rng.random((n, 2)) < 0.5, rng.integers(0, 40, (n, 2)), rng.random((n, 2)) * 40)
    p, w = place(400), place(3000)
    v = rng.integers(-9, 9, 400) / 4
    blocks = _blocks(w[:, 0], w[:, 1], 0.7)
    assert len(blocks) > 50 and sorted(np.concatenate(blocks)) == [*range(3000)]
    assert [len(b) for b in _blocks(np.zeros(5), np.zeros(5), 0.7)] == [5]
    points = spark.createDataFrame(pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "n": 1.0, "v": v}))
    centres = spark.createDataFrame(pd.DataFrame({"g": np.arange(3000), "cx": w[:, 0], "cy": w[:, 1]}))
    near = ((p[None, :, 0] - w[:, :1]) ** 2 + (p[None, :, 1] - w[:, 1:]) ** 2 <= 25.0).astype(float)
    want = [(g, n, s) for g, (n, s) in enumerate(zip(near.sum(1), near @ v, strict=True)) if n]
    assert sorted(map(tuple, radius_sums(points, centres, "g", ["n", "v"], 5.0, 20.0).collect())) == want


def test_fits_are_solved_in_batches(spark):
    from displace.operators.series import solve

    # a full one, one of rank 1, one of nothing
    rows = [(1, 3, [3.0, 3.0, 5.0, 6.0, 10.0]), (2, 1, [1.0, 2.0, 4.0, 3.0, 6.0]), (3, 0, [0.0] * 5)]
    got = {r["k"]: r for r in solve(spark.createDataFrame(rows, "k int, n long, sums array<double>").coalesce(1), ["k"], 2).collect()}
    assert np.allclose(got[1]["coeffs"], [0.0, 2.0]) and got[1]["full_rank"]
    assert np.allclose(np.dot(got[2]["coeffs"], [1.0, 2.0]), 3.0) and not got[2]["full_rank"]
    assert got[3]["coeffs"] == [0.0, 0.0] and not got[3]["full_rank"]
    assert solve(spark.createDataFrame(rows[:1], "k int, n long, sums array<double>").where("k > 9"), ["k"], 2).count() == 0
