"""Known answers and properties of what SQL does not express."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from displace.operators import cluster, geom, raster, series
from displace.operators.graph import connected_components

c = F.col
TRUE = [0.3, 1.1, 0.6, 0.8, -0.1, 0.05]


def _series(spark, n=400):
    t = (c("id") * 0.01).alias("t")
    d = spark.range(n).select(t).withColumns({"k": (F.floor(c("t") * 100) % 2).cast("int")})
    v = TRUE[0] + TRUE[1] * c("t") + TRUE[2] * F.sin(2 * math.pi * c("t")) + TRUE[3] * F.cos(2 * math.pi * c("t")) + TRUE[4] * F.sin(4 * math.pi * c("t")) + TRUE[5] * F.cos(4 * math.pi * c("t"))
    return d.withColumn("v", v)


def test_inversion_recovers_coefficients(spark):
    for fit in (series.invert, series.robust_invert):
        for r in fit(_series(spark), ["k"], "t", "v").collect():
            assert r.full_rank and np.allclose(r.coeffs, TRUE, atol=1e-8)


def test_forward_has_no_residual(spark):
    s = _series(spark)
    fits = series.invert(s, ["k"], "t", "v")
    assert series.forward(s, fits, ["k"], "t", "v").agg(F.max(F.abs("dres"))).first()[0] < 1e-9


def test_singular_fit_is_flagged(spark):
    s = spark.createDataFrame([(1, 0.5, 2.0)], "k int, t double, v double")
    r = series.invert(s, ["k"], "t", "v").first()
    assert not r.full_rank and all(math.isfinite(x) for x in r.coeffs)


def test_weights_and_steps(spark):
    s = spark.range(200).select(F.lit(1).alias("k"), (c("id") / 100.0).alias("t")).withColumn("v", 1 + 2 * c("t") + F.when(c("t") >= 1, 5.0).otherwise(0.0))
    r = series.invert(s, ["k"], "t", "v", weight=c("t") + 1, periods=(), steps=(1.0,)).first()
    assert np.allclose(r.coeffs, [1, 2, 5], atol=1e-8)


def test_cross_correlation_finds_lag(spark):
    s = spark.range(100).select(F.lit(0).alias("k"), c("id").alias("i"), F.sin(c("id") / 5.0).alias("a"), F.sin((c("id") + 3) / 5.0).alias("b"))
    assert series.cross_correlation(s, ["k"], "i", "a", "b", 8).orderBy(F.desc("r")).first().lag == 3


def test_plane_has_constant_slope(spark):
    px = spark.range(100).select(F.lit(0).alias("tile"), (c("id") / 10).cast("long").alias("r"), (c("id") % 10).alias("c")).withColumn("v", 2.0 * c("c") + 0.0 * c("r"))
    rows = raster.terrain(px, 2.0).collect()
    assert len(rows) == 64
    assert all(abs(r.slope - 45) < 1e-9 and abs(r.aspect - 270) < 1e-9 for r in rows)


def test_contour_of_a_block(spark):
    px = spark.range(400).select(F.lit(0).alias("tile"), (c("id") / 20).cast("long").alias("r"), (c("id") % 20).alias("c"))
    px = px.withColumn("v", F.when(c("r").between(5, 9) & c("c").between(3, 12), 2.0).when((c("r") == 15) & (c("c") == 15), -2.0).otherwise(0.0))
    rows = {r.level: r for r in raster.contours(px, [1.0]).collect()}
    assert set(rows) == {1.0, -1.0}
    # half-way between the block's pixel centres and their neighbours, corners cut
    assert abs(rows[1.0].area - (5 * 10 - 4 * 0.125)) < 1e-9
    assert abs(rows[-1.0].area - 0.5) < 1e-9


def test_square_shape(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 3.0)], "grp int, cx double, cy double, half double")
    ring = geom.box_ring(c("cx") - c("half"), c("cy") - c("half"), c("cx") + c("half"), c("cy") + c("half"))
    r = s.select(geom.roundness(ring).alias("q"), geom.feret(ring).alias("f"), geom.area(ring).alias("a"), geom.centroid(ring).alias("m"), geom.contains(ring, F.lit(1.0), F.lit(2.9)).alias("i"), geom.contains(ring, F.lit(4.0), F.lit(0.0)).alias("o"), geom.distance_to_ring(ring, F.lit(7.0), F.lit(0.0)).alias("d")).first()
    assert (r.q, r.a, r.i, r.o, r.d) == (0.785, 36.0, True, False, 4.0)
    assert (r.f.least, r.f.most) == (6.0, 6.0) and (r.m.x, r.m.y) == (0.0, 0.0)


def test_hull_clip_ellipse():
    rng = np.random.default_rng(3)
    p = rng.normal(size=(200, 2))
    h = geom.hull_of(p)
    q = np.roll(h, -1, axis=0)
    for x in p:
        assert ((q[:, 0] - h[:, 0]) * (x[1] - h[:, 1]) - (q[:, 1] - h[:, 1]) * (x[0] - h[:, 0]) >= -1e-9).all()
    area = lambda r: abs((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum()) / 2
    square = np.array([[0.0, 0], [4, 0], [4, 4], [0, 4]])
    cut = geom.clip_ring(square, np.array([[2.0, 2], [6, 2], [6, 6], [2, 6]]))
    assert area(cut) == 4 and area(geom.clip_ring(h, square)) <= min(area(h), 16)
    t = np.linspace(0, 2 * np.pi, 20, endpoint=False)
    a, b, theta = geom.ellipse_of(np.column_stack([5 * np.cos(t) + 100, 2 * np.sin(t) - 7]))
    assert abs(a - 5) < 1e-6 and abs(b - 2) < 1e-6
    assert geom.ellipse_of(square) is None


def test_utm_round_trip(spark):
    d = spark.createDataFrame([(50.0, 8.5), (51.6, 10.2), (49.4, 7.8)], "lat double, lon double")
    e, n = geom.to_utm(c("lat"), c("lon"))
    d = d.withColumns({"e": e, "n": n})
    la, lo = geom.from_utm(c("e"), c("n"))
    for r in d.select("lat", "lon", "e", la.alias("la"), lo.alias("lo")).collect():
        assert abs(r.lat - r.la) < 1e-8 and abs(r.lon - r.lo) < 1e-8
    x, y = geom.to_laea(F.lit(52.0), F.lit(10.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 4321000) < 1e-6 and abs(r.y - 3210000) < 1e-6


def test_datum_shifts(spark):
    d = spark.createDataFrame([(50.0, 8.5), (51.6, 10.2), (49.4, 7.8)], "lat double, lon double")
    for system in (31467, 23032, 32632):
        there = geom.reproject(d, "lat", "lon", 4326, system, ("e", "n"))
        for r in geom.reproject(there, "e", "n", system, 4326, ("la", "lo")).collect():
            # the inverse shift only negates the parameters, and heights are left at 0: some centimetres
            assert abs(r.lat - r.la) < 2e-6 and abs(r.lon - r.lo) < 2e-6
    r = geom.reproject(spark.createDataFrame([(50.0, 9.0)], "lat double, lon double"), "lat", "lon", 4326, 31467, ("e", "n")).first()
    assert 50 < abs(r.e - 3500000) < 150 and 5.53e6 < r.n < 5.55e6


def test_components_do_not_depend_on_order(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    want = {i: find(i) for i in parent}
    for n, e in ((1, edges), (7, edges[::-1])):
        df = spark.createDataFrame(e, "src long, dst long").repartition(n)
        assert {r.node: r.component for r in connected_components(df).collect()} == want


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "src long, dst long")
    assert connected_components(df).count() == 0


def test_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    xy = rng.uniform(0, 1000, (150, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {r.id: r.grp for r in cluster.group_nearest(df, "id", "x", "y", 60.0).collect()}
    label = np.arange(150)
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 3600
    for _ in range(150):
        label = np.array([label[near[i]].min() for i in range(150)])
    assert got == dict(enumerate(label.tolist()))


def test_adaptive_split_fits(spark):
    df = spark.range(500).select((c("id") % 37 * 1.0).alias("x"), (c("id") % 41 * 1.0).alias("y"))
    rows = cluster.adaptive_split(df, "x", "y", 80).collect()
    assert all(r.n <= 80 for r in rows) and sum(r.n for r in rows) >= 500


@pytest.mark.parametrize("half", [[0.5, 1.0], [-1.0, 0.5, 0.0]])
def test_levels_are_mirrored(half):
    assert raster.plus_minus(half) == [-1.0, -0.5, 0.5, 1.0]


def test_p_values_are_student_s(spark):
    from displace.operators.aggregates import p_class, p_value

    # fixed values: two-sided p of t at n, from published tables (t, n, p)
    known = [(12.706, 3, 0.05), (4.303, 4, 0.05), (3.182, 5, 0.05), (2.306, 10, 0.05), (3.355, 10, 0.01), (2.262, 11, 0.05), (2.042, 32, 0.05), (1.984, 102, 0.05), (5.041, 10, 0.001), (0.0, 7, 1.0)]
    rows = spark.createDataFrame([*known, (1.0, 2, None), (None, 9, None)], "t double, n long, p double").select("p", p_value(F.col("t"), F.col("n")).alias("got")).collect()
    assert all((r.got is None) == (r.p is None) and (r.p is None or abs(r.got - r.p) < 0.0005 * max(1, 20 * r.p)) for r in rows)
    said = spark.createDataFrame([(2.1, 10), (2.4, 10), (-6.0, 10), (None, 10)], "t double, n long").select(p_class(F.col("t"), F.col("n")).alias("p")).collect()
    assert [r.p for r in said] == ["n.s.", "p<0.05", "p<0.001", None]


def test_knn_of_nulls_far_points_and_nothing(spark):
    from displace.operators.joins import knn

    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 2000.0, 0.0), (4, 10.0, 0.0)], "id int, x double, y double")
    sources = spark.createDataFrame([(7, 1.0, 0.0), (8, 11.0, 0.0), (9, None, 0.0), (6, -1.0, 0.0)], "sid int, sx double, sy double")
    got = sorted((r.id, r.rank, r.sid, r.dist) for r in knn(points, sources, 2, 5.0, "id").collect())
    assert got == [(1, 1, 6, 1.0), (1, 2, 7, 1.0), (3, 1, 8, 1989.0), (3, 2, 7, 1999.0), (4, 1, 8, 1.0), (4, 2, 7, 9.0)]
    assert knn(points, sources.limit(0), 2, 5.0, "id").collect() == []
    assert knn(points, sources, 5, 5.0, "id").count() == 9  # fewer sources than asked for: all of them
    with pytest.raises(ValueError):
        knn(points, sources, 2, 5.0, "id", rounds=3)


def test_distances_by_edges_on_rings_that_are_no_squares(spark):
    import math as m

    from displace.operators import geom

    ring = [(0.0, 0.0), (7.0, 1.0), (9.0, 6.0), (4.0, 4.0), (1.0, 8.0)]
    rows = [(float(x) / 2, float(y) / 2) for x in range(-4, 24) for y in range(-4, 22)]
    text = "array(" + ", ".join(f"struct(double({x}) as x, double({y}) as y)" for x, y in ring) + ")"
    df = spark.createDataFrame(rows, "x double, y double").withColumn("ring", F.expr(text))
    got = df.select("x", "y", geom.distance_by_edges(geom.ring_edges(F.col("ring")), F.col("x"), F.col("y")).alias("d")).collect()
    for r in got:
        odd, best = False, m.inf
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > r.y) != (by > r.y) and r.x < (bx - ax) * (r.y - ay) / (by - ay) + ax:
                odd = not odd
            t = max(0.0, min(1.0, ((r.x - ax) * (bx - ax) + (r.y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            best = min(best, m.hypot(ax + t * (bx - ax) - r.x, ay + t * (by - ay) - r.y))
        assert abs(r.d - (0.0 if odd else best)) < 1e-8


def test_knn_looks_at_few_sources_however_many_there_are(spark):
    from displace.operators import joins

    sources = spark.range(20000).select(F.col("id").alias("sid"), (F.col("id") * 7919 % 997 / 10).alias("sx"), (F.col("id") * 104729 % 991 / 10).alias("sy"))
    same = spark.range(5000).select((F.col("id") + 10**6).alias("sid"), F.lit(50.05).alias("sx"), F.lit(50.05).alias("sy"))
    every = sources.union(same)
    points = spark.createDataFrame([(1, 50.0, 50.0), (2, 3.33, 97.1), (3, 500.0, -20.0)], "id int, x double, y double")
    wide = every.select(F.col("sx").alias("_sx"), F.col("sy").alias("_sy")).distinct()
    assert joins._knn_width(wide, 64.0, 32)[1] >= 3
    got = sorted((r.id, r.rank, r.sid) for r in joins.knn(points, every, 3, 64.0, "id").collect())
    table = every.toPandas()
    want = []
    for i, x, y in [(1, 50.0, 50.0), (2, 3.33, 97.1), (3, 500.0, -20.0)]:
        d = ((table["sx"] - x) ** 2 + (table["sy"] - y) ** 2) ** 0.5
        near = sorted(zip(d, table["sid"], strict=True))[:3]
        want += [(i, k + 1, sid) for k, (_, sid) in enumerate(near)]
    assert got == want
