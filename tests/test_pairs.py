"""Joins that give pairs: spread over tasks however small the tables, and all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from displace.operators import geom, joins
from displace.queries import joins as queries

c = F.col


def _tables(spark):
    rng = random.Random(11)
    place = lambda: rng.choice([float(rng.randrange(-40, 40)), rng.random() * 80 - 40])
    p = [(i, place(), place()) for i in range(500)] + [(500, None, 1.0), (501, 0.0, 0.0)]
    s = [(i, place(), place(), float(rng.randrange(1, 12))) for i in range(60)] + [(60, 0.0, None, 3.0), (61, 0.0, 0.0, 5.0)]
    return spark.createDataFrame(p, "ps_id long, x double, y double").coalesce(1), spark.createDataFrame(s, "grp long, cx double, cy double, half double").coalesce(1), p, s


def _tasks(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_radius_join_gives_all_pairs_in_many_tasks(spark):
    points, sites, p, s = _tables(spark)
    want = sorted((i, g) for i, x, y in p for g, cx, cy, _ in s if x is not None and cy is not None and (x - cx) ** 2 + (y - cy) ** 2 <= 36)
    for split in (1, 2, 3):
        got = joins.radius_join(points, sites, 6.0, split=split)
        assert sorted((r["ps_id"], r["grp"]) for r in got.collect()) == want
        assert _tasks(got) > 1


def test_radius_join_rounds_as_its_sql(spark):
    points, sites, _, _ = _tables(spark)
    got = queries.radius_join(points, sites)
    want = joins.radius_join(points, sites, 500.0).select("ps_id", "grp", F.round("dist", 4).alias("dist"))
    assert got.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_point_in_polygon_tells_boxes_by_their_bounds(spark):
    points, sites, p, s = _tables(spark)
    boxes = queries._boxes(sites.where("cy is not null"))
    shift = boxes.where("grp % 2 = 0").withColumn("ring", F.concat(F.slice("ring", 3, 2), F.slice("ring", 1, 2))).unionByName(boxes.where("grp % 2 = 1").withColumn("ring", F.reverse("ring")))
    want = sorted((i, g) for i, x, y in p for g, cx, cy, h in s if x is not None and cy is not None and cx - h <= x < cx + h and cy - h <= y < cy + h)
    for polygons in (boxes, shift):
        assert polygons.where(~geom.is_box(c("ring"), c("minx"), c("miny"), c("maxx"), c("maxy"))).count() == 0
        got = joins.point_in_polygon(points, polygons, 7.0)
        assert sorted((r["ps_id"], r["grp"]) for r in got.collect()) == want
        assert _tasks(got) > 1


def test_point_in_polygon_of_other_rings(spark):
    points, _, p, _ = _tables(spark)
    rings = [[(0, 0), (20, 0), (0, 20)], [(-30, -30), (30, -30), (30, 30), (0, 0), (-30, 30)], [(0, 0), (9, 9), (9, 0), (0, 9)], [(5, 5), (5, 5), (5, 5), (5, 5)], [(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)]]
    rows = [(g, [{"x": float(x), "y": float(y)} for x, y in r], *(float(f(v[k] for v in r)) for f in (min, max) for k in (0, 1))) for g, r in enumerate(rings)]
    polygons = spark.createDataFrame(rows, f"grp long, ring {geom.RING}, minx double, miny double, maxx double, maxy double")
    assert [r["grp"] for r in polygons.where(geom.is_box(c("ring"), c("minx"), c("miny"), c("maxx"), c("maxy"))).collect()] == [4]
    want = points.crossJoin(polygons).where(geom.contains(c("ring"), c("x"), c("y"))).select("ps_id", "grp")
    got = joins.point_in_polygon(points, polygons, 7.0).select("ps_id", "grp")
    assert want.count() and sorted(got.collect()) == sorted(want.collect())
