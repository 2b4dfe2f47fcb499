"""Sums and medians over points near centres, against pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from displace.operators import joins
from displace.operators.regions import radius_median, radius_sums

c = F.col


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(7)
    at = lambda: (rng.choice([float(rng.randrange(40)), rng.random() * 40]), rng.choice([float(rng.randrange(40)), rng.random() * 40]))
    pts = [(*at(), rng.randrange(3), rng.choice([1.25, 2.5, 7.0, None])) for _ in range(600)] + [(None, 1.0, 0, 1.0), (float("nan"), 1.0, 0, 1.0)]
    wells = [(i, *at()) for i in range(40)] + [(90, 500.0, 500.0), (91, None, 2.0)]
    return spark.createDataFrame(pts, "x double, y double, d int, v double"), spark.createDataFrame(wells, "g long, cx double, cy double")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sums_around_centres_equal_pairs(both):
    p, w = both
    p = p.where("v is not null").withColumn("n", F.lit(1))
    want = joins.radius_join(p, w, 5.0).groupBy("g").agg(F.sum("n").cast("double").alias("n"), F.sum("v").alias("v"))
    assert want.count() > 30 and _rows(radius_sums(p, w, "g", ["n", "v"], 5.0, 3.0)) == _rows(want)
    assert radius_sums(p.limit(0), w, "g", ["n", "v"], 5.0, 3.0).count() == 0


def test_medians_around_centres_equal_pairs(both):
    p, w = both
    want = joins.radius_join(p.where("v is not null"), w, 5.0).groupBy("g", "d").agg(F.median("v").alias("v"))
    assert want.count() > 60 and _rows(radius_median(p, w, "g", "d", "v", 5.0, 3.0)) == _rows(want)


def test_gnss_correlation_rounds_as_its_sql(spark):
    from displace.queries.series import gnss_correlation

    rows = [(1, k, f"2024-01-0{d}", v) for d, v in enumerate((1.0, 36.52, 41.3625, 50.0), 1) for k in ("click", "view")]
    s = spark.createDataFrame(rows, "ps_id long, direction string, ts string, value double").withColumn("ts", c("ts").cast("timestamp"))
    assert gnss_correlation(s).first()["median"] == 38.9412


def test_overlapping_boxes_give_few_links(spark):
    from displace.operators import cluster
    from displace.operators.graph import connected_components

    rng = random.Random(9)
    rows = [(k, k % 2, x, y, x + rng.random() * 9, y + rng.random() * 9) for k in range(300) for x, y in [(rng.random() * 90, rng.random() * 90)]] + [(1000 + k, 0, 200.0, 200.0, 203.0, 203.0) for k in range(200)]
    boxes = spark.createDataFrame(rows, "k long, g int, minx double, miny double, maxx double, maxy double")
    links = cluster.box_stars(boxes, "k", ["g"], 10.0)
    assert links.count() < 1500
    whole = {r[0]: r[0] for r in rows}
    while True:
        new = {a[0]: min(whole[b[0]] for b in rows if a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]) for a in rows}
        if new == whole:
            break
        whole = new
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {k: got.get(k, k) for k in whole} == whole
