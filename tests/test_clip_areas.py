"""Areas that polygons of one table cut out of one another: rectangles by their bounds, other rings by their edges, each pair once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from displace.operators import geom, joins
from displace.queries import joins as queries

c = F.col


def _sites(spark):
    rng = random.Random(5)
    at = lambda: rng.choice([float(rng.randrange(-30, 30)), rng.random() * 60 - 30])
    rows = [(i, at(), at(), float(rng.randrange(1, 9)) / 4) for i in range(150)] + [(200 + i, 3.0, 4.0, 1.0) for i in range(5)] + [(7, 3.5, 4.0, 1.0), (300, None, 1.0, 1.0), (301, 0.0, 0.0, None)]
    return spark.createDataFrame(rows, "grp long, cx double, cy double, half double").coalesce(1), rows


def _want(rows, scale):
    out = []
    for g, x, y, h in rows:
        for k, u, v, m in rows:
            if g < k and None not in (x, h, u, m) and abs(x - u) < (h + m) * scale and abs(y - v) < (h + m) * scale:
                side = lambda p, q: min(p + h * scale, q + m * scale) - max(p - h * scale, q - m * scale)
                out.append((g, k, side(x, u) * side(y, v)))
    return sorted(out)


def _same(got, want):
    got = sorted(map(tuple, got))
    return [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(got, want, strict=True))


def test_boxes_are_cut_without_python(spark):
    sites, rows = _sites(spark)
    got = queries.convex_clip(sites)
    assert "EvalPython" not in got._jdf.queryExecution().toString()
    assert len(_want(rows, 5.0)) > 500 and _same(got.collect(), _want(rows, 5.0))


@pytest.mark.parametrize("size", [0.7, 5.0, 100.0])
def test_overlaps_equal_pairs(spark, size):
    sites, rows = _sites(spark)
    got = joins.box_overlaps(queries._boxes(sites), "grp", size)
    assert len(_want(rows, 1.0)) > 50 and _same(got.collect(), _want(rows, 1.0))


def test_other_rings_are_cut_by_their_edges(spark):
    sites, rows = _sites(spark)
    boxes = queries._boxes(sites.where("cx is not null and half is not null"))
    # every third one is an octagon
    turn = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: geom.xy(c("cx") + c("half") * F.cos(k * 0.7853981633974483), c("cy") + c("half") * F.sin(k * 0.7853981633974483)))
    mixed = boxes.withColumn("ring", F.when(c("grp") % 3 == 0, turn).otherwise(c("ring")))
    got = joins.clip_areas(mixed, "grp", 6.0).collect()
    rings = {i: geom._anticlockwise(geom._open(geom._points(r["ring"]))) for i, r in enumerate(mixed.select("grp", "ring").collect())}
    keys = [r["grp"] for r in mixed.select("grp").collect()]
    want = []
    for i, g in enumerate(keys):
        for j, k in enumerate(keys):
            if g < k and len(p := geom.clip_ring(rings[i], rings[j])):
                x, y = (p - p[0]).T
                area = abs(sum(x * [*y[1:], y[0]] - y * [*x[1:], x[0]])) / 2
                want += [(g, k, area)] if area > 0 else []
    assert len(want) > 60 and _same(got, sorted(want))
