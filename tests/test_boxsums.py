"""Sums over boxes that meet boxes, against pairs; no pair becomes a row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from displace.operators import joins
from displace.operators.boxsums import box_sums
from displace.queries import joins as queries

c = F.col
A, B = ("minx", "miny", "maxx", "maxy"), ("bminx", "bminy", "bmaxx", "bmaxy")


def _boxes(rng, n, most, inverted):
    def one():
        x, y = (rng.choice([float(rng.randrange(-30, 30)), rng.random() * 60 - 30]) for _ in range(2))
        w, h = (rng.choice([0.0, float(rng.randrange(most)), rng.random() * most]) for _ in range(2))
        return (x, y, x + w, y + h) if not inverted or rng.random() < 0.9 else (x + w, y, x, y + h)

    return [one() for _ in range(n)]


def _tables(spark, inverted):
    rng = random.Random(3)
    own = [(g, *b) for g, b in enumerate(_boxes(rng, 80, 30, inverted))] + [(90, None, 0.0, 1.0, 1.0), (91, 900.0, 900.0, 901.0, 901.0)]
    other = [(*b, rng.choice([1.25, 3.0, None]), 0.5) for b in _boxes(rng, 700, 12, inverted)] + [(1.0, 1.0, None, 2.0, 7.0, 7.0), (900.5, 900.5, 900.5, 900.5, None, 2.0)]
    num = lambda ks: ", ".join(f"{k} double" for k in ks)
    return spark.createDataFrame(own, f"g int, {num(A)}"), spark.createDataFrame(other, num([*B, "v", "w"]))


@pytest.mark.parametrize("inverted", [False, True])
@pytest.mark.parametrize("most", [500_000, 40])
def test_sums_over_meeting_boxes_equal_pairs(spark, inverted, most):
    own, other = _tables(spark, inverted)
    meet = (c("minx") <= c("bmaxx")) & (c("bminx") <= c("maxx")) & (c("miny") <= c("bmaxy")) & (c("bminy") <= c("maxy"))
    want = own.crossJoin(other).where(meet).groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w"))
    for few in (0, 300_000):
        got = box_sums(own, other, "g", ["v", "w"], 7.0, most, few)
        assert sorted(got.collect()) == sorted(want.collect())


def test_layer_intersects_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "boxes_meet", None)
    sites = spark.createDataFrame([(1, 10.0, 10.0, 5.0), (2, 500.0, 500.0, 1.0), (3, 900.0, 0.0, 1.0)], "grp long, cx double, cy double, half double")
    features = spark.createDataFrame([(15.0, 15.0, 2.0), (3.0, 3.0, 2.0), (2.9, 3.0, 2.0), (499.0, 498.0, 300.0)], "x double, y double, len double")
    assert sorted(map(tuple, queries.layer_intersects(sites, features).collect())) == [(1, 2, 4.0), (2, 1, 300.0)]
