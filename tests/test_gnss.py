"""Correlations with the daily level: the same on every layout of the table, and of series that do not vary."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

c = F.col
KIND = "ps_id long, direction string, ts string, value double"


def _table(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("ts", c("ts").cast("timestamp"))


def test_means_do_not_depend_on_the_order_of_rows(spark):
    from displace.queries.series import gnss_correlation

    # in time order the four values of the third day make 41.3625, from behind 41.362500000000004, which rounds the median up
    days = [[1.0], [36.52], [29.81, 2.65, 8.01, 124.98], [50.0]]
    rows = [(1, k, f"2024-01-0{d} 0{h}:00:00", v) for d, day in enumerate(days, 1) for h, v in enumerate(day) for k in ("click", "view")]
    s = _table(spark, rows)
    for own in (s, _table(spark, rows[::-1]).coalesce(1), s.repartition(4, F.xxhash64("value"))):
        assert gnss_correlation(own).first()["median"] == 38.9412


def test_constant_and_exact_series(spark):
    from displace.queries.series import gnss_correlation

    level = [1.0, 2.5, 2.0, 4.0, 7.0, 3.0]
    series = {1: [5.0] * 6, 2: level, 3: [-v for v in level], 4: [None] * 6, 5: [None, None, 3.0, 4.0, None, None]}
    rows = [(9, "view", f"2024-01-0{d}", v) for d, v in enumerate(level, 1)] + [(k, "click", f"2024-01-0{d}", v) for k, own in series.items() for d, v in enumerate(own, 1)]
    got = {r["ps_id"]: r for r in gnss_correlation(_table(spark, rows)).collect()}
    assert math.isnan(got[1]["r"]) and got[1]["p"] == "n.s." and got[1]["spread"] == 0.0
    assert [(got[k]["r"], got[k]["p"]) for k in (2, 3, 4, 5)] == [(1.0, "p<0.001"), (-1.0, "p<0.001"), (None, None), (1.0, "p<0.001")]
