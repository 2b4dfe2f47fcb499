"""Filters and projections over points, features and catalogues."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def inside_box(x: str, y: str, box: tuple[float, float, float, float], closed: bool = False) -> Column:
    """Strictly inside (minx, miny, maxx, maxy), or with its edges. Plain comparisons, so they reach the scan."""
    lo, hi = (operator.ge, operator.le) if closed else (operator.gt, operator.lt)
    return lo(c(x), box[0]) & hi(c(x), box[2]) & lo(c(y), box[1]) & hi(c(y), box[3])


def where_select(df: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    return (df.where(where) if where else df).select(*columns)


def moving(v: str, var: str, least: float, most_var: float) -> Column:
    """abs(velocity) >= least and variance^2 < most_var."""
    return (F.abs(c(v)) >= least) & (c(var) * c(var) < most_var)


def cut_catalogue(df: DataFrame, key: str, value, condition=operator.ge) -> DataFrame:
    """Rows whose key compares with the value; any comparator."""
    return df.where(condition(c(key), F.lit(value)))


def tag_filter(df: DataFrame, tags: dict[str, list], kind: Column | None = None) -> DataFrame:
    """AND over tags, OR within a tag's values, and a geometry kind."""
    parts = [c(k).isin(v) for k, v in tags.items()] + ([kind] if kind is not None else [])
    return df.where(reduce(operator.and_, parts)) if parts else df


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where every aligned value is there and finite."""
    return df.where(reduce(operator.and_, [c(k).isNotNull() & ~F.isnan(k) & (F.abs(c(k)) != float("inf")) for k in columns]))


def masked(v: Column, low: float | None, high: float) -> Column:
    """Null inside (low, high); with low None, null below high."""
    return F.when((v < high) & (v > low), None).otherwise(v) if low is not None else F.when(v < high, None).otherwise(v)


def velocity_third_last(series: DataFrame, key: str = "ps_id", t: str = "ts", v: str = "value") -> DataFrame:
    """Value at the third-last epoch over the years between the first and the last."""
    w = Window.partitionBy(key)
    own = series.withColumn("_k", F.row_number().over(w.orderBy(F.desc(t), F.desc(v))))
    g = own.groupBy(key).agg(F.max(F.when(c("_k") == 3, c(v))).alias("v3"), F.min(t).alias("t0"), F.max(t).alias("t1"))
    return g.where("v3 is not null").select(key, (c("v3") / F.nullif(F.datediff("t1", "t0") / 365.25, F.lit(0.0))).alias("velocity"))


def final_rate(series: DataFrame, key: str = "ps_id", t: str = "ts", v: str = "value") -> DataFrame:
    """Last value that is there over the series' length in years of 365 days."""
    g = series.groupBy(key).agg(F.max_by(v, F.when(c(v).isNotNull(), F.struct(c(t), c(v)))).alias("last"), F.min(t).alias("t0"), F.max(t).alias("t1"))
    return g.select(key, (c("last") / F.nullif(F.datediff("t1", "t0") / 365.0, F.lit(0.0))).alias("rate"))


def flat_list(v: Column) -> Column:
    """Lists of one element as the element, longer ones as their text."""
    return F.when(F.size(v) == 1, F.element_at(v, 1).cast("string")).when(F.size(v) > 1, F.to_json(v))
