"""Queries of the filters, projections and plain joins."""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.operators import filters as ops
from displace.registry import query

c = F.col
r4 = lambda e, n: F.round(e, 4).alias(n)


@query("bbox_filter", "SELECT * FROM psi_points WHERE x > 2000 AND x < 6000 AND y > 1000 AND y < 9000", "psi_points")
def bbox_filter(p: DataFrame) -> DataFrame:
    return p.where(ops.inside_box("x", "y", (2000, 1000, 6000, 9000)))


@query("where_select", "SELECT ps_id, z FROM psi_points WHERE z > 20 AND mean_vel < 1", "psi_points")
def where_select(p: DataFrame) -> DataFrame:
    return ops.where_select(p, ["ps_id", "z"], "z > 20 AND mean_vel < 1")


@query("velocity_filter", "SELECT ps_id, mean_vel FROM psi_points WHERE abs(mean_vel) >= 1.5 AND var_mean_vel * var_mean_vel < 0.5", "psi_points")
def velocity_filter(p: DataFrame) -> DataFrame:
    return p.where(ops.moving("mean_vel", "var_mean_vel", 1.5, 0.5)).select("ps_id", "mean_vel")


@query("eq_cut", "SELECT id, magnitude FROM catalogue WHERE magnitude >= 2.5 AND t < timestamp '1997-01-01'", "catalogue")
def eq_cut(cat: DataFrame) -> DataFrame:
    import datetime

    return ops.cut_catalogue(ops.cut_catalogue(cat, "magnitude", 2.5), "t", datetime.datetime(1997, 1, 1), operator.lt).select("id", "magnitude")


@query("level_subset", "SELECT r, c, v FROM raster WHERE r % 7 = 3 AND abs(round(v / 50)) = 1", "raster")
def level_subset(px: DataFrame) -> DataFrame:
    return px.where((c("r") % 7 == 3) & (F.abs(F.round(c("v") / 50)) == 1)).select("r", "c", "v")


@query("hazard_filter", "SELECT grp, n1, n2 FROM (SELECT grp, grp % 4 - 2 AS n1, grp % 3 - 1 AS n2 FROM sites) WHERE n1 > 0 OR n2 > 0", "sites")
def hazard_filter(s: DataFrame) -> DataFrame:
    return s.select("grp", (c("grp") % 4 - 2).alias("n1"), (c("grp") % 3 - 1).alias("n2")).where("n1 > 0 or n2 > 0")


@query("displacement_counts", "SELECT direction, count(*) FILTER (abs(value) > 50) AS kept, count(*) AS total FROM psi_series GROUP BY direction", "psi_series")
def displacement_counts(s: DataFrame) -> DataFrame:
    return s.groupBy("direction").agg(F.count_if(F.abs("value") > 50).alias("kept"), F.count("*").alias("total"))


@query("finite_mask", "SELECT ps_id, z, mean_vel FROM psi_points WHERE ps_id % 10 <> 0 AND ps_id % 7 <> 0", "psi_points")
def finite_mask(p: DataFrame) -> DataFrame:
    holes = p.select("ps_id", F.when(c("ps_id") % 10 == 0, float("nan")).otherwise(c("z")).alias("z"), F.when(c("ps_id") % 7 != 0, c("mean_vel")).alias("mean_vel"))
    return ops.finite_rows(holes, ["z", "mean_vel"])


@query("threshold_mask", "SELECT ps_id, CASE WHEN mean_vel < 0.5 AND mean_vel > -0.5 THEN NULL ELSE mean_vel END AS pair, CASE WHEN z < 10 THEN NULL ELSE z END AS single FROM psi_points", "psi_points")
def threshold_mask(p: DataFrame) -> DataFrame:
    return p.select("ps_id", ops.masked(c("mean_vel"), -0.5, 0.5).alias("pair"), ops.masked(c("z"), None, 10.0).alias("single"))


@query("percentile_clip", "WITH q AS (SELECT direction, quantile_cont(abs(value), 0.99) AS lim FROM psi_series GROUP BY direction) SELECT direction, count(*) AS n, count(CASE WHEN abs(value) <= lim THEN value END) AS kept, round(max(CASE WHEN abs(value) <= lim THEN value END), 4) AS top FROM psi_series JOIN q USING (direction) GROUP BY direction", "psi_series")
def percentile_clip(s: DataFrame) -> DataFrame:
    from displace.operators.aggregates import clip_percentile

    cut = clip_percentile(s, ["value"], 0.99, ["direction"])
    return cut.groupBy("direction").agg(F.count("*").alias("n"), F.count("value").alias("kept"), r4(F.max("value"), "top"))


@query("tag_filter", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) AND p_retailprice > 0", "part")
def tag_filter(p: DataFrame) -> DataFrame:
    return ops.tag_filter(p, {"p_brand": ["Brand#11", "Brand#12", "Brand#13"], "p_size": list(range(1, 11))}, c("p_retailprice") > 0).select("p_partkey")


@query("object_filter", "SELECT id AS grp, kind FROM catalogue WHERE kind = '1-URGENT'", "catalogue")
def object_filter(cat: DataFrame) -> DataFrame:
    return cat.where(c("kind") == "1-URGENT").select(c("id").alias("grp"), "kind")


@query("road_filter", "SELECT fclass, ref, count(*) AS n, round(sum(len), 4) AS len FROM features WHERE ref = 'F' AND fclass IN ('A', 'R') GROUP BY fclass, ref", "features")
def road_filter(f: DataFrame) -> DataFrame:
    return f.where((c("ref") == "F") & c("fclass").isin("A", "R")).groupBy("fclass", "ref").agg(F.count("*").alias("n"), r4(F.sum("len"), "len"))


@query("features_by_class", "SELECT fid, ref, seen, fclass, x, y FROM features WHERE fclass IN ('N')", "features")
def features_by_class(f: DataFrame) -> DataFrame:
    return f.where(c("fclass").isin("N")).select("fid", "ref", "seen", "fclass", "x", "y")


@query(
    "velocity_third_last",
    """SELECT ps_id, round(v / ((CAST(t1 AS DATE) - CAST(t0 AS DATE)) / 365.25), 4) AS velocity FROM (
         SELECT ps_id, max(CASE WHEN k = 3 THEN value END) AS v, min(ts) AS t0, max(ts) AS t1 FROM (SELECT *, row_number() OVER (PARTITION BY ps_id ORDER BY ts DESC, value DESC) AS k FROM psi_series) GROUP BY ps_id) WHERE v IS NOT NULL AND CAST(t1 AS DATE) > CAST(t0 AS DATE)""",
    "psi_series",
)
def velocity_third_last(s: DataFrame) -> DataFrame:
    return ops.velocity_third_last(s).where("velocity is not null").select("ps_id", r4(c("velocity"), "velocity"))


@query(
    "final_rate",
    "SELECT ps_id, round(v / nullif((CAST(t1 AS DATE) - CAST(t0 AS DATE)) / 365.0, 0), 4) AS rate FROM (SELECT ps_id, arg_max(value, (ts, value)) AS v, min(ts) AS t0, max(ts) AS t1 FROM psi_series GROUP BY ps_id)",
    "psi_series",
)
def final_rate(s: DataFrame) -> DataFrame:
    return ops.final_rate(s).select("ps_id", r4(c("rate"), "rate"))


@query(
    "flatten_lists",
    """SELECT p_brand, CASE WHEN len(l) = 1 THEN CAST(l[1] AS VARCHAR) ELSE '[' || array_to_string(l, ',') || ']' END AS sizes FROM (SELECT p_brand, list(DISTINCT p_size ORDER BY p_size) AS l FROM part GROUP BY p_brand)""",
    "part",
)
def flatten_lists(p: DataFrame) -> DataFrame:
    g = p.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("l"))
    return g.select("p_brand", ops.flat_list(c("l")).alias("sizes"))
