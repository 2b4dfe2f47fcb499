"""Queries of the scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.functions import mathfn, textfn, timefn
from displace.registry import query

c = F.col


@query(
    "key_to_time",
    """SELECT event_id, CAST(CASE event_id % 3 WHEN 2 THEN date '2015-04-07' + CAST((event_id % 40) * 6 AS INT) ELSE CAST(ts AS DATE) END AS TIMESTAMP) AS t FROM events""",
    "events",
)
def key_to_time(events: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyyMMdd")
    key = F.when(c("event_id") % 3 == 0, F.concat(F.lit("date_"), day)).when(c("event_id") % 3 == 1, day).otherwise(F.concat(F.lit("epoch"), (20150 + c("event_id") % 40).cast("string")))
    return events.select("event_id", timefn.key_to_time(key).alias("t"))


@query("float_year", "SELECT event_id, round(year(ts) + (dayofyear(ts) - 1) / 365.25, 6) AS y FROM events", "events")
def float_year(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.round(timefn.float_year(c("ts")), 6).alias("y"))


@query(
    "from_float_year",
    """SELECT id, CAST(make_date(CAST(floor(y) AS BIGINT), 1, 1) AS TIMESTAMP) + to_seconds(CAST(round((y - floor(y)) * 365.25 * 86400) AS BIGINT)) AS t
       FROM (SELECT id, year(t) + (dayofyear(t) - 1) / 365.25 + id % 7 / 10000.0 AS y FROM catalogue)""",
    "catalogue",
)
def from_float_year(cat: DataFrame) -> DataFrame:
    return cat.select("id", timefn.from_float_year(timefn.float_year(c("t")) + c("id") % 7 / 10000.0).alias("t"))


@query("gps_week", "SELECT id, CAST(date '1980-01-06' + CAST(7 * (id % 2400) AS INT) AS TIMESTAMP) AS t FROM catalogue", "catalogue")
def gps_week(cat: DataFrame) -> DataFrame:
    return cat.select("id", timefn.gps_week(c("id") % 2400).alias("t"))


_TIMES = "CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '7:' || lpad(CAST(id % 60 AS VARCHAR(9)), 2, '0') || ':05' WHEN 2 THEN lpad(CAST(id % 24 AS VARCHAR(9)), 2, '0') || ':10' WHEN 3 THEN '12:00:' || lpad(CAST(id % 70 AS VARCHAR(9)), 2, '0') || '.5' WHEN 4 THEN 'about noon' ELSE '1:2:3:4..5' END"


@query(
    "time_repair",
    f"""SELECT id, CASE WHEN s IS NULL THEN '00:00:00.0' WHEN regexp_matches(p, '^\\d\\d:\\d\\d$') THEN p || ':00.0' WHEN regexp_matches(p, '^\\d\\d:\\d\\d:\\d\\d$') THEN p || '.0'
        WHEN regexp_matches(p, '^\\d\\d:\\d\\d:\\d\\d\\.\\d+$') THEN p ELSE '' END AS fixed
        FROM (SELECT id, s, CASE WHEN regexp_matches(s, '^\\d:') THEN '0' || s ELSE s END AS p FROM (SELECT id, {_TIMES} AS s FROM catalogue))""",
    "catalogue",
)
def time_repair(cat: DataFrame) -> DataFrame:
    return cat.select("id", timefn.time_repair(F.expr(_TIMES)).alias("fixed"))


@query(
    "time_validate",
    f"""SELECT id, s, len(regexp_extract_all(s, '\\.')) > 1 OR len(regexp_extract_all(s, ':')) > 2 OR coalesce(TRY_CAST(nullif(regexp_extract(s, '^\\d+:\\d+:(\\d+)', 1), '') AS INT), 0) >= 60 AS wrong
        FROM (SELECT id, {_TIMES} AS s FROM catalogue) WHERE s IS NOT NULL""",
    "catalogue",
)
def time_validate(cat: DataFrame) -> DataFrame:
    return cat.select("id", F.expr(_TIMES).alias("s")).where("s is not null").select("id", "s", timefn.time_is_wrong(c("s")).alias("wrong"))


@query(
    "peak_date",
    """SELECT ps_id, strftime(date '2015-01-01' + CAST(floor(p / 6.283185307179586 * 365) AS INT), '%d.%m.') AS annual,
              strftime(date '2015-01-01' + CAST(floor(p / 6.283185307179586 * 182.5) AS INT), '%d.%m.') AS half
       FROM (SELECT ps_id, (ps_id % 628) / 100.0 AS p FROM psi_points)""",
    "psi_points",
)
def peak_date(points: DataFrame) -> DataFrame:
    p = c("ps_id") % 628 / 100.0
    return points.select("ps_id", timefn.peak_date(p).alias("annual"), timefn.peak_date(p, 182.5).alias("half"))


_SUPER = """sqrt(greatest(a*a + b*b + 2*a*b*cos(0 - pi()/2), 0)) AS amp_raw, atan((a*sin(0) + b*sin(pi()/2)) / nullif(a*cos(0) + b*cos(pi()/2), 0)) + pi()/2 + CASE WHEN a < 0 THEN pi() ELSE 0 END AS ph_raw"""


@query("superpose", f"SELECT ps_id, round(amp_raw, 4) AS amplitude, round(ph_raw, 4) AS phase FROM (SELECT ps_id, {_SUPER} FROM (SELECT ps_id, mean_vel AS a, z AS b FROM psi_points))", "psi_points")
def superpose(points: DataFrame) -> DataFrame:
    amplitude, phase = mathfn.superpose(c("mean_vel"), c("z"))
    return points.select("ps_id", F.round(amplitude, 4).alias("amplitude"), F.round(phase, 4).alias("phase"))


@query(
    "r_squared",
    """SELECT direction, n, round(1 - ss_res / ss_tot, 4) AS r2, round(1 - (ss_res / ss_tot) * (n - 1) / (n - 3), 4) AS adj_r2
       FROM (SELECT direction, count(*) AS n, sum((value - 50) * (value - 50)) AS ss_res, var_pop(value) * count(*) AS ss_tot FROM psi_series GROUP BY direction)""",
    "psi_series",
)
def r_squared(series: DataFrame) -> DataFrame:
    got = mathfn.r_squared(series.withColumn("fit", F.lit(50.0)), ["direction"], "value", "fit", 2)
    return got.select("direction", "n", F.round("r2", 4).alias("r2"), F.round("adj_r2", 4).alias("adj_r2"))


@query("logistic_step", "SELECT ps_id, round(2.0 / (1 + exp(-2.92 * 2.0 * (mean_vel - 0.5)) * (2.0 / 0.1 - 1)), 4) AS g FROM psi_points", "psi_points")
def logistic_step(points: DataFrame) -> DataFrame:
    return points.select("ps_id", F.round(mathfn.logistic_step(c("mean_vel"), 2.0, 0.1, 0.5, 2.0), 4).alias("g"))


@query(
    "thermal_expansion",
    """WITH material AS (SELECT r_regionkey AS m, 1e-6 * (8 + 2 * r_regionkey) AS alpha, 0.05 + r_regionkey / 100.0 AS e_alpha FROM region)
       SELECT fid, ref, seen, x, round(alpha * len * 40, 6) AS moved, round(alpha * len * 40 * sqrt(0.0001 + e_alpha * e_alpha + 0.0025), 6) AS error
       FROM features JOIN material ON m = fid % 5""",
    "features",
    "region",
)
def thermal_expansion(features: DataFrame, region: DataFrame) -> DataFrame:
    material = region.select(c("r_regionkey").alias("m"), (F.lit(1e-6) * (8 + 2 * c("r_regionkey"))).alias("alpha"), (0.05 + c("r_regionkey") / 100.0).alias("e_alpha"))
    joined = features.join(F.broadcast(material), c("m") == c("fid") % 5)  # a table of materials
    moved, error = mathfn.thermal_expansion(c("len"), c("alpha"), F.lit(40.0), F.lit(0.01), c("e_alpha"), F.lit(0.05))
    return joined.select("fid", "ref", "seen", "x", F.round(moved, 6).alias("moved"), F.round(error, 6).alias("error"))


@query("uncertain_mean", "SELECT direction, round(avg(value), 4) AS mean, round(sqrt(sum(value * value)) / count(*), 4) AS error FROM psi_series GROUP BY direction", "psi_series")
def uncertain_mean(series: DataFrame) -> DataFrame:
    # sums first, so that no array grows with the data
    return series.groupBy("direction").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.sqrt(F.sum(c("value") * c("value"))) / F.count("*"), 4).alias("error"))


@query(
    "seasonal_peak",
    """WITH comp AS (SELECT ps_id, mean_vel AS a, z AS b FROM psi_points),
       lim AS (SELECT quantile_cont(abs(a), 0.9999) AS qa, quantile_cont(abs(b), 0.9999) AS qb FROM comp),
       cut AS (SELECT ps_id, CASE WHEN abs(a) <= qa THEN a END AS a, CASE WHEN abs(b) <= qb THEN b END AS b FROM comp, lim)
       SELECT ps_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(amp_raw, 4) END AS amplitude, round(ph_raw / (2 * pi()) * 365, 4) AS peak FROM (SELECT ps_id, a, b, """
    + _SUPER
    + " FROM cut)",
    "psi_points",
)
def seasonal_peak(points: DataFrame) -> DataFrame:
    from displace.operators.aggregates import clip_percentile

    cut = clip_percentile(points, ["mean_vel", "z"], 0.9999)
    amplitude, phase = mathfn.superpose(c("mean_vel"), c("z"))
    return cut.select("ps_id", F.round(amplitude, 4).alias("amplitude"), F.round(phase / (2 * math.pi) * 365, 4).alias("peak"))


def _class_sql(v: str, bounds, last: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL " + " ".join(f"WHEN {v} < {b} THEN '{n}'" for b, n in bounds) + f" ELSE '{last}' END"


for _name, _col, _sqlcol, _fn, _b, _l in (
    ("slope_class", "x % 50", "x % 50", textfn.slope_class, textfn.SLOPE, textfn.SLOPE_LAST),
    ("slope_std_class", "x % 20", "x % 20", textfn.slope_std_class, textfn.SLOPE_STD, textfn.SLOPE_STD_LAST),
    ("part_class", "x % 100", "x % 100", textfn.part_class, textfn.PART, textfn.PART_LAST),
    ("depth_class", "x % 150", "x % 150", textfn.depth_class, textfn.DEPTH, textfn.DEPTH_LAST),
):
    query(_name, f"SELECT ps_id, {_class_sql(_sqlcol, _b, _l)} AS cls FROM psi_points", "psi_points")(lambda p, f=_fn, e=_col: p.select("ps_id", f(F.expr(e)).alias("cls")))


@query(
    "compass",
    "SELECT ps_id, list_extract([" + ", ".join(f"'{k}'" for k in textfn.COMPASS) + "], CAST(greatest(ceil((x % 360 - 11.25) / 22.5), 0) AS INT) % 16 + 1) AS code FROM psi_points",
    "psi_points",
)
def compass(points: DataFrame) -> DataFrame:
    return points.select("ps_id", textfn.compass(c("x") % 360).alias("code"))


@query("volume_verdict", "SELECT ps_id, CASE WHEN x > 1000 THEN 'added' WHEN x < 1000 THEN 'removed' WHEN x = 1000 THEN 'unchanged' END AS verdict FROM psi_points", "psi_points")
def volume_verdict(points: DataFrame) -> DataFrame:
    return points.select("ps_id", textfn.volume_verdict(c("x")).alias("verdict"))


_LANDUSE = {"A": "Acker", "N": "Nadelwald", "R": "Rebfläche"}


@query("landuse_name", "SELECT fclass, CASE fclass WHEN 'A' THEN 'Acker' WHEN 'N' THEN 'Nadelwald' WHEN 'R' THEN 'Rebfläche' END AS name, count(*) AS n FROM features GROUP BY 1, 2", "features")
def landuse_name(features: DataFrame) -> DataFrame:
    return features.groupBy("fclass").agg(F.count("*").alias("n")).select("fclass", textfn.translated(c("fclass"), _LANDUSE, strict=True).alias("name"), "n")


@query(
    "list_sentence",
    """SELECT n_regionkey, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:-2], ', ') || ' und ' || l[-1] END AS sentence
       FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey)""",
    "nation",
)
def list_sentence(nation: DataFrame) -> DataFrame:
    g = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return g.select("n_regionkey", textfn.list_sentence(c("l")).alias("sentence"))


@query(
    "keyword_class",
    "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'copper') THEN 'spring' WHEN contains(lower(p_type), 'steel') THEN 'sinkhole' END AS cls FROM part",
    "part",
)
def keyword_class(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", textfn.keyword_class(c("p_type"), [("spring", ["brass", "copper"]), ("sinkhole", ["steel"])]).alias("cls"))


@query(
    "address_pick",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'town' || CAST(c_nationkey AS VARCHAR) WHEN 1 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END AS place FROM customer",
    "customer",
)
def address_pick(customer: DataFrame) -> DataFrame:
    k = c("c_custkey")
    address = F.to_json(F.struct(F.when(k % 3 == 1, c("c_mktsegment")).alias("village"), F.when(k % 3 == 0, F.concat(F.lit("town"), c("c_nationkey").cast("string"))).alias("town"), k.cast("string").alias("postcode")))
    return customer.select("c_custkey", textfn.first_present(address, ["hamlet", "village", "town", "city", "postcode"]).alias("place"))
