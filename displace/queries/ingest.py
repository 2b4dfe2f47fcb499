"""Queries of the ingests: raw lines are spelt from the test tables and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.registry import query
from displace.sources import ingest as ops

c = F.col
r4 = lambda e, n: F.round(e, 4).alias(n)
comma = lambda e: F.regexp_replace(e.cast("string"), r"\.", ",")


@query("psi_scan", "SELECT ps_id, x, y, CASE WHEN ps_id % 10 <> 0 THEN z END AS z, mean_vel, var_mean_vel FROM psi_points", "psi_points")
def psi_scan(p: DataFrame) -> DataFrame:
    a = p.select(c("ps_id").alias("PS_ID"), c("x").alias("X"), c("y").alias("Y"), F.when(c("ps_id") % 10 == 0, float("nan")).otherwise(c("z")).alias("Z"), c("mean_vel").alias("mean_velocity"), c("var_mean_vel").alias("var_mean_velocity"), F.lit(1).alias("OBJECTID"))
    return ops.normalize_psi(a)


@query("unpivot_series", "SELECT ps_id, CAST(date '2015-04-07' + CAST(6 * k AS INT) AS TIMESTAMP) AS ts, CASE WHEN k = 2 THEN NULL ELSE z + k END AS value FROM psi_points, (SELECT unnest(range(0, 4)) AS k)", "psi_points")
def unpivot_series(p: DataFrame) -> DataFrame:
    wide = p.select("ps_id", "x", "y", "z", *[(F.lit(float("nan")) if k == 2 else c("z") + k).alias(f"epoch{20150 + k}") for k in range(4)])
    return ops.unpivot_series(wide)


@query("csv_direction", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'U' ELSE '' END AS direction FROM part", "part")
def csv_direction(p: DataFrame) -> DataFrame:
    k = c("p_partkey")
    name = F.when(k % 6 == 0, "L3_a_E_2020.csv").when(k % 6 == 3, "L3_b_E.csv").when(k % 3 == 1, "L3_U.csv").otherwise("other.csv")
    return p.select("p_partkey", ops.direction_of(name).alias("direction"))


@query("merge_direction", "SELECT DISTINCT ps_id, direction, ts, value FROM psi_series WHERE direction = 'click'", "psi_series")
def merge_direction(s: DataFrame) -> DataFrame:
    return ops.merge_direction(s.unionByName(s.where("ps_id % 2 = 0")), "click")


@query("station_series", "SELECT CASE WHEN ps_id % 7 = 0 THEN 0 ELSE CAST(ps_id AS INT) END AS short_id, 'w' || CAST(ps_id AS VARCHAR) AS station, count(*) AS n, round(sum(value), 2) AS total, CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) AS first FROM psi_series GROUP BY 1, 2", "psi_series")
def station_series(s: DataFrame) -> DataFrame:
    k = c("ps_id")
    line = F.concat_ws(";", F.when(k % 7 == 0, "n/a").otherwise(k.cast("string")), F.concat(F.lit("w"), k.cast("string")), F.lit("well"), F.lit("1"), F.lit("2"), F.date_format("ts", "dd.MM.yyyy"), comma(c("value")))
    got = ops.groundwater(s.select(line.alias("value")))
    return got.groupBy("short_id", "station").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("ts").alias("first"))


@query("gauge_ingest", "SELECT 'g' || CAST(ps_id % 5 AS VARCHAR) AS station, date_trunc('second', ts) AS ts, value FROM psi_series WHERE value >= 20", "psi_series")
def gauge_ingest(s: DataFrame) -> DataFrame:
    file = F.concat(F.lit("f"), (c("ps_id") % 5).cast("string"))
    data = s.select(file.alias("file"), F.concat_ws(" ", F.date_format("ts", "yyyyMMddHHmmss"), F.when(c("value") >= 20, c("value")).otherwise(-777.0).cast("string")).alias("value"))
    head = s.select((c("ps_id") % 5).cast("string").alias("k")).distinct().select(F.concat(F.lit("f"), "k").alias("file"), F.concat(F.lit("#REX|*|SNAMEg"), "k", F.lit("|*|SWATERriver|*|SANR9|*|")).alias("value"))
    got = ops.gauge(data.unionByName(head))
    return got.select("station", "ts", "value")


@query("climate_sentinels", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, value AS mean, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS high, value AS low, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS rain FROM events", "events")
def climate_sentinels(e: DataFrame) -> DataFrame:
    v = c("value").cast("string")
    high = F.when(c("event_id") % 3 == 0, "-999").otherwise(v)
    rain = F.when(c("event_id") % 4 == 0, "-999").otherwise(v)
    line = F.concat_ws(";", F.lit("1"), F.date_format("ts", "yyyyMMdd"), *[F.lit("x")] * 3, v, high, v, *[F.lit("x")] * 6, rain)
    return ops.climate(e.select(line.alias("value")))


@query("rainfall_clean", "SELECT date_trunc('second', ts) AS ts, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS rain FROM events", "events")
def rainfall_clean(e: DataFrame) -> DataFrame:
    line = F.concat_ws(";", F.date_format("ts", "dd.MM.yyyy HH:mm:ss"), F.lit("a"), F.lit("b"), F.when(c("event_id") % 5 == 0, "-").otherwise(comma(c("value"))))
    return ops.rainfall(e.select(line.alias("value")))


@query("temperature_unpivot", "SELECT direction AS station, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, round(max(value), 2) AS value FROM psi_series WHERE direction IN ('click', 'view', 'error') GROUP BY 1, 2", "psi_series")
def temperature_unpivot(s: DataFrame) -> DataFrame:
    days = s.groupBy(F.date_format("ts", "dd.MM.yyyy").alias("day"))
    wide = days.agg(*[F.coalesce(comma(F.round(F.max(F.when(c("direction") == k, c("value"))), 2)), F.lit("-")).alias(f"{k} / station") for k in ("click", "view", "error")])
    return ops.temperature_matrix(wide, "day").where("value is not null")


@query("gas_percent", "SELECT CAST(CAST(t AS DATE) AS TIMESTAMP) AS ts, CAST(id AS DOUBLE) AS level, round(id / (SELECT max(id) FROM catalogue) * 100, 4) AS percent FROM catalogue", "catalogue")
def gas_percent(cat: DataFrame) -> DataFrame:
    k = c("id")
    day = F.when(k % 2 == 0, F.date_format("t", "d. M. yyyy")).otherwise(F.date_format("t", "d.M.yyyy"))
    level = F.concat((F.floor(k / 1000)).cast("string"), F.lit(" "), F.lpad((k % 1000).cast("string"), 3, "0"))
    got = ops.gas_storage(cat.select(F.concat_ws("\t", day, level).alias("value")))
    return got.select("ts", "level", r4(c("percent"), "percent"))


@query("eq_scan", "SELECT id, CAST(CAST(t AS DATE) AS TIMESTAMP) + to_minutes(10) + to_hours(7) AS t, 50.5 AS lat, 8.25 AS lon, magnitude FROM catalogue", "catalogue")
def eq_scan(cat: DataFrame) -> DataFrame:
    line = F.concat_ws(";", c("id").cast("string"), F.year("t").cast("string"), F.month("t").cast("string"), F.day("t").cast("string"), F.lit("7:10"), F.lit("50,5"), F.lit("8,25"), F.lit("10"), comma(c("magnitude")))
    return ops.earthquakes(cat.select(line.alias("value"))).select("id", "t", "lat", "lon", "magnitude")


@query("gnss_series", "SELECT CAST(date '1980-01-06' + CAST(7 * (2000 + ps_id % 300) AS INT) AS TIMESTAMP) AS ts, round(x, 2) AS north, 0.1 AS sigma_north, round(y, 2) AS east, 0.2 AS sigma_east, round(z, 2) AS up, 0.3 AS sigma_up FROM psi_points", "psi_points")
def gnss_series(p: DataFrame) -> DataFrame:
    line = F.concat_ws("   ", (2000 + c("ps_id") % 300).cast("string"), F.round("x", 2).cast("string"), F.lit("0.1"), F.round("y", 2).cast("string"), F.lit("0.2"), F.round("z", 2).cast("string"), F.lit("0.3"))
    return ops.gnss(p.select(line.alias("value")))


@query("sitelog_pivot", "SELECT 'ST' || CAST(grp AS VARCHAR) AS id, 'Upper ' || CAST(grp AS VARCHAR) AS name, cx AS x, cy AS y, half AS z FROM sites", "sites")
def sitelog_pivot(s: DataFrame) -> DataFrame:
    lines = F.array(F.concat(F.lit("     Site Name : UPPER "), c("grp").cast("string")), F.lit("     Inscription : none"), *[F.concat(F.lit(f"     {k} coordinate (m) : "), c(v).cast("string")) for k, v in (("X", "cx"), ("Y", "cy"), ("Z", "half"))])
    return ops.site_logs(s.select(F.concat(F.lit("/logs/st"), c("grp").cast("string"), F.lit(".log")).alias("file"), F.explode(lines).alias("value")))


@query("tile_corners", "SELECT 'g_' || CAST(s_suppkey AS VARCHAR) || '_' || CAST(s_nationkey AS VARCHAR) || '.xyz' AS path, CAST((s_suppkey + dx) * 1000 AS DOUBLE) AS x, CAST((s_nationkey + dy) * 1000 AS DOUBLE) AS y FROM supplier, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)", "supplier")
def tile_corners(s: DataFrame) -> DataFrame:
    return ops.tile_corners(s.select(F.concat(F.lit("g_"), c("s_suppkey").cast("string"), F.lit("_"), c("s_nationkey").cast("string"), F.lit(".xyz")).alias("path")))


@query("manual_labels", "SELECT grp, id % 2 = 0 AS research, id % 3 = 0 AS known, class_1, class_3 AS class_2, CAST(NULL AS VARCHAR) AS class_3, id % 5 = 0 AS unclear_1, FALSE AS unclear_2, FALSE AS unclear_3, comment FROM labels3", "labels3")
def manual_labels(df: DataFrame) -> DataFrame:
    k = c("id")
    g = c("grp").cast("string")
    first = F.when((k % 6 == 0), F.concat(F.lit("\\underline{\\textbf{"), g, F.lit("}}"))).when(k % 2 == 0, F.concat(F.lit("\\underline{"), g, F.lit("}"))).when(k % 3 == 0, F.concat(F.lit("\\textbf{"), g, F.lit("}"))).otherwise(g)
    one = F.when(k % 5 == 0, F.concat("class_1", F.lit("$^{?}$"))).otherwise(c("class_1"))
    return ops.manual_labels(df.select(F.concat_ws(" & ", first, F.concat_ws(", ", one, "class_3"), F.concat(F.lit("\\emph{"), "comment", F.lit("}"))).alias("value")))


@query("roi_scan", "SELECT coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS VARCHAR)) AS name, n_regionkey AS region FROM nation", "nation")
def roi_scan(n: DataFrame) -> DataFrame:
    own = n.select("n_nationkey", F.when(c("n_nationkey") % 3 == 0, c("n_name")).alias("name"), c("n_regionkey").alias("region"))
    return ops.regions_of_interest(own, "n_nationkey").select("name", "region")
