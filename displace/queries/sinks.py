"""Queries of sources and sinks that write the test tables' rows to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.operators import geom, joins
from displace.queries.joins import _boxes
from displace.registry import query
from displace.session import fresh_path
from displace.sources import ingest, sinks

c = F.col
_DEGREES = "SELECT ps_id, round(49.5 + y / 5000, 7) AS lat, round(8.0 + x / 5000, 7) AS lon FROM psi_points"


def _degrees(p: DataFrame, *more: str) -> DataFrame:
    return p.select("ps_id", (49.5 + c("y") / 5000).alias("lat"), (8.0 + c("x") / 5000).alias("lon"), *more)


def _r7(*names: str) -> list:
    return [F.round(n, 7).alias(n) for n in names]


@query("points", "SELECT ps_id, CASE WHEN ps_id % 9 <> 0 THEN x END AS px, CASE WHEN ps_id % 9 <> 0 THEN y END AS py, CASE WHEN ps_id % 9 <> 0 THEN z END AS pz FROM psi_points", "psi_points")
def points(p: DataFrame) -> DataFrame:
    own = p.select("ps_id", geom.point(F.when(c("ps_id") % 9 != 0, c("x")), c("y"), c("z")).alias("point"))
    return own.select("ps_id", c("point.x").alias("px"), c("point.y").alias("py"), c("point.z").alias("pz"))


@query("csv_ingest", "SELECT CAST(ps_id AS VARCHAR) AS ps_id, CASE WHEN ps_id % 2 = 0 THEN 'E' ELSE 'U' END AS direction, round(49.5 + y / 5000, 7) AS lat, round(8.0 + x / 5000, 7) AS lon, z FROM psi_points", "psi_points")
def csv_ingest(p: DataFrame) -> DataFrame:
    path = fresh_path(p.sparkSession, "provider")
    grid = geom.reproject(_degrees(p, "z"), "lat", "lon", 4326, 3035, ("easting", "northing")).select("ps_id", "easting", "northing", c("z").alias("height"))
    for k, name in enumerate(("L3_E_2020.csv", "L3_U.csv")):
        grid.where(c("ps_id") % 2 == k).write.csv(f"{path}/{name}", header=True)
    read = ingest.provider_points(ingest.read_provider_csv(p.sparkSession, f"{path}/*", grid.columns))
    back = geom.reproject(read.select("ps_id", "direction", "geometry.*"), "x", "y", 32632, 4326, ("lat", "lon"))
    return back.select("ps_id", "direction", *_r7("lat", "lon"), "z")


@query("table_catalogue", "SELECT name FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'Zeitreihe_' WHEN 1 THEN 'VERTIKAL' WHEN 2 THEN 'rtree_vertikal' WHEN 3 THEN 'gpkg_' ELSE 'roads' END || CAST(p_partkey AS VARCHAR) AS name FROM part) WHERE name LIKE 'Zeit%' OR name LIKE 'VERT%'", "part")
def table_catalogue(p: DataFrame) -> DataFrame:
    k = c("p_partkey") % 5
    head = F.when(k == 0, "Zeitreihe_").when(k == 1, "VERTIKAL").when(k == 2, "rtree_vertikal").when(k == 3, "gpkg_").otherwise("roads")
    return ingest.named_tables(p.select(F.concat(head, c("p_partkey").cast("string")).alias("name")))


@query("reproject_laea", _DEGREES, "psi_points")
def reproject_laea(p: DataFrame) -> DataFrame:
    """Degrees to the European grid, to UTM, and back the same way."""
    moved = _degrees(p)
    for source, target in ((4326, 3035), (3035, 32632), (32632, 3035), (3035, 4326)):
        moved = geom.reproject(moved, *(("lat", "lon") if source == 4326 else ("x", "y")), source, target, ("lat", "lon") if target == 4326 else ("x", "y"))
    return moved.select("ps_id", *_r7("lat", "lon"))


@query("sitelog_points", "SELECT 'ST' || CAST(grp AS VARCHAR) AS id, round(49.5 + cy / 5000, 7) AS lat, round(8.0 + cx / 5000, 7) AS lon FROM sites", "sites")
def sitelog_points(s: DataFrame) -> DataFrame:
    axis, f = geom.WGS84
    e2 = f * (2 - f)
    phi, lam = F.radians(49.5 + c("cy") / 5000), F.radians(8.0 + c("cx") / 5000)
    n = axis / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    place = {"X": n * F.cos(phi) * F.cos(lam), "Y": n * F.cos(phi) * F.sin(lam), "Z": n * (1 - e2) * F.sin(phi)}
    lines = F.array(*[F.concat(F.lit(f" {k} coordinate (m) : "), F.round(v, 5).cast("string")) for k, v in place.items()])
    logs = ingest.site_logs(s.select(F.concat(F.lit("st"), c("grp").cast("string"), F.lit(".log")).alias("file"), F.explode(lines).alias("value")))
    lat, lon = geom.from_geocentric(c("x"), c("y"), c("z"))
    moved = geom.reproject(logs.select("id", lat.alias("lat"), lon.alias("lon")), "lat", "lon", 4326, 32632, ("x", "y"))
    return geom.reproject(moved, "x", "y", 32632, 4326, ("lat", "lon")).select("id", *_r7("lat", "lon"))


@query("partitioned_sink", "SELECT grp, half, 'POLYGON ((' || concat_ws(', ', cx - half || ' ' || cy - half, cx + half || ' ' || cy - half, cx + half || ' ' || cy + half, cx - half || ' ' || cy + half, cx - half || ' ' || cy - half) || '))' AS ring FROM (SELECT grp, half, cx, cy FROM sites)", "sites")
def partitioned_sink(s: DataFrame) -> DataFrame:
    path = fresh_path(s.sparkSession, "regions")
    own = _boxes(s).select("grp", "half", "ring")
    sinks.write_partitioned(own, path, ["half"])
    sinks.write_partitioned(own.where("half > 100"), path, ["half"])  # an existing result stays
    return s.sparkSession.read.parquet(path).select("grp", "half", "ring")


@query("grid_sink", "SELECT CAST(floor(x / 500) AS BIGINT) AS i, CAST(floor(y / 500) AS BIGINT) AS j, component, coalesce(round(avg(CASE WHEN v > 0 THEN v END), 6), -9999) AS v FROM (SELECT x, y, 'z' AS component, z AS v FROM psi_points UNION ALL SELECT x, y, 'mean_vel', mean_vel FROM psi_points) GROUP BY ALL", "psi_points")
def grid_sink(p: DataFrame) -> DataFrame:
    path = fresh_path(p.sparkSession, "grids")
    long = p.unpivot(["x", "y"], ["z", "mean_vel"], "component", "v")
    cells = long.groupBy(joins.cell("x", 500).alias("i"), joins.cell("y", 500).alias("j"), "component").agg(F.round(F.avg(F.when(c("v") > 0, c("v"))), 6).alias("v"))
    sinks.write_grid(cells, path)
    return p.sparkSession.read.parquet(path).select("i", "j", "component", "v")


@query("comparison_sink", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(median(value), 4) AS med, round(min(value) FILTER (ps_id = 1), 2) AS ps_1, round(min(value) FILTER (ps_id = 2), 2) AS ps_2, round(min(value) FILTER (ps_id = 3), 2) AS ps_3 FROM psi_series GROUP BY 1", "psi_series")
def comparison_sink(s: DataFrame) -> DataFrame:
    path = fresh_path(s.sparkSession, "comparison")
    table = sinks.comparison_table(s.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "ps_id", "value", [1, 2, 3])
    sinks.write_comparison(table, path)
    return s.sparkSession.read.schema(table.schema).csv(path, header=True)


@query("report_sink", "SELECT grp, unnest(['cx', 'cy', 'half']) AS key, unnest([cx, cy, half]) AS value FROM sites", "sites")
def report_sink(s: DataFrame) -> DataFrame:
    path = fresh_path(s.sparkSession, "reports")
    sinks.write_reports(_boxes(s).select("grp", "cx", "cy", "half", "ring"), path, "grp")
    read = sinks.read_reports(s.sparkSession, path, "grp")
    return read.select(c("grp").cast("long").alias("grp"), "key", c("value").cast("double").alias("value"))
