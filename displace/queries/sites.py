"""Queries of the site classification and of its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.functions import textfn
from displace.operators import joins
from displace.plans import sites as ops
from displace.queries.joins import _boxes
from displace.queries.raster import _TERRAIN_COLS, _TERRAIN_ZONE, _VOL, _zones, zonal_terrain_table
from displace.registry import query

c = F.col
_NEAR = """near AS (SELECT grp, half, fclass, ref, len, area, sqrt(greatest(abs(x - cx) - half, 0) ** 2 + greatest(abs(y - cy) - half, 0) ** 2) AS dist FROM sites JOIN features ON abs(x - cx) <= half + 50 AND abs(y - cy) <= half + 50)"""
_IN = f"WITH {_NEAR}, ins AS (SELECT * FROM near WHERE dist = 0), nb AS (SELECT * FROM near WHERE dist <= 50)"


def _near(s: DataFrame, f: DataFrame) -> DataFrame:
    return ops.layers(f, _boxes(s))


@query("site_hull", "SELECT grp, round(4 * half * half, 1) AS area, round(8 * half, 1) AS outline FROM sites", "sites")
def site_hull(s: DataFrame) -> DataFrame:
    return ops.hulls(_boxes(s))


def _network_sql(name: str, cls: str) -> str:
    return f"SELECT grp, round(coalesce(sum(len) FILTER (dist = 0), 0), 4) AS {name}_length, CAST(floor(min(dist) FILTER (dist > 0)) AS BIGINT) AS {name}_nearest, bool_or(dist = 0) AS {name}_inside, coalesce(string_agg(DISTINCT ref, ',' ORDER BY ref) FILTER (dist = 0), '') AS {name}_refs FROM nb WHERE fclass = '{cls}' GROUP BY grp"


def _surface_sql(name: str, cls: str) -> str:
    return f"SELECT grp, count(*) FILTER (dist = 0) AS {name}_count, round(coalesce(sum(area) FILTER (dist = 0), 0), 4) AS {name}_area, bool_or(dist > 0) AS {name}_close FROM nb WHERE fclass = '{cls}' GROUP BY grp"


query("site_roads", f"{_IN} {_network_sql('roads', 'A')}", "sites", "features")(lambda s, f: ops.network(_near(s, f), "roads", ["A"]))
query("site_railways", f"{_IN} {_network_sql('railways', 'R')}", "sites", "features")(lambda s, f: ops.network(_near(s, f), "railways", ["R"]))
query("site_buildings", f"{_IN} {_surface_sql('buildings', 'N')}", "sites", "features")(lambda s, f: ops.surfaces(_near(s, f), "buildings", ["N"]))
query("site_water", f"{_IN} {_surface_sql('water', 'R')}", "sites", "features")(lambda s, f: ops.surfaces(_near(s, f), "water", ["R"]))

_SHARES = f"{_IN}, per AS (SELECT grp, fclass AS cls, sum(area) AS area FROM ins GROUP BY grp, fclass), rest AS (SELECT sites.grp, 'unclassified' AS cls, 4 * half * half - coalesce(u, 0) AS area FROM sites LEFT JOIN (SELECT grp, sum(area) AS u FROM per GROUP BY grp) USING (grp)), every AS (SELECT * FROM per UNION ALL SELECT * FROM rest WHERE abs(area) > 1)"


@query("site_landuse", f"{_SHARES} SELECT grp, cls, round(every.area, 3) AS area, round(100 * every.area / (4 * half * half), 2) AS percent FROM every JOIN sites USING (grp)", "sites", "features")
def site_landuse(s: DataFrame, f: DataFrame) -> DataFrame:
    return ops.shares(_near(s, f), _boxes(s), c("fclass"), rest="unclassified", decimals=3)


@query("site_geology", f"{_IN} SELECT grp, coalesce(CASE WHEN ref = 'F' THEN fclass END, 'rock-' || ref) AS unit, round(sum(area), 3) AS area, round(100 * sum(area) / min(4 * half * half), 2) AS percent FROM ins GROUP BY 1, 2", "sites", "features")
def site_geology(s: DataFrame, f: DataFrame) -> DataFrame:
    return ops.shares(_near(s, f), _boxes(s), ops.geology_unit(), decimals=3).withColumnRenamed("cls", "unit")


@query("site_susceptibility", f"{_IN}, per AS (SELECT grp, fclass, round(100 * sum(area) / min(4 * half * half), 2) AS p, sum(area) AS a FROM ins WHERE fclass <> 'N' GROUP BY 1, 2) SELECT grp, arg_max(fclass, (round(a, 1), fclass)) AS major_class, round(sum(p), 2) AS total_percent, count(*) AS classes FROM per GROUP BY grp", "sites", "features")
def site_susceptibility(s: DataFrame, f: DataFrame) -> DataFrame:
    return ops.major(ops.shares(_near(s, f), _boxes(s), c("fclass"), ignore=["N"]))


@query("site_districts", f"{_IN} SELECT grp, string_agg(DISTINCT fclass, ',' ORDER BY fclass) AS names FROM ins GROUP BY grp", "sites", "features")
def site_districts(s: DataFrame, f: DataFrame) -> DataFrame:
    return ops.districts(ops.layers(f, _boxes(s), 0.0)).withColumnRenamed("districts", "names")


@query("site_terrain", _TERRAIN_ZONE + ", y AS (SELECT unnest([2014, 2019, 2021]) AS year) SELECT year, grp, " + _TERRAIN_COLS.replace("least(sqrt(sa*sa + ca*ca), 1)))), 4)", "least(sqrt(sa*sa + ca*ca), 1)))), 3) + 0.0") + " FROM q, y", "raster", "sites")
def site_terrain(px: DataFrame, s: DataFrame) -> DataFrame:
    from functools import reduce

    # one elevation model per year; here the same pixels stand for each
    return reduce(DataFrame.unionByName, [zonal_terrain_table(px, s).withColumn("year", F.lit(y)) for y in (2014, 2019, 2021)])


@query("site_shape", None, "sites")
def site_shape(s: DataFrame) -> DataFrame:
    return ops.shape(_boxes(s))


_VOLS = ", ".join(f"CAST(round_even({k} / 100, 0) AS BIGINT) AS volume_{k}_100" for k in ("total", "added", "removed", "moved")) + ", round(error, 4) AS volume_error"


@query("site_volumes", _VOL + f"SELECT sites.grp, {_VOLS} FROM sites LEFT JOIN g USING (grp)", "raster", "sites")
def site_volumes(px: DataFrame, s: DataFrame) -> DataFrame:
    return ops.volumes(_zones(px, s), s)


@query(
    "classified_sites",
    _VOL.replace("WITH ", f"WITH {_NEAR}, ins AS (SELECT * FROM near WHERE dist = 0), nb AS (SELECT * FROM near WHERE dist <= 50), {_SHARES[len(_IN) + 2:]}, ", 1)
    + f""", ro AS ({_network_sql('roads', 'A')}), ra AS ({_network_sql('railways', 'R')}), bu AS ({_surface_sql('buildings', 'N')}), wa AS ({_surface_sql('water', 'R')}),
       lu AS (SELECT grp, arg_max(cls, (round(every.area, 1), cls)) AS major_class, round(sum(round(100 * every.area / (4 * half * half), 2)), 2) AS total_percent, count(*) AS classes FROM every JOIN sites USING (grp) GROUP BY grp),
       vo AS (SELECT grp, {_VOLS} FROM g),
       ge AS (SELECT grp, arg_max(unit, (round(a, 1), unit)) AS geology_major, count(*) AS geology_units FROM (SELECT grp, coalesce(CASE WHEN ref = 'F' THEN fclass END, 'rock-' || ref) AS unit, sum(area) AS a FROM ins GROUP BY 1, 2) GROUP BY grp),
       su AS (SELECT grp, arg_max(fclass, (round(a, 1), fclass)) AS susceptibility_major, round(sum(p), 2) AS susceptibility_percent FROM (SELECT grp, fclass, sum(area) AS a, round(100 * sum(area) / min(4 * half * half), 2) AS p FROM ins WHERE fclass <> 'N' GROUP BY 1, 2) GROUP BY grp),
       di AS (SELECT grp, string_agg(DISTINCT fclass, ',' ORDER BY fclass) AS districts FROM ins GROUP BY grp)
       SELECT grp, round(4 * half * half, 1) AS area, round(8 * half, 1) AS outline, coalesce(roads_length, 0) AS roads_length, roads_nearest, coalesce(roads_inside, FALSE) AS roads_inside, coalesce(roads_refs, '') AS roads_refs,
              coalesce(railways_length, 0) AS railways_length, railways_nearest, coalesce(railways_inside, FALSE) AS railways_inside, coalesce(railways_refs, '') AS railways_refs,
              coalesce(buildings_count, 0) AS buildings_count, coalesce(buildings_area, 0) AS buildings_area, coalesce(buildings_close, FALSE) AS buildings_close, coalesce(water_count, 0) AS water_count, coalesce(water_area, 0) AS water_area, coalesce(water_close, FALSE) AS water_close,
              coalesce(geology_major, 'unclassified') AS geology_major, coalesce(geology_units, 0) AS geology_units, coalesce(susceptibility_major, 'none') AS susceptibility_major, coalesce(susceptibility_percent, 0) AS susceptibility_percent, coalesce(districts, '') AS districts,
              major_class, total_percent, classes, 0.785 AS roundness, round(2 * half, 4) AS length, round(2 * half, 4) AS width, 1.0 AS aspect_ratio, volume_total_100, volume_added_100, volume_removed_100, volume_moved_100, volume_error
       FROM sites LEFT JOIN ro USING (grp) LEFT JOIN ra USING (grp) LEFT JOIN bu USING (grp) LEFT JOIN wa USING (grp) LEFT JOIN lu USING (grp) LEFT JOIN ge USING (grp) LEFT JOIN su USING (grp) LEFT JOIN di USING (grp) LEFT JOIN vo USING (grp)""",
    "sites",
    "features",
    "raster",
)
def classified_sites(s: DataFrame, f: DataFrame, px: DataFrame) -> DataFrame:
    return ops.classified(_boxes(s), f, _zones(px, s))


@query(
    "site_sentences",
    """SELECT grp, CASE WHEN half <= 100 THEN 'small' END AS note, CASE WHEN cx < 3000 THEN 'nicht' WHEN cx < 6000 THEN 'teilweise' ELSE 'stark' END AS said, 'https://maps.example.org/?lat=' || CAST(CAST(round(cy, 0) AS BIGINT) AS VARCHAR) || '&lon=' || CAST(CAST(round(cx, 0) AS BIGINT) AS VARCHAR) AS link FROM sites""",
    "sites",
)
def site_sentences(s: DataFrame) -> DataFrame:
    link = F.concat(F.lit("https://maps.example.org/?lat="), F.round("cy", 0).cast("long").cast("string"), F.lit("&lon="), F.round("cx", 0).cast("long").cast("string"))
    return s.select("grp", F.when(c("half") <= 100, "small").alias("note"), textfn.classed(c("cx"), [(3000, "nicht"), (6000, "teilweise")], "stark").alias("said"), link.alias("link"))


@query("site_report_kv", "SELECT grp, 'cx' AS key, CAST(CAST(cx AS BIGINT) AS VARCHAR) AS value FROM sites UNION ALL SELECT grp, 'cy', CAST(CAST(cy AS BIGINT) AS VARCHAR) FROM sites UNION ALL SELECT grp, 'half', CAST(CAST(half AS BIGINT) AS VARCHAR) FROM sites", "sites")
def site_report_kv(s: DataFrame) -> DataFrame:
    from displace.sources.sinks import key_values

    return key_values(s.select("grp", *[c(k).cast("long").cast("string").alias(k) for k in ("cx", "cy", "half")]), "grp")


@query("comparison_pivot", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(median(value), 4) AS med, round(min(value) FILTER (ps_id = 1), 2) AS ps_1, round(min(value) FILTER (ps_id = 2), 2) AS ps_2, round(min(value) FILTER (ps_id = 3), 2) AS ps_3 FROM psi_series GROUP BY 1", "psi_series")
def comparison_pivot(s: DataFrame) -> DataFrame:
    from displace.sources.sinks import comparison_table

    return comparison_table(s.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "ps_id", "value", [1, 2, 3])
