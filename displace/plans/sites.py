"""The wide classification table: each layer is one join with the sites and one aggregation; the table is a chain of left joins on the site.

Sites carry grp, cx, cy, half, a convex ring and its bounds; features x, y, fclass, ref, len, area."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from displace.operators import geom, joins
from displace.operators.regions import region_sums
from displace.session import materialize

c = F.col


def hulls(sites: DataFrame) -> DataFrame:
    """Hull area (one decimal) and outline length."""
    return sites.select("grp", F.round(geom.area(c("ring")), 1).alias("area"), F.round(geom.perimeter(c("ring")), 1).alias("outline"))


def inside(features: DataFrame, sites: DataFrame, size: float = 250.0, margin: float = 0.0) -> DataFrame:
    """Features in a site or at most `margin` beside it, with dist (0 inside)."""
    own = sites.select("grp", "ring", "minx", "miny", "maxx", "maxy")
    if not margin:
        return joins.point_in_polygon(features, own, size).withColumn("dist", F.lit(0.0))
    return joins.near_polygons(features, own, size, margin)


def layers(features: DataFrame, sites: DataFrame, margin: float = 50.0) -> DataFrame:
    """(grp, fclass, ref, n_in, n_near, len, area, nearest): what each site has of each class and reference, without a row per feature and site."""
    return region_sums(features, sites, "grp", ["fclass", "ref"], ["len", "area"], margin)


def network(near: DataFrame, name: str, classes: list[str]) -> DataFrame:
    """Roads or railways (of layers): length inside, distance of the nearest within the margin, and whether there are any."""
    within = c("n_in") > 0
    return near.where(c("fclass").isin(classes)).groupBy("grp").agg(
        F.round(F.coalesce(F.sum("len"), F.lit(0.0)), 4).alias(f"{name}_length"),
        F.floor(F.min("nearest")).alias(f"{name}_nearest"),
        F.bool_or(within).alias(f"{name}_inside"),
        F.array_join(F.array_sort(F.collect_set(F.when(within, c("ref")))), ",").alias(f"{name}_refs"),
    )


def surfaces(near: DataFrame, name: str, classes: list[str]) -> DataFrame:
    """Buildings or water (of layers): count and area inside, and whether any is close."""
    own = near.where(c("fclass").isin(classes))
    return own.groupBy("grp").agg(F.sum("n_in").alias(f"{name}_count"), F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 4).alias(f"{name}_area"), F.bool_or(c("n_near") > c("n_in")).alias(f"{name}_close"))


def shares(near: DataFrame, sites: DataFrame, cls: Column, ignore: list[str] = (), rest: str | None = None, decimals: int = 1) -> DataFrame:
    """(grp, cls, area, percent) of layers: area per class inside a site in percent of the site; rest names what no class covers (if it is over 1)."""
    hull = hulls(sites).select("grp", c("area").alias("site_area"))
    per = near.where("n_in > 0").groupBy("grp", cls.alias("cls")).agg(F.sum("area").alias("area"))
    per = per.where(~c("cls").isin(list(ignore))) if ignore else per
    if rest:
        left = hull.join(per.groupBy("grp").agg(F.sum("area").alias("used")), "grp", "left").select("grp", F.lit(rest).alias("cls"), (c("site_area") - F.coalesce("used", F.lit(0.0))).alias("area"))
        per = per.unionByName(left.where(F.abs("area") > 1))
    return per.join(hull, "grp").select("grp", "cls", F.round("area", decimals).alias("area"), F.round(100 * c("area") / c("site_area"), 2).alias("percent"))


def major(per: DataFrame) -> DataFrame:
    return per.groupBy("grp").agg(F.max_by("cls", F.struct("area", "cls")).alias("major_class"), F.round(F.sum("percent"), 2).alias("total_percent"), F.count("*").alias("classes"))


def geology_unit() -> Column:
    """A feature's unit: its class where the reference is F, otherwise the rock of its reference."""
    return F.coalesce(F.when(c("ref") == "F", c("fclass")), F.concat(F.lit("rock-"), c("ref")))


def districts(near: DataFrame) -> DataFrame:
    """The names of the districts that a site touches."""
    return near.where("n_in > 0").groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("fclass")), ",").alias("districts"))


def shape(sites: DataFrame) -> DataFrame:
    """Roundness, ellipse half axes and flattening, Feret diameters and their ratio."""
    f = sites.select("grp", "ring", geom.feret(c("ring")).alias("f"), geom.ellipse_fit("ring").alias("e"))
    return f.select("grp", geom.roundness(c("ring")).alias("roundness"), F.round("f.most", 4).alias("length"), F.round("f.least", 4).alias("width"), F.round(c("f.least") / c("f.most"), 4).alias("aspect_ratio"), F.round((c("e.a") - c("e.b")) / c("e.a"), 4).alias("flattening"))


def volumes(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """Volume balance rounded to hundreds (half to even); errors in quadrature."""
    from displace.operators.raster import volume_balance

    v = volume_balance(sites, pairs, "grp", "v")
    return v.select("grp", *[F.bround(c(k) / 100, 0).cast("long").alias(f"volume_{k}_100") for k in ("total", "added", "removed", "moved")], F.round("error", 4).alias("volume_error"))


#: What a site without features of a layer gets.
DEFAULTS = {"roads_length": 0.0, "roads_inside": False, "roads_refs": "", "railways_length": 0.0, "railways_inside": False, "railways_refs": "", "buildings_count": 0, "buildings_area": 0.0, "buildings_close": False, "water_count": 0, "water_area": 0.0, "water_close": False, "major_class": "unclassified", "classes": 0, "total_percent": 0.0, "geology_major": "unclassified", "geology_units": 0, "susceptibility_major": "none", "susceptibility_percent": 0.0, "districts": ""}


def classified(sites: DataFrame, features: DataFrame, pixels: DataFrame, margin: float = 50.0) -> DataFrame:
    """One row per site: hull, roads, railways, buildings, water, land use, geology, susceptibility, districts, shape and volumes, with defaults
    for what is missing. The features meet the sites once for all layers."""
    near = materialize(layers(features, sites, margin), "near")
    parts = [
        network(near, "roads", ["A"]),
        network(near, "railways", ["R"]),
        surfaces(near, "buildings", ["N"]),
        surfaces(near, "water", ["R"]),
        major(shares(near, sites, c("fclass"), rest="unclassified")),
        major(shares(near, sites, geology_unit())).select("grp", c("major_class").alias("geology_major"), c("classes").alias("geology_units")),
        major(shares(near, sites, c("fclass"), ignore=["N"])).select("grp", c("major_class").alias("susceptibility_major"), c("total_percent").alias("susceptibility_percent")),
        districts(near),
        shape(sites).drop("flattening"),
        volumes(pixels, sites),
    ]
    wide = reduce(lambda a, b: a.join(b, "grp", "left"), parts, hulls(sites))
    return wide.fillna(DEFAULTS)
