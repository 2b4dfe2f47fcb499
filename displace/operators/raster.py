"""Raster operators on pixel tables (tile, r, c, v): stencils on blocks of pixels, zones by spatial joins, contours per ring."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from displace.operators.geom import RING
from displace.operators.graph import connected_components
from displace.operators.series import keyed
from displace.session import materialize

c = F.col


def pixel_xy(px: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Pixel centres: x along the columns, y along the rows."""
    return px.withColumns({"x": (c("c") + 0.5) * size + x0, "y": (c("r") + 0.5) * size + y0})


def stencil(px: DataFrame, kernel: Callable[[np.ndarray], list[np.ndarray]], names: list[str], by: tuple[str, ...] = ("tile",), block: int = 256) -> DataFrame:
    """(by, r, c, v, names): arrays that `kernel` makes of a block of pixels with one row and column more on each side. Pixels meet in square
    blocks; only those on a block's border are sent to its neighbours too, so the raster is shuffled once and 4 / block of it twice. A missing
    pixel (no row, null or NaN) is NaN in the array; pixels where an output is NaN are left out. Of repeated pixels the largest value counts."""
    beside = lambda k: F.explode(F.array_distinct(F.array(F.floor((c(k) - 1) / block), F.floor((c(k) + 1) / block))))
    own = px.select(*by, "r", "c", c("v").cast("double").alias("v")).where(c("v").isNotNull() & ~F.isnan("v") & c("r").isNotNull() & c("c").isNotNull())
    sent = own.withColumn("_br", beside("r")).withColumn("_bc", beside("c"))
    kinds = dict(px.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[-2]) * block, int(key[-1]) * block
        z = np.full((block + 2, block + 2), np.nan)
        np.fmax.at(z, (pdf["r"].to_numpy() - r0 + 1, pdf["c"].to_numpy() - c0 + 1), pdf["v"].to_numpy())
        inner, out = z[1:-1, 1:-1], kernel(z)
        i, j = np.nonzero(np.logical_and.reduce([~np.isnan(x) for x in (inner, *out)]))
        return pd.DataFrame({**keyed(by, key, len(i)), "r": i + r0, "c": j + c0, "v": inner[i, j], **{k: x[i, j] for k, x in zip(names, out, strict=True)}})

    kept = [*[f"`{k}` {kinds[k]}" for k in by], f"r {kinds['r']}", f"c {kinds['c']}", "v double", *[f"{k} double" for k in names]]
    return sent.groupBy(*by, "_br", "_bc").applyInPandas(run, ", ".join(kept))


def horn(size: float) -> Callable[[np.ndarray], list[np.ndarray]]:
    """Kernel of the differences along columns and rows, weighted 1 2 1 across."""

    def run(z: np.ndarray) -> list[np.ndarray]:
        across, down = z[:-2] + 2 * z[1:-1] + z[2:], z[:, :-2] + 2 * z[:, 1:-1] + z[:, 2:]
        # both need the whole neighbourhood: what one lacks leaves the other out too
        return [(across[:, 2:] - across[:, :-2]) / (8 * size), (down[2:] - down[:-2]) / (8 * size)]

    return run


def gradient(z: np.ndarray) -> list[np.ndarray]:
    """Kernel of the central differences along rows and columns, of one side where the other neighbour is missing."""

    def along(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
        one = np.where(np.isnan(after), here - before, after - here)
        return np.where(np.isnan(before) | np.isnan(after), one, (after - before) / 2)

    return [along(z[:-2, 1:-1], z[1:-1, 1:-1], z[2:, 1:-1]), along(z[1:-1, :-2], z[1:-1, 1:-1], z[1:-1, 2:])]


def central_slope(px: DataFrame) -> DataFrame:
    """(tile, r, c, v, slope): degrees by central differences over pixels of unit width; at an edge or beside a missing pixel by the difference
    to the other side, none where both are missing."""
    return stencil(px, gradient, ["_dr", "_dc"]).select("tile", "r", "c", "v", F.degrees(F.atan(F.sqrt(c("_dr") * c("_dr") + c("_dc") * c("_dc")))).alias("slope"))


def terrain(px: DataFrame, size: float, altitude: float = 45.0, azimuth: float = 315.0) -> DataFrame:
    """Slope (degrees), aspect (downslope direction, clockwise from north, null on flat ground) and hillshade (0 to 255) by Horn's stencil;
    rows run northwards. Pixels on the edge or beside a missing one have none."""
    g = stencil(px, horn(size), ["dx", "dy"])
    slope = F.atan(F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")))
    aspect = F.when((c("dx") != 0) | (c("dy") != 0), F.pmod(F.degrees(F.atan2(-c("dx"), -c("dy"))) + 360, F.lit(360.0)))
    zenith, az = math.radians(90 - altitude), math.radians(azimuth)
    shade = math.cos(zenith) * F.cos(slope) + math.sin(zenith) * F.sin(slope) * F.cos(az - F.radians(F.coalesce(aspect, F.lit(0.0))))
    return g.select("tile", "r", "c", "v", F.degrees(slope).alias("slope"), aspect.alias("aspect"), F.greatest(F.lit(0.0), 255 * shade).alias("hillshade"))


def zonal(pairs: DataFrame, zone: str, **stats: Column) -> DataFrame:
    """Any aggregates over the pixels of a zone; pairs hold one row per pixel and zone."""
    return pairs.groupBy(zone).agg(*[e.alias(k) for k, e in stats.items()])


def volume_balance(zones: DataFrame, pairs: DataFrame, zone: str, v: str, area: float = 1.0) -> DataFrame:
    """Total, added, removed and moved volume and its error sqrt(0.09 n); zones without pixels stay, with nulls."""
    g = pairs.groupBy(zone).agg(
        F.sum(c(v) * area).alias("total"),
        F.coalesce(F.sum(F.when(c(v) > 0, c(v) * area)), F.lit(0.0)).alias("added"),
        F.coalesce(F.sum(F.when(c(v) < 0, -c(v) * area)), F.lit(0.0)).alias("removed"),
        F.sum(F.abs(c(v)) * area).alias("moved"),
        F.sqrt(0.09 * F.count(v)).alias("error"),
    )
    return zones.select(zone).join(g, zone, "left")


def circular(v: Column) -> tuple[Column, Column]:
    """Circular mean (0 to 360) and standard deviation of directions, as aggregates."""
    s, k = F.avg(F.sin(F.radians(v))), F.avg(F.cos(F.radians(v)))
    r = F.sqrt(s * s + k * k)
    return F.pmod(F.degrees(F.atan2(s, k)) + 360, F.lit(360.0)), F.degrees(F.sqrt(-2 * F.log(F.when(r > 0, F.least(r, F.lit(1.0))))))


def scatter_grid(df: DataFrame, x: str, y: str, v: str, size: float, order: str) -> DataFrame:
    """Cell numbers left of the next edge; of several values the one with the largest `order` stays."""
    return df.groupBy(F.ceil(c(x) / size).alias("i"), F.ceil(c(y) / size).alias("j")).agg(F.max_by(v, order).alias("v"))


def burn(px: DataFrame, pairs: DataFrame, value: str, order: str) -> DataFrame:
    """All pixels with the value of the last feature on them, 0 where there is none."""
    top = pairs.groupBy("tile", "r", "c").agg(F.max_by(value, order).alias("burned"))
    return px.join(top, ["tile", "r", "c"], "left").withColumn("burned", F.coalesce("burned", F.lit(0)))


def plus_minus(levels: list[float]) -> list[float]:
    """A half-sided list mirrored: -l .. -1, 1 .. l."""
    half = sorted({abs(v) for v in levels if v})
    return [-v for v in reversed(half)] + half


def contours(px: DataFrame, levels: list[float], least_area: float = 0.0, size: float = 1.0) -> DataFrame:
    """(tile, level, label, ring, area): closed outlines of what lies beyond each level (above a positive, below a negative one), by marching squares
    between pixel centres; outside the raster counts as zero. Rings of less than least_area are left out. A pixel is sent to the four squares it is
    a corner of; a square's crossed edges lead to one another, and the components of these links are the rings. One task per ring."""
    kind = dict(px.dtypes)["tile"]
    links = materialize(_links(px, plus_minus(levels)).withColumn("id", F.monotonically_increasing_id()), "contours")
    ends = links.select("tile", "level", c("a").alias("b"), c("id").alias("next"))
    # every crossed edge is entered once and left once
    steps = materialize(links.join(ends, ["tile", "level", "b"]).select("tile", "level", "id", "next", "x", "y"), "contours")
    ring = connected_components(steps.select(c("id").alias("src"), c("next").alias("dst"))).select(c("node").alias("id"), c("component").alias("name"))

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        at = dict(zip(pdf["id"], zip(pdf["next"], pdf["x"], pdf["y"], strict=True), strict=True))
        e, xy = int(pdf["name"].iloc[0]), []
        for _ in at:
            e, x, y = at[e]
            xy.append((float(x) * size, float(y) * size))
        # relative to the first corner, for areas far from the origin
        rel = [(x - xy[0][0], y - xy[0][1]) for x, y in xy]
        a = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(rel, rel[1:] + rel[:1], strict=True))) / 2
        if len(xy) < 3 or a <= least_area:
            return pd.DataFrame(columns=["tile", "level", "label", "ring", "area"])
        level = float(pdf["level"].iloc[0])
        return pd.DataFrame([(pdf["tile"].iloc[0], level, ("> " if level > 0 else "< ") + f"{level:g}", [{"x": x, "y": y} for x, y in xy], a)], columns=["tile", "level", "label", "ring", "area"])

    return steps.join(ring, "id").groupBy("name").applyInPandas(trace, f"tile {kind}, level double, label string, ring {RING}, area double")


def _links(px: DataFrame, levels: list[float]) -> DataFrame:
    """(tile, level, a, b, x, y): from edge a, an edge by its first corner and direction, an outline leads to edge b of the same square; x, y (in
    pixels) is where it crosses a."""
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("n")
    sent = px.select("tile", F.nanvl(c("v").cast("double"), F.lit(0.0)).alias("v"), c("r").cast("long").alias("r"), c("c").cast("long").alias("c"), near).select("tile", (c("r") - c("n.i")).alias("r"), (c("c") - c("n.j")).alias("c"), "v", "n.i", "n.j")
    corner = lambda i, j: F.coalesce(F.max(F.when((c("i") == i) & (c("j") == j), c("v"))), F.lit(0.0)).alias(f"z{i}{j}")
    square = sent.groupBy("tile", "r", "c").agg(*[corner(i, j) for i in (0, 1) for j in (0, 1)])
    sign, lim = F.when(c("level") > 0, 1.0).otherwise(-1.0), F.abs("level")
    up = square.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels]))).withColumns({f"z{i}{j}": sign * c(f"z{i}{j}") for i in (0, 1) for j in (0, 1)})
    bit = lambda k, n: F.when(c(k) > lim, n).otherwise(0)
    coded = up.withColumn("code", bit("z00", 1) + bit("z01", 2) + bit("z11", 4) + bit("z10", 8)).where("code > 0 and code < 15")
    edge = lambda i, j, down: F.struct((c("r") + i).alias("r"), (c("c") + j).alias("c"), F.lit(down).alias("down"))
    part = lambda p, q: (lim - c(p)) / (c(q) - c(p))
    edges = [edge(0, 0, 0), edge(0, 1, 1), edge(1, 0, 0), edge(0, 0, 1)]
    ry = [c("r") + F.lit(0.0), c("r") + part("z01", "z11"), c("r") + F.lit(1.0), c("r") + part("z00", "z10")]
    cx = [c("c") + part("z00", "z01"), c("c") + F.lit(1.0), c("c") + part("z10", "z11"), c("c") + F.lit(0.0)]
    link = lambda a, b: F.struct(edges[a].alias("a"), edges[b].alias("b"), (cx[a] + 0.5).alias("x"), (ry[a] + 0.5).alias("y"))
    found = None
    for code, pairs in _CASES.items():
        these = F.array(*[link(a, b) for a, b in pairs])
        found = F.when(c("code") == code, these) if found is None else found.when(c("code") == code, these)
    return coded.select("tile", "level", F.explode(found).alias("s")).select("tile", "level", "s.*")


#: Which edges of a square (0 below, 1 right, 2 above, 3 left) an outline enters and leaves, by the corners inside (1 lower left, 2 lower
#: right, 4 upper right, 8 upper left), the inside on its left.
_CASES = {1: [(0, 3)], 2: [(1, 0)], 3: [(1, 3)], 4: [(2, 1)], 5: [(0, 3), (2, 1)], 6: [(2, 0)], 7: [(2, 3)], 8: [(3, 2)], 9: [(0, 2)], 10: [(1, 0), (3, 2)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)]}


def rings(z: np.ndarray, level: float) -> list[list[tuple[float, float]]]:
    """Closed outlines (row, column) of z > level; z must be at or below it on its edge."""
    inside = z > level
    code = inside[:-1, :-1] + 2 * inside[:-1, 1:] + 4 * inside[1:, 1:] + 8 * inside[1:, :-1]
    nxt = {}
    for i, j in zip(*np.nonzero((code > 0) & (code < 15)), strict=True):
        edge = [(i, j, 0), (i, j + 1, 1), (i + 1, j, 0), (i, j, 1)]  # an edge by its first corner and direction
        for a, b in _CASES[int(code[i, j])]:
            nxt[edge[a]] = edge[b]

    def place(e):
        i, j, down = e
        i2, j2 = (i + 1, j) if down else (i, j + 1)
        t = (level - z[i, j]) / (z[i2, j2] - z[i, j])
        return (i + t * (i2 - i), j + t * (j2 - j))

    out = []
    while nxt:
        start = next(iter(nxt))
        at, ring = start, []
        while at in nxt:
            ring.append(place(at))
            at = nxt.pop(at)
        if at == start and len(ring) > 2:
            out.append(ring)
    return out


def reproject_nearest(px: DataFrame, targets: DataFrame, size: float) -> DataFrame:
    """Target cells (tr, tc) with source coordinates (sx, sy) get the value of the pixel they lie in."""
    at = targets.withColumns({"r": F.floor(c("sy") / size).cast("long"), "c": F.floor(c("sx") / size).cast("long")})
    return at.join(px.select("r", "c", "v"), ["r", "c"], "left").select("tr", "tc", "v")


def last_rows(df: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
