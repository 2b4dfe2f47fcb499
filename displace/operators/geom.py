"""Geometry on vertex arrays: rings are array<struct<x:double,y:double>>, closed or not. Column expressions but for hull, clip and ellipse."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

c = F.col
RING = "array<struct<x:double,y:double>>"
_RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
_ELLIPSE = StructType([StructField(k, DoubleType()) for k in ("a", "b", "theta")])


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    """A point of coordinate columns, with a height if given. Null where x or y is."""
    parts = {"x": x, "y": y} | ({} if z is None else {"z": z})
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(*[v.cast("double").alias(k) for k, v in parts.items()]))


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Closed ring of a box, anticlockwise from its lower left corner."""
    return F.array(xy(minx, miny), xy(maxx, miny), xy(maxx, maxy), xy(minx, maxy), xy(minx, miny))


def edges(ring: Column) -> Column:
    """Edges (a, b) of a ring, closing it if it is open; edges without length only add zeros."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(e: Column, f) -> Column:
    return F.aggregate(e, F.lit(0.0), lambda t, s: t + f(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))


def signed_area(ring: Column) -> Column:
    return _sum(edges(ring), lambda ax, ay, bx, by: ax * by - bx * ay) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _sum(edges(ring), lambda ax, ay, bx, by: F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)))


def centroid(ring: Column) -> Column:
    a6 = F.nullif(6 * signed_area(ring), F.lit(0.0))
    e = edges(ring)
    return xy(_sum(e, lambda ax, ay, bx, by: (ax + bx) * (ax * by - bx * ay)) / a6, _sum(e, lambda ax, ay, bx, by: (ay + by) * (ax * by - bx * ay)) / a6)


def roundness(ring: Column) -> Column:
    """4 pi A / P^2, three decimals."""
    p = perimeter(ring)
    return F.round(4 * math.pi * area(ring) / F.nullif(p * p, F.lit(0.0)), 3)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of edges crossed to the right."""
    return F.aggregate(edges(ring), F.lit(False), lambda t, s: t != (((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.when(s["b"]["y"] != s["a"]["y"], s["b"]["y"] - s["a"]["y"]) + s["a"]["x"]).eqNullSafe(True)))


def is_box(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether a ring is the rectangle of its bounds. It then contains what lies in minx <= x < maxx, miny <= y < maxy, as `contains` has it."""
    corners = F.array(xy(minx, miny), xy(minx, maxy), xy(maxx, miny), xy(maxx, maxy))
    straight = F.forall(edges(ring), lambda s: (s["a"]["x"] == s["b"]["x"]) | (s["a"]["y"] == s["b"]["y"]))
    return F.coalesce((F.size(ring) <= 5) & (F.array_sort(F.array_distinct(ring)) == corners) & straight, F.lit(False))


def distance_to_ring(ring: Column, x: Column, y: Column) -> Column:
    """Distance to a polygon: zero inside, else to the nearest edge."""

    def one(s):
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        d2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(d2 > 0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / F.when(d2 > 0, d2)).otherwise(0.0)))
        return (ax + t * (bx - ax) - x) * (ax + t * (bx - ax) - x) + (ay + t * (by - ay) - y) * (ay + t * (by - ay) - y)

    return F.when(contains(ring, x, y), 0.0).otherwise(F.sqrt(F.array_min(F.transform(edges(ring), one))))


#: Resolution of distances, in the coordinates' unit.
ON_EDGE = 2.0**-30


def ring_edges(ring: Column) -> Column:
    """Edges of a ring with what distances need, to be made once per ring: a, the direction d and its squared length."""
    return F.transform(edges(ring), lambda s: F.struct(s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), (s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy"), s["b"]["y"].alias("by"), ((s["b"]["x"] - s["a"]["x"]) * (s["b"]["x"] - s["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (s["b"]["y"] - s["a"]["y"])).alias("d2")))


def distance_by_edges(made: Column, x: Column, y: Column) -> Column:
    """distance_to_ring by edges of ring_edges, in whole multiples of ON_EDGE: points on an edge are at 0 whatever the rounding."""
    crosses = lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < s["dx"] * (y - s["ay"]) / F.nullif(s["dy"], F.lit(0.0)) + s["ax"]).eqNullSafe(True)
    along = F.transform(made, lambda s: F.struct(s["ax"].alias("ax"), s["ay"].alias("ay"), s["dx"].alias("dx"), s["dy"].alias("dy"), F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["ax"]) * s["dx"] + (y - s["ay"]) * s["dy"]) / F.nullif(s["d2"], F.lit(0.0)))), F.lit(0.0)).alias("t")))
    squared = F.transform(along, lambda s: F.pow(s["ax"] + s["t"] * s["dx"] - x, F.lit(2.0)) + F.pow(s["ay"] + s["t"] * s["dy"] - y, F.lit(2.0)))
    inside = F.size(F.filter(made, crosses)) % 2 == 1
    return F.when(inside, 0.0).otherwise(F.floor(F.sqrt(F.array_min(squared)) / ON_EDGE + 0.5) * ON_EDGE)


def feret(ring: Column) -> Column:
    """(min, max) over the edges of the greatest vertex distance from the edge's line."""

    def widest(s):
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        d = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
        return F.when(d > 0, F.array_max(F.transform(ring, lambda p: F.abs((bx - ax) * (ay - p["y"]) - (ax - p["x"]) * (by - ay)))) / F.when(d > 0, d))

    w = F.filter(F.transform(edges(ring), widest), lambda v: v.isNotNull())
    return F.struct(F.array_min(w).alias("least"), F.array_max(w).alias("most"))


def hull_of(points: np.ndarray) -> np.ndarray:
    """Convex hull of distinct points, anticlockwise (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(pts)[:-1] + half(pts[::-1])[:-1])


def group_hull(points: DataFrame, key: str, x: str = "x", y: str = "y", parts: int = 16) -> DataFrame:
    """(key, ring): convex hull of each group's points. Hulls of `parts` shares of a group first, then of their vertices, so that no
    task holds a large group."""
    kind = points.schema[key].dataType.simpleString()

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(h), "x": h[:, 0], "y": h[:, 1]})

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ring": [[{"x": float(a), "y": float(b)} for a, b in h]]})

    own = points.select(key, c(x).cast("double").alias("x"), c(y).cast("double").alias("y")).dropna().withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    first = own.groupBy(key, "_part").applyInPandas(share, f"{key} {kind}, x double, y double")
    return first.groupBy(key).applyInPandas(ring, f"{key} {kind}, ring {RING}")


def clip_ring(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """A ring cut by an anticlockwise convex one (Sutherland-Hodgman)."""
    out = subject
    for a, b in zip(convex, np.roll(convex, -1, axis=0), strict=True):
        if not len(out):
            break
        e = b - a
        side = e[0] * (out[:, 1] - a[1]) - e[1] * (out[:, 0] - a[0])
        nxt, nside = np.roll(out, -1, axis=0), np.roll(side, -1)
        keep = []
        for p, q, s, t in zip(out, nxt, side, nside, strict=True):
            if s >= 0:
                keep.append(p)
            if (s > 0 > t) or (s < 0 < t):
                keep.append(p + (q - p) * (s / (s - t)))
        out = np.array(keep).reshape(-1, 2)
    return out


def _points(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def _padded(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (rings, most, 2), the last one repeated, and their numbers without a closing vertex; null rings are empty."""
    n = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(rings)
    xy = np.column_stack([pc.struct_field(flat, k).to_numpy(zero_copy_only=False) for k in ("x", "y")]).reshape(-1, 2).astype(float)
    start = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    at = start[:, None] + np.minimum(np.arange(max(n.max(initial=0), 1)), np.maximum(n[:, None] - 1, 0))
    p = np.vstack([xy, np.zeros((1, 2))])[np.where(n[:, None] > 0, at, len(xy))]
    last = p[np.arange(len(n)), np.maximum(n - 1, 0)]
    return p, n - ((n > 1) & (last == p[:, 0]).all(1))


def _ahead(n: np.ndarray, width: int) -> np.ndarray:
    """Each vertex's successor."""
    j = np.arange(width)
    return np.where(j + 1 < n[:, None], np.minimum(j + 1, width - 1), 0)


def _cut(rings: pa.Array, convex: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """clip_ring of many pairs at once: vertices (pairs, most, 2) and their numbers."""
    (p, n), (k, m) = _padded(rings), _padded(convex)
    pair = np.arange(len(n))[:, None]
    step = _ahead(m, k.shape[1])
    turn = np.where(np.arange(k.shape[1]) < m[:, None], k[..., 0] * k[pair, step, 1] - k[pair, step, 0] * k[..., 1], 0.0).sum(1)
    for i in range(k.shape[1]):
        # clockwise regions are walked backwards; past the last edge nothing is cut
        here = np.where(turn >= 0, i, m - 1 - i).clip(0)
        then = np.where(turn >= 0, (i + 1) % np.maximum(m, 1), (m - 2 - i) % np.maximum(m, 1))
        a, b = k[pair[:, 0], here], k[pair[:, 0], then]
        e = np.where((i < m)[:, None], b - a, 0.0)
        side = e[:, :1] * (p[..., 1] - a[:, 1:]) - e[:, 1:] * (p[..., 0] - a[:, :1])
        nxt = _ahead(n, p.shape[1])
        q, t = p[pair, nxt], side[pair, nxt]
        real = np.arange(p.shape[1]) < n[:, None]
        cross = real & (((side > 0) & (t < 0)) | ((side < 0) & (t > 0)))
        share = side / np.where(cross, side - t, 1.0)
        both = np.stack([p, p + (q - p) * share[..., None]], 2).reshape(len(n), -1, 2)
        keep = np.stack([real & (side >= 0), cross], 2).reshape(len(n), -1)
        n = keep.sum(1)
        order = np.argsort(~keep, 1, kind="stable")[:, : max(int(n.max(initial=0)), 1)]
        p = both[pair, order]
    return p, n


@F.arrow_udf(_RING)
def convex_clip(ring: pa.Array, convex: pa.Array) -> pa.Array:
    """Each polygon cut by its convex region; empty if they do not meet."""
    p, n = _cut(ring, convex)
    xy = p[np.arange(p.shape[1]) < n[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"]))


@F.arrow_udf(DoubleType())
def convex_clip_area(ring: pa.Array, convex: pa.Array) -> pa.Array:
    """Area of convex_clip."""
    p, n = _cut(ring, convex)
    q = p[np.arange(len(n))[:, None], _ahead(n, p.shape[1])] - p[:, :1]
    p = p - p[:, :1]
    return pa.array(np.abs(np.where(np.arange(p.shape[1]) < n[:, None], p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1], 0.0).sum(1)) / 2)


def _open(p: np.ndarray) -> np.ndarray:
    return p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p


def _anticlockwise(p: np.ndarray) -> np.ndarray:
    q = np.roll(p, -1, axis=0)
    return p if (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() >= 0 else p[::-1]


def ellipse_of(p: np.ndarray):
    """Least-squares ellipse (a, b, theta) of ring vertices by the direct method; None if there is none."""
    p = _open(p)
    if len(np.unique(p, axis=0)) < 5:
        return None
    centre, scale = p.mean(0), max(np.abs(p - p.mean(0)).max(), 1e-12)
    x, y = ((p - centre) / scale).T
    d1, d2 = np.column_stack([x * x, x * y, y * y]), np.column_stack([x, y, np.ones_like(x)])
    s1, s2, s3 = d1.T @ d1, d1.T @ d2, d2.T @ d2
    try:
        t = -np.linalg.solve(s3, s2.T)
        m = s1 + s2 @ t
        m = np.array([m[2] / 2, -m[1], m[0] / 2])
        _, v = np.linalg.eig(m)
    except np.linalg.LinAlgError:
        return None
    v = np.real(v)
    ok = 4 * v[0] * v[2] - v[1] ** 2 > 1e-12
    if not ok.any():
        return None
    k = v[:, np.flatnonzero(ok)[0]]
    a, b, cc, d, e, f = *k, *(t @ k)
    det = b * b - 4 * a * cc
    up = 2 * (a * e * e + cc * d * d - b * d * e + det * f)
    root = math.hypot(a - cc, b)
    axes = [-math.sqrt(max(up * ((a + cc) + s * root), 0)) / det for s in (1, -1)]
    theta = 0.5 * math.atan2(-b, cc - a)
    return max(axes) * scale, min(axes) * scale, theta


@F.pandas_udf(_ELLIPSE)
def ellipse_fit(ring: pd.Series) -> pd.DataFrame:
    """Half axes and angle of the fitted ellipse; nulls where no ellipse fits."""
    rows = [ellipse_of(_points(r)) or (None, None, None) for r in ring]
    return pd.DataFrame(rows, columns=["a", "b", "theta"]).astype(float)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing on a sphere, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360, F.lit(360.0))


#: Ellipsoids (semi-major axis, flattening), projections (ellipsoid, scale, false easting, central meridian; LAEA: ellipsoid, centre)
#: and shifts to WGS84 (metres, arc seconds, parts per million; position vector).
WGS84, BESSEL, HAYFORD = (6378137.0, 1 / 298.257223563), (6377397.155, 1 / 299.1528128), (6378388.0, 1 / 297.0)
LAEA = (WGS84, 52.0, 10.0)
UTM32, GK3, ED50_UTM32 = (WGS84, 0.9996, 500000.0, 9.0), (BESSEL, 1.0, 3500000.0, 9.0), (HAYFORD, 0.9996, 500000.0, 9.0)
DHDN = (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)
ED50 = (-87.0, -98.0, -121.0, 0.0, 0.0, 0.0, 0.0)


def _series(f: float):
    n = f / (2 - f)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3]
    beta = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3]
    delta = [2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3]
    return n, alpha, beta, delta


def to_mercator(lat: Column, lon: Column, system=UTM32) -> tuple[Column, Column]:
    """Easting and northing (northern half) of a transverse Mercator system by the Kruger series; better than 1 mm inside a zone."""
    (axis, f), k0, false_east, meridian = system
    m, alpha, _, _ = _series(f)
    rect = axis / (1 + m) * (1 + m**2 / 4 + m**4 / 64)
    p, d = F.radians(lat), F.radians(lon - meridian)
    e = 2 * math.sqrt(m) / (1 + m)
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, k in enumerate(alpha, 1):
        east = east + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return false_east + k0 * rect * east, k0 * rect * north


def from_mercator(east: Column, north: Column, system=UTM32) -> tuple[Column, Column]:
    """Latitude and longitude of a transverse Mercator system's coordinates (northern half)."""
    (axis, f), k0, false_east, meridian = system
    m, _, beta, delta = _series(f)
    rect = axis / (1 + m) * (1 + m**2 / 4 + m**4 / 64)
    xi, eta = north / (k0 * rect), (east - false_east) / (k0 * rect)
    x2, e2 = xi, eta
    for j, k in enumerate(beta, 1):
        x2 = x2 - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e2 = e2 - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x2) / F.cosh(e2))
    phi = chi
    for j, k in enumerate(delta, 1):
        phi = phi + k * F.sin(2 * j * chi)
    return F.degrees(phi), meridian + F.degrees(F.atan2(F.sinh(e2), F.cos(x2)))


def to_utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    return to_mercator(lat, lon, UTM32)


def from_utm(east: Column, north: Column) -> tuple[Column, Column]:
    return from_mercator(east, north, UTM32)


def shift_datum(lat: Column, lon: Column, shift, source, target=WGS84, inverse: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude on another ellipsoid by a seven-parameter shift at height 0 (Germany: a few metres, as the parameters are)."""
    dx, dy, dz, rx, ry, rz, ppm = (-v if inverse else v for v in shift)
    rx, ry, rz = (math.radians(v / 3600) for v in (rx, ry, rz))
    axis, f = source
    e2 = f * (2 - f)
    p, lam = F.radians(lat), F.radians(lon)
    n = axis / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    x, y, z = n * F.cos(p) * F.cos(lam), n * F.cos(p) * F.sin(lam), n * (1 - e2) * F.sin(p)
    k = 1 + ppm * 1e-6
    x, y, z = dx + k * (x - rz * y + ry * z), dy + k * (rz * x + y - rx * z), dz + k * (-ry * x + rx * y + z)
    return from_geocentric(x, y, z, target)


def from_geocentric(x: Column, y: Column, z: Column, ellipsoid=WGS84) -> tuple[Column, Column]:
    """Latitude and longitude of earth-centred coordinates; better than 1e-9 degrees near the ground."""
    axis, f = ellipsoid
    e2, b = f * (2 - f), axis * (1 - f)
    r = F.sqrt(x * x + y * y)
    theta = F.atan2(z * axis, r * b)
    s, q = F.sin(theta), F.cos(theta)
    return F.degrees(F.atan2(z + e2 / (1 - e2) * b * s * s * s, r - e2 * axis * q * q * q)), F.degrees(F.atan2(y, x))


#: Coordinate systems by EPSG number: a projection (None: latitude and longitude in degrees) and a shift with its ellipsoid.
SYSTEMS = {4326: (None, None, WGS84), 3035: (LAEA, None, WGS84), 32632: (UTM32, None, WGS84), 25832: (UTM32, None, WGS84), 31467: (GK3, DHDN, BESSEL), 23032: (ED50_UTM32, ED50, HAYFORD)}


def reproject(df: DataFrame, x: str, y: str, source: int, target: int, out: tuple[str, str]) -> DataFrame:
    """df with coordinates of another system. For 4326, x is the latitude and y the longitude. One projection per step, so that no step's
    expression is repeated inside the next one's."""
    (p1, s1, e1), (p2, s2, e2) = SYSTEMS[source], SYSTEMS[target]
    back = from_laea if p1 is LAEA else from_mercator
    lat, lon = back(c(x), c(y), p1) if p1 else (c(x), c(y))
    steps = df.withColumns({"_lat": lat, "_lon": lon})
    for shift, a, b, inverse in ((s1, e1, WGS84, False), (s2, WGS84, e2, True)):
        if shift:
            lat, lon = shift_datum(c("_lat"), c("_lon"), shift, a, b, inverse)
            steps = steps.withColumns({"_lat": lat, "_lon": lon})
    there = to_laea if p2 is LAEA else to_mercator
    lat, lon = there(c("_lat"), c("_lon"), p2) if p2 else (c("_lat"), c("_lon"))
    return steps.withColumns({out[0]: lat, out[1]: lon}).drop("_lat", "_lon")


class _EqualArea:
    """Constants of a Lambert azimuthal equal-area system and its authalic function q, for numbers (math) or columns (F)."""

    def __init__(self, system):
        (axis, f), lat0, self.lon0 = system
        self.e2 = f * (2 - f)
        s0 = math.sin(math.radians(lat0))
        self.qp = self.q(1.0, math)
        self.b0 = math.asin(self.q(s0, math) / self.qp)
        self.rq = axis * math.sqrt(self.qp / 2)
        self.d = axis * math.cos(math.radians(lat0)) / math.sqrt(1 - self.e2 * s0 * s0) / (self.rq * math.cos(self.b0))

    def q(self, s, lib):
        e = math.sqrt(self.e2)
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - lib.log((1 - e * s) / (1 + e * s)) / (2 * e))


def to_laea(lat: Column, lon: Column, system=LAEA) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area coordinates of the European grid (false origin 4321000, 3210000)."""
    k = _EqualArea(system)
    beta, dl = F.asin(k.q(F.sin(F.radians(lat)), F) / k.qp), F.radians(lon - k.lon0)
    b = k.rq * F.sqrt(2 / (1 + math.sin(k.b0) * F.sin(beta) + math.cos(k.b0) * F.cos(beta) * F.cos(dl)))
    return 4321000 + b * k.d * F.cos(beta) * F.sin(dl), 3210000 + b / k.d * (math.cos(k.b0) * F.sin(beta) - math.sin(k.b0) * F.cos(beta) * F.cos(dl))


def from_laea(x: Column, y: Column, system=LAEA) -> tuple[Column, Column]:
    """Latitude and longitude of the European grid's coordinates: the authalic latitude, taken back by its first series term and two Newton steps."""
    k = _EqualArea(system)
    u, v = (x - 4321000) / k.d, (y - 3210000) * k.d
    rho = F.sqrt(u * u + v * v)
    half = F.asin(rho / (2 * k.rq)) * 2
    sine = F.when(rho == 0, math.sin(k.b0)).otherwise(F.cos(half) * math.sin(k.b0) + v * F.sin(half) * math.cos(k.b0) / rho)
    phi = F.asin(sine) + k.e2 / 3 * F.sin(2 * F.asin(sine))
    for _ in range(2):
        s = F.sin(phi)
        phi = phi + (k.qp * sine - k.q(s, F)) * (1 - k.e2 * s * s) * (1 - k.e2 * s * s) / (2 * (1 - k.e2) * F.cos(phi))
    return F.degrees(phi), k.lon0 + F.degrees(F.atan2(u * F.sin(half), rho * math.cos(k.b0) * F.cos(half) - v * math.sin(k.b0) * F.sin(half)))
