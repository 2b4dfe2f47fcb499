"""Spatial, nearest and temporal joins. Space is cut into square cells, so every spatial join is an equi-join on cells with a refinement;
salt > 1 splits the rows of crowded cells and repeats the other, smaller side."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from displace.operators.geom import contains, convex_clip_area, distance_by_edges, is_box, ring_edges
from displace.session import materialize, n_partitions

c = F.col


def cell(v: Column | str, size: float) -> Column:
    return F.floor((c(v) if isinstance(v, str) else v) / size).cast("long")


def cover_cells(minx: Column, miny: Column, maxx: Column, maxy: Column, size: float) -> Column:
    """All cells (i, j) that a box touches."""
    return F.flatten(F.transform(F.sequence(cell(minx, size), cell(maxx, size)), lambda i: F.transform(F.sequence(cell(miny, size), cell(maxy, size)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def meet_cells(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left and right joined on cells, both spread by cell and merged: pairs are made in as many tasks as a shuffle has, however few files or bytes the tables
    are (a broadcast leaves all pairs to the tasks that scan the other table). The right side's rows of a cell are held, and spilled if many."""
    spark = left.sparkSession
    n = max(n_partitions(spark), 2 * spark.sparkContext.defaultParallelism)
    return left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), keys)


def box_join(points: DataFrame, boxes: DataFrame, size: float, x: str = "x", y: str = "y", salt: int = 1) -> DataFrame:
    """Points joined with the boxes (minx, miny, maxx, maxy) whose cells they lie in: candidates, each pair once."""
    own = points.withColumns({"_i": cell(x, size), "_j": cell(y, size)})
    other = boxes.withColumn("_c", F.explode(cover_cells(c("minx"), c("miny"), c("maxx"), c("maxy"), size))).withColumns({"_i": c("_c.i"), "_j": c("_c.j")}).drop("_c")
    keys = ["_i", "_j"]
    if salt > 1:
        own = own.withColumn("_s", F.pmod(F.xxhash64(x, y), F.lit(salt)).cast("int"))
        other = other.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys.append("_s")
    return meet_cells(own, other, keys).drop(*keys)


def point_in_polygon(points: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y", ring: str = "ring", salt: int = 1) -> DataFrame:
    """Pairs of points and polygons that contain them; polygons carry their bounds minx .. maxy. Rectangles along the axes are told by their bounds, inside the
    join; the rays through other rings are cast a pair at a time."""
    kind = polygons.withColumn("_box", is_box(c(ring), c("minx"), c("miny"), c("maxx"), c("maxy")))
    near = lambda own: box_join(points, own.drop("_box"), size, x, y, salt)
    boxes = near(kind.where("_box")).where((c(x) >= c("minx")) & (c(x) < c("maxx")) & (c(y) >= c("miny")) & (c(y) < c("maxy")))
    inside = c(x).between(c("minx"), c("maxx")) & c(y).between(c("miny"), c("maxy"))
    return boxes.unionByName(near(kind.where("not _box")).where(inside).where(contains(c(ring), c(x), c(y))))


def near_polygons(points: DataFrame, polygons: DataFrame, size: float, margin: float, x: str = "x", y: str = "y", ring: str = "ring", salt: int = 1) -> DataFrame:
    """Pairs of points and polygons at most `margin` apart, with dist (0 inside), instead of the ring; polygons carry their bounds. The widened box is
    tested before the distance, a ring's edges are made once, and each pair's distance is evaluated once (in a generator, which no filter is pushed through)."""
    wide = polygons.withColumns({"_e": ring_edges(c(ring)), "minx": c("minx") - margin, "miny": c("miny") - margin, "maxx": c("maxx") + margin, "maxy": c("maxy") + margin}).drop(ring)
    near = box_join(points, wide, size, x, y, salt).where(c(x).between(c("minx"), c("maxx")) & c(y).between(c("miny"), c("maxy")))
    return near.withColumn("dist", F.explode(F.filter(F.array(distance_by_edges(c("_e"), c(x), c(y))), lambda d: d <= margin))).drop("_e", "minx", "miny", "maxx", "maxy")


def radius_join(points: DataFrame, centres: DataFrame, radius: float, x: str = "x", y: str = "y", cx: str = "cx", cy: str = "cy", salt: int = 1, split: int = 1) -> DataFrame:
    """Pairs at most `radius` apart, with dist; cells are as wide as the radius, so a centre meets nine. With `split` they are that many times narrower:
    more rows of centres, fewer pairs that are looked at in vain."""
    boxes = centres.withColumns({"minx": c(cx) - radius, "maxx": c(cx) + radius, "miny": c(cy) - radius, "maxy": c(cy) + radius})
    d2 = (c(x) - c(cx)) * (c(x) - c(cx)) + (c(y) - c(cy)) * (c(y) - c(cy))
    near = box_join(points, boxes, radius / split, x, y, salt).where(d2 <= radius * radius)
    return near.withColumn("dist", F.sqrt(d2)).drop("minx", "maxx", "miny", "maxy")


def boxes_meet(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes (a: minx .. maxy, b: bminx .. bmaxy) that overlap: cells in common, kept where both lower corners' larger one lies, so
    that a pair comes once."""
    left = a.withColumn("_c", F.explode(cover_cells(c("minx"), c("miny"), c("maxx"), c("maxy"), size)))
    right = b.withColumn("_c", F.explode(cover_cells(c("bminx"), c("bminy"), c("bmaxx"), c("bmaxy"), size)))
    meet = (c("minx") <= c("bmaxx")) & (c("bminx") <= c("maxx")) & (c("miny") <= c("bmaxy")) & (c("bminy") <= c("maxy"))
    once = (c("_c.i") == cell(F.greatest("minx", "bminx"), size)) & (c("_c.j") == cell(F.greatest("miny", "bminy"), size))
    return meet_cells(left, right, ["_c"]).where(meet & once).drop("_c")


def box_overlaps(boxes: DataFrame, key: str, size: float) -> DataFrame:
    """(key, other, area) of each two boxes (minx .. maxy) of one table that share some area, once, with the smaller key first. Of two boxes one begins later to the
    right; where it also begins later upwards, its corner lies in the other box, else its left edge crosses the other's lower one: a pair meets in one cell, and
    few others are looked at if cells are smaller than boxes. Boxes of equal key, with a null bound or without area have no pairs."""
    bounds = ["minx", "miny", "maxx", "maxy"]
    own = boxes.select(c(key).alias("k"), *[c(k).cast("double").alias(k) for k in bounds]).dropna().where("minx < maxx and miny < maxy")
    other = own.select(*[c(k).alias(f"b{k}") for k in own.columns])
    span = lambda lo, hi: F.explode(F.sequence(cell(lo, size), cell(hi, size)))
    right = (c("minx") > c("bminx")) | ((c("minx") == c("bminx")) & (c("k") > c("bk")))
    above = (c("miny") > c("bminy")) | ((c("miny") == c("bminy")) & (c("k") > c("bk")))
    keys, own = ["_i", "_j"], own.withColumn("_i", cell("minx", size))
    wide = other.withColumn("_i", span("bminx", "bmaxx"))
    corner = meet_cells(wide.withColumn("_j", span("bminy", "bmaxy")), own.withColumn("_j", cell("miny", size)), keys).where((c("minx") < c("bmaxx")) & (c("miny") < c("bmaxy")) & right & above & (c("k") != c("bk")))
    cross = meet_cells(wide.withColumn("_j", cell("bminy", size)), own.withColumn("_j", span("miny", "maxy")), keys).where((c("minx") < c("bmaxx")) & (c("bminy") < c("maxy")) & right & ~above & (c("k") != c("bk")))
    area = lambda low: (F.least("maxx", "bmaxx") - c("minx")) * (F.least("maxy", "bmaxy") - c(low))
    first = c("k") < c("bk")
    pair = [F.when(first, c("k")).otherwise(c("bk")).alias(key), F.when(first, c("bk")).otherwise(c("k")).alias("other")]
    return corner.select(*pair, area("miny").alias("area")).unionByName(cross.select(*pair, area("bminy").alias("area")))


def clip_areas(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """(key, other, area) of each two polygons (ring, minx .. maxy) of one table, the smaller key first: the area of the first cut by the second, which is convex;
    pairs without area are left out. Rectangles along the axes are cut by their bounds, inside the join; where one of the two is another ring, the pair is cut
    by the ring's edges."""
    bounds = ["minx", "miny", "maxx", "maxy"]
    own = polygons.select(key, "ring", *bounds).dropna(subset=[key, *bounds]).repartition(n_partitions(polygons.sparkSession))
    # written once: each of the joins reads it twice, and telling rectangles takes longer than what follows
    kind = materialize(own.withColumn("_box", is_box(c("ring"), *map(c, bounds))), "polygons")
    boxes, rings, every = kind.where("_box"), kind.where("not _box").drop("_box"), kind.drop("_box")
    overlaps = box_overlaps(boxes, key, size / 3)
    if rings.isEmpty():
        return overlaps
    convex = lambda df: df.select(c(key).alias("other"), c("ring").alias("_convex"), *[c(k).alias(f"b{k}") for k in bounds])
    met = boxes_meet(rings, convex(every), size).unionByName(boxes_meet(boxes.drop("_box"), convex(rings), size)).where(c(key) < c("other"))
    # the area comes out of a generator, so that the filter does not ask for it a second time
    cut = met.select(key, "other", F.explode(F.array(convex_clip_area("ring", "_convex"))).alias("area"))
    return overlaps.unionByName(cut.where("area > 0"))


def _knn_width(sources: DataFrame, size: float, most: int) -> tuple[int, int]:
    """Number of sources, and how often `size` is halved until no cell holds over `most` of them (as far as halving helps)."""
    halved = 0
    while True:
        wide = size / 2**halved
        n, top = sources.groupBy(cell("_sx", wide).alias("i"), cell("_sy", wide).alias("j")).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        if top <= most or halved >= 40:
            return n, halved
        halved += max(1, math.ceil(math.log2(top / most) / 2))


def knn(points: DataFrame, sources: DataFrame, k: int, size: float, key: str, x: str = "x", y: str = "y", sx: str = "sx", sy: str = "sy", sid: str = "sid", rounds: int = 40) -> DataFrame:
    """(key, sid, dist, rank) of the k nearest sources of each point (ties: the smaller id). In each round cells are twice as wide as before and a point looks at
    the nine around it; what k sources within a cell's width settle is done, the rest goes on. Sources that are asked for in a round alone are looked at. The first
    round's cells are `size` wide, halved until they hold few sources, so that a point looks at a number of them that does not follow the table's; of
    sources on one spot the k smallest ids are kept.

    Points and sources with a null coordinate have no neighbours; no sources give no rows, fewer than k all of them. The loop asks only whether any points are left,
    and raises if some are after `rounds` doublings of `size`."""
    left = points.select(key, c(x).cast("double").alias("_x"), c(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    every = sources.select(c(sx).cast("double").alias("_sx"), c(sy).cast("double").alias("_sy"), c(sid).alias("sid")).dropna(subset=["_sx", "_sy"])
    spot = Window.partitionBy("_sx", "_sy").orderBy("sid")
    every = materialize(every.withColumn("_n", F.row_number().over(spot)).where(c("_n") <= k).drop("_n"), "knn")
    total, halved = _knn_width(every, size, max(32, 4 * k))
    want = min(k, total)
    none = left.join(every, F.lit(False)).select(key, "sid", F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    if not want:
        return none
    done = [none]
    w = Window.partitionBy(key).orderBy("dist", "sid")
    span = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    for r in range(-halved, rounds):
        wide = size * 2.0**r
        asked = left.withColumn("_c", F.explode(span)).select(key, "_x", "_y", (cell("_x", wide) + c("_c.a")).alias("_i"), (cell("_y", wide) + c("_c.b")).alias("_j"))
        d2 = (c("_x") - c("_sx")) * (c("_x") - c("_sx")) + (c("_y") - c("_sy")) * (c("_y") - c("_sy"))
        near = asked.join(every.withColumns({"_i": cell("_sx", wide), "_j": cell("_sy", wide)}), ["_i", "_j"]).withColumn("dist", F.sqrt(d2))
        top = materialize(near.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k).select(key, "sid", "dist", "rank"), "knn")
        settled = top.where((c("rank") == want) & (c("dist") <= wide)).select(key)
        done.append(top.join(settled, key, "left_semi"))
        left = materialize(left.join(settled, key, "left_anti"), "knn")
        if left.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, done)
    raise ValueError(f"points lie more than {rounds} doublings of {size} away from {want} sources")


def snap_grid(df: DataFrame, x: str, y: str, size: float, minx: float = 0.0, miny: float = 0.0) -> DataFrame:
    """df with the nearest node (nx, ny) of a regular mesh: no join."""
    return df.withColumns({"nx": F.floor((c(x) - minx) / size + 0.5) * size + minx, "ny": F.floor((c(y) - miny) / size + 0.5) * size + miny})


def _brackets(left: DataFrame, right: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """left rows with the last right sample at or before (t0, v0) and the first at or after (t1, v1): one union, one window per group."""
    a = left.withColumns({"_side": F.lit(1), "_s": F.lit(None).cast(f"struct<t:{dict(right.dtypes)[t]},v:double>")})
    b = right.select(*by, t, F.lit(0).alias("_side"), F.struct(c(t).alias("t"), c(v).cast("double").alias("v")).alias("_s"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by)
    before = F.last("_s", ignorenulls=True).over(w.orderBy(c(t), c("_side")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_s", ignorenulls=True).over(w.orderBy(c(t), c("_side").desc()).rowsBetween(0, Window.unboundedFollowing))
    return both.withColumns({"_b": before, "_a": after}).where("_side = 1").drop("_side", "_s").select(*left.columns, c("_b.t").alias("t0"), c("_b.v").alias("v0"), c("_a.t").alias("t1"), c("_a.v").alias("v1"))


def _micros(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t).cast("double")


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """left rows with the right sample nearest in time (ties: the earlier one), inside the right side's span."""
    got = _brackets(left, right, by, t, v).where("t0 is not null and t1 is not null")
    early = _micros(c(t)) - _micros(c("t0")) <= _micros(c("t1")) - _micros(c(t))
    return got.select(*left.columns, F.when(early, c("t0")).otherwise(c("t1")).alias("matched_t"), F.when(early, c("v0")).otherwise(c("v1")).alias("matched"))


def interp_join(left: DataFrame, right: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """left rows inside the right side's span with the right value interpolated linearly at their time."""
    got = _brackets(left, right, by, t, v).where("t0 is not null and t1 is not null")
    gap = _micros(c("t1")) - _micros(c("t0"))
    part = F.when(gap > 0, (_micros(c(t)) - _micros(c("t0"))) / F.when(gap > 0, gap)).otherwise(0.0)
    return got.select(*left.columns, (c("v0") + (c("v1") - c("v0")) * part).alias("interpolated"))


def align_series(a: DataFrame, b: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """Both series interpolated on one grid per group: the common span in steps of the larger mean step (whole seconds)."""
    step = lambda df, n: df.groupBy(*by).agg(F.min(t).alias(f"{n}0"), F.max(t).alias(f"{n}1"), F.count("*").alias(f"{n}n"))
    g = step(a, "a").join(step(b, "b"), by).where("an > 1 and bn > 1")
    mean = lambda n: (_micros(c(f"{n}1")) - _micros(c(f"{n}0"))) / (c(f"{n}n") - 1) / 1e6
    g = g.withColumns({"lo": F.greatest("a0", "b0"), "hi": F.least("a1", "b1"), "dt": F.greatest(F.ceil(F.greatest(mean("a"), mean("b"))), F.lit(1)).cast("long")}).where("lo < hi")
    steps = F.sequence(F.lit(0).cast("long"), F.floor((_micros(c("hi")) - _micros(c("lo"))) / 1e6 / c("dt")).cast("long"))
    grid = g.select(*by, "lo", "dt", F.explode(steps).alias("k")).select(*by, "k", F.timestamp_add("SECOND", (c("k") * c("dt")).cast("int"), c("lo")).alias(t))
    one = interp_join(grid, a, by, t, v).withColumnRenamed("interpolated", "a")
    return interp_join(one, b, by, t, v).withColumnRenamed("interpolated", "b")


def overlay_update(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """a with the columns overwritten by b's where the key is in b (also by nulls)."""
    other = b.select(key, F.lit(True).alias("_hit"), *[c(k).alias(f"_b_{k}") for k in columns])
    return a.join(other, key, "left").withColumns({k: F.when(c("_hit"), c(f"_b_{k}")).otherwise(c(k)) for k in columns}).select(*a.columns)


def grid_average(df: DataFrame, x: str, y: str, v: str, size: float) -> DataFrame:
    """Means on a mesh of nodes over closed boxes of half the width around them; a point on an edge counts for both sides."""
    lo, hi = lambda k: F.ceil(c(k) / size - 0.5), lambda k: F.floor(c(k) / size + 0.5)
    nodes = df.withColumn("gx", F.explode(F.sequence(lo(x), hi(x)))).withColumn("gy", F.explode(F.sequence(lo(y), hi(y))))
    return nodes.groupBy("gx", "gy").agg(F.avg(v).alias("v"), F.count(v).alias("n"))
