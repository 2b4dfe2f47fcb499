"""Groups of nearby things: proximity components, merged levels, adaptive splits, tilings, active areas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from displace.operators.graph import connected_components
from displace.operators.joins import cell, cover_cells, radius_join
from displace.session import materialize

c = F.col


def near_pairs(df: DataFrame, key: str, x: str, y: str, dist: float) -> DataFrame:
    """Links (src, dst) between members at most `dist` apart that join what all such pairs join. Members of one cell of side dist / 2 are all
    near each other, so they hang on the smallest of them, and only near pairs of different cells are looked for: a crowded cell
    gives links in proportion to its members. Two cells are linked once, by their closest members' smallest pair."""
    own = df.select(c(key).alias("id"), c(x).alias("x"), c(y).alias("y")).where("x is not null and y is not null")
    small = dist / 2
    cells = own.withColumns({"ci": cell("x", small), "cj": cell("y", small)})
    # dist / 2 * sqrt(2) < dist: one cell is one component
    hub = cells.groupBy("ci", "cj").agg(F.min("id").alias("hub"))
    inner = cells.join(hub, ["ci", "cj"]).select("id", "x", "y", "hub")
    star = inner.where("id <> hub").select(c("id").alias("src"), c("hub").alias("dst"))
    other = inner.select(c("id").alias("oid"), c("x").alias("cx"), c("y").alias("cy"), c("hub").alias("ohub"))
    cross = radius_join(inner, other, dist).where("hub < ohub").groupBy("hub", "ohub").agg(F.lit(1)).select(c("hub").alias("src"), c("ohub").alias("dst"))
    return star.unionByName(cross)


def group_nearest(df: DataFrame, key: str, x: str, y: str, dist: float) -> DataFrame:
    """(key, grp): grp is the smallest key of the transitive closure of distance <= dist; every row without a null coordinate is in one."""
    own = df.select(key, x, y).where(c(x).isNotNull() & c(y).isNotNull())
    comp = connected_components(near_pairs(own, key, x, y, dist))
    return own.select(key).distinct().join(comp.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("grp"))


def merge_points(df: DataFrame, key: str, x: str, y: str, dist: float) -> DataFrame:
    """One point per cluster of points at most `dist` apart: the mean of its members."""
    g = group_nearest(df, key, x, y, dist)
    return df.join(g, key).groupBy("grp").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))


def box_stars(boxes: DataFrame, key: str, by: list[str], size: float) -> DataFrame:
    """Links (src, dst) that join what overlapping boxes of equal `by` join: in each cell, the components of the boxes that touch it, each as a star around its
    smallest key. Two boxes that overlap do so in a cell that both touch, so there is at most one link a box and cell, not one a pair."""
    kind = dict(boxes.dtypes)[key]
    at = ["_i", "_j", *by]
    cells = boxes.select(key, *by, "minx", "miny", "maxx", "maxy", F.explode(cover_cells(c("minx"), c("miny"), c("maxx"), c("maxy"), size)).alias("_c")).withColumns({"_i": c("_c.i"), "_j": c("_c.j")}).drop("_c")

    def stars(own: pa.Table) -> pa.Table:
        own = own.sort_by(key)
        x0, y0, x1, y1 = (own[k].to_numpy() for k in ("minx", "miny", "maxx", "maxy"))
        left, src, dst = np.arange(len(own)), [], []
        while len(left):
            hub, todo, left = left[0], [left[0]], left[1:]
            while todo and len(left):
                k = todo.pop()
                met = (x0[left] <= x1[k]) & (x0[k] <= x1[left]) & (y0[left] <= y1[k]) & (y0[k] <= y1[left])
                todo.extend(left[met])
                src.extend(left[met])
                dst.extend([hub] * int(met.sum()))
                left = left[~met]
        return pa.table({"src": own[key].take(pa.array(src, pa.int64())), "dst": own[key].take(pa.array(dst, pa.int64()))})

    return cells.groupBy(*at).applyInArrow(stars, f"src {kind}, dst {kind}").where("src <> dst").distinct()


def merge_levels(boxes: DataFrame, grp: str, level: str, key: str, size: float, gap: float = 0.1) -> DataFrame:
    """Inside a group and level, overlapping boxes (grown by `gap`) become one: (key, merged, grp, level, n, area); the area of the union is counted
    on cells of side `size`, so it is exact to the cells an outline crosses. A column's cells are counted by the ends of its boxes."""
    grown = boxes.withColumns({"minx": c("minx") - gap, "miny": c("miny") - gap, "maxx": c("maxx") + gap, "maxy": c("maxy") + gap}).where(f"{grp} is not null and {level} is not null")
    comp = connected_components(box_stars(grown, key, [grp, level], 1000.0))
    named = boxes.join(comp.withColumnRenamed("node", key), key, "left").withColumn("merged", F.coalesce("component", key))
    count = named.groupBy("merged", grp, level).agg(F.count("*").alias("n"))
    first, last = lambda k: F.ceil(c(k) / size - 0.5).cast("long"), lambda k: (F.ceil(c(k) / size - 0.5) - 1).cast("long")
    spans = named.select("merged", first("minx").alias("i0"), last("maxx").alias("i1"), first("miny").alias("lo"), last("maxy").alias("hi")).where("i0 <= i1 and lo <= hi")
    columns = spans.select("merged", F.explode(F.sequence("i0", "i1")).alias("i"), "lo", "hi").groupBy("merged", "i", "lo").agg(F.max("hi").alias("hi"))
    before = F.max("hi").over(Window.partitionBy("merged", "i").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    new = columns.withColumn("new", F.greatest(c("hi") - F.greatest(F.coalesce(before, c("lo") - 1), c("lo") - 1), F.lit(0)))
    area = new.groupBy("merged").agg((F.sum("new") * size * size).alias("area"))
    return count.join(area, "merged", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def adaptive_split(points: DataFrame, x: str, y: str, most: int, overlap: float = 0.0, rounds: int | None = None) -> DataFrame:
    """Regions (rid, minx, miny, maxx, maxy, n, over) of at most `most` points: the longer side is halved, with an overlap, until it fits. Points
    carry their region along: a round counts by region and keeps, by an equi-join, the points of those that are halved. What cannot be halved
    (points on one spot, a side of four overlaps or of the last bit), or is left after `rounds`, stays in the result with over = true."""
    box = ["rid", "minx", "miny", "maxx", "maxy"]
    own = points.select(c(x).alias("_x"), c(y).alias("_y")).where("_x is not null and _y is not null")
    b = own.agg(F.min("_x").alias("minx"), F.min("_y").alias("miny"), F.max("_x").alias("maxx"), F.max("_y").alias("maxy"))
    left = own.crossJoin(F.broadcast(b)).withColumn("rid", F.lit("0"))  # one row of bounds
    wide = (c("maxx") - c("minx")) >= (c("maxy") - c("miny"))
    mx, my = (c("minx") + c("maxx")) / 2, (c("miny") + c("maxy")) / 2
    low, mid, high = F.when(wide, c("minx")).otherwise(c("miny")), F.when(wide, mx).otherwise(my), F.when(wide, c("maxx")).otherwise(c("maxy"))
    spot = (c("_lx") == c("_hx")) & (c("_ly") == c("_hy"))
    whole = spot | (high - low <= 4 * overlap + 1e-9) | (mid <= low) | (mid >= high)
    done, k = None, 0
    while True:
        spans = [F.min("_x").alias("_lx"), F.max("_x").alias("_hx"), F.min("_y").alias("_ly"), F.max("_y").alias("_hy")]
        counted = materialize(left.groupBy(*box).agg(F.count("*").alias("n"), *spans).select(*box, "n", (c("n") > most).alias("over"), whole.alias("_whole")), "split")
        k += 1
        ends = ~c("over") | c("_whole") if rounds is None or k < rounds else F.lit(True)
        fits = counted.where(ends).drop("_whole")
        done = fits if done is None else done.unionByName(fits)
        big = counted.where(~ends).select("rid")
        if big.limit(1).count() == 0:
            return done
        cut = left.join(big, "rid", "left_semi").withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
        halves = cut.select(
            "_x",
            "_y",
            F.concat("rid", c("h").cast("string")).alias("rid"),
            F.when(wide & (c("h") == 1), mx - overlap).otherwise(c("minx")).alias("minx"),
            F.when(~wide & (c("h") == 1), my - overlap).otherwise(c("miny")).alias("miny"),
            F.when(wide & (c("h") == 0), mx + overlap).otherwise(c("maxx")).alias("maxx"),
            F.when(~wide & (c("h") == 0), my + overlap).otherwise(c("maxy")).alias("maxy"),
        )
        left = materialize(halves.where(c("_x").between(c("minx"), c("maxx")) & c("_y").between(c("miny"), c("maxy"))), "split")


def tile_regions(bounds: DataFrame, nsub: int | None = None, width: float | None = None) -> DataFrame:
    """Boxes (i, j, minx ..) over each bounds row: nsub x nsub, or squares of a width aligned to its multiples."""
    if nsub:
        sx, sy = (c("maxx") - c("minx")) / nsub, (c("maxy") - c("miny")) / nsub
        cells = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nsub - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nsub - 1))))
        x0, y0 = c("minx") + c("i") * sx, c("miny") + c("j") * sy
        return cells.select("i", "j", x0.alias("minx"), y0.alias("miny"), (x0 + sx).alias("maxx"), (y0 + sy).alias("maxy"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(c(lo) / width).cast("int"), (F.ceil(c(hi) / width) - 1).cast("int")))
    cells = bounds.withColumn("i", span("minx", "maxx")).withColumn("j", span("miny", "maxy"))
    return cells.select("i", "j", (c("i") * width).alias("minx"), (c("j") * width).alias("miny"), ((c("i") + 1) * width).alias("maxx"), ((c("j") + 1) * width).alias("maxy"))


def active_areas(points: DataFrame, key: str, x: str, y: str, v: str, least: float, radius: float, members: int) -> DataFrame:
    """Clusters of moving points (abs(v) > least) within `radius` of each other with at least `members` of them."""
    moving = points.where(F.abs(c(v)) > least)
    g = group_nearest(moving, key, x, y, radius)
    w = Window.partitionBy("grp")
    return g.withColumn("n", F.count("*").over(w)).where(c("n") >= members)
