"""Queries of the aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from displace.operators import aggregates as ops
from displace.operators.series import median_filter as median_mirrored
from displace.registry import query

c = F.col
r4 = lambda e, n: F.round(e, 4).alias(n)


@query("region_count", "SELECT count(*) AS n, count(*) FILTER (x > 2000 AND x < 6000 AND y > 1000 AND y < 9000) AS inside FROM psi_points", "psi_points")
def region_count(p: DataFrame) -> DataFrame:
    from displace.operators.filters import inside_box

    return p.agg(F.count("*").alias("n"), F.count_if(inside_box("x", "y", (2000, 1000, 6000, 9000))).alias("inside"))


@query("distinct_values", "SELECT fclass AS v FROM features UNION SELECT direction FROM psi_series UNION SELECT kind FROM catalogue", "features", "psi_series", "catalogue")
def distinct_values(f: DataFrame, s: DataFrame, cat: DataFrame) -> DataFrame:
    parts = [f.select(c("fclass").alias("v")), s.select(c("direction").alias("v")), cat.select(c("kind").alias("v"))]
    return parts[0].distinct().unionByName(parts[1].distinct()).unionByName(parts[2].distinct()).distinct()


@query("layer_bounds", "SELECT fclass, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM features GROUP BY fclass", "features")
def layer_bounds(f: DataFrame) -> DataFrame:
    return f.groupBy("fclass").agg(F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"))


@query("area_per_class", "SELECT site, fclass, round(sum(area), 1) AS area FROM (SELECT fid % 100 AS site, fclass, area FROM features) GROUP BY site, fclass HAVING round(sum(area), 1) >= 1", "features")
def area_per_class(f: DataFrame) -> DataFrame:
    return f.groupBy((c("fid") % 100).alias("site"), "fclass").agg(F.round(F.sum("area"), 1).alias("area")).where("area >= 1")


@query("road_lengths", "SELECT fclass, ref, round(sum(len), 4) AS len FROM features WHERE fclass = 'A' GROUP BY fclass, ref", "features")
def road_lengths(f: DataFrame) -> DataFrame:
    return f.where("fclass = 'A'").groupBy("fclass", "ref").agg(r4(F.sum("len"), "len"))


@query(
    "label_topk",
    """WITH l AS (SELECT grp, unnest([class_1, class_2, class_3]) AS label FROM labels3), n AS (SELECT grp, label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY grp, label)
       SELECT grp, label, n, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, label DESC) AS k FROM n) WHERE k <= 3""",
    "labels3",
)
def label_topk(df: DataFrame) -> DataFrame:
    return ops.label_topk(df, "grp", ["class_1", "class_2", "class_3"])


@query(
    "label_collapse",
    """SELECT grp, coalesce(string_agg(DISTINCT class_1, ', ' ORDER BY class_1), '(empty)') AS class_1, coalesce(string_agg(DISTINCT class_2, ', ' ORDER BY class_2), '(empty)') AS class_2,
              CAST(coalesce(bool_or(known), FALSE) AS INT) AS known, coalesce(string_agg(DISTINCT comment, ' und ' ORDER BY comment), '(empty)') AS comment FROM labels3 GROUP BY grp""",
    "labels3",
)
def label_collapse(df: DataFrame) -> DataFrame:
    return ops.label_collapse(df, "grp", ["class_1", "class_2"], ["known"], ["comment"])


@query("label_counts", "SELECT class_3 AS label, count(*) AS n, count(*) FILTER (known) AS known FROM labels3 GROUP BY class_3", "labels3")
def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(c("class_3").alias("label")).agg(F.count("*").alias("n"), F.count_if("known").alias("known")).orderBy("n", "label")


@query(
    "velocity_summary",
    """WITH m AS (SELECT median(value) AS m, direction FROM psi_series GROUP BY direction)
       SELECT direction, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(m), 4) AS median, round(median(abs(value - m)), 4) AS mad FROM psi_series JOIN m USING (direction) GROUP BY direction""",
    "psi_series",
)
def velocity_summary(s: DataFrame) -> DataFrame:
    g = s.groupBy("direction").agg(r4(F.avg("value"), "mean"), r4(F.stddev_pop("value"), "std"))
    return g.join(ops.mad(s, ["direction"], "value"), "direction").select("direction", "mean", "std", r4(c("median"), "median"), r4(c("mad"), "mad"))


@query("level_stats", "SELECT grp % 5 AS region, CAST(floor(half / 100) AS INT) AS level, count(*) AS n, round(sum(4 * half * half) / 1e6, 6) AS km2, round(sum(4 * half * half) / 1e8 * 100, 6) AS percent FROM sites GROUP BY 1, 2", "sites")
def level_stats(s: DataFrame) -> DataFrame:
    area = F.sum(4 * c("half") * c("half"))
    return s.groupBy((c("grp") % 5).alias("region"), F.floor(c("half") / 100).cast("int").alias("level")).agg(F.count("*").alias("n"), F.round(area / 1e6, 6).alias("km2"), F.round(area / 1e8 * 100, 6).alias("percent"))


def _size_limit(df: DataFrame, v: str) -> DataFrame:
    """The 95th percentile of the sizes, as one row."""
    return ops.exact_percentiles(df.select(F.abs(v).alias("size")), [], "size", (0.95,)).select(c("p")[0].alias("lim"))


@query(
    "displacement_hist",
    """WITH q AS (SELECT quantile_cont(abs(value), 0.95) AS q FROM psi_series)
       SELECT CAST(least(floor((value + q) / (2 * q / 99)), 98) AS INT) AS bin, count(*) AS n FROM psi_series, q WHERE value >= -q AND value < q GROUP BY 1""",
    "psi_series",
)
def displacement_hist(s: DataFrame) -> DataFrame:
    wide = s.withColumn("q", _size_limit(s, "value").scalar())
    return ops.histogram(wide, [], c("value"), -c("q"), c("q"), 99)


_DAY = "strftime(ts, '%Y-%m-%d') AS day"


@query("quantile_band", f"SELECT {_DAY}, round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.32), 4) AS p32, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.68), 4) AS p68, round(quantile_cont(value, 0.95), 4) AS p95 FROM psi_series GROUP BY 1", "psi_series")
def quantile_band(s: DataFrame) -> DataFrame:
    g = ops.quantile_band(s.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], "value")
    return g.select("day", *[r4(c(k), k) for k in ("p05", "p32", "p50", "p68", "p95")])


@query("epoch_stat", f"SELECT {_DAY}, round(stddev_pop(value), 4) AS v FROM psi_series GROUP BY 1", "psi_series")
def epoch_stat(s: DataFrame) -> DataFrame:
    return epoch_statistic(s, F.stddev_pop)


def epoch_statistic(s: DataFrame, stat) -> DataFrame:
    """Any statistic (a function from a column to an aggregate) across points per epoch."""
    return s.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(r4(stat("value"), "v"))


@query(
    "pluggable_stat",
    "SELECT direction, round(sqrt(avg(value * value)), 4) AS rms, round(max(value) - min(value), 4) AS spread FROM psi_series WHERE value <= 90 GROUP BY direction",
    "psi_series",
)
def pluggable_stat(s: DataFrame) -> DataFrame:
    import operator

    from displace.operators.filters import cut_catalogue

    stats = {"rms": lambda v: F.sqrt(F.avg(c(v) * c(v))), "spread": lambda v: F.max(v) - F.min(v)}
    return cut_catalogue(s, "value", 90, operator.le).groupBy("direction").agg(*[r4(f("value"), k) for k, f in stats.items()])


@query(
    "normal_fit",
    """WITH g AS (SELECT direction, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM psi_series GROUP BY direction)
       SELECT direction, round(mean, 4) AS mean, round(std, 4) AS std, CAST(least(floor((value - (mean - 2 * std)) / (4 * std / 20)), 19) AS INT) AS bin, round(count(*) / (min(n) * min(4 * std / 20)), 6) AS density
       FROM psi_series JOIN g USING (direction) WHERE value >= mean - 2 * std AND value < mean + 2 * std GROUP BY 1, 2, 3, 4""",
    "psi_series",
)
def normal_fit(s: DataFrame) -> DataFrame:
    g = s.groupBy("direction").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("total"))
    h = ops.histogram(s.join(g, "direction"), ["direction", "mean", "std", "total"], c("value"), c("mean") - 2 * c("std"), c("mean") + 2 * c("std"), 20)
    return h.select("direction", r4(c("mean"), "mean"), r4(c("std"), "std"), "bin", F.round(c("n") / (c("total") * (4 * c("std") / 20)), 6).alias("density"))


@query("profile_bins", "SELECT round_even(x / 100, 0) * 100 - 2000 AS d, round(median(z), 6) AS med, round(quantile_cont(z, 0.05), 6) AS p05, round(quantile_cont(z, 0.95), 6) AS p95 FROM psi_points GROUP BY 1", "psi_points")
def profile_bins(p: DataFrame) -> DataFrame:
    g = ops.quantile_band(p.select((F.bround(c("x") / 100, 0) * 100 - 2000).alias("d"), "z"), ["d"], "z", (0.05, 0.5, 0.95))
    return g.select("d", F.round("p50", 6).alias("med"), F.round("p05", 6).alias("p05"), F.round("p95", 6).alias("p95"))


@query("region_summary", "SELECT CAST(floor(x / 2500) AS INT) AS region, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM psi_points GROUP BY 1", "psi_points")
def region_summary(p: DataFrame) -> DataFrame:
    return p.groupBy(F.floor(c("x") / 2500).cast("int").alias("region")).agg(F.count("*").alias("n"), *[r4(F.avg(k), k) for k in ("x", "y", "z")])


_GMA = """moved AS (SELECT * FROM psi_points, params WHERE abs(mean_vel) >= min_mean AND var_mean_vel * var_mean_vel < max_var),
       cells AS (SELECT cellsize, min_mean, max_var, CAST(floor(x / 50) AS BIGINT) AS i, CAST(floor(y / 50) AS BIGINT) AS j, arg_max(mean_vel, ps_id) AS v FROM moved GROUP BY ALL),
       blocks AS (SELECT cellsize, min_mean, max_var, CAST(floor(i * 50 / cellsize) AS BIGINT) AS bi, CAST(floor(j * 50 / cellsize) AS BIGINT) AS bj, sum(abs(v)) AS total, count(*) AS n FROM cells GROUP BY ALL)
       SELECT cellsize, min_mean, max_var, bi, bj, round(total, 4) AS total, n, round(log10(n * total), 4) AS score FROM blocks"""


def _gma(p: DataFrame, sizes, means, variances) -> DataFrame:
    rows = [(float(a), float(b), float(d)) for a in sizes for b in means for d in variances]
    params = p.sparkSession.createDataFrame(rows, "cellsize double, min_mean double, max_var double")
    return ops.gma_grid(p, params).select("cellsize", "min_mean", "max_var", "bi", "bj", r4(c("total"), "total"), "n", r4(c("score"), "score"))


@query("gma_grid", "WITH params AS (SELECT 500.0::DOUBLE AS cellsize, 1.0::DOUBLE AS min_mean, 0.5::DOUBLE AS max_var), " + _GMA, "psi_points")
def gma_grid(p: DataFrame) -> DataFrame:
    return _gma(p, [500], [1], [0.5])


@query("gma_sweep", "WITH params AS (SELECT a::DOUBLE AS cellsize, b::DOUBLE AS min_mean, d::DOUBLE AS max_var FROM (SELECT unnest([250, 500, 1000]) AS a), (SELECT unnest([0.5, 1.5]) AS b), (SELECT unnest([0.25, 0.8]) AS d)), " + _GMA, "psi_points")
def gma_sweep(p: DataFrame) -> DataFrame:
    return _gma(p, [250, 500, 1000], [0.5, 1.5], [0.25, 0.8])


@query(
    "hexbin",
    """WITH l AS (SELECT x, y, z, floor(x / 500 + 0.5) * 500 AS ax, floor(y / (500 * sqrt(3)) + 0.5) * (500 * sqrt(3)) AS ay, (floor(x / 500) + 0.5) * 500 AS bx, (floor(y / (500 * sqrt(3))) + 0.5) * (500 * sqrt(3)) AS bys FROM psi_points),
       n AS (SELECT z, CASE WHEN (x-ax)*(x-ax)+(y-ay)*(y-ay) <= (x-bx)*(x-bx)+(y-bys)*(y-bys) THEN ax ELSE bx END AS cx, CASE WHEN (x-ax)*(x-ax)+(y-ay)*(y-ay) <= (x-bx)*(x-bx)+(y-bys)*(y-bys) THEN ay ELSE bys END AS cy FROM l)
       SELECT round(cx, 4) AS cx, round(cy, 4) AS cy, count(*) AS n, round(avg(z), 6) AS v FROM n GROUP BY 1, 2 HAVING count(*) >= 3""",
    "psi_points",
)
def hexbin(p: DataFrame) -> DataFrame:
    return ops.hexbin(p, "x", "y", 500.0, 3, "z").select(r4(c("cx"), "cx"), r4(c("cy"), "cy"), "n", F.round("v", 6).alias("v"))


@query("station_mean", f"SELECT {_DAY}, round(avg(CASE WHEN value < 5 THEN NULL ELSE value END), 4) AS v FROM psi_series WHERE direction IN ('click', 'view', 'purchase') GROUP BY 1", "psi_series")
def station_mean(s: DataFrame) -> DataFrame:
    return s.where(c("direction").isin("click", "view", "purchase")).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(r4(F.avg(F.when(c("value") < 5, None).otherwise(c("value"))), "v"))


@query(
    "feature_index",
    """WITH d AS (SELECT DISTINCT 1 AS layer, 'osm_' || fclass AS cls FROM features UNION SELECT DISTINCT 2, 'manclass_' || class_1 FROM labels3)
       SELECT cls, CAST(row_number() OVER (ORDER BY layer, cls) AS INT) AS num FROM d""",
    "features",
    "labels3",
)
def feature_index(f: DataFrame, labels: DataFrame) -> DataFrame:
    names = f.select(F.lit(1).alias("layer"), F.concat(F.lit("osm_"), "fclass").alias("cls")).distinct().unionByName(labels.select(F.lit(2).alias("layer"), F.concat(F.lit("manclass_"), "class_1").alias("cls")).distinct())
    return names.select("cls", F.row_number().over(Window.orderBy("layer", "cls")).alias("num"))  # as many rows as classes


@query(
    "fit_error",
    """WITH m AS (SELECT direction, median(value) AS m, stddev_pop(value) AS s FROM psi_series GROUP BY direction)
       SELECT direction, round(2 * stddev_pop(value), 4) AS error FROM psi_series JOIN m USING (direction) WHERE abs(value - m) <= s GROUP BY direction""",
    "psi_series",
)
def fit_error(s: DataFrame) -> DataFrame:
    return ops.fit_error(s, ["direction"], "value").select("direction", r4(c("error"), "error"))


@query("abs_p95", "SELECT round(quantile_cont(abs(mean_vel), 0.95), 4) AS lim FROM psi_points", "psi_points")
def abs_p95(p: DataFrame) -> DataFrame:
    return _size_limit(p, "mean_vel").select(r4(c("lim"), "lim"))


# windows


@query("stack_series", "SELECT ps_id, direction, ts, value, CAST(row_number() OVER (PARTITION BY ps_id ORDER BY ts, direction, value) AS INT) AS pos FROM psi_series WHERE direction IN ('click', 'view')", "psi_series")
def stack_series(s: DataFrame) -> DataFrame:
    both = s.where("direction = 'click'").unionByName(s.where("direction = 'view'"))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("ps_id").orderBy("ts", "direction", "value")))


@query("median_filter", "SELECT ps_id, ts, value, round(quantile_cont(value, 0.5) OVER (PARTITION BY ps_id ORDER BY ts, value ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM psi_series", "psi_series")
def median_filter(s: DataFrame) -> DataFrame:
    w = Window.partitionBy("ps_id").orderBy("ts", "value").rowsBetween(-2, 2)
    return s.select("ps_id", "ts", "value", r4(F.percentile("value", F.lit(0.5)).over(w), "smooth"))


@query(
    "median_filter_reflected",
    """WITH o AS (SELECT ps_id, ts, value, row_number() OVER (PARTITION BY ps_id ORDER BY ts, value) AS p, count(*) OVER (PARTITION BY ps_id) AS n FROM psi_series),
       q AS (SELECT ps_id, ts, value, p, n, (p - 1 + unnest(range(-3, 4)) + 8 * n) % (2 * n) AS k FROM o),
       m AS (SELECT ps_id, ts, value, p, CASE WHEN k < n THEN k + 1 ELSE 2 * n - k END AS src FROM q)
       SELECT ps_id, m.ts, m.value, round(quantile_cont(o.value, 0.5), 4) AS smooth FROM m JOIN o USING (ps_id) WHERE o.p = m.src GROUP BY ps_id, m.ts, m.value, m.p""",
    "psi_series",
)
def median_filter_reflected(s: DataFrame) -> DataFrame:
    """median_filter over seven neighbours, mirrored at the ends."""
    return median_mirrored(s.select("ps_id", "ts", "value"), ["ps_id"], ["ts", "value"], "value", 7).select("ps_id", "ts", "value", r4(c("smooth"), "smooth"))


@query("spacing", "WITH d AS (SELECT DISTINCT y FROM psi_points), g AS (SELECT y - lag(y) OVER (ORDER BY y) AS d FROM d) SELECT round(avg(d), 4) AS mean, min(d) AS least FROM g", "psi_points")
def spacing(p: DataFrame) -> DataFrame:
    # the mean of the differences needs no order; the least one is found inside bands that overlap by their last value
    d = p.select("y").distinct()
    w = Window.partitionBy("band").orderBy("y")
    band = d.withColumn("band", F.floor(c("y") / 1000))
    edge = band.groupBy("band").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    jump = edge.select((c("lo") - F.lag("hi").over(Window.orderBy("band"))).alias("d"))  # a row per band
    inner = band.select((c("y") - F.lag("y").over(w)).alias("d")).unionByName(jump).agg(F.min("d").alias("least"))
    mean = d.agg(r4((F.max("y") - F.min("y")) / F.nullif(F.count("*") - 1, F.lit(0)), "mean"))
    return mean.withColumn("least", inner.scalar())


@query("landuse_major", "WITH a AS (SELECT fid % 100 AS site, fclass, sum(area) AS area FROM features GROUP BY 1, 2) SELECT site, arg_max(fclass, (area, fclass)) AS major, string_agg(fclass, ',' ORDER BY area DESC, fclass DESC) AS ranking FROM a GROUP BY site", "features")
def landuse_major(f: DataFrame) -> DataFrame:
    a = f.groupBy((c("fid") % 100).alias("site"), "fclass").agg(F.sum("area").alias("area"))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("area", "fclass")), asc=False), lambda v: v["fclass"])
    return a.groupBy("site").agg(F.max_by("fclass", F.struct("area", "fclass")).alias("major"), F.array_join(ranked, ",").alias("ranking"))


@query("first_per_time", f"SELECT direction, day, value FROM (SELECT direction, value, {_DAY}, row_number() OVER (PARTITION BY direction, CAST(ts AS DATE) ORDER BY ts, value) AS k FROM psi_series) WHERE k = 1", "psi_series")
def first_per_time(s: DataFrame) -> DataFrame:
    g = s.groupBy("direction", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min(F.struct("ts", "value")).alias("m"))
    return g.select("direction", "day", c("m.value").alias("value"))


# set operations


@query("union_layers", "SELECT fclass, count(*) AS n, round(sum(len), 4) AS len FROM features WHERE fclass IN ('A', 'R') GROUP BY fclass", "features")
def union_layers(f: DataFrame) -> DataFrame:
    both = f.where("fclass = 'A'").unionByName(f.where("fclass = 'R'"))
    return both.groupBy("fclass").agg(F.count("*").alias("n"), r4(F.sum("len"), "len"))


@query("mask_union", "SELECT cls, count(*) AS n FROM (SELECT 'osm_' || fclass AS cls FROM features UNION ALL SELECT 'manclass_' || coalesce(class_2, 'None') FROM labels3) GROUP BY cls", "features", "labels3")
def mask_union(f: DataFrame, labels: DataFrame) -> DataFrame:
    both = f.select(F.concat(F.lit("osm_"), F.coalesce("fclass", F.lit("None"))).alias("cls")).unionByName(labels.select(F.concat(F.lit("manclass_"), F.coalesce("class_2", F.lit("None"))).alias("cls")))
    return both.groupBy("cls").agg(F.count("*").alias("n"))


@query("distinct_tiles", "SELECT DISTINCT CAST(floor(x / 1000) AS INT) AS tx, CAST(floor(y / 1000) AS INT) AS ty FROM features WHERE fclass = 'R'", "features")
def distinct_tiles(f: DataFrame) -> DataFrame:
    return f.where("fclass = 'R'").select(F.floor(c("x") / 1000).cast("int").alias("tx"), F.floor(c("y") / 1000).cast("int").alias("ty")).distinct()


@query("label_translate", "SELECT id, CASE class_1 WHEN 'slide' THEN 'gravitational' WHEN 'sinkhole' THEN 'karst' END AS cls, id % 4 = 0 AS unclear, class_2 IS NULL AS research FROM labels3", "labels3")
def label_translate(df: DataFrame) -> DataFrame:
    from displace.functions.textfn import translated

    raw = F.when(c("id") % 4 == 0, F.concat(F.lit("("), "class_1", F.lit(")"))).otherwise(c("class_1"))
    names = {"slide": "gravitational", "sinkhole": "karst"}
    return df.select("id", translated(F.regexp_replace(raw, r"[()]", ""), names).alias("cls"), raw.contains("(").alias("unclear"), c("class_2").isNull().alias("research"))
