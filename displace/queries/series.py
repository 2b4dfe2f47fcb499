"""Queries of the time-series models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.functions.mathfn import superpose
from displace.functions.timefn import peak_date
from displace.operators import joins, series as ops
from displace.queries.joins import _boxes
from displace.operators.regions import radius_median, radius_sums
from displace.registry import query

c = F.col
r4 = lambda e, n: F.round(e, 4).alias(n)
#: The test events span a month, so the cycle is a week and time is counted in weeks from their first day.
WEEK = {"degree": 1, "periods": (1.0, 0.5)}
_WEEKS = "(epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / (7 * 86400e6)"


def _weeks(s: DataFrame) -> DataFrame:
    return s.withColumn("w", F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), c("ts")).cast("double") / (7 * 86400e6))


def _coefficients(fits: DataFrame, by: list[str], n: int = 6) -> DataFrame:
    return fits.select(*by, "n", *[r4(c("coeffs")[i], f"m{i}") for i in range(n)])


@query(
    "linear_fit",
    f"SELECT ps_id, count(*) AS n, round(regr_slope(value, w), 4) AS slope, round(regr_intercept(value, w), 4) AS intercept, round(var_pop(value) - regr_slope(value, w) * covar_pop(w, value), 4) AS residual_var FROM (SELECT ps_id, value, {_WEEKS} AS w FROM psi_series) GROUP BY ps_id",
    "psi_series",
)
def linear_fit(s: DataFrame) -> DataFrame:
    return ops.linear_fit(_weeks(s), ["ps_id"], "w", "value").select("ps_id", "n", *[r4(c(k), k) for k in ("slope", "intercept", "residual_var")])


@query(
    "design_terms",
    f"SELECT event_id, round(w, 4) AS trend, round(w * w, 4) AS square, round(sin(2 * pi() * w), 4) AS s1, round(cos(2 * pi() * w), 4) AS c1, CASE WHEN w >= 2 THEN 1.0 ELSE 0.0 END AS step, round(CASE WHEN w >= 1 THEN ln(1 + (w - 1)) ELSE 0 END, 4) AS post FROM (SELECT event_id, {_WEEKS} AS w FROM events)",
    "events",
)
def design_terms(e: DataFrame) -> DataFrame:
    t = dict(ops.terms(c("w"), degree=2, periods=(1.0,), steps=(2.0,), quakes=(1.0,)))
    return _weeks(e).select("event_id", r4(t["trend1"], "trend"), r4(t["trend2"], "square"), r4(t["sin_1"], "s1"), r4(t["cos_1"], "c1"), t["step_2"].alias("step"), r4(t["post_1"], "post"))


@query("ls_inversion", None, "psi_series")
def ls_inversion(s: DataFrame) -> DataFrame:
    return _coefficients(ops.invert(_weeks(s), ["ps_id"], "w", "value", **WEEK), ["ps_id"])


_LINE = f"WITH d AS (SELECT ps_id, ts, value, {_WEEKS} AS w FROM psi_series), f AS (SELECT ps_id, regr_slope(value, w) AS b, regr_intercept(value, w) AS a FROM d GROUP BY ps_id), r AS (SELECT ps_id, ts, value, w, a + b * w AS dhat, value - a - b * w AS dres FROM d JOIN f USING (ps_id)) "
_FLAT = {"degree": 1, "periods": ()}


@query("forward_model", _LINE + "SELECT ps_id, ts, value, round(dhat, 4) AS dhat, round(dres, 4) AS dres FROM r", "psi_series")
def forward_model(s: DataFrame) -> DataFrame:
    own = _weeks(s)
    fits = ops.invert(own, ["ps_id"], "w", "value", **_FLAT)
    return ops.forward(own, fits, ["ps_id"], "w", "value", **_FLAT).select("ps_id", "ts", "value", r4(c("dhat"), "dhat"), r4(c("dres"), "dres"))


@query("residual_trim", _LINE + ", q AS (SELECT ps_id, quantile_cont(dres, 0.05) AS lo, quantile_cont(dres, 0.95) AS hi FROM r GROUP BY ps_id) SELECT ps_id, count(*) AS n, round(sum(value), 4) AS total FROM r JOIN q USING (ps_id) WHERE dres >= lo AND dres <= hi GROUP BY ps_id", "psi_series")
def residual_trim(s: DataFrame) -> DataFrame:
    own = _weeks(s)
    res = ops.forward(own, ops.invert(own, ["ps_id"], "w", "value", **_FLAT), ["ps_id"], "w", "value", **_FLAT)
    return ops.trim_residuals(res, ["ps_id"]).groupBy("ps_id").agg(F.count("*").alias("n"), r4(F.sum("value"), "total"))


@query(
    "robust_inversion",
    _LINE + ", q AS (SELECT ps_id, quantile_cont(dres, 0.05) AS lo, quantile_cont(dres, 0.95) AS hi, count(*) AS n_first FROM r GROUP BY ps_id) SELECT ps_id, min(n_first) AS n_first, count(*) AS n, round(regr_intercept(value, w), 4) AS m0, round(regr_slope(value, w), 4) AS m1 FROM r JOIN q USING (ps_id) WHERE dres >= lo AND dres <= hi GROUP BY ps_id",
    "psi_series",
)
def robust_inversion(s: DataFrame) -> DataFrame:
    fits = ops.robust_invert(_weeks(s), ["ps_id"], "w", "value", **_FLAT)
    return fits.select("ps_id", "n_first", "n", r4(c("coeffs")[0], "m0"), r4(c("coeffs")[1], "m1"))


def _on_mesh(s: DataFrame, p: DataFrame, size: float) -> DataFrame:
    nodes = joins.snap_grid(p.select("ps_id", "x", "y"), "x", "y", size).select("ps_id", "nx", "ny")
    return _weeks(s).join(nodes, "ps_id")


@query("mesh_inversion", None, "psi_series", "psi_points")
def mesh_inversion(s: DataFrame, p: DataFrame) -> DataFrame:
    return _coefficients(ops.robust_invert(_on_mesh(s, p, 2500.0), ["nx", "ny"], "w", "value", **WEEK), ["nx", "ny"])


@query(
    "region_inversion",
    f"""WITH reg AS (SELECT ps_id, CAST(floor(x / 5000) AS INT) AS region FROM psi_points), d AS (SELECT region, direction, value, {_WEEKS} AS w, s.ps_id FROM psi_series s JOIN reg USING (ps_id) WHERE direction IN ('click', 'view'))
        SELECT region, direction, count(*) AS n, round(regr_intercept(value, w), 4) AS m0, round(regr_slope(value, w), 4) AS m1 FROM d GROUP BY region, direction HAVING count(DISTINCT ps_id) >= 5""",
    "psi_series",
    "psi_points",
)
def region_inversion(s: DataFrame, p: DataFrame) -> DataFrame:
    region = p.select("ps_id", F.floor(c("x") / 5000).cast("int").alias("region"))
    own = _weeks(s.where(c("direction").isin("click", "view"))).join(region, "ps_id")
    enough = own.groupBy("region", "direction").agg(F.countDistinct("ps_id").alias("ids")).where("ids >= 5").select("region", "direction")
    fits = ops.invert(own.join(enough, ["region", "direction"], "left_semi"), ["region", "direction"], "w", "value", **_FLAT)
    return _coefficients(fits, ["region", "direction"], 2)


@query("site_seasonality", None, "psi_series", "psi_points")
def site_seasonality(s: DataFrame, p: DataFrame) -> DataFrame:
    fits = ops.invert(_on_mesh(s, p, 2500.0), ["nx", "ny"], "w", "value", **WEEK)
    amp1, ph1 = superpose(c("coeffs")[2], -c("coeffs")[3])
    amp2, ph2 = superpose(c("coeffs")[4], -c("coeffs")[5])
    day = lambda ph: F.pmod(ph, F.lit(2 * math.pi))
    return fits.select("nx", "ny", "n", F.round(c("coeffs")[1], 2).alias("linear"), F.round(amp1, 2).alias("annual"), F.round(amp2, 2).alias("half_annual"), peak_date(day(ph1)).alias("annual_peak"), peak_date(day(ph2), 182.5).alias("half_peak"))


@query(
    "event_series",
    f"""WITH q AS (SELECT o_orderkey AS id, CAST((o_orderkey * 7919) % 10007 AS DOUBLE) AS cx, CAST((o_orderkey * 104729) % 10009 AS DOUBLE) AS cy FROM orders),
        n AS (SELECT id, ps_id FROM q JOIN psi_points ON (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 1000000)
        SELECT id, count(*) AS n, round(regr_intercept(value, w), 4) AS m0, round(regr_slope(value, w), 4) AS m1 FROM (SELECT id, value, {_WEEKS} AS w FROM n JOIN psi_series USING (ps_id)) GROUP BY id HAVING count(*) >= 2""",
    "psi_series",
    "psi_points",
    "orders",
)
def event_series(s: DataFrame, p: DataFrame, o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    quakes = o.select(k.alias("id"), ((k * 7919) % 10007).cast("double").alias("cx"), ((k * 104729) % 10009).cast("double").alias("cy"))
    return _near_events(s, p, quakes)


def _near_events(s: DataFrame, p: DataFrame, quakes: DataFrame) -> DataFrame:
    """Fits of all series near each event. A point's sums are made once and added up for the events near it, without a row per point and event."""
    design = ops.terms(c("w"), **_FLAT)
    own = ops.normal_sums(_weeks(s), ["ps_id"], design, "value").join(p.select("ps_id", "x", "y"), "ps_id")
    k = len(design) * (len(design) + 1) // 2 + len(design)
    parts = [f"_s{i}" for i in range(k)]
    near = radius_sums(own.select("x", "y", "n", *[c("sums")[i].alias(n) for i, n in enumerate(parts)]), quakes, "id", ["n", *parts], 1000.0, 500.0)
    fits = ops.solve(ops.merge_sums(near.select("id", c("n").cast("long").alias("n"), F.array(*parts).alias("sums")), ["id"], len(design)), ["id"], len(design))
    return _coefficients(fits.where("n >= 2"), ["id"], 2)


@query("event_series_all", None, "psi_series", "psi_points", "catalogue")
def event_series_all(s: DataFrame, p: DataFrame, e: DataFrame) -> DataFrame:
    """event_series of the events that the reference prepares, from magnitude 2.5."""
    k = c("id")
    return _near_events(s, p, e.where("magnitude >= 2.5").select("id", ((k * 7919) % 10007).cast("double").alias("cx"), ((k * 104729) % 10009).cast("double").alias("cy")))


@query("stacked_fit", f"SELECT direction, count(*) AS n, round(regr_intercept(value, w), 4) AS m0, round(regr_slope(value, w), 4) AS m1 FROM (SELECT direction, value, {_WEEKS} AS w FROM psi_series) GROUP BY direction", "psi_series")
def stacked_fit(s: DataFrame) -> DataFrame:
    return _coefficients(ops.invert(_weeks(s), ["direction"], "w", "value", **_FLAT), ["direction"], 2)


@query(
    "coefficients_long",
    f"WITH f AS (SELECT direction, regr_intercept(value, w) AS a, regr_slope(value, w) AS b FROM (SELECT direction, value, {_WEEKS} AS w FROM psi_series) GROUP BY direction) SELECT direction, 'offset' AS term, round(a, 2) AS value FROM f UNION ALL SELECT direction, 'trend1', round(b, 2) FROM f",
    "psi_series",
)
def coefficients_long(s: DataFrame) -> DataFrame:
    fits = ops.invert(_weeks(s), ["direction"], "w", "value", **_FLAT)
    return ops.named(fits, ["direction"], **_FLAT).select("direction", "term", F.round("value", 2).alias("value"))


@query("fit_curve", _LINE + ", k AS (SELECT ps_id, unnest(range(0, 5)) AS q FROM f) SELECT ps_id, q, round(a + b * q, 4) AS dhat FROM f JOIN k USING (ps_id)", "psi_series")
def fit_curve(s: DataFrame) -> DataFrame:
    fits = ops.invert(_weeks(s), ["ps_id"], "w", "value", **_FLAT)
    at = fits.select("ps_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("q")).withColumns({"w": c("q").cast("double"), "value": F.lit(0.0)})
    return ops.forward(at, fits, ["ps_id"], "w", "value", **_FLAT).select("ps_id", "q", r4(c("dhat"), "dhat"))


@query(
    "spline_curve",
    _LINE + ", e AS (SELECT ps_id, min(w) AS lo, max(w) AS hi FROM d WHERE value IS NOT NULL GROUP BY ps_id), k AS (SELECT ps_id, unnest(range(0, 50)) / 10.0 AS q FROM e) SELECT ps_id, CAST(q AS DOUBLE) AS q, round(a + b * q, 4) AS dhat FROM k JOIN e USING (ps_id) JOIN f USING (ps_id) WHERE lo < hi AND q >= lo AND q <= hi",
    "psi_series",
)
def spline_curve(s: DataFrame) -> DataFrame:
    """The spline through a series' fitted values, at tenths of a week inside the series; through a straight fit it is that line."""
    own = _weeks(s).where("value is not null")
    fitted = ops.forward(own, ops.invert(own, ["ps_id"], "w", "value", **_FLAT), ["ps_id"], "w", "value", **_FLAT)
    ends = own.groupBy("ps_id").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo < hi")
    tenths = ends.withColumn("w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: k / 10.0))).where("w >= lo and w <= hi")
    return ops.spline_at(fitted, tenths, ["ps_id"], "w", "dhat").select("ps_id", c("w").alias("q"), r4(c("dhat"), "dhat"))


@query(
    "fit_results",
    f"WITH f AS (SELECT ps_id, round(regr_intercept(value, w), 4) AS m0, round(regr_slope(value, w), 4) AS m1 FROM (SELECT ps_id, value, {_WEEKS} AS w FROM psi_series) GROUP BY ps_id) SELECT ps_id, x, y, m0, m1 FROM f JOIN psi_points USING (ps_id) WHERE m1 IS NOT NULL",
    "psi_series",
    "psi_points",
)
def fit_results(s: DataFrame, p: DataFrame) -> DataFrame:
    fits = ops.invert(_weeks(s), ["ps_id"], "w", "value", **_FLAT).withColumn("fit", F.lit(1))
    stored = p.select("ps_id", "x", "y").join(fits, "ps_id", "left")
    return stored.where("fit = 1 and coeffs is not null").select("ps_id", "x", "y", r4(c("coeffs")[0], "m0"), r4(c("coeffs")[1], "m1"))


_DAILY = "WITH d AS (SELECT CAST(ts AS DATE) - date '2024-01-01' AS i, avg(CASE WHEN direction = 'click' THEN value END) AS a, avg(CASE WHEN direction = 'view' THEN value END) AS b FROM psi_series GROUP BY 1) "


def _daily(s: DataFrame) -> DataFrame:
    g = s.groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("i"))
    return g.agg(F.avg(F.when(c("direction") == "click", c("value"))).alias("a"), F.avg(F.when(c("direction") == "view", c("value"))).alias("b"))


@query(
    "cross_correlation",
    _DAILY + ", m AS (SELECT i, a - (SELECT avg(a) FROM d) AS a, b - (SELECT avg(b) FROM d) AS b FROM d), s AS (SELECT CAST(x.i - y.i AS INT) AS lag, sum(x.a * y.b) AS s FROM m x JOIN m y ON abs(x.i - y.i) <= 10 GROUP BY 1) SELECT lag, round(s / (SELECT max(s) FROM s), 4) AS r, s = (SELECT max(s) FROM s) AS best FROM s",
    "psi_series",
)
def cross_correlation(s: DataFrame) -> DataFrame:
    got = ops.cross_correlation(_daily(s).withColumn("k", F.lit(0)), ["k"], "i", "a", "b", 10)
    return got.select("lag", r4(c("r"), "r"), (c("r") == 1.0).alias("best"))


@query("cross_correlation_full", None, "psi_series")
def cross_correlation_full(s: DataFrame) -> DataFrame:
    """cross_correlation over every lag of the series."""
    got = ops.cross_correlation(_daily(s).withColumn("k", F.lit(0)), ["k"], "i", "a", "b")
    return got.select("lag", r4(c("r"), "r"), (c("r") == 1.0).alias("best"))


@query(
    "wavelet_power",
    _DAILY
    + """, f AS (SELECT regr_slope(a, i) AS sl, regr_intercept(a, i) AS a0, var_pop(a) - regr_slope(a, i) * covar_pop(i, a) AS v FROM d), y AS (SELECT i, (a - a0 - sl * i) / sqrt(v) AS y FROM d, f), sc AS (SELECT 2 * 2 ** (k / 4.0) AS scale FROM (SELECT unnest(range(0, 8)) AS k)),
       g AS (SELECT x.i, scale, sum(y.y * exp(-((y.i - x.i) / scale) * ((y.i - x.i) / scale) / 2) * cos(6 * (y.i - x.i) / scale)) AS re, sum(y.y * exp(-((y.i - x.i) / scale) * ((y.i - x.i) / scale) / 2) * sin(6 * (y.i - x.i) / scale)) AS im FROM y x, y y, sc WHERE abs(y.i - x.i) <= ceil(4 * scale) GROUP BY 1, 2)
       SELECT i, round(scale, 4) AS scale, round((re * re + im * im) / sqrt(pi()) / scale / scale, 4) AS power FROM g""",
    "psi_series",
)
def wavelet_power(s: DataFrame) -> DataFrame:
    got = ops.wavelet_power(_daily(s).withColumn("k", F.lit(0)), ["k"], "i", "a", 0.25, 8)
    return got.select("i", r4(c("scale"), "scale"), r4(c("power"), "power"))


@query("wavelet_power_full", None, "psi_series")
def wavelet_power_full(s: DataFrame) -> DataFrame:
    """wavelet_power at the reference's scales, seven octaves from 8 samples in twelfths, with the cone of influence."""
    got = ops.wavelet_power(_daily(s).withColumn("k", F.lit(0)), ["k"], "i", "a", 1 / 12, 85, 8.0)
    return got.select("i", *[r4(c(k), k) for k in ("scale", "power", "freq", "coi")])


@query(
    "well_correlation",
    """WITH w AS (SELECT grp, cx, cy FROM sites), n AS (SELECT grp, ps_id FROM w JOIN psi_points ON (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 4000000),
       d AS (SELECT grp, CAST(ts AS DATE) AS d, median(value) AS v FROM n JOIN psi_series USING (ps_id) WHERE direction = 'view' GROUP BY 1, 2), g AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS w FROM psi_series WHERE direction = 'click' GROUP BY 1),
       j AS (SELECT grp, v, w FROM d JOIN g USING (d)), k AS (SELECT grp, v, w, rank() OVER (PARTITION BY grp ORDER BY v) + (count(*) OVER (PARTITION BY grp, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY grp ORDER BY w) + (count(*) OVER (PARTITION BY grp, w) - 1) / 2.0 AS rw FROM j)
       SELECT grp, count(*) AS n, round(corr(v, w), 4) AS pearson, round(corr(rv, rw), 4) AS spearman FROM k GROUP BY grp HAVING count(*) > 5""",
    "sites",
    "psi_points",
    "psi_series",
)
def well_correlation(sites: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    return _well_correlation(sites, p, s)


@query("well_correlation_all", None, "sites", "psi_points", "psi_series")
def well_correlation_all(sites: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    """well_correlation, held against brute force instead of SQL."""
    return _well_correlation(sites, p, s)


def _well_correlation(sites: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    wells = sites.select("grp", "cx", "cy")
    day = F.to_date("ts").alias("d")
    view = s.where("direction = 'view'").select("ps_id", day, c("value").alias("v")).join(p.select("ps_id", "x", "y"), "ps_id")
    psi = radius_median(view, wells, "grp", "d", "v", 2000.0, 1000.0)
    level = s.where("direction = 'click'").groupBy(day).agg(F.avg("value").alias("w"))
    got = ops.spearman(psi.join(level, "d"), ["grp"], "v", "w").where("n > 5")
    return got.select("grp", "n", r4(c("pearson"), "pearson"), r4(c("spearman"), "spearman"))


@query(
    "gnss_correlation",
    """WITH a AS (SELECT ps_id, CAST(ts AS DATE) AS d, avg(value) AS v FROM psi_series WHERE direction = 'click' GROUP BY 1, 2), b AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS w FROM psi_series WHERE direction = 'view' GROUP BY 1),
       g AS (SELECT ps_id, count(*) AS n, corr(v, w) AS r, median(v) AS mv, 2 * stddev_pop(v) AS sv FROM a JOIN b USING (d) GROUP BY ps_id HAVING count(*) > 2),
       -- the tail of Student's t for whole degrees of freedom v: cos2 is 1 - r * r, sine is r; terms by gamma functions
       q AS (SELECT *, 1 - CASE WHEN n % 2 = 1 THEN 2 / pi() * (asin(abs(r)) + CASE WHEN n > 3 THEN abs(r) * sqrt(1 - r * r) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + ln(pi()) / 2 - ln(2)) * (1 - r * r) ** k)), 0) ELSE 0 END)
             ELSE abs(r) * coalesce(list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2) * (1 - r * r) ** k)), 0) END AS p FROM g)
       SELECT ps_id, n, round(r, 4) AS r, round(mv, 4) AS median, round(sv, 4) AS spread, CASE WHEN r IS NULL THEN NULL WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.01 THEN 'p<0.01' WHEN p < 0.05 THEN 'p<0.05' ELSE 'n.s.' END AS p FROM q""",
    "psi_series",
)
def gnss_correlation(s: DataFrame) -> DataFrame:
    from displace.operators.aggregates import correlation, mean_in_order, p_class, t_statistic

    day = F.to_date("ts").alias("d")
    # a median of means of four or eight values may be a tie in its fifth decimal: the last bit of the sum decides, so the order in which values are added does
    a = mean_in_order(s.where("direction = 'click'").select("ps_id", day, "ts", c("value").alias("v")), ["ps_id", "d"], ["ts", "v"], "v")
    b = s.where("direction = 'view'").groupBy(day).agg(F.avg("value").alias("w"))
    g = a.join(b, "d").groupBy("ps_id").agg(F.count("*").alias("n"), correlation("v", "w").alias("r"), F.median("v").alias("mv"), (2 * F.stddev_pop("v")).alias("sv")).where("n > 2")
    # rounded as the SQL does, the scaled number to a whole one: 38.94125 is a tie in decimals, but not once scaled
    half = lambda e, n: (F.round(e * 10000, 0) / 10000).alias(n)
    return g.select("ps_id", "n", half(c("r"), "r"), half(c("mv"), "median"), half(c("sv"), "spread"), p_class(t_statistic(c("r"), c("n")), c("n")).alias("p"))
