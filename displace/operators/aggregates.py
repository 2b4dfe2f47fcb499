"""Aggregations: percentiles, bands, histograms, hotspots, label majorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from displace.session import materialize

c = F.col


def exact_percentiles(df: DataFrame, by: list[str], v: str, qs: tuple[float, ...], most: int = 1_000_000, bins: int = 4096, accuracy: int = 10_000) -> DataFrame:
    """(by, n, p): exact percentiles per group, linear between neighbours, as an array in the order of qs; no task holds a group's values. A sketch brackets
    the ranks, the values below and inside a bracket are counted, and brackets of more than `most` values are narrowed by counts in `bins` equal
    steps until they hold fewer or one value only; those alone are put in order. Missing values (null or not finite) are left out; a group
    without values has no row, but without `by` there is always one."""
    number = c(v).cast("double")
    own = df.select(*by, number.alias("_v")).where(c("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    near = [x for q in qs for x in (max(q - 2 / accuracy, 0.0), min(q + 2 / accuracy, 1.0))]
    sketch = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", near, accuracy).alias("_near"))
    first = materialize(sketch, "percentiles")

    def against(state: DataFrame, *columns: str) -> DataFrame:
        """Values with their group's row of the state; without groups that is one row."""
        return own.join(state.select(*by, *columns), by) if by else own.withColumns({k: state.select(k).scalar() for k in columns})

    # counts below and inside each bracket; where the sketch missed a rank, the group's whole range is the bracket
    below = [F.count_if(c("_v") < c("_near")[2 * j]).alias(f"_b{j}") for j in range(len(qs))]
    inside = [F.count_if(c("_v").between(c("_near")[2 * j], c("_near")[2 * j + 1])).alias(f"_i{j}") for j in range(len(qs))]
    counted = against(first, "_near").groupBy(*by).agg(*below, *inside)
    joined = first.join(counted, by) if by else first.crossJoin(counted)  # without groups one row each
    targets = []
    for j, q in enumerate(qs):
        for side, rank in enumerate((F.floor(q * (c("n") - 1)), F.ceil(q * (c("n") - 1)))):
            rank = rank.cast("long")
            held = (rank >= c(f"_b{j}")) & (rank < c(f"_b{j}") + c(f"_i{j}"))
            pick = lambda a, b, held=held: F.when(held, a).otherwise(b)
            lo, hi = pick(c("_near")[2 * j], c("_lo")), pick(c("_near")[2 * j + 1], c("_hi"))
            targets.append(F.struct(F.lit(j).alias("j"), F.lit(side).alias("side"), rank.alias("rank"), lo.alias("lo"), hi.alias("hi"), pick(c(f"_b{j}"), F.lit(0).cast("long")).alias("below"), pick(c(f"_i{j}"), c("n")).alias("inside")))
    state = materialize(joined.select(*by, "n", F.array(*targets).alias("_targets")), "percentiles")
    wide = lambda t: (t["inside"] > most) & (t["lo"] < t["hi"])
    holds = lambda t: c("_v").between(t["lo"], t["hi"])
    while not state.where(F.exists("_targets", wide)).isEmpty():
        seen = against(state, "_targets").select(*by, "_v", F.explode(F.filter("_targets", lambda t: wide(t) & holds(t))).alias("t"))
        step = F.least(F.floor((c("_v") / 2 - c("t.lo") / 2) / (c("t.hi") / 2 - c("t.lo") / 2) * bins), F.lit(bins - 1)).alias("_bin")
        counts = seen.groupBy(*by, "t", step).agg(F.count("*").alias("k"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = counts.withColumn("_below", c("t.below") + F.sum("k").over(Window.partitionBy(*by, "t").orderBy("_bin")) - c("k"))
        chosen = upto.where((c("_below") <= c("t.rank")) & (c("t.rank") < c("_below") + c("k")))
        now = F.struct("t.j", "t.side", "t.rank", "lo", "hi", c("_below").alias("below"), c("k").alias("inside"))
        new = chosen.groupBy(*by).agg(F.collect_list(now).alias("_new"))
        rest = F.filter("_targets", lambda t: ~wide(t))
        told = state.join(new, by, "left") if by else state.withColumn("_new", new.select("_new").scalar())
        state = materialize(told.select(*by, "n", F.when(c("_new").isNull(), rest).otherwise(F.concat(rest, "_new")).alias("_targets")), "percentiles")
    seen = against(state, "n", "_targets").select(*by, "n", "_v", F.explode(F.filter("_targets", holds)).alias("t"))
    values = seen.groupBy(*by, "n", "t", "_v").agg(F.count("*").alias("k"))
    upto = values.withColumn("_upto", c("t.below") + F.sum("k").over(Window.partitionBy(*by, "t").orderBy("_v")))
    at = upto.where(c("_upto") > c("t.rank")).groupBy(*by, "n", "t.j").agg(*[F.min(F.when(c("t.side") == k, c("_v"))).alias(f"_{k}") for k in (0, 1)])
    q = F.element_at(F.array(*map(F.lit, qs)), c("j") + 1) * (c("n") - 1)
    point = c("_0") + (q - F.floor(q)) * (c("_1") - c("_0"))
    found = at.groupBy(*by, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", point.alias("p")))), lambda x: x["p"]).alias("p"))
    return found if by else state.select("n", found.select("p").scalar().alias("p"))


def clip_percentile(df: DataFrame, columns: list[str], q: float, by: list[str] | None = None) -> DataFrame:
    """Values whose size is beyond the q-th percentile of sizes become null; limits per group, or overall. A group without values, or without
    a key, has no limit and keeps none."""
    by = by or []
    for k in columns:
        limit = exact_percentiles(df.select(*by, F.abs(c(k)).alias("_size")), by, "_size", (q,)).select(*by, c("p")[0].alias("_limit"))
        wide = df.join(limit, by, "left") if by else df.withColumn("_limit", limit.scalar())
        df = wide.withColumn(k, F.when(F.abs(c(k)) <= c("_limit"), c(k))).drop("_limit")
    return df


def quantile_band(df: DataFrame, by: list[str], v: str, qs: tuple[float, ...] = (0.05, 0.32, 0.5, 0.68, 0.95), exact: bool = True) -> DataFrame:
    """Percentiles per group with linear interpolation; beyond ten million values a group, exact=False keeps a sketch instead of all."""
    p = F.percentile(v, F.array(*map(F.lit, qs))) if exact else F.percentile_approx(v, list(qs), 10000)
    return df.groupBy(*by).agg(p.alias("_p")).select(*by, *[c("_p")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(qs)])


def mad(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Median and median absolute deviation."""
    med = df.groupBy(*by).agg(F.median(v).alias("med"))
    return df.join(med, by).groupBy(*by).agg(F.first("med").alias("median"), F.median(F.abs(c(v) - c("med"))).alias("mad"))


def histogram(df: DataFrame, by: list[str], v: Column, low: Column, high: Column, bins: int) -> DataFrame:
    """Counts per bin of [low, high); values outside are left out."""
    b = F.floor((v - low) / ((high - low) / bins)).cast("int")
    return df.select(*by, F.when((v >= low) & (v < high), F.least(b, F.lit(bins - 1))).alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def label_topk(df: DataFrame, key: str, columns: list[str], k: int = 3) -> DataFrame:
    """The k most frequent labels over several columns; ties: the larger label first."""
    long = df.select(key, F.explode(F.array(*columns)).alias("label")).where("label is not null").groupBy(key, "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.desc("label"))
    return long.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def label_collapse(df: DataFrame, key: str, lists: list[str], flags: list[str], comments: list[str]) -> DataFrame:
    """Per key: sorted distinct labels, flags as 1 if any is set, comments joined by ' und '; '(empty)' where there is nothing."""
    said = lambda k, sep: F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(k)), sep), F.lit("")), F.lit("(empty)")).alias(k)
    return df.groupBy(key).agg(*[said(k, ", ") for k in lists], *[F.coalesce(F.bool_or(k), F.lit(False)).cast("int").alias(k) for k in flags], *[said(k, " und ") for k in comments])


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def gma_grid(points: DataFrame, params: DataFrame, fine: float = 50.0) -> DataFrame:
    """Ground-motion hotspots for each parameter row (cellsize, min_mean, max_var): points that move enough, one per 50 m cell
    (of several the one with the largest id), sums of abs(velocity) and counts per block, score log10(count * sum).

    params is a small table of settings; points are read once for all of them."""
    moved = points.join(F.broadcast(params), (F.abs("mean_vel") >= c("min_mean")) & (c("var_mean_vel") * c("var_mean_vel") < c("max_var")))
    keys = ["cellsize", "min_mean", "max_var"]
    cells = moved.groupBy(*keys, cell(c("x"), fine).alias("i"), cell(c("y"), fine).alias("j")).agg(F.max_by("mean_vel", "ps_id").alias("v"))
    blocks = cells.groupBy(*keys, F.floor(c("i") * fine / c("cellsize")).alias("bi"), F.floor(c("j") * fine / c("cellsize")).alias("bj")).agg(F.sum(F.abs("v")).alias("total"), F.count("*").alias("n"))
    return blocks.withColumn("score", F.log10(F.when(c("n") * c("total") > 0, c("n") * c("total"))))


def hexbin(df: DataFrame, x: str, y: str, size: float, least: int, value: str | None = None) -> DataFrame:
    """Counts per hexagon of width `size` (centres kept) with at least `least` members: the nearer of two rectangular lattices."""
    tall = size * 3**0.5
    ax, ay = F.floor(c(x) / size + 0.5) * size, F.floor(c(y) / tall + 0.5) * tall
    bx, by = (F.floor(c(x) / size) + 0.5) * size, (F.floor(c(y) / tall) + 0.5) * tall
    da = (c(x) - ax) * (c(x) - ax) + (c(y) - ay) * (c(y) - ay)
    db = (c(x) - bx) * (c(x) - bx) + (c(y) - by) * (c(y) - by)
    own = df.select(F.when(da <= db, ax).otherwise(bx).alias("cx"), F.when(da <= db, ay).otherwise(by).alias("cy"), *([c(value).alias("v")] if value else []))
    return own.groupBy("cx", "cy").agg(F.count("*").alias("n"), *([F.avg("v").alias("v")] if value else [])).where(c("n") >= least)


def mean_in_order(df: DataFrame, by: list[str], order: list[str], v: str) -> DataFrame:
    """(by, v): means per group, added up in the given order, so that their last bits do not depend on how rows lie in files and tasks. A group's rows are sorted
    in one task and spilled if many."""
    w = Window.partitionBy(*by).orderBy(*order)
    own = df.withColumns({"_v": F.avg(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_k": F.row_number().over(w)})
    return own.where("_k = 1").select(*by, c("_v").alias(v))


def correlation(a: str, b: str) -> Column:
    """Pearson's r over the rows that have both; NaN where one of them does not vary, null without such rows."""
    both = c(a).isNotNull() & c(b).isNotNull()
    spread = F.stddev_pop(F.when(both, c(a))) * F.stddev_pop(F.when(both, c(b)))
    return F.when(F.count_if(both) > 0, F.coalesce(F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)), F.lit(float("nan"))))


def t_statistic(r: Column, n: Column) -> Column:
    """Infinite where r is 1 or -1, also by rounding."""
    return F.when(~F.isnan(r) & (F.abs(r) >= 1), r * F.lit(float("inf"))).otherwise(r * F.sqrt((n - 2) / (1 - r * r)))


#: Levels of significance.
LEVELS = [(0.001, "p<0.001"), (0.01, "p<0.01"), (0.05, "p<0.05")]


def p_value(t: Column, n: Column) -> Column:
    """Two-sided p of Student's t with n - 2 degrees of freedom, by the finite series for whole degrees; null for n below 3."""
    v = (n - 2).cast("double")
    cos2, sine = v / (v + t * t), F.when(F.abs(t) == float("inf"), 1.0).otherwise(F.abs(t) / F.sqrt(v + t * t))
    odd = v % 2 == 1
    last = F.greatest(F.floor((v - F.when(odd, 3).otherwise(2)) / 2), F.lit(0)).cast("int")
    # the terms after the first: each is the one before times cos2 times a ratio
    ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    terms = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(terms, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda a, k: F.struct((a["term"] * cos2 * ratio(k)).alias("term"), (a["sum"] + a["term"] * cos2 * ratio(k)).alias("sum")), lambda a: a["sum"])
    within = F.when(odd, 2 / F.pi() * (F.asin(F.least(sine, F.lit(1.0))) + F.when(v > 1, sine * F.sqrt(cos2) * series).otherwise(0.0))).otherwise(sine * series)
    return F.when(n > 2, 1 - within)


def p_class(t: Column, n: Column) -> Column:
    """The level that the p value of t stays below, n.s. for none."""
    out, p = F.when(t.isNull() | (n < 3), None), p_value(t, n)
    for limit, name in LEVELS:
        out = out.when(p < limit, name)
    return out.otherwise("n.s.")


def fit_error(df: DataFrame, by: list[str], residual: str) -> DataFrame:
    """Twice the standard deviation of the residuals within one standard deviation of their median."""
    first = df.groupBy(*by).agg(F.median(residual).alias("_m"), F.stddev_pop(residual).alias("_s"))
    near = df.join(first, by).where(F.abs(c(residual) - c("_m")) <= c("_s"))
    return near.groupBy(*by).agg((2 * F.stddev_pop(residual)).alias("error"))
