"""Time-series models: the sums of the normal equations are mergeable aggregates (one shuffle of one row per group and task), a
small solve per group follows. Times are float years, shifted by each group's middle so that the sums stay well conditioned."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def years(t: Column) -> Column:
    """Exact float years since 2015-01-01, of 365.25 days."""
    return F.timestamp_diff("MICROSECOND", F.lit("2015-01-01").cast("timestamp_ntz"), t).cast("double") / (365.25 * 86400e6)


def linear_fit(df: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """Slope and intercept per group, and the variance of the residuals: var(v) - slope * cov(t, v), in one pass."""
    g = df.groupBy(*by).agg(F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("intercept"), F.var_pop(v).alias("_vv"), F.covar_pop(t, v).alias("_tv"), F.count(v).alias("n"))
    return g.select(*by, "n", "slope", "intercept", F.greatest(c("_vv") - F.coalesce("slope", F.lit(0.0)) * c("_tv"), F.lit(0.0)).alias("residual_var"))


def terms(t: Column, degree: int = 1, periods: tuple[float, ...] = (1.0, 0.5), steps: tuple[float, ...] = (), quakes: tuple[float, ...] = (), relaxation: float = 1.0) -> list[tuple[str, Column]]:
    """Named design terms of a time column: offset, trend powers, a sine and cosine for each period, unit steps, and after quakes a step and a
    logarithm. One column each; every event has its own."""
    out: list[tuple[str, Column]] = [("offset", F.lit(1.0))]
    out += [(f"trend{k}", F.pow(t, F.lit(float(k)))) for k in range(1, degree + 1)]
    for p in periods:
        out += [(f"sin_{p:g}", F.sin(2 * math.pi / p * t)), (f"cos_{p:g}", F.cos(2 * math.pi / p * t))]
    out += [(f"step_{s:g}", F.when(t >= s, 1.0).otherwise(0.0)) for s in steps]
    for q in quakes:
        out += [(f"quake_{q:g}", F.when(t >= q, 1.0).otherwise(0.0)), (f"post_{q:g}", F.when(t >= q, F.log(1 + (t - q) / relaxation)).otherwise(0.0))]
    return out


def normal_sums(df: DataFrame, by: list[str], design: list[tuple[str, Column]], v: str, weight: Column | None = None) -> DataFrame:
    """Per group the lower triangle of G'WG and G'Wd as one array, and n."""
    w = weight if weight is not None else F.lit(1.0)
    p = len(design)
    named = df.select(*by, c(v).cast("double").alias("_d"), w.alias("_w"), *[e.alias(f"_g{i}") for i, (_, e) in enumerate(design)]).where(c("_d").isNotNull())
    sums = [F.sum(c("_w") * c(f"_g{i}") * c(f"_g{j}")).alias(f"_s{i}_{j}") for i in range(p) for j in range(i + 1)]
    sums += [F.sum(c("_w") * c(f"_g{i}") * c("_d")).alias(f"_r{i}") for i in range(p)]
    g = named.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    return g.select(*by, "n", F.array(*[c(f"_s{i}_{j}") for i in range(p) for j in range(i + 1)], *[c(f"_r{i}") for i in range(p)]).alias("sums"))


def merge_sums(sums: DataFrame, by: list[str], p: int) -> DataFrame:
    """Sums of several groups as those of one: they are additive, so a series that belongs to many groups is read once."""
    k = p * (p + 1) // 2 + p
    g = sums.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c("sums")[i]).alias(f"_s{i}") for i in range(k)])
    return g.select(*by, "n", F.array(*[c(f"_s{i}") for i in range(k)]).alias("sums"))


def solve(sums: DataFrame, by: list[str], p: int) -> DataFrame:
    """(by, n, coeffs, full_rank): least squares from the sums; of minimum norm, and flagged, where they are singular."""
    low = np.tril_indices(p)

    def run(batches):
        for pdf in batches:
            s = np.array([*pdf["sums"]], float).reshape(len(pdf), -1)
            m = np.zeros((len(s), p, p))
            m[:, low[0], low[1]] = m[:, low[1], low[0]] = s[:, : len(low[0])]
            scale = np.sqrt(np.maximum(np.diagonal(m, axis1=1, axis2=2), 1e-300))
            m, r = m / (scale[:, :, None] * scale[:, None, :]), s[:, len(low[0]) :] / scale
            full = np.linalg.matrix_rank(m, tol=1e-10) == p if len(s) else np.zeros(0, bool)
            x = np.zeros((len(s), p))
            x[full] = np.linalg.solve(m[full], r[full][:, :, None])[:, :, 0]
            for i in np.flatnonzero(~full):
                x[i] = np.linalg.lstsq(m[i], r[i], rcond=1e-10)[0]
            coeffs = [*(x / scale)]
            yield pd.DataFrame({**{k: pdf[k] for k in by}, "n": pdf["n"], "coeffs": coeffs, "full_rank": full})

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in by], "n bigint, coeffs array<double>, full_rank boolean"]))


def invert(df: DataFrame, by: list[str], t: str, v: str, weight: Column | None = None, **model) -> DataFrame:
    """Least-squares fit per group; t holds float years (see years)."""
    design = terms(c(t), **model)
    return solve(normal_sums(df, by, design, v, weight), by, len(design))


def forward(df: DataFrame, fits: DataFrame, by: list[str], t: str, v: str, **model) -> DataFrame:
    """df with the fitted value dhat and residual dres of its group's fit."""
    design = F.array(*[e for _, e in terms(c(t), **model)])
    dhat = F.aggregate(F.zip_with(design, c("coeffs"), lambda g, m: g * m), F.lit(0.0), lambda a, b: a + b)
    return df.join(fits.select(*by, "coeffs"), by).withColumn("dhat", dhat).withColumn("dres", c(v) - c("dhat")).drop("coeffs")


def trim_residuals(df: DataFrame, by: list[str], residual: str = "dres", low: float = 0.05, high: float = 0.95, stds: float | None = None) -> DataFrame:
    """Rows whose residual lies in the group's percentile window, or within so many standard deviations."""
    if stds is not None:
        lim = df.groupBy(*by).agg(F.avg(residual).alias("_m"), F.stddev_pop(residual).alias("_s"))
        return df.join(lim, by).where(F.abs(c(residual) - c("_m")) <= stds * c("_s")).drop("_m", "_s")
    lim = df.groupBy(*by).agg(F.percentile(residual, F.array(F.lit(low), F.lit(high))).alias("_q"))
    return df.join(lim, by).where(c(residual).between(c("_q")[0], c("_q")[1])).drop("_q")


def robust_invert(df: DataFrame, by: list[str], t: str, v: str, **model) -> DataFrame:
    """Fit, drop the residuals outside 5 to 95 percent, fit again: (by, n, coeffs, full_rank, n_first)."""
    own = df.select(*by, t, v)
    first = invert(own, by, t, v, **model)
    kept = trim_residuals(forward(own, first, by, t, v, **model), by).select(*by, t, v)
    return invert(kept, by, t, v, **model).join(first.select(*by, c("n").alias("n_first")), by)


def named(fits: DataFrame, by: list[str], t: Column | None = None, **model) -> DataFrame:
    """(by, term, value): coefficients with their names."""
    names = [n for n, _ in terms(F.lit(0.0), **model)]
    rows = fits.select(*by, F.posexplode("coeffs").alias("_i", "value"))
    return rows.select(*by, F.element_at(F.array(*map(F.lit, names)), c("_i") + 1).alias("term"), "value")


def keyed(by: Sequence[str], key: tuple, n: int) -> dict[str, pd.Series]:
    """A group's key as columns of n rows, as Python objects: any type, nulls too."""
    return {k: pd.Series([x] * n, dtype=object) for k, x in zip(by, key, strict=False)}


def cross_correlation(df: DataFrame, by: list[str], i: str, a: str, b: str, most: int | None = None, shown: int | None = None) -> DataFrame:
    """(by, lag, r): sums of a[i] * b[i - lag] over deviations from the means, over the largest of them, by Fourier transforms of a group's
    series. Every lag between two rows of a group is looked at, or only |lag| <= most; `shown` leaves out further lags after they have been
    divided. A missing value (null or not finite) takes part in no product, a lag without products has no r; rows of one step are added up
    before they meet in a task; rows without a step are left out."""
    step = c(i).cast("long").alias("_i")
    ok = {k: F.when(~F.isnan(c(k).cast("double")) & (F.abs(c(k).cast("double")) < math.inf), c(k).cast("double")) for k in (a, b)}
    own = df.where(c(i).isNotNull()).groupBy(*by, step).agg(F.count("*").alias("_n"), *[f(ok[k]).alias(n) for k, n in ((a, "a"), (b, "b")) for f, n in ((F.sum, f"_s{n}"), (F.count, f"_n{n}"))])

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(batches))
        at, n, na, nb = (g[k].to_numpy(np.int64) for k in ("_i", "_n", "_na", "_nb"))
        sa, sb = (np.nan_to_num(g[k].to_numpy(float)) for k in ("_sa", "_sb"))
        sa, sb = sa - na * (sa.sum() / max(na.sum(), 1)), sb - nb * (sb.sum() / max(nb.sum(), 1))
        lag, sums = correlate(at, [(n, n), (na, nb), (sa, sb)], most)
        some = sums[0] > 0.5
        lag, met, r = lag[some], sums[1][some] > 0.5, sums[2][some]
        top = r[met].max() if met.any() else 0.0
        r = pd.array(np.where(met & (top != 0), r / (top or 1.0), 0.0), "Float64")
        r[~met | (top == 0)] = pd.NA
        out = pd.DataFrame({"lag": lag.astype(np.int32), "r": r})
        out = out if shown is None else out[out["lag"].abs() <= shown]
        yield pd.DataFrame({**keyed(by, key, len(out)), "lag": out["lag"].to_numpy(), "r": out["r"].array})

    kinds = dict(df.dtypes)
    return own.groupBy(*by).applyInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "lag int, r double"]))


def correlate(at: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], most: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lags in rising order and, for each pair (x, y) over the distinct steps `at`, the sums of x[i] * y[i - lag]: n log n of the span by Fourier
    transforms, or of the pairs themselves where the span is so sparse that they are fewer."""
    at = at - at.min()
    span = int(at.max()) + 1
    size = 1 << (2 * span - 1).bit_length()
    if len(at) ** 2 < size:
        lag, slot = np.unique(np.subtract.outer(at, at), return_inverse=True)
        sums = [np.bincount(slot.ravel(), np.multiply.outer(x, y).ravel().astype(float)) for x, y in pairs]
    else:
        lag = np.arange(1 - span, span)
        dense = lambda x: np.fft.rfft(np.bincount(at, x, span), size)
        sums = [np.fft.irfft(dense(x) * np.conj(dense(y)), size)[lag] for x, y in pairs]
    near = slice(None) if most is None else np.abs(lag) <= most
    return lag[near], [x[near] for x in sums]


def wavelet_power(df: DataFrame, by: list[str], i: str, v: str, dj: float, scales: int, first: float = 2.0, omega: float = 6.0) -> DataFrame:
    """(by, i, scale, power, freq, coi): Morlet power over the scale of a detrended, normalised series on whole steps; a scale's wavelet is cut at
    four times the scale. One series is convolved at a time, scale by scale, by Fourier transforms. freq is the scale's frequency; coi the
    frequency below which a sample is nearer to an end of its series than the wavelet's e-folding time, at most the largest freq. A step's rows
    are averaged before they meet in a task; missing values (null or not finite) add nothing, and power is null where a window holds no value
    or the series has no residual; rows without a step are left out."""
    value = c(v).cast("double")
    own = df.where(c(i).isNotNull()).groupBy(*by, c(i).cast("long").alias("_i")).agg(F.avg(F.when(~F.isnan(value) & (F.abs(value) < math.inf), value)).alias("_v"))
    values = [first * 2 ** (dj * k) for k in range(scales)]
    period = 4 * math.pi / (omega + math.sqrt(2 + omega * omega))

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(batches)).sort_values("_i")
        at, y, ok = g["_i"].to_numpy(np.int64), *flatten(g["_i"].to_numpy(float), g["_v"].to_numpy(float))
        coi = np.minimum(math.sqrt(2) / (period * (np.minimum(at - at[0], at[-1] - at) + 0.5)), 1 / (period * first))
        for scale in values:
            power, some = morlet(at, y, ok, scale, omega)
            power = pd.array(power, "Float64")
            power[~some] = pd.NA
            yield pd.DataFrame({**keyed(by, key, len(at)), "i": at, "scale": scale, "power": power, "freq": 1 / (period * scale), "coi": coi})

    kinds = dict(df.dtypes)
    return own.groupBy(*by).applyInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "i bigint, scale double, power double, freq double, coi double"]))


def flatten(t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of a straight line over their standard deviation (0 where there is none), and where there is one."""
    ok = np.isfinite(v)
    out = np.zeros(len(v))
    if ok.sum() > 1:
        x, d = t[ok] - t[ok].mean(), v[ok] - v[ok].mean()
        d = d - x * ((x @ d) / (x @ x))
        if (sd := d.std()) > 1e-12 * np.abs(v[ok]).max():
            out[ok] = d / sd
            return out, ok
    return out, np.zeros(len(v), bool)


def morlet(at: np.ndarray, y: np.ndarray, ok: np.ndarray, scale: float, omega: float) -> tuple[np.ndarray, np.ndarray]:
    """Power over the scale at the rising steps `at`, and whether their windows hold a value. Stretches further apart than the window do not
    meet and are convolved one by one, so a gap costs nothing."""
    width = math.ceil(4 * scale)
    power, some = np.zeros(len(at)), np.zeros(len(at), bool)
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > width) + 1):
        step = at[part] - at[part[0]]
        span = int(step[-1]) + 1
        half = min(width, span - 1)
        x = np.arange(-half, half + 1) / scale
        size = 1 << (span + 2 * half - 1).bit_length()
        dense, wave = np.bincount(step, y[part], span), np.exp(-x * x / 2 - 1j * omega * x)
        met = np.fft.ifft(np.fft.fft(dense, size) * np.fft.fft(wave, size))[step + half]
        power[part] = np.abs(met) ** 2 / math.sqrt(math.pi) / scale**2
        seen = np.concatenate([[0], np.cumsum(np.bincount(step[ok[part]], minlength=span))])
        some[part] = seen[np.minimum(step + half + 1, span)] > seen[np.maximum(step - half, 0)]
    return power, some


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson and rank correlation per group; ties share their mean rank."""

    def rank(k: str) -> Column:
        w = Window.partitionBy(*by)
        return F.rank().over(w.orderBy(k)) + (F.count("*").over(Window.partitionBy(*by, k)) - 1) / 2.0

    ranked = df.where(reduce(lambda x, y: x & y, [c(k).isNotNull() for k in (a, b)])).withColumns({"_ra": rank(a), "_rb": rank(b)})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


def median_filter(df: DataFrame, by: list[str], order: list[str], v: str, width: int) -> DataFrame:
    """df with `smooth`: the median of `width` (odd) neighbours in a group's order; beyond its ends a series goes on as its mirror image, the end's
    value repeated, as often as a short series needs. Missing values take no part."""
    if width < 1 or width % 2 == 0:
        raise ValueError("width must be odd")
    half, each = width // 2, Window.partitionBy(*by)
    own = df.withColumns({"_p": F.row_number().over(each.orderBy(*order)).cast("long"), "_n": F.count("*").over(each)})
    turns = (F.ceil(half / (2 * c("_n"))) + 1).cast("long")
    images = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(c("_p") + 2 * k * c("_n"), 1 - c("_p") + 2 * k * c("_n"))))
    wide = own.withColumn("_q", F.explode(F.filter(images, lambda q: (q > -half) & (q <= c("_n") + half))))
    smooth = F.percentile(v, F.lit(0.5)).over(each.orderBy("_q").rowsBetween(-half, half))
    return wide.withColumn("smooth", smooth).where(c("_q") == c("_p")).drop("_p", "_q", "_n")


def spline_slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes at rising knots (four or more) of the cubic spline through them whose third derivative passes the second and the last but one
    knot without a jump: one tridiagonal system, solved by elimination."""
    h = np.diff(t)
    d = np.diff(y) / h
    first, last = t[2] - t[0], t[-1] - t[-3]
    low, mid, up, right = (np.zeros(len(t)) for _ in range(4))
    low[1:-1], mid[1:-1], up[1:-1], right[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1], 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    mid[0], up[0], right[0] = h[1], first, ((h[0] + 2 * first) * h[1] * d[0] + h[0] ** 2 * d[1]) / first
    low[-1], mid[-1], right[-1] = last, h[-2], (h[-1] ** 2 * d[-2] + (2 * last + h[-1]) * h[-2] * d[-1]) / last
    for k in range(1, len(t)):
        w = low[k] / mid[k - 1]
        mid[k] -= w * up[k - 1]
        right[k] -= w * right[k - 1]
    out = np.empty(len(t))
    out[-1] = right[-1] / mid[-1]
    for k in range(len(t) - 2, -1, -1):
        out[k] = (right[k] - up[k] * out[k + 1]) / mid[k]
    return out


def spline(t: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Values at q of the cubic spline through rising (t, y); of the polynomial through them where they are fewer than four."""
    if len(t) < 4:
        parts = [y[k] * np.prod([(q - t[j]) / (t[k] - t[j]) for j in range(len(t)) if j != k], axis=0) for k in range(len(t))]
        return np.sum(np.broadcast_arrays(np.zeros(len(q)), *parts), axis=0) if parts else np.full(len(q), np.nan)
    s = spline_slopes(t, y)
    k = np.clip(np.searchsorted(t, q, "right") - 1, 0, len(t) - 2)
    h, u = t[k + 1] - t[k], q - t[k]
    d = (y[k + 1] - y[k]) / h
    return y[k] + u * (s[k] + u * ((3 * d - 2 * s[k] - s[k + 1]) / h + u * (s[k] + s[k + 1] - 2 * d) / h**2))


def spline_at(df: DataFrame, at: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """(by, t, v): the cubic spline through each group's values, at the group's times in `at` (by, t), a row for each of them. Values of one time are averaged
    before they meet in a task; missing ones (null or not finite) are left out; null where a group has no value or a time is null. A task holds
    one series."""
    ok = [c(k).isNotNull() & ~F.isnan(c(k).cast("double")) & (F.abs(c(k).cast("double")) < math.inf) for k in (t, v)]
    knots = df.where(ok[0] & ok[1]).groupBy(*by, c(t).cast("double").alias("_t")).agg(F.avg(c(v).cast("double")).alias("_v"))
    asked = at.select(*[c(k).alias(k) for k in by], c(t).cast("double").alias("_q"))
    kinds = dict(at.dtypes)

    def run(key: tuple, own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_t")
        got = spline(own["_t"].to_numpy(float), own["_v"].to_numpy(float), queries["_q"].to_numpy(float))
        return pd.DataFrame({**keyed(by, key, len(got)), t: queries["_q"].to_numpy(), v: got})

    return knots.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in by], f"`{t}` double, `{v}` double"]))
