"""Whitening of vectors by Chebyshev-filtered subspace iteration.

Entries become whole numbers first, so that counts and sums are exact. A block of vectors Q, wider than the components asked for, goes through
rounds: a Chebyshev polynomial of the covariance V, applied by its three-term recurrence, damps the spectrum below the block's smallest Ritz
value; QR makes the block orthonormal; Rayleigh-Ritz within it gives eigenpairs and their residuals. Each product V Q is one pass over the table:
tasks sum Xc^T (Xc Q) over their rows, centred before multiplying, and only sums of the size of Q leave a task. Rounds end when the residuals
certify the pairs, at the level of rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from displace.session import materialize

#: Entries of x handled together in a task, and about how many lie in a stored row.
SLICE = 1 << 17
STORED = 1 << 11
#: Tasks' sums up to so many bytes together are added on the driver, more are added by Spark first.
GATHER = 64 << 20
ROUNDS = 200


def whole(vector: str | Column, scale: int = 1024, shift: int = 100000) -> Column:
    """x = floor(scale * c) + shift of every entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + shift)


def complete(vector: str | Column) -> Column:
    """True for vectors with entries that are all finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def _entries(column: pa.Array) -> np.ndarray:
    """A list column's entries side by side."""
    return column.flatten().to_numpy(zero_copy_only=False)


def _store(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, STORED // d)
    for batch in batches:
        x = _entries(batch.column(0)).reshape(-1, d)
        yield pa.RecordBatch.from_pydict({"data": pa.array([x[a : a + rows].tobytes() for a in range(0, len(x), rows)], pa.binary())})


def _slices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    rows = max(1, SLICE // d)
    for batch in batches:
        if batch.num_rows:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, d)
            for a in range(0, len(x), rows):
                yield x[a : a + rows]


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    n, total, top = 0, np.zeros(d, object), 0
    for x in _slices(batches, d):
        n, top = n + len(x), max(top, int(np.abs(x).max()))
        total += x.sum(0) if top < 1 << 44 else x.astype(object).sum(0)
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "top": pa.array([top], pa.int64()), "sums": pa.array([[str(int(s)) for s in total]], pa.list_(pa.string()))})


class Centre:
    """Count and exact sums of the fit list; n * x - S of rows, exact."""

    def __init__(self, n: int, sums: list[int], top: int):
        self.n, self.sums = n, sums
        self.small = 2 * n * max(top, 1) < 1 << 62
        self.row = np.array(sums, np.int64 if self.small else object)

    def away(self, x: np.ndarray) -> np.ndarray:
        return (x if self.small else x.astype(object)) * self.n - self.row

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.away(x).astype(np.float64) / self.n


def _product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return x.T @ (x @ q)


def _spread(x: np.ndarray) -> np.ndarray:
    return np.array([np.square(x).sum()])


def _moments(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    z = x @ to
    return np.concatenate([z.T @ z, z.sum(0)[None]])


def _partials(batches: Iterator[pa.RecordBatch], centre: Centre, part: Callable) -> Iterator[pa.RecordBatch]:
    total = None
    for x in _slices(batches, len(centre.sums)):
        own = part(centre(x))
        total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.ravel()], pa.list_(pa.float64()))})


def mean_over(stored: DataFrame, tasks: int, centre: Centre, part: Callable, shape: tuple) -> np.ndarray:
    """The sum over all rows of part(centred rows), over n. One array of the given shape leaves a task."""
    sums = stored.mapInArrow(partial(_partials, centre=centre, part=part), "v array<double>")
    size = int(np.prod(shape))
    if tasks * size * 8 <= GATHER:
        total = np.sum([r.v for r in sums.collect()], axis=0)
    else:
        cells = sums.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
        total = np.zeros(size)
        for r in cells:
            total[r.pos] = r.v
    return np.asarray(total).reshape(shape) / centre.n


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and unit eigenvectors of a symmetric operator without negative eigenvalues, given only its products with blocks."""
    b = min(d, block)
    q = np.eye(d) if b == d else np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))[0]
    best = np.inf
    for _ in range(ROUNDS):
        vq = times(q)
        h = q.T @ vq
        e, s = np.linalg.eigh((h + h.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        q, vq = q @ s, vq @ s
        off = np.linalg.norm(vq[:, :k] - q[:, :k] * e[:k], axis=0).max()
        top = max(e[0], 0.0)
        # rounding leaves residuals of this order; once below a looser bound, no halving in a round means that they are rounding
        if b == d or off <= 4 * np.finfo(float).eps * top or (off <= 1e-12 * top and off > best / 2):
            return np.maximum(e[:k], 0.0), q[:, :k]
        best = min(best, off)
        q = np.linalg.qr(_filtered(times, q, vq, max(e[-1], 0.0), top))[0]
    raise RuntimeError(f"eigenvectors are not certified after {ROUNDS} rounds")


def _filtered(times: Callable, q: np.ndarray, vq: np.ndarray, edge: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the operator, small on [0, edge] and one at top, applied to q; vq is the first product. The degree keeps the
    growth between edge and top at 1e8 or less."""
    x = 2 * top / edge - 1 if edge > 1e-8 * top else np.inf
    degree = int(np.clip(18 / np.arccosh(x), 1, 12)) if 1 < x < np.inf else 1
    if degree == 1:
        return vq
    half = edge / 2
    sigma = first = half / (top - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def whiten(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = 8, block: int | None = None) -> DataFrame:
    """(id, component, n, deviation, deviation_wide, whitened, explained, identity_error) per remaining row and component.

    Vectors that are null or hold null or non-finite entries, or no entries, are dropped; all others, repeated rows and rows with a null id included, are fit
    and returned. There are min(components, dimensions) components. A component without variance (fewer independent vectors than components; relative to the
    first below 1e-13) has a null whitened value, and explained is null where all vectors are equal. deviation is null where it passes a long; deviation_wide,
    its decimal text, never is. Vectors of unequal length, or entries of x beyond 2^52, are an error. Columns of any other name are ignored; an empty
    table, or one without remaining vectors, gives an empty result. Components of equal eigenvalues are some basis of their space.

    The driver holds blocks of dimensions x block numbers (block: four times the components), and no vectors.
    """
    rows = df.where(complete(F.col(vector))).select(F.col(id_col).alias("id"), whole(F.col(vector)).alias("x"))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, deviation_wide string, whitened double, explained double, identity_error double"
    shape = rows.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("d"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("top")).first()
    if shape.d is None:
        return df.sparkSession.createDataFrame([], schema)
    if shape.low != shape.d:
        raise ValueError(f"vectors of {shape.low} and of {shape.d} entries have no common covariance")
    if shape.top > 1 << 52:
        raise ValueError("entries are too large to be whole numbers")
    d = shape.d
    stored = materialize(rows.select("x").mapInArrow(partial(_store, d=d), "data binary"), "vectors")
    tasks = stored.rdd.getNumPartitions()
    parts = stored.mapInArrow(partial(_sums, d=d), "n bigint, top bigint, sums array<string>")
    cells = parts.select("n", "top", F.posexplode("sums")).groupBy("pos").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    centre = Centre(int(cells[0].n), [int(r.s) for r in cells], int(cells[0].top))
    trace = float(mean_over(stored, tasks, centre, _spread, (1,))[0])

    k = min(components, d)
    wide = block or 4 * components
    e, q = leading(lambda q: mean_over(stored, tasks, centre, partial(_product, q=q), q.shape), d, k, wide)
    real = e > 1e-13 * max(e[0], np.finfo(float).tiny)
    to = np.where(real, q / np.sqrt(np.where(real, e, 1.0)), 0.0)
    moments = mean_over(stored, tasks, centre, partial(_moments, to=to), (k + 1, k))
    away = np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k))[np.ix_(real, real)]
    error = float(away.max()) if away.size else 0.0
    share = [float(v / trace) if trace > 0 else None for v in e]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SLICE // d)
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(a, step)
                m = batch.num_rows
                x = _entries(batch.column(1)).reshape(m, d)
                exact = centre.away(x)
                if not centre.small or int(np.abs(exact).max()) ** 2 * d >= 1 << 63:
                    exact = exact.astype(object)
                deviation = (exact * exact).sum(1).tolist()
                z = centre(x) @ to
                each = np.repeat(np.arange(m), k)
                columns = [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n)),
                    pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()).take(pa.array(each)),
                    pa.array([str(v) for v in deviation]).take(pa.array(each)),
                    pa.array(z.ravel(), mask=~np.tile(real, m)),
                    pa.array(share * m, pa.float64()),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "deviation_wide", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
