"""Hashed word features and sparse logistic models in numpy, shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from displace.llm.textbytes import Rolling, spare_name, text_buffer, word_segments, words
from displace.session import materialize

BITS = 20
SIZE = 1 << BITS


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For every segment its first text and (owner text, feature) of every word and of its first (or, below zero, last) few bytes."""
    for i, j, begin, end in word_segments(data, offsets):
        inner = np.clip(offsets[i : j + 1], begin, end) - begin
        low, starts, ends, owner = words(data[begin:end], inner)
        roll, owner = Rolling(low, 0), owner + i
        found = [(owner, bucket(roll.at(starts, ends)))]
        for n in prefixes:
            part = roll.at(starts, np.minimum(ends, starts + n)) if n > 0 else roll.at(np.maximum(starts, ends + n), ends)
            found.append((owner, bucket(part ^ np.uint64((n << 61) & (2**64 - 1)))))
        yield i, found


def distinct_pieces(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text, wanted feature) pairs in order, a segment of whole texts or one long text at a time: wanted gives each feature's number, or
    -1. So memory follows a segment, or the distinct features of one text, not the batch."""
    text, held = -1, np.zeros(0, np.int64)
    for first, found in word_features(data, offsets, prefixes):
        keys = [np.unique(owner[n >= 0] * SIZE + n[n >= 0]) for owner, n in ((owner, wanted[f]) for owner, f in found)]
        own = np.unique(np.concatenate(keys))
        if first == text:  # a long text goes on
            held = np.union1d(held, own)
            continue
        yield held // SIZE, held % SIZE
        text, held = first, own
    yield held // SIZE, held % SIZE


def distinct_hits(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all pieces."""
    owner, f = zip(*distinct_pieces(data, offsets, prefixes, wanted), strict=True)
    return np.concatenate(owner), np.concatenate(f)


def label_sample(labels: DataFrame, label: str, id_col: str, most: int, folds: int, held: int) -> DataFrame:
    """(id, label) of at most `most` rows, the first by a hash of the id, of those whose crc32(id) is not `held` modulo `folds`."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held)
    return rows.groupBy(id_col).agg(F.max(label).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(most)


def bounded_rows(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, most: int, folds: int, held: int, *more: Column) -> DataFrame:
    """(k, text, label, *more), k a hash of the id: at most `most` labelled rows, one for each id (of repeated ids the row with the smallest text)."""
    sample = label_sample(labels, label, id_col, most, folds, held)
    own = docs.select(F.col(id_col).alias("id"), F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), *more).alias("row"))
    rows = own.join(F.broadcast(sample.withColumnRenamed(id_col, "id")), "id")  # `most` rows at most
    rows = rows.groupBy("id").agg(F.min("row").alias("row"), F.max("label").alias("label"))
    return materialize(rows.select(F.xxhash64("id").alias("k"), "row.*", F.col("label").cast("int").alias("label")), "labelled")


PIECE = np.dtype([("f", "<u4"), ("n", "<u4", 2)])
RANGES = 8


def chosen_features(rows: DataFrame, prefixes: tuple[int, ...], n: int, marking: bool = False, least: int = 3) -> np.ndarray:
    """The n features that tell the labels apart best, by their G statistic (ties: the smaller feature), of a bounded sample (text, label 0 or 1). Only
    features in `least` texts whose statistic chance would hardly reach once among all candidates; with `marking` only those that lean to label 1.
    Counts are added in ranges of features; the driver gets the chosen ones alone."""
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    totals = (sizes.get(0, 0), sizes.get(1, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SIZE, 2), np.uint32)
        every = np.arange(SIZE)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            label = batch.column(1).to_numpy().astype(np.int64)
            for owner, f in distinct_pieces(data, offsets, prefixes, every):
                for y in (0, 1):
                    total[:, y] += np.bincount(f[label[owner] == y], minlength=SIZE).astype(np.uint32)
        f = np.flatnonzero(total.any(1))
        own = np.zeros(len(f), PIECE)
        own["f"], own["n"] = f, total[f]
        cuts = np.searchsorted(f, np.arange(RANGES + 1) * (SIZE // RANGES))
        yield pa.RecordBatch.from_pydict({"s": pa.array(range(RANGES), pa.int32()), "data": pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros((SIZE, 2), np.uint32)
        for d in t["data"]:
            own = np.frombuffer(d.as_buffer(), PIECE)
            total[own["f"]] += own["n"]
        f = np.flatnonzero(total.sum(1) >= least)
        own = np.zeros(len(f), PIECE)
        own["f"], own["n"] = f, total[f]
        return pa.table({"data": pa.array([own.tobytes()], pa.binary())})

    def pick(t: pa.Table) -> bytes:
        own = np.concatenate([np.frombuffer(d.as_buffer(), PIECE) for d in t["data"]])
        return choose(own["f"], own["n"], totals, n, marking).astype("<i4").tobytes()

    tasks = rows.select(F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label")).mapInArrow(count, "s int, data binary")
    got = in_one_task(tasks.groupBy("s").applyInArrow(add, "data binary"), pick)  # one row per range
    return np.frombuffer(got or b"", "<i4").astype(np.int64)


def choose(f: np.ndarray, counts: np.ndarray, sizes: tuple[int, int], n: int, marking: bool = False) -> np.ndarray:
    """Of the features f, in how many texts with label 0 and 1 they occur (counts), the n with the largest G statistic, in order."""
    n0, n1 = counts[:, 0].astype(float), counts[:, 1].astype(float)
    t0, t1 = max(float(sizes[0]), 1.0), max(float(sizes[1]), 1.0)
    p, q0, q1 = (n0 + n1 + 1) / (t0 + t1 + 2), (n0 + 0.5) / (t0 + 1), (n1 + 0.5) / (t1 + 1)
    p, q0, q1 = (np.clip(v, 1e-9, 1 - 1e-9) for v in (p, q0, q1))
    g = n0 * np.log(q0 / p) + n1 * np.log(q1 / p) + (t0 - n0) * np.log((1 - q0) / (1 - p)) + (t1 - n1) * np.log((1 - q1) / (1 - p))
    ok = g >= np.log(max(len(f), 1)) + 1
    if marking:
        ok &= n1 >= n0
    f, g = f[ok], g[ok]
    return np.sort(f[np.lexsort((f, -g))[:n]].astype(np.int64))


class Sparse:
    """Rows of binary features, by row and by feature: what matrix products need."""

    def __init__(self, rows: list[np.ndarray], n_features: int):
        self.n, self.m = len(rows), n_features
        size = np.array([len(r) for r in rows], np.int64)
        self.col = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.starts, self.filled = _starts(size)
        row = np.repeat(np.arange(self.n, dtype=np.int32), size)
        order = np.argsort(self.col, kind="stable")
        self.row_by_col = row[order]
        self.col_starts, self.col_filled = _starts(np.bincount(self.col, minlength=n_features))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(w[self.col], self.starts)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.m)
        if len(self.col_filled):
            out[self.col_filled] = np.add.reduceat(r[self.row_by_col], self.col_starts)
        return out


def _starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches that are not empty start, and which they are."""
    filled = np.flatnonzero(size)
    return (np.cumsum(size) - size)[filled], filled


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 200, tolerance: float = 1e-5, start: tuple[np.ndarray, float] | None = None, pairs: tuple[Sparse, Sparse] | None = None, keep_equal: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by limited-memory quasi-Newton steps on all rows, until no gradient exceeds `tolerance`. start: where to begin. pairs: rows
    and their counterfactuals, whose mean squared score difference is penalised `keep_equal` times."""
    weight = np.ones(x.n) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-9)
    equal = pairs is not None and pairs[0].n > 0 and keep_equal > 0

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = p[:-1], p[-1]
        z = x.times(w) + b
        r = (logistic(z) - y) * weight
        value = float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w @ w))
        g = np.append(x.back(r) + ridge * w, r.sum())
        if equal:
            d = pairs[0].times(w) - pairs[1].times(w)
            value += keep_equal * float(d @ d) / pairs[0].n
            d *= 2 * keep_equal / pairs[0].n
            g[:-1] += pairs[0].back(d) - pairs[1].back(d)
        return value, g

    p = np.zeros(x.m + 1) if start is None else np.append(start[0], start[1])
    value, g = loss(p)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(g).max() <= tolerance:
            break
        q, tried = g.copy(), []
        for s, t, c in reversed(history):
            tried.append(c * (s @ q))
            q -= tried[-1] * t
        q *= history[-1][0] @ history[-1][1] / (history[-1][1] @ history[-1][1]) if history else 1 / max(np.abs(g).sum(), 1e-12)
        for (s, t, c), a in zip(history, reversed(tried), strict=True):
            q += s * (a - c * (t @ q))
        slope, size = float(g @ q), 1.0
        if slope <= 0:  # not a descent: forget the curvature
            q, slope, history = g, float(g @ g), []
        while True:
            to = p - size * q
            new, g_new = loss(to)
            if new <= value - 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, t = to - p, g_new - g
        if s @ t > 1e-12:
            history = [*history, (s, t, 1 / (s @ t))][-10:]
        done = value - new <= 1e-9 * max(abs(value), 1e-12)
        p, value, g = to, new, g_new
        if done:
            break
    return p[:-1], float(p[-1])


def numbering(chosen: np.ndarray) -> np.ndarray:
    """Each feature's place among the chosen ones, or -1."""
    numbers = np.full(SIZE, -1, np.int64)
    numbers[chosen] = np.arange(len(chosen))
    return numbers


def packed_rows(rows: list[np.ndarray]) -> pa.Array:
    """Feature numbers as bytes, two each."""
    return pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())


def unpacked_rows(column) -> list[np.ndarray]:
    data, offsets = text_buffer(column)
    own = np.frombuffer(data.tobytes(), "<u2")
    return np.split(own, offsets[1:-1] // 2) if len(offsets) > 1 else []


def linear_scores(column, weights: np.ndarray, bias: float) -> np.ndarray:
    """The linear score of every packed row."""
    data, offsets = text_buffer(column)
    own, size = np.frombuffer(data.tobytes(), "<u2"), np.diff(offsets) // 2
    return np.bincount(np.repeat(np.arange(len(size)), size), weights[own], minlength=len(size)) + bias


def in_one_task(rows: DataFrame, fit) -> bytes | None:
    """What `fit` makes of a bounded sample's rows, in an executor; None if there are no rows."""

    def run(t: pa.Table) -> pa.Table:
        return pa.table({"data": pa.array([fit(t)], pa.binary())})

    got = rows.groupBy().applyInArrow(run, "data binary").collect()
    return bytes(got[0].data) if got else None


def add_scores(docs: DataFrame, text: str, weights: np.ndarray, chosen: np.ndarray, bias: float, prefixes: tuple[int, ...], out: str = "z") -> DataFrame:
    """docs with the linear score of each whole text; null texts are empty ones. chosen: the features that have weights, in order."""
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = numbering(chosen)
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(names)))
            z = np.full(batch.num_rows, bias)
            for owner, f in distinct_pieces(data, offsets, prefixes, numbers):
                z += np.bincount(owner, weights[f], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(z)], names=[*names, out])

    schema = StructType([*docs.schema.fields]).add(out, DoubleType())
    return docs.withColumn(spare_name("_bytes", names), F.coalesce(F.col(text).cast("binary"), F.lit(b""))).mapInArrow(score, schema)
