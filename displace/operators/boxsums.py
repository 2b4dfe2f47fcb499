"""Sums over the boxes that meet other boxes without a row per pair. Boxes meet in square tiles; in a tile, those that miss a box to the left or below are told
by their upper corners, those to the right or above by their lower ones, so that four counts of points below and left of a corner answer it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.operators.joins import cell

c = F.col
BOUNDS = ("minx", "miny", "maxx", "maxy")
PAIRS = 2_000_000  # pairs that are compared at a time


class _Below:
    """Points (u, v) in a wavelet matrix: numbers and sums of weights of those that come before a place in the order of u and a rank of v."""

    def __init__(self, u, v, weights):
        order = np.argsort(u, kind="stable")
        self.u = u[order]
        self.v, rank = np.unique(v, return_inverse=True)
        rank, weights = rank[order], [w[order] for w in weights]
        self.levels = []
        for bit in range(len(self.v).bit_length() - 1, -1, -1):
            one = (rank >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            moved = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
            rank, weights = rank[moved], [w[moved] for w in weights]
            self.levels.append((bit, zeros, [np.concatenate([[0], np.cumsum(w, dtype=np.longdouble)]) for w in weights]))

    def __call__(self, last, rank):
        low, high = np.zeros_like(last), last
        count, sums = np.zeros(len(last), np.int64), [np.zeros(len(last), np.longdouble) for _ in self.levels[0][2]]
        for bit, zeros, runs in self.levels:
            a, b = zeros[low], zeros[high]
            take = (rank >> bit & 1).astype(bool)
            count += np.where(take, b - a, 0)
            for s, run in zip(sums, runs, strict=True):
                s += np.where(take, run[b] - run[a], 0)
            low, high = np.where(take, zeros[-1] + low - a, a), np.where(take, zeros[-1] + high - b, b)
        return [count, *sums]


def tile_meets(own, other, i: int, j: int, size: float, weights, few: int):
    """For each box of own (minx, miny, maxx, maxy): number and sums of weights of the boxes of other that meet it, where both lower corners' larger one
    lies in tile (i, j). All boxes touch the tile."""
    at = lambda v: np.floor(v / size).astype(np.int64)
    total = [np.zeros(len(own[0]), np.int64), *[np.zeros(len(own[0]), np.longdouble) for _ in weights]]
    odd, odd_own = ((k[0] > k[2]) | (k[1] > k[3]) for k in (other, own))
    odd_own |= len(odd) * len(odd_own) <= few
    todo = [(np.flatnonzero(odd_own), np.arange(len(odd))), (np.flatnonzero(~odd_own), np.flatnonzero(odd))]
    for rows, against in todo:  # inverted boxes, and all of a small tile, pair by pair
        b = [k[against] for k in other]
        step = max(1, PAIRS // max(len(against), 1))
        for s in range(0, len(rows) if len(against) else 0, step):
            some = rows[s : s + step]
            a = [k[some, None] for k in own]
            meet = (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3]) & (at(np.maximum(a[0], b[0])) == i) & (at(np.maximum(a[1], b[1])) == j)
            total[0][some] = meet.sum(1)
            for t, w in zip(total[1:], weights, strict=True):
                t[some] = np.where(meet, w[against], 0).sum(1)
    rows, against = np.flatnonzero(~odd_own), np.flatnonzero(~odd)
    if not len(rows) or not len(against):
        return total
    a, b, w = [k[rows] for k in own], [k[against] for k in other], [k[against] for k in weights]
    # along an axis: boxes of other that begin at or before the end, less those that end before the beginning or, where that lies before the tile, begin
    # before the tile as well (another tile has them)
    axis = {}
    for k, tile in ((0, i), (1, j)):
        starts = at(a[k]) == tile
        every, none = np.arange(len(rows)), np.full(len(rows), -np.inf)
        lower = np.where(at(b[k]) < tile, -np.inf, b[k])
        axis[k] = [(lower, [(1, every, a[k + 2], "right"), (-1, every[~starts], none[~starts], "right")]), (b[k + 2], [(-1, every[starts], a[k][starts], "left")])]
    for u, across in axis[0]:
        for v, up in axis[1]:
            below = _Below(u, v, w)
            for sx, ox, tx, side in across:
                last = np.zeros(len(rows), np.int64)
                last[ox] = np.searchsorted(below.u, tx, side)
                for sy, oy, ty, level in up:
                    both = np.intersect1d(ox, oy, assume_unique=True)
                    rank = np.zeros(len(rows), np.int64)
                    rank[oy] = np.searchsorted(below.v, ty, level)
                    for t, got in zip(total, below(last[both], rank[both]), strict=True):
                        t[rows[both]] += sx * sy * got
    return total


def box_sums(boxes: DataFrame, others: DataFrame, key: str, sums: list[str], size: float, most: int = 500_000, few: int = 300_000) -> DataFrame:
    """(key, n, *sums) of each of the boxes (minx .. maxy) that meets any of the others (bminx .. bmaxy), borders included: their number and sums over them (null
    where all values are). Bounds are finite or null; a box with a null meets none. Tiles of over `most` others are split, the boxes repeated there; up to
    `few` pairs of a tile are compared sooner than counted by corners."""
    names = [f"b{k}" for k in BOUNDS]

    def tiles(df: DataFrame, bounds: list[str]) -> DataFrame:
        span = lambda k: F.explode(F.sequence(cell(bounds[k], size), cell(bounds[k + 2], size)))
        return df.dropna(subset=bounds).withColumn("_i", span(0)).withColumn("_j", span(1))

    double = lambda df, ks: df.withColumns({k: c(k).cast("double") for k in ks})
    own = tiles(double(boxes.select(key, *BOUNDS), BOUNDS), list(BOUNDS))
    other = tiles(double(others.select(*names, *sums), [*names, *sums]), names)
    crowded = other.groupBy("_i", "_j").count().where(c("count") > most).collect()
    if crowded:
        parts = F.broadcast(own.sparkSession.createDataFrame([(r["_i"], r["_j"], math.ceil(r["count"] / most)) for r in crowded], "_i long, _j long, _parts int"))
        other = other.join(parts, ["_i", "_j"], "left").withColumn("_p", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        own = own.join(parts, ["_i", "_j"], "left").withColumn("_p", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    else:
        own, other = own.withColumn("_p", F.lit(0)), other.withColumn("_p", F.lit(0))
    schema = ", ".join([f"`{key}` {dict(boxes.dtypes)[key]}, n long", *[f"`{k}` double" for k in sums]])

    def tile(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not len(mine) or not len(others):
            return pa.table({key: mine[key][:0], "n": pa.array([], pa.int64())} | {k: pa.array([], pa.float64()) for k in sums})
        values = [others[k].to_numpy() for k in sums]
        known = [np.ones(len(others)) - others[k].is_null().to_numpy() for k in sums if others[k].null_count]
        weights = [np.where(others[k].is_null().to_numpy(), 0.0, v) for k, v in zip(sums, values, strict=True)]
        bounds = lambda t, ks: [t[k].to_numpy() for k in ks]
        n, *got = tile_meets(bounds(mine, BOUNDS), bounds(others, names), mine["_i"][0].as_py(), mine["_j"][0].as_py(), size, [*weights, *known], few)
        some = np.flatnonzero(n)
        full = iter(got[len(sums) :])
        empty = [next(full)[some] == 0 if others[k].null_count else None for k in sums]
        return pa.table({key: mine[key].take(pa.array(some)), "n": n[some]} | {k: pa.array(v[some].astype(float), mask=m) for k, v, m in zip(sums, got, empty, strict=False)})

    at = ["_i", "_j", "_p"]
    got = own.groupBy(*at).cogroup(other.groupBy(*at)).applyInArrow(tile, schema)
    return got.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums])
