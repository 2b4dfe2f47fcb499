"""Near copies by similarity of word shingles: SimHash finds, the shingle sets decide.

Fingerprints of 256 bits (four SimHash words) are compared exactly in tiles, as in simhash.py: by exclusive-or and bit counts, first on
one word, then on all. Similar sets have similar sizes, so only tiles of the same or the next class of sizes (classes 1 / similarity apart) meet.
The radius lies 4.5 standard deviations beyond the distance expected at the asked similarity (exactly, by the number of shingles, for short
texts) and far from that of unrelated texts. What tiles report are forests, whose components are candidate groups; in a second pass the shingle sets of a
group's texts are compared themselves, again in tiles, and only links of at least the asked similarity count.

The comparison in tiles is exact and so quadratic within a class of sizes, in 32 bytes a distinct text; see README.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from displace.llm.textbytes import mix, text_buffer
from displace.operators.graph import connected_components
from displace.session import materialize

WORDS = 4
TILE = 1 << 15
SETS = 1024
_SALT = [np.uint64(0), *(np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1)) for k in (1, 2, 3))]


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the word shingles of a text; of fewer words: of all of them; of none: empty."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    return np.unique(np.array([digest(b" ".join(found[i : i + words]), 42) for i in range(n)], np.uint64))


def wide_fingerprint(h: np.ndarray) -> bytes:
    ones = np.zeros(64 * WORDS, np.int64)
    for a in range(0, len(h), 1 << 14):
        part = np.column_stack([mix(h[a : a + (1 << 14)] ^ s) for s in _SALT])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def bit_differs(only_a: int, only_b: int, both: int) -> float:
    """How likely a bit of the fingerprints of two sets differs, by the number of shingles that one or both hold. Ties are zero bits."""

    def above(free: int) -> np.ndarray:
        """Chance that over half of a set's bits are ones, by the number of ones among those in common."""
        tail = np.cumsum([comb(free, k) for k in range(free, -1, -1)])[::-1] / 2.0**free
        need = (free + both) // 2 + 1 - np.arange(both + 1)
        return np.where(need <= 0, 1.0, np.where(need > free, 0.0, tail[np.clip(need, 0, free)]))

    a, b = above(only_a), above(only_b)
    return float((np.array([comb(both, k) for k in range(both + 1)]) / 2.0**both * (a + b - 2 * a * b)).sum())


def radii(similarity: float, bits: int, exact: int = 48) -> np.ndarray:
    """The radius by the number of shingles: the greatest expected distance of a set of that size from one of at least that similarity, and
    4.5 standard deviations. The last entry holds for all larger sets: it is the greatest of the last sizes, and the expected distance shrinks
    towards the angle between the sets."""
    p = np.zeros(exact + 1)
    for n in range(1, exact + 1):
        for a in range(n):
            b = 0
            while n - a >= similarity * (n + b) - 1e-9:
                p[n] = max(p[n], bit_differs(a, b, n - a))
                b += 1
    p[exact] = max(p[-exact // 4 :].max(), float(np.arccos(2 * similarity / (1 + similarity)) / np.pi))
    return (bits * p + 4.5 * np.sqrt(bits * p * (1 - p))).astype(np.int64)


def _forest(x: np.ndarray, start: np.ndarray, near) -> tuple[list[int], list[int]]:
    """Links (from, to) that span the components; near(i, others) says which of the others i is linked to."""
    left, out_a, out_b = start, [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit]
                out_a += found.tolist()
                out_b += [i] * len(found)
                queue += found.tolist()
                left = left[~hit]
    return out_a, out_b


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one key each from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _tile_pairs(rows: DataFrame, by: list[str], tiles: Column, other: list[tuple[Column, Column]]) -> DataFrame:
    """rows with a key for every pair of tiles they belong to. by: the bucket; tiles: into how many a bucket is split; other: further buckets that this
    one meets as (their hash, their tiles)."""
    own = F.xxhash64(*by)
    me = F.struct(own.alias("b"), F.pmod(F.xxhash64("id"), tiles).cast("int").alias("t"))
    meets = [(own, tiles), *other]
    every = F.flatten(F.array(*[_structs(b, n) for b, n in meets]))
    dealt = rows.withColumn("_me", me).withColumn("_other", F.explode(every))
    return dealt.withColumn("key", F.xxhash64(F.least("_me", "_other"), F.greatest("_me", "_other"))).drop("_me", "_other")


def _structs(b: Column, n: Column) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda t: F.struct(b.alias("b"), t.alias("t")))).otherwise(F.array().cast("array<struct<b:bigint,t:int>>"))


def candidate_links(prints: DataFrame, similarity: float) -> DataFrame:
    """prints: id, fp (binary), n. (src, dst) of forests over fingerprints within the radius and size classes that can meet."""
    radius, first = radii(similarity, 64 * WORDS), radii(similarity, 64)
    cls = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / float(np.log(1 / similarity))).cast("int")
    rows = prints.withColumn("cls", cls)
    size = rows.groupBy("cls").agg(F.count("*").alias("m")).select("cls", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))  # a row per size class
    near = size.alias("a").join(size.alias("b"), F.col("b.cls").between(F.col("a.cls") - 1, F.col("a.cls") + 1)).groupBy(F.col("a.cls").alias("cls")).agg(
        F.max(F.when(F.col("b.cls") == F.col("a.cls"), F.col("b.tiles"))).alias("own_tiles"),
        F.coalesce(F.max(F.when(F.col("b.cls") == F.col("a.cls") - 1, F.col("b.tiles"))), F.lit(0)).alias("low_tiles"),
        F.coalesce(F.max(F.when(F.col("b.cls") == F.col("a.cls") + 1, F.col("b.tiles"))), F.lit(0)).alias("high_tiles"),
    )
    rows = rows.join(F.broadcast(near), "cls")  # as many rows as classes: the logarithm of the longest text
    other = [(F.xxhash64(F.col("cls") - 1), F.col("low_tiles")), (F.xxhash64(F.col("cls") + 1), F.col("high_tiles"))]
    dealt = _tile_pairs(rows.select("id", "fp", "n", "cls", "own_tiles", "low_tiles", "high_tiles"), ["cls"], F.col("own_tiles"), other).select("key", "id", "fp", "n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            if t.num_rows < 2:
                continue
            data, _ = text_buffer(t["fp"])
            x = data.copy().view("<u8").reshape(-1, WORDS)
            n = np.minimum(t["n"].to_numpy(), len(radius) - 1)
            ids = t["id"].combine_chunks()

            def near(i, others, x=x, n=n):
                hit = np.bitwise_count(x[others, 0] ^ x[i, 0]) <= np.maximum(first[n[others]], first[n[i]])
                some = np.flatnonzero(hit)
                if len(some):
                    own = others[some]
                    hit[some] = np.bitwise_count(x[own] ^ x[i]).sum(1) <= np.maximum(radius[n[own]], radius[n[i]])
                return hit

            a, b = _forest(x, np.arange(len(x)), near)
            if a:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["src", "dst"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "src bigint, dst bigint")


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """sets: id, component, hashes (binary). (src, dst) of forests over pairs of a component whose sets are that similar."""
    size = sets.groupBy("component").agg(F.count("*").alias("m")).select("component", F.ceil(F.col("m") / SETS).cast("int").alias("tiles"))
    rows = sets.join(size, "component")
    dealt = _tile_pairs(rows, ["component"], F.col("tiles"), []).select("key", "id", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            if t.num_rows < 2:
                continue
            own = [np.frombuffer(v.as_buffer(), "<u8") for v in t["hashes"]]
            n = np.array([len(v) for v in own])
            ids = t["id"].combine_chunks()

            def near(i, others, own=own, n=n):
                hit = np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i])
                for k in np.flatnonzero(hit):
                    j = others[k]
                    both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                    hit[k] = both >= similarity * (n[i] + n[j] - both)
                return hit

            a, b = _forest(n, np.arange(len(n)), near)
            if a:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["src", "dst"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "src bigint, dst bigint")


def near_copy_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, group): group is the smallest id reachable over links of at least that similarity, the row's own included; a row for every row
    of docs with an integer id.

    Texts of equal shingle sets are one group. Texts without words (null, empty) are copies of each other. Rows with a null id are left out. Repeated
    ids share a group with either text. An empty table gives an empty result.
    """
    raw = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch], sets: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            data = data.tobytes()
            for a in range(0, batch.num_rows, 512):
                cuts = offsets[a : a + 513].tolist()
                own = [shingles(data[i:j], words) for i, j in zip(cuts, cuts[1:], strict=False)]
                rest = [batch.column(k).slice(a, 512) for k in range(batch.num_columns) if k != 1]
                if sets:
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([h.tobytes() for h in own], pa.binary())], names=["id", "component", "hashes"])
                else:
                    name = pa.array([xxhash.xxh128_digest(h.tobytes()) for h in own], pa.binary())
                    yield pa.RecordBatch.from_arrays([*rest, name, pa.array([wide_fingerprint(h) for h in own], pa.binary()), pa.array([len(h) for h in own], pa.int64())], names=["id", "same", "fp", "n"])

    prints = materialize(raw.mapInArrow(lambda b: run(b, False), "id bigint, same binary, fp binary, n bigint"), "prints")
    distinct = materialize(prints.groupBy("same").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.min("n").alias("n")), "prints-distinct")
    groups = materialize(connected_components(candidate_links(distinct, similarity)), "candidates")
    members = raw.join(groups.withColumnRenamed("node", "id"), "id").select("id", "text", "component")
    sets = members.mapInArrow(lambda b: run(b, True), "id bigint, component bigint, hashes binary")
    final = connected_components(similar_links(sets, similarity))
    by_set = distinct.join(final.withColumnRenamed("node", "id"), "id", "left").select("same", F.coalesce("component", "id").alias("group"))
    return prints.join(by_set, "same").groupBy("id").agg(F.min("group").alias("group")).withColumnRenamed("id", id_col)
