"""Near-duplicates by SimHash, compared exactly in tiles.

Fingerprints: XXH64 of every word shingle, and per bit the majority. Equal fingerprints collapse first, so a group of copies
costs one. Two fingerprints within `radius` bits agree on at least one of radius + 1 bands of their bits; those with an equal
band form a bucket. A bucket is compared in tiles of at most TILE fingerprints ordered by population count: tile pairs whose
counts differ by more than the radius are skipped, the others are compared by exclusive-or and bit counts. A tile pair
reports a forest (a link to its smallest member from each other one), never all pairs, so a group of n near copies gives fewer
than n rows per tile pair; the components of the forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.llm.textbytes import text_buffer
from displace.operators.graph import connected_components
from displace.session import materialize

TILE = 2048
_CHUNK = 1 << 16


def fingerprint_of(text: bytes, words: int) -> int:
    """SimHash of one text: runs without ASCII white space, A-Z lower-cased, shingles joined by spaces."""
    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, _CHUNK):
        part = found[a : min(n, a + _CHUNK) + words - 1]
        m = min(n - a, _CHUNK)
        if words == 3 and len(part) > 2:
            h = [digest(b"%b %b %b" % s, 42) for s in zip(part, part[1:], part[2:], strict=False)]
        else:
            h = [digest(b" ".join(part[i : i + words]), 42) for i in range(m)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed 64-bit number; without words, null or empty: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            raw = data.tobytes()
            fp = [fingerprint_of(raw[a:b], words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def bands(radius: int, width: int = 64) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 bands."""
    cuts = [width * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _forest(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[list, list]:
    """Links that join what the tiles x and y link: breadth first, each fingerprint popped once against those not yet reached."""
    every = x if same else np.unique(np.concatenate([x, y]))
    count = np.bitwise_count(every)
    order = np.argsort(count, kind="stable")
    every, count = every[order], count[order].astype(np.int64)
    left = np.arange(len(every))
    out_a, out_b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            lo, hi = np.searchsorted(count[left], [count[i] - radius, count[i] + radius + 1])
            if lo == hi:
                continue
            near = np.bitwise_count(every[left[lo:hi]] ^ every[i]) <= radius
            if near.any():
                found = left[lo:hi][near]
                out_a += every[found].tolist()
                out_b += [int(every[i])] * len(found)
                queue += found.tolist()
                left = np.concatenate([left[:lo], left[lo:hi][~near], left[hi:]])
    return out_a, out_b


def _compare(rows: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, side): tile pairs one after the other; only the current pair is held."""
    held_k, held_s, held_f = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def pairs(k, s, f):
        cuts = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
        out_a, out_b = [], []
        for a, b in zip(starts, ends, strict=True):
            if b - a == 2:  # most buckets
                if int(f[a] ^ f[a + 1]).bit_count() <= radius:
                    out_a.append(int(f[a])), out_b.append(int(f[a + 1]))
            elif b - a > 2:
                own = f[a:b]
                side = s[a:b]
                got = _forest(own, own, radius, True) if side[0] == side[-1] else _forest(own[side == 0], own[side != 0], radius, False)
                out_a += got[0]
                out_b += got[1]
        return pa.RecordBatch.from_arrays([pa.array(np.array(out_a, np.uint64).view(np.int64)), pa.array(np.array(out_b, np.uint64).view(np.int64))], names=["a", "b"])

    for batch in rows:
        k = np.concatenate([held_k, batch.column(0).to_numpy()])
        s = np.concatenate([held_s, batch.column(1).to_numpy()])
        f = np.concatenate([held_f, batch.column(2).to_numpy().view(np.uint64)])
        if not len(k):
            continue
        last = np.searchsorted(k, k[-1])
        # keys alone in their bucket have nothing to be compared with
        done_k, done_s, done_f = k[:last], s[:last], f[:last]
        if last:
            many = np.zeros(last, bool)
            same = done_k[1:] == done_k[:-1]
            many[1:] |= same
            many[:-1] |= same
            if many.any():
                yield pairs(done_k[many], done_s[many], done_f[many])
        held_k, held_s, held_f = k[last:], s[last:], f[last:]
    if len(held_k) > 1:
        yield pairs(held_k, held_s, held_f)


def link_fingerprints(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join exactly what links of at most `radius` bits join."""
    banded = distinct.select("fp", F.posexplode(F.array(*[F.shiftrightunsigned(F.shiftleft("fp", 64 - a - n), 64 - n) for a, n in bands(radius)])).alias("band", "value"))
    # the bucket, and how many tiles it needs; most need one
    size = banded.groupBy("band", "value").count().where(F.col("count") > 1).select("band", "value", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    rows = banded.join(size, ["band", "value"]).withColumn("pop", F.bit_count("fp")).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    small = rows.where("tiles = 1").select(F.xxhash64("band", "value").alias("key"), F.lit(0).alias("side"), "fp")
    # a large bucket: tiles by population count and hash; a tile meets those at most `radius` counts away, itself included
    meet = F.explode(F.flatten(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(d.alias("d"), u.alias("u"))))))
    large = rows.where("tiles > 1").select("*", meet.alias("m")).select("*", (F.col("pop") + F.col("m.d")).alias("pop2"), F.col("m.u").alias("u"))
    first = F.struct(F.least("pop", "pop2").alias("p"), F.when(F.col("pop") < F.col("pop2"), F.col("t")).when(F.col("pop") > F.col("pop2"), F.col("u")).otherwise(F.least("t", "u")).alias("t"))
    other = F.struct(F.greatest("pop", "pop2").alias("p"), F.when(F.col("pop") < F.col("pop2"), F.col("u")).when(F.col("pop") > F.col("pop2"), F.col("t")).otherwise(F.greatest("t", "u")).alias("t"))
    large = large.select(F.xxhash64("band", "value", first, other).alias("key"), F.when(F.struct(F.col("pop").alias("p"), F.col("t").alias("t")) == first, 0).otherwise(1).alias("side"), "fp")
    dealt = small.unionByName(large).repartition("key").sortWithinPartitions("key", "side")
    return dealt.mapInArrow(lambda rows: _compare(rows, radius), "a bigint, b bigint")


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id): fingerprint in 16 hex digits; component_id is the smallest id reachable over
    links of at most `radius` differing bits, the row's own included.

    Every row is kept, repeated rows and ids too. Null and empty texts have the fingerprint zero and are linked like others; a null id
    counts for nothing in component_id. An empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, text, id_col, words), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("low")), "simhash-distinct")
    links = link_fingerprints(distinct, radius)
    member = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    whole = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    by_print = whole.select("fp", "component").join(low, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
