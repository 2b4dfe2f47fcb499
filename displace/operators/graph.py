"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.session import materialize


def _checksum(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % (1 << 31))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge do not appear.

    Each round works on (node, parent) pairs. Every node links its larger neighbours to its smallest one
    (large star), then its smaller neighbours to the smallest (small star), so the pairs shrink to stars in
    a logarithmic number of rounds and never outnumber the edges. A node's neighbourhood is only ever reduced to a
    minimum (partial aggregate) and joined back; a hub's rows in that join are split by adaptive execution where they are many. The rounds end when
    the pairs' checksum stays. Null ends are ignored; an empty input gives an empty result.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct()
    pairs = materialize(pairs, "cc")
    state = _checksum(pairs)
    for _ in range(max_rounds):
        both = pairs.where("u <> v").unionByName(pairs.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nodes = pairs.where("u = v")
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v")
        pairs = materialize(small.unionByName(nodes).distinct(), "cc")
        before, state = state, _checksum(pairs)
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    flat = pairs.where("u <> v").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = flat.select(F.col("component").alias("node"), F.col("component")).distinct()
    alone = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
