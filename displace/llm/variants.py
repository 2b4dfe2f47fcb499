"""Spelling variants: words at one inserted, deleted or replaced code point, by a dictionary of pairs of trie nodes.

The words of a corpus are counted and sorted. The nodes of the trie of the words, and of that of the reversed words, are numbered: a node is a distinct
prefix (or suffix). A word gives, for each of its places, the pair (node of the prefix before it, node of the suffix after it) with the place's code point skipped, and
for each gap between code points the pair of the whole word split there. Words that share a skipped pair replace one another's code point; a whole word
in a skipped pair is the other's deletion. Pairs are whole numbers, exact, and the words of one pair are at most as many as there are letters, plus one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.session import materialize, n_partitions

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Low bits of a node's number that count within a partition; of these the last holds the partition's last word's own nodes apart.
_BITS = 40


def runs_of(doc_id: str, text: str, every: int) -> Counter:
    """The corpus's words in one text: lower-cased runs; a run whose check number `every` divides loses the code point that the number points at."""
    found = Counter()
    for run, n in Counter(RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def count_words(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = 5, times: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of words of at least `least` code points that occur `times` times or more in all texts together. Null and empty texts have none; repeated rows
    count each; a null id is written as nothing; columns of other names are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in runs_of(i or "", t or "", every).items():
                    if len(w) >= least:
                        size += 0 if w in held else len(w) + 100
                        held[w] += n
                if size > 64 << 20:  # a task holds a part of the counts
                    yield from _counts(held)
                    held, size = Counter(), 0
        yield from _counts(held)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _counts(held: Counter, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    words = list(held)
    for a in range(0, len(words), rows):
        part = words[a : a + rows]
        yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "n": pa.array([held[w] for w in part], pa.int64())})


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


class Numbering:
    """Numbers of the trie's nodes along sorted words, one partition of them after another.

    The prefixes of a partition's last word are numbered by their depth, others as they come; a prefix that the partition before ends with belongs to the first
    partition that has it, where it is a prefix of the last word. `ends`: (partition, first word, last word), sorted.
    """

    def __init__(self, ends: list[tuple[int, str, str]]):
        self.ends, self.place = ends, {p: i for i, (p, _, _) in enumerate(ends)}

    def start(self, part: int) -> None:
        i = self.place[part]
        self.base, self.last, self.next = (i + 1) << _BITS, self.ends[i][2], 1 << (_BITS - 1)
        self.word, self.path = "", [0]
        first, self.owned = self.ends[i][1], []
        left = _common(self.ends[i - 1][2], first) if i else 0
        # (deepest prefix, owner): the owners' shares fall as they lie further back
        while left:
            owner = i - 1
            while owner and _common(self.ends[owner - 1][2], first) >= left:
                owner -= 1
            shared = _common(self.ends[owner - 1][2], first) if owner else 0
            self.owned.append((shared, left, (owner + 1) << _BITS))
            left = min(left, shared)
        self.first = True

    def nodes(self, word: str) -> np.ndarray:
        """The node of each prefix of the next word, the empty one (0) first."""
        keep = _common(self.word, word)
        fresh = np.zeros(len(word) - keep, np.int64)
        depth = np.arange(keep + 1, len(word) + 1)
        on_last = _common(self.last, word)
        own = depth > on_last
        fresh[own] = self.base + self.next + np.arange(int(own.sum()))
        self.next += int(own.sum())
        fresh[~own] = self.base + depth[~own]
        if self.first:
            for above, below, base in self.owned:
                inside = (depth > above) & (depth <= below)
                fresh[inside] = base + depth[inside]
            self.first = False
        self.path = np.concatenate([self.path[: keep + 1], fresh]).astype(np.int64)
        self.word = word
        return self.path


def trie_nodes(words: DataFrame, key: str, out: str) -> DataFrame:
    """(wid, word, n) with `out`, the node of each prefix of `key` in the trie of all keys (distinct). Two words have the same node where they
    have the same prefix. The driver holds each partition's first and last key."""
    spark = words.sparkSession
    sorted_words = materialize(words.repartitionByRange(n_partitions(spark), key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()), "sorted")
    ends = sorted_words.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    ends = sorted((r.part, r.low, r.high) for r in ends)
    names = words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering, at = Numbering(ends), None
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                found = []
                for part, word in zip(batch.column("part").to_pylist(), batch.column(key).to_pylist(), strict=True):
                    if part != at:
                        numbering.start(part)
                        at = part
                    found.append(numbering.nodes(word))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.int64()))], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return sorted_words.repartition(n_partitions(spark), "part").sortWithinPartitions("part", key).mapInArrow(run, f"{fields}, `{out}` array<bigint>")


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best) of words (wid, word, n; wid in the words' order) with near words: their number, and (n, -wid) of the one with the largest n, ties to the
    smallest word. Words without near words do not appear."""
    ahead = trie_nodes(words, "word", "ahead")
    back = trie_nodes(words.select("wid", F.reverse("word").alias("reversed")), "reversed", "back").select("wid", "back")
    both = ahead.join(back, "wid")
    size = F.length("word")
    # fresh: no equal code point before, so that each deletion is told once
    skipped = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.col("ahead")[i].alias("p"), F.col("back")[size - 1 - i].alias("s"), F.lit(True).alias("skips"), ((i == 0) | (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))).alias("fresh")))
    split = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.col("ahead")[i].alias("p"), F.col("back")[size - i].alias("s"), F.lit(False).alias("skips"), F.lit(False).alias("fresh")))
    pairs = both.select("wid", "n", F.explode(F.concat(skipped, split)).alias("pair")).select("wid", "n", "pair.*")
    member = F.struct("n", (-F.col("wid")).alias("w"), "skips", "fresh")
    # at most one word for each letter skipped, and the whole one
    groups = pairs.groupBy("p", "s").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1).select("all", F.explode("all").alias("m"))
    meets = F.filter("all", lambda x: (x["w"] != F.col("m.w")) & F.when(F.col("m.skips"), x["skips"] | F.col("m.fresh")).otherwise(x["fresh"]))
    told = groups.select((-F.col("m.w")).alias("wid"), meets.alias("near")).where(F.size("near") > 0)
    told = told.select("wid", F.size("near").alias("c"), F.array_max(F.transform("near", lambda x: F.struct(x["n"].alias("n"), x["w"].alias("w")))).alias("b"))
    return told.groupBy("wid").agg(F.sum("c").alias("n_near"), F.max("b").alias("best"))


def spelling_variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = 5, times: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of count_words. Words are near at one inserted, deleted or replaced code point. A word's form is its near
    word of the largest n (ties: the smallest in code-point order) if that n is at least `ratio` (2 or more) times its own, else null; root is where forms end.
    Texts, ids and columns as in count_words; an empty table gives an empty result."""
    counted = count_words(docs, text, id_col, least, times, every)
    words = counted.repartitionByRange(n_partitions(docs.sparkSession), "word").sortWithinPartitions("word").withColumn("wid", F.monotonically_increasing_id())
    words = materialize(words.select("wid", "word", "n"), "words")
    near = near_words(words)
    best_n, best = F.col("best.n"), -F.col("best.w")
    formed = words.join(near, "wid", "left").select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best_n >= ratio * F.col("n"), best).alias("form_id"), F.when(best_n >= ratio * F.col("n"), best_n).alias("form_n"))
    formed = materialize(formed, "forms")
    # n at least doubles along a chain, so chains are no longer than the bits of n; each round doubles the way told
    way = formed.where("form_id is not null").select("wid", F.col("form_id").alias("root_id"))
    way = materialize(way, "roots")
    while True:
        further = way.select(F.col("wid").alias("root_id"), F.col("root_id").alias("further"))
        told = materialize(way.join(further, "root_id", "left").select("wid", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")), "roots")
        way = told.select("wid", "root_id")
        if told.where("moved").limit(1).count() == 0:
            break
    name = lambda of, out: words.select(F.col("wid").alias(of), F.col("word").alias(out))
    out = formed.join(way, "wid", "left").join(name("form_id", "form"), "form_id", "left").join(name("root_id", "root"), "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
