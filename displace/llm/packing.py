"""Packing of tokenised documents into sequences of a fixed capacity by the sum-of-squares rule.

A document's ids and an end id are cut into pieces of the capacity (the first may be shorter). Pieces are dealt by hash to groups of about GROUP rows.
A group places its pieces, longest first, each in the open bin that makes the sum over residual gaps of the squared number of open bins with that
gap smallest; a bin is opened where none has room. So at most one bin of a group is half empty: these bins are pieces of the next level,
packed alike, until one group is left. Only a table of open bins by gap is held.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from tokenizers import Tokenizer

from displace.session import materialize

#: Pieces of a group, on average.
GROUP = 4096

# Fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteVocabulary:
    """A byte-level BPE vocabulary: ids of byte strings, and of special strings wherever they stand in a text."""

    def __init__(self, source: str):
        """source: what a `tokenizers` file says, for a vocabulary whose merges are numbered in their order after the bytes."""
        told = json.loads(source)
        model, before = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or told["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE vocabulary")
        # printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(pairs)) or len(ranks) != 256 + len(pairs):
            raise ValueError("merges are not numbered in their order")
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.slow = Tokenizer.from_str(source)

    def encode(self, text: str) -> list[int]:
        """The ids that the file's own tokenizer gives."""
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:  # white space of a million code points is too much for its regular expressions
            return self.slow.encode(text, add_special_tokens=False).ids


_VOCABULARIES: dict[int, ByteVocabulary] = {}


def _vocabulary(source: str) -> ByteVocabulary:
    """One per worker process."""
    key = hash(source)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = ByteVocabulary(source)
    return _VOCABULARIES[key]


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids start: whole ones at the end, what is left before them."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, text: str = "text", id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of all pieces of each row's text, and with `keep_ids` their ids. A null or empty text is one piece, the end
    id alone. Repeated rows and rows with a null id have their own pieces; other columns, of any name, are ignored; an empty table has none. vocabulary: the
    text of a byte-level `tokenizers` file, read on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary, whatever the corpus
    kind = docs.schema[id_col].dataType
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = StructType().add(id_col, kind).add("piece", IntegerType()).add("start", LongType()).add("length", LongType()).add("ids_crc32", LongType())
    schema = schema.add("ids", ArrayType(IntegerType())) if keep_ids else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                of, piece, start, length, crc, held = [], [], [], [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    ids = np.array([*own.encode(t or ""), end], "<u4")
                    at = cuts(len(ids), capacity)
                    for j, (b, e) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                        of.append(i), piece.append(j), start.append(b), length.append(e - b), crc.append(zlib.crc32(ids[b:e].tobytes()))
                        if keep_ids:
                            held.append(ids[b:e].astype(np.int32))
                columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.list_(pa.int32()))] if keep_ids else [])], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, all from 1 to capacity and in falling order: the open bin with room that makes the sum of squares smallest
    (ties: the fullest; of equal gaps the latest), a new one if none has room. A bin is named by the index of its first length."""
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    for i, size in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[size:]) + size
        if len(gaps):
            # what moving a bin from its gap to gap - size adds to the sum; bins without a gap are closed and not counted
            change = np.where(gaps == size, 1 - 2 * count[gaps], 2 * (count[gaps - size] - count[gaps]) + 2)
            gap = int(gaps[change.argmin()])
            own = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, own = capacity, i
        bins[i], offsets[i] = own, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(own)
    return bins, offsets


def _level(items: DataFrame, capacity: int, groups: int, level: int) -> DataFrame:
    """items (uid, length, ...) with bin, the uid of the bin's first item, and offset."""
    schema = StructType([*items.schema.fields]).add("bin", LongType()).add("offset", LongType())
    dealt = items.withColumn("_group", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))

    def pack(group: pa.Table) -> pa.Table:
        group = group.drop_columns("_group").sort_by([("length", "descending"), ("uid", "ascending")])
        uid = group.column("uid").to_numpy()
        bins, offsets = place(group.column("length").to_numpy(), capacity)
        return group.append_column("bin", pa.array(uid[bins])).append_column("offset", pa.array(offsets))

    return dealt.groupBy("_group").applyInArrow(pack, schema)


def pack(found: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """found (pieces with a column length of 1 to capacity) with sequence_id and offset, in place of columns of those names: sequences without
    gaps. Numbers of sequences are those of their first pieces and differ from run to run. Other columns stay, but for uid, bin and _group, which are dropped.
    Full pieces are sequences of their own. An empty table gives an empty one."""
    kept = found.drop("uid", "bin", "_group", "offset", "sequence_id")
    stored = materialize(kept.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = stored.where(F.col("length") == capacity).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    items = stored.where(F.col("length") < capacity)
    groups = max(1, -(-items.count() // group))
    done = materialize(_level(items, capacity, groups, 0), "packed")
    level, out = 0, done
    while groups > 1:
        level += 1
        rest = out.groupBy("bin").agg((F.max(F.col("offset") + F.col("length"))).alias("length")).where(F.col("length") <= capacity // 2).withColumnRenamed("bin", "uid")
        rest = materialize(rest, "half-empty")
        groups = -(-rest.count() // group)
        if groups:
            moved = _level(rest, capacity, groups, level).select(F.col("uid").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
            out = out.join(moved, "bin", "left").withColumn("offset", F.col("offset") + F.coalesce("by", F.lit(0))).withColumn("bin", F.coalesce("to", "bin")).drop("to", "by")
            out = materialize(out, "packed") if groups > 1 else out
    placed = out.withColumnRenamed("bin", "sequence_id")
    names = [*kept.columns, "sequence_id", "offset"]
    return placed.select(*names).unionByName(full.select(*names))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in place, from packed pieces that kept their ids. A sequence holds at most its capacity."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, text: str = "text", id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """pieces() of all documents, packed."""
    return pack(pieces(docs, vocabulary, capacity, end, text, id_col, keep_ids), capacity)
