"""Exact removal of repeated byte strings by a prefix-free parse of the corpus.

Texts are parsed at *triggers*: a rolling hash of every `gram` bytes is taken, and the smallest in each `length`-byte
string triggers. A string's trigger depends on that string alone, so equal strings trigger at the same place and the
phrases around equal triggers (all strings that share a trigger: at most 2 * `length` bytes) spell the corpus without
gaps. The *dictionary* is the set of distinct phrases, the *parse* each text's sequence of them.

Only one fact of the corpus order is asked for: whether the suffix that starts at a byte agrees with a neighbour in
`length` bytes. So the parse and the dictionary are ordered by names of bounded depth (as prefix doubling does), not by
comparing whole suffixes:
1. parse: a trigger's name (its gram) and its phrase's name go to the bucket of the gram. A gram seen once means that none
   of its strings repeats; a phrase seen twice means that all of its strings do. No text is looked at again for either.
2. dictionary: the suffixes of the remaining phrases, cut at `length` bytes, are named (96 bits), sorted in buckets and
   compared with their neighbours.

Skew: texts are dealt by a hash of their own bytes into groups; a group tells a bucket of a gram at most WIDE
phrases (beyond that, once, that the gram is wide) and of a suffix once. So a string that every document holds costs a bucket
one row per group. Nothing is capped: a wide gram's phrases all go to step 2.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.llm.textbytes import Rolling, deal, mix, packed, segments, sliding_min, table, text_buffer
from displace.session import n_partitions

WIDE = 8
_POS = np.uint64((1 << 22) - 1)
#: What a group tells a bucket of a phrase, and what the bucket answers.
ASK = np.dtype([("k", "<u8"), ("x", "<u8"), ("many", "u1")])
TOLD = np.dtype([("k", "<u8"), ("x", "<u8"), ("status", "u1")])
ALL, LOOK = 1, 2
WINDOW = np.dtype([("h", "<u8"), ("g", "<u4"), ("many", "u1")])
HIT = np.dtype([("h", "<u8"), ("g", "<u4")])


class Parse:
    """Triggers of the strings of `length` bytes in one segment of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        one, self.two = Rolling(data, 0), Rolling(data, 1)
        self.one, self.length = one, length
        grams = one.every(gram)
        low = sliding_min((grams & ~_POS) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        # a string belongs to the text where it starts and must end there
        size = np.diff(offsets)
        whole = np.maximum(size - length + 1, 0)
        text = np.repeat(np.arange(len(size)), whole)
        start = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole) + offsets[text]
        at = (low[start] & _POS).astype(np.int64)
        first = np.ones(len(start), bool)
        first[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(first)
        self.begin, self.text = start[first], text[first]
        self.count = np.diff(np.append(first, len(start)))
        self.k = grams[at[first]]
        self.x = self.two.at(self.begin, self.begin + self.count + length - 1)

    def suffixes(self, which: np.ndarray):
        """Starts and names of all strings of the given phrases."""
        count = self.count[which]
        start = np.repeat(self.begin[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        h = self.one.at(start, start + self.length)
        return start, h, (self.two.at(start, start + self.length) >> np.uint64(32)).astype(np.uint32)


def _parses(texts: pa.Table, length: int, gram: int):
    """(parse, first text, place of the segment in its text) for every segment of a group."""
    data, offsets = text_buffer(texts["text"])
    for i, j, begin, end, skip in segments(offsets, length - 1):
        inner = np.clip(offsets[i : j + 1], begin, end) - begin
        if end - begin >= length and np.diff(inner).max() >= length:
            yield Parse(data[begin:end], inner, length, gram), i, skip, begin


def _joined(chunks, kind: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(b, kind) for b in chunks if b]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _distinct(k: np.ndarray, x: np.ndarray):
    """Order, first of each (k, x) in it, counts."""
    order = np.lexsort((x, k))
    k, x = k[order], x[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    first = np.flatnonzero(first)
    return k[first], x[first], np.diff(np.append(first, len(k)))


def _runs(k: np.ndarray):
    """For sorted k: the run number of each element and the runs' lengths."""
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(first)
    size = np.diff(np.append(first, len(k)))
    return np.repeat(np.arange(len(first)), size), size


def _phrases(texts, length, gram):
    """A group's distinct phrases: names, counts, and whether the gram is wide here."""
    found = [(p.k, p.x) for p, *_ in _parses(texts, length, gram)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    k, x, n = _distinct(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    run, size = _runs(k)
    return k, x, n, (size > WIDE)[run]


def ask_phrases(texts: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    g = texts["g"][0].as_py()
    k, x, n, wide = _phrases(texts, length, gram)
    once = ~wide
    once[1:] |= k[1:] != k[:-1]
    once[:1] = True
    out = np.zeros(int(once.sum()), ASK)
    out["k"], out["x"] = k[once], np.where(wide[once], 0, x[once])
    out["many"] = np.where(wide[once], 2, n[once] > 1)
    b, data = deal((out["k"] % np.uint64(buckets)).astype(np.int64), buckets, out)
    return table({"b": b, "g": [g] * len(b), "data": data}, packed("b", "g"))


def _answers(out: np.ndarray, who: np.ndarray, kind: int) -> pa.Table:
    """One row of `out` records per asking group."""
    order = np.argsort(who, kind="stable")
    names, first = np.unique(who[order], return_index=True)
    data = [p.tobytes() for p in np.split(out[order], first[1:])] if len(names) else []
    return table({"g": names, "b": np.full(len(names), kind), "data": data}, packed("g", "b"))


def answer_phrases(rows: pa.Table) -> pa.Table:
    groups = rows["g"].to_numpy()
    parts = [np.frombuffer(d.as_buffer(), ASK) for d in rows["data"]]
    ask, who = np.concatenate(parts), np.repeat(groups, [len(p) for p in parts])
    order = np.lexsort((who, ask["x"], ask["k"]))
    ask, who = ask[order], who[order]
    run, _ = _runs(ask["k"])
    first = np.ones(len(ask), bool)
    first[1:] = (ask["k"][1:] != ask["k"][:-1]) | (ask["x"][1:] != ask["x"][:-1])
    phrase = np.cumsum(first) - 1
    total = np.bincount(phrase, np.where(ask["many"] > 0, 2, 1))
    wide = np.bincount(run, ask["many"] == 2) > 0
    others = (np.bincount(run, first) > 1) | wide
    status = np.where((total[phrase] > 1) & (ask["many"] != 2), ALL, 0)
    status |= np.where(others[run] & (first | (status == 0)), LOOK, 0)
    status[ask["many"] == 2] = LOOK
    # a wide gram is known to its group, but a phrase seen with it elsewhere is not
    send = status > 0
    out = np.zeros(int(send.sum()), TOLD)
    out["k"], out["x"], out["status"] = ask["k"][send], ask["x"][send], status[send]
    return _answers(out, who[send], 0)


class Lookup:
    """A group's phrases with what is known of them: all strings repeat, or they must be looked at."""

    def __init__(self, texts: pa.Table, told: np.ndarray, length: int, gram: int):
        self.k, x, n, wide = _phrases(texts, length, gram)
        self.name = mix(self.k ^ mix(x))
        order = np.argsort(self.name)
        status = np.where(n > 1, ALL, 0) | np.where(wide, LOOK, 0)
        told_name = mix(told["k"] ^ mix(told["x"]))
        at = np.searchsorted(self.name[order], told_name)
        ok = (at < len(order)) & (self.name[order][np.minimum(at, max(len(order) - 1, 0))] == told_name) if len(order) else np.zeros(len(told), bool)
        status[order[at[ok]]] |= told["status"][ok]
        self.name, self.status = self.name[order], status[order]

    def of(self, parse: Parse) -> np.ndarray:
        return self.status[np.searchsorted(self.name, mix(parse.k ^ mix(parse.x)))]


def _looked_at(texts: pa.Table, lookup: Lookup, length: int, gram: int):
    """Names of the suffixes of the group's distinct phrases that must be looked at."""
    seen = np.zeros(0, np.uint64)
    for parse, *_ in _parses(texts, length, gram):
        name = mix(parse.k ^ mix(parse.x))
        which = np.flatnonzero(lookup.of(parse) & LOOK)
        which = which[np.sort(np.unique(name[which], return_index=True)[1])]
        new = which[~np.isin(name[which], seen)]
        seen = np.concatenate([seen, name[new]])
        _, h, g = parse.suffixes(new)
        yield h, g, lookup.of(parse)[new].repeat(parse.count[new]) & ALL


def ask_suffixes(texts: pa.Table, told: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    if not texts.num_rows or not told.num_rows:
        return table({"b": [], "g": [], "data": []}, packed("b", "g"))
    me = texts["g"][0].as_py()
    lookup = Lookup(texts, _joined((d.as_buffer() for d in told["data"]), TOLD), length, gram)
    parts = list(_looked_at(texts, lookup, length, gram))
    if not parts:
        return table({"b": [], "g": [], "data": []}, packed("b", "g"))
    h, g, many = (np.concatenate([p[i] for p in parts]) for i in range(3))
    h, g, n, many = _counted(h, g, many)
    out = np.zeros(len(h), WINDOW)
    out["h"], out["g"], out["many"] = h, g, (n > 1) | many
    b, data = deal((h % np.uint64(buckets)).astype(np.int64), buckets, out)
    return table({"b": b, "g": [me] * len(b), "data": data}, packed("b", "g"))


def _counted(h, g, many):
    order = np.lexsort((g, h))
    h, g, many = h[order], g[order], many[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(first)
    if not len(first):
        return h, g, np.zeros(0, int), many > 0
    return h[first], g[first], np.diff(np.append(first, len(h))), np.maximum.reduceat(many, first) > 0


def answer_suffixes(rows: pa.Table) -> pa.Table:
    groups = rows["g"].to_numpy()
    parts = [np.frombuffer(d.as_buffer(), WINDOW) for d in rows["data"]]
    ask, who = np.concatenate(parts), np.repeat(groups, [len(p) for p in parts])
    order = np.lexsort((ask["g"], ask["h"]))
    ask, who = ask[order], who[order]
    first = np.ones(len(ask), bool)
    first[1:] = (ask["h"][1:] != ask["h"][:-1]) | (ask["g"][1:] != ask["g"][:-1])
    name = np.cumsum(first) - 1
    again = (np.bincount(name, np.where(ask["many"] > 0, 2, 1)) > 1)[name]
    out = np.zeros(int(again.sum()), HIT)
    out["h"], out["g"] = ask["h"][again], ask["g"][again]
    return _answers(out, who[again], 1)


def _hits(h, g, hit: np.ndarray) -> np.ndarray:
    """Which (h, g) are in hit (sorted by h; equal h with other g are told apart)."""
    out = np.zeros(len(h), bool)
    at = np.searchsorted(hit["h"], h)
    while True:
        live = np.flatnonzero((at < len(hit)) & ~out)
        live = live[hit["h"][at[live]] == h[live]]
        if not len(live):
            return out
        out[live] = hit["g"][at[live]] == g[live]
        at[live] += 1


SPANS = pa.schema([("row_id", pa.string()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def cut(texts: pa.Table, told: pa.Table, length: int, gram: int, passed: list[str], schema: pa.Schema) -> pa.Table:
    """Spans of repeated bytes and the bytes kept, per text of a group."""
    if not texts.num_rows:
        return schema.empty_table()
    data, offsets = text_buffer(texts["text"])
    kinds, blobs = told["b"].to_numpy(), [d.as_buffer() for d in told["data"]]
    phrases = _joined((d for d, k in zip(blobs, kinds, strict=True) if k == 0), TOLD)
    hit = np.sort(_joined((d for d, k in zip(blobs, kinds, strict=True) if k == 1), HIT), order="h")
    lookup = Lookup(texts, phrases, length, gram)
    delta = np.zeros(len(data) + 1, np.int32)
    for parse, _, _, begin in _parses(texts, length, gram):
        status = lookup.of(parse)
        whole = np.flatnonzero(status & ALL)
        np.add.at(delta, begin + parse.begin[whole], 1)
        np.add.at(delta, begin + parse.begin[whole] + parse.count[whole] + length - 1, -1)
        part = np.flatnonzero((status & (ALL | LOOK)) == LOOK)
        start, h, g = parse.suffixes(part)
        start = start[_hits(h, g, hit)] + begin
        np.add.at(delta, start, 1)
        np.add.at(delta, start + length, -1)
    gone = np.cumsum(delta[:-1]) > 0
    del delta
    step = np.diff(gone.astype(np.int8))
    rise = gone.copy()
    rise[1:] = step > 0
    fall = gone.copy()
    fall[:-1] = step < 0
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(gone))]
    both = inner[gone[inner] & gone[inner - 1]]  # a span ends where its text does
    rise[both] = True
    fall[both - 1] = True
    starts, ends = np.flatnonzero(rise), np.flatnonzero(fall) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(texts.num_rows + 1))
    base = offsets[owner]
    spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["start", "end"]))
    keep = ~gone
    left = np.concatenate([[0], np.cumsum(keep)])[offsets]
    kept = pa.Array.from_buffers(pa.large_binary(), texts.num_rows, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())])
    columns = [texts[c] for c in passed] + [pa.array(np.diff(offsets)), spans, kept.cast(pa.binary())]
    return pa.table(dict(zip(schema.names, columns, strict=True))).cast(schema)


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 200, gram: int = 64, groups: int | None = None, buckets: int | None = None, group_bytes: int = 64 << 20) -> DataFrame:
    """(id, n_bytes, spans, kept): each text's bytes without those covered by a `length`-byte string that also starts
    elsewhere in the corpus, same text included. spans lists the removed runs, kept holds the other bytes.

    Every row of `docs` is a text of its own: repeated rows and ids repeat each other and keep their rows. A null text
    is an empty one, a null id is passed on, other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    if groups is None:  # a group's texts are in memory together
        size = docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
        groups = max(2 * n_partitions(spark), -(-size // group_bytes))
    buckets = buckets or n_partitions(spark)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    own = own.withColumn("g", F.pmod(F.xxhash64("id", F.length("text"), F.substring("text", 1, 64)), F.lit(groups)).cast("int"))
    id_type = docs.schema[id_col].dataType
    schema = pa.schema([("id", texts_type(id_type)), *list(SPANS)[1:]])
    dealt = "b int, g int, data binary"
    told = "g int, b int, data binary"

    def ask1(t):
        return ask_phrases(t, buckets, length, gram)

    def ask2(a, b):
        return ask_suffixes(a, b, buckets, length, gram)

    def last(a, b):
        return cut(a, b, length, gram, ["id"], schema)

    first = own.groupBy("g").applyInArrow(ask1, dealt).groupBy("b").applyInArrow(answer_phrases, told)
    second = own.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(ask2, dealt).groupBy("b").applyInArrow(answer_suffixes, told)
    out = own.groupBy("g").cogroup(first.unionByName(second).groupBy("g")).applyInArrow(last, f"id {id_type.simpleString()}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def texts_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def spans_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and the hash of what remove_repeats gives."""
    return found.select(
        id_col,
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
