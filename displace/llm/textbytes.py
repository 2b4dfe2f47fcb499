"""Numpy helpers over the bytes of many texts at once, and the bucketed exchange built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at together; longer texts are cut into overlapping segments.
SEGMENT = 1 << 20

_rng = np.random.default_rng(20240607)
_TAB = [_rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1]
_POWERS: dict = {}


def powers(which: int, n: int):
    """(base**i, base**-i) modulo 2**64 for i < n; the base is odd, so it has an inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT + 4096)
        out = []
        for base in (_BASE[which], pow(_BASE[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[which] = have = tuple(out)
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Rolling:
    """Polynomial hashes of any stretch of a byte array, all starts at once."""

    def __init__(self, data: np.ndarray, which: int):
        p, self.inverse = powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TAB[which][data] * p[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def every(self, size: int) -> np.ndarray:
        h = (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]
        return mix(h + np.uint64(size * 0x2545F4914F6CDD1D & (2**64 - 1)))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, in linear time (block prefix and suffix minima)."""
    n = len(v) - width + 1
    if n <= 0:
        return v[:0]
    rows = -(-len(v) // width)
    padded = np.full(rows * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    grid = padded.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts together, offsets): no Python object per text. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(offsets: np.ndarray, overlap: int, limit: int = SEGMENT):
    """Yield (first text, last text + 1, begin, end, skip): byte ranges of whole texts up to `limit`, or parts of one
    longer text that overlap by `overlap` bytes; skip is the begin's place in its text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        if offsets[i + 1] - offsets[i] > limit:
            size, at = int(offsets[i + 1] - offsets[i]), 0
            while at == 0 or at + overlap < size:
                end = min(size, at + limit)
                yield i, i + 1, int(offsets[i]) + at, int(offsets[i]) + end, at
                at = end - overlap
                if end == size:
                    break
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, int(offsets[i]), int(offsets[j]), 0
        i = j


#: What `bytes.split()` and `bytes.lower()` do, for byte arrays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, starts, ends, owner) of the words, runs without ASCII white space, of texts that lie side by side."""
    low = LOWER[data]
    inside = ~SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    begin, stop = np.zeros(len(low), bool), np.zeros(len(low), bool)
    if len(low):
        begin[0] = inside[0]
        begin[1:] = inside[1:] & (~inside[:-1] | edge[1:-1])
        stop[-1] = inside[-1]
        stop[:-1] = inside[:-1] & (~inside[1:] | edge[1:-1])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def spare_name(name: str, taken: list[str]) -> str:
    """name, with underscores after it until no column has it (in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def table(rows: dict, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


PACKED = "{key} int, {to} int, data binary"


def packed(key: str, to: str) -> pa.Schema:
    return pa.schema([(key, pa.int32()), (to, pa.int32()), ("data", pa.binary())])


def deal(bucket: np.ndarray, n_buckets: int, record: np.ndarray):
    """Split a structured array by bucket: (bucket numbers, one bytes object each)."""
    order = np.argsort(bucket, kind="stable")
    record = record[order]
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    keep = [b for b in range(n_buckets) if cuts[b + 1] > cuts[b]]
    return keep, [record[cuts[b] : cuts[b + 1]].tobytes() for b in keep]


def word_segments(data: np.ndarray, offsets: np.ndarray, limit: int = SEGMENT):
    """Yield (first text, last text + 1, begin, end): whole texts up to `limit` bytes together; a longer text in parts that end
    after white space, so that no word is cut."""
    n, i = len(offsets) - 1, 0
    while i < n:
        if offsets[i + 1] - offsets[i] > limit:
            at, stop = int(offsets[i]), int(offsets[i + 1])
            while at < stop:
                end = min(stop, at + limit)
                if end < stop:
                    spaces = np.flatnonzero(SPACE[data[at:end]])
                    if len(spaces):
                        end = at + int(spaces[-1]) + 1
                    else:
                        later = np.flatnonzero(SPACE[data[end:stop]])
                        end = end + int(later[0]) + 1 if len(later) else stop
                yield i, i + 1, at, end
                at = end
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, int(offsets[i]), int(offsets[j])
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, limit: int = SEGMENT):
    """Yield (owner text, 64-bit name, name of the last three bytes) of all words, segment by segment in order."""
    for i, j, begin, end in word_segments(data, offsets, limit):
        inner = np.clip(offsets[i : j + 1], begin, end) - begin
        low, starts, ends, owner = words(data[begin:end], inner)
        roll = Rolling(low, 0)
        yield owner + i, roll.at(starts, ends), roll.at(np.maximum(starts, ends - 3), ends)
