"""Whitening, packing and spelling variants against brute force."""

from __future__ import annotations

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from displace.llm import packing, variants, whitening
from displace.llm.queries import BYTES

c = F.col

# whitening

VECTORS = "vec_id long, embedding array<float>, n long, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 5, "clash") for i, v in rows], VECTORS).repartition(3)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((300, 40)) * np.linspace(3, 0.5, 40) + 2
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(a.astype(np.float32))]
    return [*rows, rows[0], (0, rows[1][1]), (None, rows[2][1]), (900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [])]


def whole_vectors(rows):
    keep = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    return [i for i, _ in keep], np.floor(1024 * np.array([v for _, v in keep], np.float64)).astype(np.int64) + 100000


@pytest.mark.parametrize("block,gather", [(None, None), (12, None), (12, 0)])
def test_whitening_equals_dense_eigenvectors(spark, cloud, block, gather, monkeypatch):
    if gather is not None:  # sums of tasks are added by Spark first
        monkeypatch.setattr(whitening, "GATHER", gather)
    got = whitening.whiten(vectors(spark, cloud), block=block).collect()
    ids, x = whole_vectors(cloud)
    n, centred = len(x), x - x.mean(0)
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    want = centred @ q / np.sqrt(e)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, x.sum(0), strict=True)) for v in x]
    key = lambda i, d: (i is None, i or 0, d)
    by_row = sorted(((ids[k], exact[k], want[k]) for k in range(n)), key=lambda r: key(r[0], r[1]))
    found = collections.defaultdict(list)
    for r in got:
        assert str(r.deviation) == r.deviation_wide
        found[r.component].append(r)
    for j in range(8):
        rows = sorted(found[j + 1], key=lambda r: key(r.vec_id, r.deviation))
        assert [(r.vec_id, r.deviation) for r in rows] == [(i, d) for i, d, _ in by_row]
        own, told = np.array([w[j] for _, _, w in by_row]), np.array([r.whitened for r in rows])
        assert min(np.abs(told - own).max(), np.abs(told + own).max()) < 1e-8
        assert abs(rows[0].explained / (e[j] / np.trace(centred.T @ centred / n)) - 1) < 1e-10
    assert got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    none = whitening.whiten(vectors(spark, [(1, None), (2, [])]))
    assert none.columns[:2] == ["vec_id", "component"] and none.count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 4)).collect()
    assert len(same) == 8 and {(r.component, r.deviation, r.whitened, r.explained) for r in same} == {(1, 0, None, None), (2, 0, None, None)}
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_wide_deviations_are_exact():
    centre = whitening.Centre(1 << 40, [5 << 40], 1 << 30)
    assert not centre.small and centre.away(np.array([[7]]))[0, 0] == (2 << 40)


def test_leading_pairs_with_close_and_missing_eigenvalues():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for e in (np.concatenate([[9, 9 - 1e-4, 5], np.linspace(4.9, 0.1, 57)]), np.concatenate([[3, 2, 1], np.zeros(57)])):
        v = (q * e) @ q.T
        got, w = whitening.leading(lambda x, v=v: v @ x, 60, 6, 12)
        assert np.abs(got - np.sort(e)[::-1][:6]).max() < 1e-12 and np.abs(v @ w - w * got).max() < 1e-11


# packing


@pytest.fixture(scope="module")
def vocabulary():
    with open(BYTES, encoding="utf-8") as f:
        return f.read()


def packed_right(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity,group", [(2048, 4096), (64, 4096), (64, 8)])
def test_packing(spark, docs, texts, vocabulary, capacity, group):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(vocabulary)
    rows = packing.pack(packing.pieces(docs, vocabulary, capacity), capacity, group).collect()
    want = collections.Counter()
    for i, t in texts:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = packing.cuts(len(ids), capacity)
        sizes = np.diff([*at, len(ids)]).tolist()
        assert 1 <= sizes[0] <= capacity and all(n == capacity for n in sizes[1:])
        for j, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
            want[i, j, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n, least = packed_right(rows, capacity), -(-sum(r.length for r in rows) // capacity)
    assert n <= least * 1.2 + 2
    if group == 8:  # half-empty bins of groups are packed together
        assert n < sum(1 for _ in range(0, len(rows), 8)) + least


def test_place_makes_the_sum_of_squares_smallest():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 31) for _ in range(200)), reverse=True)
    bins, offsets = packing.place(np.array(lengths), 30)
    fill = {}
    for size, own, at in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        square = lambda f: sum(k * k for k in collections.Counter(30 - v for v in f.values() if v < 30).values())
        room = {b: square(fill | {b: f + size}) for b, f in fill.items() if f + size <= 30}
        assert at == fill.get(own, 0)
        assert own not in fill and not room or room[own] == min(room.values())
        fill[own] = fill.get(own, 0) + size


def test_packing_edges(spark, docs, empty, vocabulary):
    assert packing.pack_documents(empty, vocabulary).count() == 0
    clash = packing.pieces(docs, vocabulary).withColumn("offset", F.lit("x")).withColumn("other", F.lit("kept"))
    got = packing.pack(clash)
    assert dict(got.dtypes)["offset"] == "bigint" and got.where("other = 'kept'").count() == clash.count()
    two = spark.createDataFrame([(None, "a b"), (None, None), (3, "a<|endoftext|>b")], "doc_id long, text string")
    held = packing.pack_documents(two, vocabulary, 4, keep_ids=True)
    whole = [x for r in packing.sequences(held).collect() for x in r.ids]
    assert sorted(whole) == sorted(x for r in held.collect() for x in r.ids) and 50256 in whole
    assert all(len(r.ids) <= 4 for r in packing.sequences(held).collect())


def test_white_space_that_is_too_long_for_the_fast_encoder(vocabulary):
    own = packing.ByteVocabulary(vocabulary)
    assert own.encode(" " * 600000 + "x") == own.slow.encode(" " * 600000 + "x", add_special_tokens=False).ids


# spelling variants


def brute(rows, least=5, times=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in seen.items() if len(w) >= least and n >= times}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, count = {}, {}
    for w in words:
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w], count[w] = best if best and words[best] >= 2 * words[w] else None, len(close)
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], count[w], words[form[w]] if form[w] else None))
    return out


def spelled():
    rng = random.Random(9)
    base = ["banana", "letters", "aaaaaa", "école", "colour", "ÀÉÎÕÜ", "x" * 700, "zzzzz", "abcabc", "shelve"]
    rows = []
    for k in range(500):
        said = []
        for _ in range(12):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i, a = rng.randrange(len(w) + 1), rng.choice("abez")
                w = rng.choice([w[:i] + a + w[i:], w[:i] + w[i + 1 :], w[:i] + a + w[i + 1 :]])
            said.append(rng.choice([w, w.upper()]))
        rows.append((k, " ".join(said)))
    return [*rows, rows[3], rows[3], (None, rows[4][1]), (700, None), (701, ""), (702, "- 1 ,")]


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_variants_equal_brute_force(spark, partitions):
    rows = spelled()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [tuple(r) for r in variants.spelling_variants(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(r[1] and r[1] != r[2] for r in got)  # a chain of forms


def test_variants_edges(docs, texts, empty):
    assert variants.spelling_variants(empty).count() == 0
    assert {tuple(r) for r in variants.spelling_variants(docs).collect()} == brute(texts)


def test_nodes_are_prefixes_across_partitions():
    words = sorted({"a" * k for k in range(1, 9)} | {"aaab", "aaabc", "aaabd", "aab", "b", "ba", "baa", "baab", "baabc", "bb"})
    for size in (1, 2, 3, 5, 30):
        parts = [words[a : a + size] for a in range(0, len(words), size)]
        numbering = variants.Numbering([(2 * p, w[0], w[-1]) for p, w in enumerate(parts)])
        of = {}
        for p in reversed(range(len(parts))):  # partitions run in any order
            numbering.start(2 * p)
            for w in parts[p]:
                for depth, node in enumerate(numbering.nodes(w).tolist()):
                    assert of.setdefault(w[:depth], node) == node
        assert len(set(of.values())) == len(of)


def test_vocabulary_is_outside_the_repository():
    assert os.path.isabs(BYTES)
