"""The text operators against brute force on a small corpus with nulls, ties, copies and a long text, and on an empty one."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from displace.llm import decontaminate, gru, imatch, language_model, linear, near_copies, pieces, quality, repeats, secrets, simhash, textbytes, toxicity, warc

c = F.col


def raw(texts):
    return [(i, (t or "").encode()) for i, t in texts]


# byte helpers


def test_words_and_hashes_agree_with_split():
    data = [b"One two\tTHREE", b"", b"  x\n\ny ", "É a".encode()]
    offsets = np.cumsum([0, *map(len, data)])
    low, s, e, o = textbytes.words(np.frombuffer(b"".join(data), np.uint8), offsets)
    got = [(int(k), low[a:b].tobytes()) for a, b, k in zip(s, e, o, strict=True)]
    assert got == [(i, w) for i, d in enumerate(data) for w in d.lower().split()]


def test_segments_cover_long_texts():
    offsets = np.array([0, 5, 5, 45, 50])
    parts = list(textbytes.segments(offsets, 3, 10))
    covered = sorted({p for _, _, a, b, _ in parts for p in range(a, b)})
    assert covered == list(range(50)) and all(b - a <= 10 for _, _, a, b, _ in parts)


def test_sliding_min():
    v = np.random.default_rng(0).integers(0, 50, 101)
    for w in (1, 2, 7, 101, 102):
        assert textbytes.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(max(0, 102 - w))]


# repeated strings


@pytest.mark.parametrize("length,gram,limit", [(200, 64, None), (40, 12, None), (40, 12, 130)])
def test_repeats_equal_brute_force(docs, texts, length, gram, limit, monkeypatch):
    if limit:  # long texts in several segments
        monkeypatch.setattr(repeats, "segments", lambda o, n: textbytes.segments(o, n, limit))
    seen = collections.Counter(b[k : k + length] for _, b in raw(texts) for k in range(len(b) - length + 1))
    want = []
    for i, b in raw(texts):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        want.append((i, len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = repeats.remove_repeats(docs, length=length, gram=gram, groups=5, buckets=3).collect()
    assert sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got) == sorted(want)


def test_repeats_of_nothing(empty):
    assert repeats.spans_digest(repeats.remove_repeats(empty)).collect() == []


# decontamination


def _words(t):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in (t or ""))
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def test_contamination_equals_brute_force(spark, docs, texts):
    base = [t for i, t in texts if i >= 300 and i < 303]
    items = [(0, " ".join(_words(base[0])[15:45])), (1, " ".join(_words(base[1])[2:16])), (2, "theta"), (3, "iota kappa"), (4, None), (5, "..."), (6, "theta"), (7, " ".join(["alpha"] * 20))]
    table = spark.createDataFrame(items, "item_id int, text string")
    got = {}
    for r in decontaminate.contamination_digest(decontaminate.contaminated_words(docs, table)).collect():
        got[r.doc_id] = (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
    for i, t in texts:
        w, hit, own = _words(t), set(), set()
        for k, it in items:
            v = _words(it)
            n = min(13, len(v))
            wins = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    own.add(str(k))
        assert got[i] == (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)), i


def test_contamination_without_items(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contaminated_words(docs, none).collect()} == {0}
    assert decontaminate.contaminated_words(empty, none).collect() == []


# SimHash and near copies


def _fingerprint(b, words):
    w = b.lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _components(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            m = min([low[a], *(low[b] for b in linked[a])])
            if m < low[a]:
                low[a], changed = m, True
    return low


@pytest.mark.parametrize("tile", [2048, 2])
def test_simhash_equals_brute_force(docs, texts, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    fp = {i: _fingerprint(b, 3) for i, b in raw(texts)}
    for radius in (2, 5):
        low = _components(sorted(fp), {a: [b for b in fp if (fp[a] ^ fp[b]).bit_count() <= radius] for a in fp})
        got = simhash.simhash_components(docs, radius=radius).collect()
        assert len(got) == len(texts)
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", low[i]) for i in fp}


def test_simhash_of_nothing(empty):
    assert simhash.simhash_components(empty).collect() == []


@pytest.mark.parametrize("sets", [1024, 3])
def test_near_copies_equal_brute_force(docs, texts, sets, monkeypatch):
    monkeypatch.setattr(near_copies, "SETS", sets)
    own = {i: set(near_copies.shingles(b, 5).tolist()) for i, b in raw(texts)}
    near = {a: [b for b in own if (not own[a] and not own[b]) or (own[a] or own[b]) and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])] for a in own}
    assert {r.doc_id: r.group for r in near_copies.near_copy_groups(docs).collect()} == _components(sorted(own), near)


@pytest.mark.parametrize("only_a, only_b, both", [(0, 1, 4), (1, 1, 4), (2, 0, 3), (0, 0, 5), (3, 2, 6)])
def test_bit_differs_equals_every_case(only_a, only_b, both):
    n = only_a + only_b + both
    bits = np.array(list(itertools.product((0, 1), repeat=n)))
    a = 2 * (bits[:, :only_a].sum(1) + bits[:, only_a + only_b :].sum(1)) > only_a + both
    b = 2 * bits[:, only_a:].sum(1) > only_b + both
    assert near_copies.bit_differs(only_a, only_b, both) == pytest.approx((a != b).mean())


def test_short_texts_of_the_asked_similarity_lie_within_the_radius():
    """Eight words against nine: 4 of 5 shingles in common, and the fours' ties are zero bits."""
    radius = near_copies.radii(0.8, 64 * near_copies.WORDS)
    h = np.random.default_rng(5).integers(0, 2**64, (3000, 5), np.uint64)
    far = [(int.from_bytes(near_copies.wide_fingerprint(v), "little") ^ int.from_bytes(near_copies.wide_fingerprint(v[:4]), "little")).bit_count() for v in h]
    assert max(far) <= max(radius[4], radius[5])
    assert max(far) > radius[-1]  # the radius of long texts would miss some
    assert (radius[1:4] == 0).all() and radius[-1] < 70


def test_near_copies_judge_every_text_by_its_own_shingles(spark):
    """Many short texts a word apart: whatever share a fingerprint, groups are those of the texts."""
    rng = np.random.default_rng(6)
    word = np.array([f"w{i}" for i in range(40)])
    base = [" ".join(rng.choice(word, n)) for n in (8, 9, 12, 16, 25, 60) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base + [t + " more" for t in base] + ["first " + t for t in base] + [t.replace(" ", "  ").upper() for t in base])]
    own = {i: set(near_copies.shingles(t.encode(), 5).tolist()) for i, t in rows}
    near = {a: [b for b in own if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])] for a in own}
    got = near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group for r in got} == _components(sorted(own), near)


# language model


def test_base_scores_and_model(docs, texts, empty):
    got = {r.doc_id: r for r in language_model.score_texts(docs, n_words=64, per_class=8, n_tails=4, rounds=2).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    count = collections.Counter(w for i, b in raw(texts) if not held[i] for w in [*b.lower().split(), None])
    n, v = sum(count.values()), len(count)
    for i, b in raw(texts):
        w = [*b.lower().split(), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert language_model.score_texts(empty).collect() == []


def test_scores_equal_a_loop_over_tokens(monkeypatch, docs, texts):
    """The trained model's score of every text, token by token in plain Python: gates, class, word, and the tail's own unigram."""
    kept = {}
    train = language_model.train

    def spy(encoded, model, *more):
        train(encoded, model, *more)
        kept["p"] = {k: v.astype(float) for k, v in model.p.items()}

    monkeypatch.setattr(language_model, "train", spy)
    sizes = dict(n_words=32, per_class=8, n_tails=4, hidden=5)
    encoded = language_model.materialize
    monkeypatch.setattr(language_model, "materialize", lambda df, name: kept.setdefault("encoded", encoded(df, name)))
    got = {(r.doc_id, r.n_tokens): r.score for r in language_model.score_texts(docs, rounds=2, **sizes).collect()}
    p, k = kept["p"], 5
    sig = lambda v: 1 / (1 + np.exp(-v))
    soft = lambda v: v - np.log(np.exp(v - v.max()).sum()) - v.max()
    for r in kept["encoded"].collect():
        h, before, total = np.zeros(k), 0, 0.0
        for t in np.frombuffer(r.tokens, "<u2").tolist():
            x = p["table"][before] + p["b"]
            z, q = sig(x[:k] + h @ p["u"][:, :k]), sig(x[k : 2 * k] + h @ p["u"][:, k : 2 * k])
            n = np.tanh(x[2 * k :] + q * (h @ p["u"][:, 2 * k :]))
            h = n + z * (h - n)
            cls = t // 8 if t < 32 else 4 + t - 32
            total += soft(h @ p["class_w"] + p["class_b"])[cls]
            if t < 32:
                total += soft(h @ p["word_w"][cls] + p["word_b"][cls])[t % 8]
            before = t
        assert math.isclose(got[r.id, r.n_tokens], total / math.log(10) + r.tail_score, rel_tol=1e-4), r.id


def test_partitions_do_not_change_the_model(spark, docs):
    sizes = dict(n_words=32, per_class=8, n_tails=4, hidden=5, rounds=2, group_bytes=4000)
    few = {(r.doc_id, r.n_tokens): r.score for r in language_model.score_texts(docs.repartition(2), **sizes).collect()}
    many = {(r.doc_id, r.n_tokens): r.score for r in language_model.score_texts(docs.repartition(9), **sizes).collect()}
    assert few.keys() == many.keys() and all(math.isclose(few[k], many[k], rel_tol=1e-4) for k in few)


def test_untrained_model_is_unigram_and_gradient_is_right():
    rng = np.random.default_rng(1)
    m = gru.Gru(8, 4, 3, 3)
    counts = rng.integers(1, 40, 11)
    m.start(counts[:8], counts[8:])
    tokens = rng.integers(0, 11, (4, 5))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    h = np.zeros((5, 3))
    fresh = np.zeros((4, 5), bool)
    fresh[2, 1] = True
    g, _, base = m.gradient(tokens, fresh, np.roll(tokens, -1, 0), h)
    for name in ("u", "b", "class_w", "class_b", "word_w", "word_b"):
        at = tuple(0 for _ in m.p[name].shape)
        eps = 1e-3
        m.p[name][at] += eps
        up = m.gradient(tokens, fresh, np.roll(tokens, -1, 0), h)[2]
        m.p[name][at] -= 2 * eps
        down = m.gradient(tokens, fresh, np.roll(tokens, -1, 0), h)[2]
        m.p[name][at] += eps
        assert abs(-(up - down) / (2 * eps) - g[name][at]) < 2e-3, name


def test_state_is_carried_across_windows():
    m = gru.Gru(8, 4, 3, 4)
    m.start(np.arange(1, 9), np.arange(1, 4))
    tokens = np.random.default_rng(2).integers(0, 11, 50)
    offsets = np.array([0, 20, 20, 50])
    assert np.allclose(m.score(tokens, offsets, 7), m.score(tokens, offsets, 64), atol=1e-5)


def test_pipeline_near_copies_keeps_documents_without_an_id(spark):
    import corpus_pipeline

    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (None, "another text"), (None, None)], "doc_id long, text string")
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("1", text), ("None", text), ("None", "another text"), ("None", "None")])


@pytest.mark.parametrize("n", [0, 1, 5, 7, 50, 2048 * 5 + 3])
def test_training_uses_each_token_once(n, monkeypatch):
    m = gru.Gru(8, 4, 3, 4)
    m.start(np.arange(1, 9), np.arange(1, 4))
    used, losses = [], gru.Gru.losses

    def spy(self, states, targets, grads=None):
        used.extend(targets.tolist())
        return losses(self, states, targets, grads)

    monkeypatch.setattr(gru.Gru, "losses", spy)
    tokens = np.random.default_rng(n).integers(0, 11, n)
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    assert math.isfinite(m.train(tokens, fresh, 16))
    assert collections.Counter(used) == collections.Counter(tokens.tolist())


# classifiers


def _labelled(spark, n=400):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        bad = bool(rng.random() < 0.3)
        w = [f"w{k}" for k in rng.integers(0, 60, 30)]
        if bad:
            w[int(rng.integers(0, 30))] = f"vileword{rng.integers(0, 9)}"
        rows.append((i, " ".join(w) + (" a woman said so." if i % 4 == 0 else "")))
        labels.append((i, int(not bad), int(bad)))
    rows += [(n, None), (n + 1, ""), (None, "w1")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (n + 5, None, None)], "doc_id long, quality int, toxic int")


def test_features_of_long_texts_are_told_once():
    texts = ["a b a", "", "word " * 250_000 + "other", "b word", "x" * 1_200_000 + " a", ""]
    data, offsets = textbytes.text_buffer(pa.array([t.encode() for t in texts], pa.large_binary()))
    owner, f = linear.distinct_hits(data, offsets, (2,), np.arange(linear.SIZE))
    alone = [linear.distinct_hits(*textbytes.text_buffer(pa.array([" ".join(sorted(set(t.split()))).encode()], pa.large_binary())), (2,), np.arange(linear.SIZE))[1] for t in texts]
    assert np.split(f, np.searchsorted(owner, np.arange(1, len(texts))))[2].tolist() == alone[2].tolist()
    assert owner.tolist() == np.repeat(np.arange(len(texts)), [len(v) for v in alone]).tolist() and f.tolist() == np.concatenate(alone).tolist()
    none = linear.distinct_hits(*textbytes.text_buffer(pa.array([], pa.large_binary())), (2,), np.arange(linear.SIZE))
    assert [len(v) for v in none] == [0, 0]


def test_toxicity_on_held_out_rows(spark, empty):
    docs, labels = _labelled(spark)
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    every = toxicity.score_toxicity(docs, labels).collect()
    assert len(every) == 403 and all(0 <= r.score <= 1 for r in every)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score_toxicity(empty.select("doc_id", "text"), labels).collect() == []


def _mentioning(spark, n=600):
    """Labelled rows in which a mention of women goes with label 1 most of the time, and of men with label 0."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        bad = bool(rng.random() < 0.4)
        w = " ".join(f"w{k}" for k in rng.integers(0, 60, 20)) + (f" vileword{rng.integers(0, 9)}" if bad and rng.random() < 0.8 else "")
        group = "woman" if bad == bool(rng.random() < 0.9) else "man"
        rows.append((i, f"{w}. The {group} went home."))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_counterfactual_penalty_evens_out_identity_terms(spark):
    docs, labels = _mentioning(spark)
    probe = [(9001, "the woman went home"), (9002, toxicity.swapped("the woman went home")), (9003, "a woman, w3 w5 w9"), (9004, toxicity.swapped("a woman, w3 w5 w9")), (9005, "w3 vileword2 w5")]
    probe = spark.createDataFrame(probe, "doc_id long, text string")
    moved = {}
    for k in (0.0, 10.0):
        s = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.unionByName(probe), labels, keep_equal=k).where("doc_id > 9000").collect()}
        moved[k] = max(abs(s[9001] - s[9002]), abs(s[9003] - s[9004]))
        assert s[9005] > 0.7
    assert moved[0.0] > 0.2 and moved[10.0] < 0.05  # without the penalty the mention decides
    assert toxicity.swapped("Woman and womanly") == "man and womanly"


def test_logistic_fit_is_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 6, 3)) if i % 7 else np.zeros(0, np.int64) for i in range(80)]
    x, y = linear.Sparse(rows, 6), (rng.random(80) < 0.5).astype(float)
    dense = np.zeros((80, 6))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    assert np.allclose(x.times(np.arange(6.0)), dense @ np.arange(6.0)) and np.allclose(x.back(y), dense.T @ y)
    w, b = linear.fit_logistic(x, y, ridge=0.01, tolerance=1e-8)
    r = (linear.logistic(dense @ w + b) - y) / 80
    assert np.abs(dense.T @ r + 0.01 * w).max() < 1e-5 and abs(r.sum()) < 1e-5


def test_cotraining_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "f": F.lit(7), "_row": F.lit("clash"), "label": F.lit(1)})
    docs = docs.unionByName(docs.where("doc_id = 3"))
    rows = quality.score_quality(docs, labels).drop("label").join(labels, "doc_id", "left").collect()
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert len(rows) == 404 and {(r.f, r["_row"]) for r in rows} == {(7, "clash")} and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1  # repeated rows
    assert len({r.score for r in rows if r.doc_id in (400, 401)}) == 1 and sum(r.doc_id is None for r in rows) == 1  # null and empty texts, a null id
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).collect() == []


def test_views_teach_each_other(spark):
    """The content view alone knows a word, the metadata view alone a category; each learns the other's from unlabelled rows."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(1500):
        good = i % 2 == 0
        known = i < 300
        text = " ".join([*(f"w{k}" for k in rng.integers(0, 40, 25)), "finery" if good else "rubbish", *([] if known else ["lately" if good else "erewhile"])])
        rows.append((i, text, "s1" if good else "s2"))
        if known:
            labels.append((i, int(good)))
    probe = [(9000, "w1 w2 lately w3", "s3"), (9001, "w1 w2 erewhile w3", "s3")]
    docs = spark.createDataFrame([*rows, *probe], "doc_id long, text string, source string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    first = quality.chosen_features
    own = first(docs.select("text", (F.col("doc_id") % 2 == 0).cast("int").alias("label")), quality.PREFIXES, 8192)
    quality.chosen_features = lambda *a: own  # words that no labelled row has
    try:
        s = {k: {r.doc_id: r.content_score for r in quality.score_quality(docs, labels, rounds=k).where("doc_id >= 9000").collect()} for k in (0, 3)}
    finally:
        quality.chosen_features = first
    assert s[0][9000] - s[0][9001] < 0.1 and s[3][9000] - s[3][9001] > 0.1


def test_surest_rows_are_counted_out():
    assert quality.surest({5: 10, 4: 10, 1: 100}, 15, 3) == (4, 0.5)
    assert quality.surest({5: 10, 4: 10, 1: 100}, 50, 3) == (4, 1.0)
    assert quality.surest({1: 100}, 50, 3) == (1 << 30, 0.0)


# I-Match


def test_edits_and_equal_texts(docs, texts, empty):
    rows = imatch.imatch_report(docs, low=0.01, high=0.6).collect()
    assert len(rows) == len(texts)
    by_text = collections.defaultdict(set)
    text = {i: t or "" for i, t in texts}
    ids = sorted(text, reverse=True)
    nxt = {a: b for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    for r in rows:
        t, half = text[r.doc_id], len(text[r.doc_id]) // 2
        edited = t[: len(t) - half] + text[nxt[r.doc_id]][:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[t].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert imatch.imatch_report(empty).collect() == []


def test_fingerprints_equal_brute_force(spark, docs, texts):
    """Every subset's hash from the terms themselves, and likeness from the hashes."""
    low, high = 0.01, 0.6
    df = collections.Counter(h for r in docs.select(imatch.terms(F.coalesce("text", F.lit(""))).alias("t")).collect() for h in r.t)
    said = {i: set(re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").lower())) for i, t in texts}
    named = {r.w: r.h for r in spark.createDataFrame([(w,) for w in set().union(*said.values())], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert df == collections.Counter(named[w] for i, _ in texts for w in said[i])
    n = len(texts)
    kept_terms = {h for h, k in df.items() if k >= 2 and n * low <= k <= max(2, n * high)}
    assert {r.h for r in imatch.lexicon(docs, "text", low, high).collect()} == kept_terms
    rows = imatch.imatch_report(docs, low=low, high=high).collect()
    terms = {r.doc_id: sorted(set(r.t) & kept_terms) for r in docs.select("doc_id", imatch.terms(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    bits = {r.h: (r.a, r.b) for r in spark.createDataFrame([(h,) for h in kept_terms], "h long").select("h", F.xxhash64("h", F.lit(0)).alias("a"), F.xxhash64("h", F.lit(1)).alias("b")).collect()}
    subset = lambda d, s, r: [h for h in terms[d] if (bits[h][s // 8] >> (8 * (s % 8)) & 255) >> (8 - r) == 0]
    wanted = [(d, s, r, subset(d, s, r)) for d in terms for s in range(imatch.SEEDS) for r in imatch.RATES]
    hashed = spark.createDataFrame([(d, s, r, t) for d, s, r, t in wanted if t], "d long, s int, r int, t array<bigint>").select("d", "s", "r", F.lower(F.hex(F.xxhash64("t", "r"))).alias("h")).collect()
    name = {(x.d, x.s, x.r): x.h for x in hashed}
    prints = {d: [name.get((d, s, r), "-") for s in range(imatch.SEEDS) for r in imatch.RATES] for d in terms}
    ids = sorted({i for i, _ in texts}, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1], strict=True))

    def like(x, y):
        if x == y:
            return 1.0
        if x.startswith("=") or y.startswith("="):
            return 0.0
        x, y, size, told = x.split(","), y.split(","), len(imatch.RATES), []
        for s in range(imatch.SEEDS):
            pairs = [(a, b) for a, b in zip(x[s * size : (s + 1) * size], y[s * size : (s + 1) * size], strict=True) if (a, b) != ("-", "-")]
            told += [pairs[-1][0] == pairs[-1][1]] if pairs else []
        return sum(told) / len(told) if told else 0.0

    by_id = {r.doc_id: r.fingerprint for r in rows}
    for r in rows:
        assert r.fingerprint == ",".join(prints[r.doc_id]) if terms[r.doc_id] else r.fingerprint.startswith("=")
        assert math.isclose(r.near_edited, like(r.fingerprint, r.edited_fingerprint))
        assert math.isclose(r.near_next, like(r.fingerprint, by_id[following[r.doc_id]]))


def test_next_ids_of_any_kind(spark):
    rows = [-(10**18), 0, 5, 7, 7, 10**18, None]
    ids = sorted({i for i in rows if i is not None}, reverse=True)
    want = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    assert {r.id: r.next for r in imatch.next_ids(spark.createDataFrame([(i,) for i in rows], "doc_id long")).collect()} == want
    words = spark.createDataFrame([("b",), ("a",), ("c",)], "doc_id string")
    assert {r.id: r.next for r in imatch.next_ids(words).collect()} == {"a": "c", "b": "a", "c": "b"}
    assert imatch.next_ids(words.limit(0)).collect() == []


# secrets


def test_trigram_queries():
    assert secrets.trigram_query(secrets.HEX) == frozenset()
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == frozenset([frozenset([frozenset(["aki", "kia"])])])
    assert secrets.trigram_query("(abc|abd)x") == frozenset([frozenset([frozenset(["abc", "bcx"]), frozenset(["abd", "bdx"])])])


def test_secrets_equal_brute_force(spark):
    rows = [(0, 'PassWord = "abcdef123" token:xyz secret=token=abcdefgh'), (1, None), (2, ""), (3, "AKIAAKIA" + "B" * 15 + " AKIA123 é🙂 " + "0a" * 13), (4, "api-key: aaaaaaa apikey='bbbbbbbb' api_key==c"), (5, "x" * 5000 + "passwd:" + "q" * 40), (6, "-----BEGIN RSA PRIVATE KEY----- abc"), (6, "-----BEGIN RSA PRIVATE KEY----- abc")]
    got = secrets.secrets_digest(secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string"))).collect()
    base = [("assign", secrets.ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    for r in got:
        t = dict(rows)[r.doc_id] or ""
        found = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, g, least) in enumerate(base) for m in re.finditer(p.replace("(?i:", "(?ai:"), t) if len(m[g]) >= least)
        assert r.base_sha256 == hashlib.sha256(",".join(f[2] for f in found).encode()).hexdigest(), t
    redacted = {r.doc_id: r.text for r in secrets.redact(secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string"))).collect()}
    assert redacted[1] is None and redacted[5] == "x" * 5000 + "[secret]" and redacted[6] == "[secret] abc"


def test_postings_intersect(spark, empty):
    rules = (secrets.Rule("one", "(abc|abd)xyz"), secrets.Rule("two", "xyz[0-9]+secret"), secrets.Rule("any", "[0-9]+"))
    rows = [(1, "abcxyz"), (2, "abd, cxy xyz"), (3, "ABDXYZ1SECRET"), (4, "xyz secret"), (5, "nothing"), (6, ""), (3, "ABDXYZ1SECRET")]
    own = spark.createDataFrame(rows, "k long, t string")
    index = secrets.postings(own, "k", "t", rules)
    names = secrets._grams(rules)
    assert sorted((names[r.gram], r.k) for r in index.collect()) == sorted({(g, k) for k, t in rows for g in names if g in t.lower()})
    assert {r.k: sorted(r.rules) for r in secrets.candidates(index, "k", rules).collect()} == {1: [0], 3: [0, 1], 4: [1]}
    assert secrets.find_secrets(empty).collect() == []
    clash = spark.createDataFrame([(1, "token=abcdefgh", "r", "k", "s"), (None, "token=abcdefgh", None, None, None)], "doc_id long, text string, rules string, _key string, secrets string")
    got = secrets.find_secrets(clash).collect()
    assert got[0].__fields__ == ["doc_id", "text", "rules", "_key", "secrets"] and all([tuple(x) for x in r.secrets] == [(0, "assign", 14)] for r in got)


# pieces


def _best(model, text):
    """Score of the best segmentation by plain dynamic programming."""
    score = {p: s for p, s, _ in model.pieces}
    penalty = min(score.values()) - pieces.UNKNOWN_PENALTY
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 20), j):
            s = score.get(text[i:j], penalty if j - i == 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_pieces_are_best_and_come_back(spark, docs, texts):
    path = "/opt/tokenizers/piece_bpe_32k.model"
    pytest.importorskip("sentencepiece")
    model = pieces.Model.load(path)
    coder = pieces.Coder(model)
    score = {i: s for _, s, i in model.pieces}
    for t in ("the quick brown fox", "  two  spaces ", "naïve\nline", "a"):
        ids = np.frombuffer(coder.encode(t), "<i4").tolist()
        marked = "▁" + t.replace(" ", "▁")
        unknown = sum(ch not in coder.singles and coder.by_id[0] is not None for ch in marked if ch == "\n")
        got = sum(score.get(i, 0.0) for i in ids) + unknown * coder.penalty
        assert math.isclose(got, _best(model, marked), rel_tol=1e-12)
    coded = pieces.encode_texts(docs, model, decoded="decoded")
    assert all(r.exact for r in pieces.pieces_digest(coded).collect())
    back = pieces.decode_ids(coded.drop("decoded"), model).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in texts)


# WARC


def test_archives_round_trip(spark, tmp_path):
    big, small = "b" * 1500, "s" * 10
    rows = [(1, "u1", big), (2, "u2", big), (3, None, small), (4, "u4", small), (5, "u5", None), (6, "u6", ""), (7, "u7", "é" * 700), (9, "u9", big)]
    rows += [(100 + i, f"v{i}", f"page {i} " * (i * 40)) for i in range(30)]
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.plan_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), path)
    want = {}
    for i, _, h in rows:
        b = (h or "").encode()
        last = max(k for k, _, g in rows if g == h)
        revisit = len(b) >= 1000 and i < last
        want[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
    for split in (32 << 20, 97):  # ranges far smaller than a record, too
        got = {r.page_id: tuple(r)[1:] for r in warc.resolve_revisits(warc.read_warc(spark, path, split)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
        assert got == want


def test_archives_of_clashing_columns_repeated_ids_and_nothing(spark, tmp_path):
    big = "b" * 1500
    rows = [(1, "u", big, 7, "d"), (2, "u", big, 8, "d"), (2, "u", big, 9, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, last int, full string")
    for name, own, want in (("a", pages, [(1, 1500, 2), (2, 1500, None), (2, 1500, None)]), ("b", pages.limit(0), [])):
        path = f"file://{tmp_path}/{name}"
        warc.write_warc(warc.plan_revisits(own), path)
        got = warc.resolve_revisits(warc.read_warc(spark, path)).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_foreign_bytes_between_records(spark, tmp_path):
    import gzip

    rec = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    (tmp_path / "a").write_bytes(b"junk\x1f\x8b\x08\x00zz" + rec + b"\x00" * 7 + gzip.compress(b"no record") + rec)
    rows = warc.read_warc(spark, f"file://{tmp_path}/a").collect()
    assert [(r.record_type, r.payload_bytes) for r in rows] == [("resource", 3)] * 2


def test_warc_reads_long_heads_and_payloads_in_a_task_a_range(spark, tmp_path):
    noise = np.random.default_rng(0).integers(33, 127, 20 << 20, dtype=np.uint8).tobytes().decode()
    rows = [(1, "http://a/" + noise[: 3 << 20], "x"), (2, "http://b/", noise[: 2 << 20]), (3, "http://c/", noise), (4, "http://d/", "y"), (5, None, noise[: 2 << 20])]
    path = f"file://{tmp_path}/long"
    warc.write_warc(warc.plan_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)), path)
    found = warc.read_warc(spark, path, 1 << 20)
    assert found.rdd.getNumPartitions() > 15
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in warc.resolve_revisits(found).collect()}
    assert got == {i: (len(t), hashlib.sha1(t.encode()).hexdigest(), "revisit" if i == 2 else "response") for i, _, t in rows}
