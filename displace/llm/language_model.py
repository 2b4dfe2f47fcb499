"""Scoring of whole texts by a gated recurrent language model that learns from the corpus.

1. Counts. Texts are dealt into groups; a group tells each word bucket its distinct words (64-bit names) with their
   training counts, the bucket answers with the corpus's counts. No bucket gets a word more than once per group.
2. Encoding. Each text becomes 16-bit tokens (frequent words, or a class of the rarer ones by their last bytes) with its unigram
   base score; the encoded table goes to the shared folder.
3. Training. `rounds` slices of the training texts, together all of them, each once: every group runs truncated
   backpropagation over its texts from the round's shared parameters, and the results are averaged by tokens.
4. Scoring. Every text is read from its first token to its end, the state carried across windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.llm.gru import Gru
from displace.llm.textbytes import deal, packed, table, text_buffer, word_hashes
from displace.session import materialize, n_partitions

WORD = np.dtype([("h", "<u8"), ("n", "<u4"), ("cls", "u1")])
END = np.uint64(0)


def _distinct_words(texts: pa.Table, n_tails: int):
    """A group's words in order of their names: training counts and tail classes; the end of a text has the name 0."""
    data, offsets = text_buffer(texts["text"])
    train = ~texts["held_out"].to_numpy(zero_copy_only=False)
    names, counts, classes = [np.array([END])], [np.array([train.sum()])], [np.array([0])]
    for owner, h, tail in word_hashes(data, offsets):
        seen, first, back = np.unique(h, return_index=True, return_inverse=True)
        names.append(seen)
        counts.append(np.bincount(back, train[owner], minlength=len(seen)).astype(np.int64))
        classes.append((tail[first] % np.uint64(n_tails)).astype(np.int64))
    name, first, back = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    count = np.bincount(back, np.concatenate(counts), minlength=len(name)).astype(np.int64)
    return name, count, np.concatenate(classes)[first]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def ask_counts(texts: pa.Table, buckets: int, n_tails: int) -> pa.Table:
    name, count, cls = _distinct_words(texts, n_tails)
    out = np.zeros(len(name), WORD)
    out["h"], out["n"], out["cls"] = name, count, cls
    b, data = deal(_bucket(name, buckets), buckets, out)
    return table({"b": b, "g": [texts["g"][0].as_py()] * len(b), "data": data}, packed("b", "g"))


def _sums(rows: pa.Table):
    parts = [np.frombuffer(d.as_buffer(), WORD) for d in rows["data"]]
    every = np.concatenate(parts)
    name, first, back = np.unique(every["h"], return_index=True, return_inverse=True)
    return parts, name, np.bincount(back, every["n"]).astype(np.int64), every["cls"][first], back


def answer_counts(rows: pa.Table) -> pa.Table:
    """Each group's words again, in its order, with the corpus's counts."""
    parts, _, count, _, back = _sums(rows)
    cuts = np.cumsum([0, *map(len, parts)])
    data = [count[back[a:b]].astype("<i8").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return table({"g": rows["g"], "b": rows["b"], "data": data}, packed("g", "b"))


SUMMARY = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("cls", pa.int32())])


def summarise(rows: pa.Table, n_words: int) -> pa.Table:
    """A bucket's most frequent words, which hold all of it that can be among the corpus's, and its totals per tail class (h null)."""
    _, name, count, cls, _ = _sums(rows)
    own = np.flatnonzero((name != END) & (count > 0))
    top = own[np.lexsort((name[own], -count[own]))[:n_words]]
    k = np.unique(cls[own])
    h = [*name[top].view(np.int64).tolist(), *[None] * len(k)]
    n = [*count[top].tolist(), *np.bincount(cls[own], count[own]).astype(int)[k].tolist()]
    v = [*[1] * len(top), *np.bincount(cls[own])[k].tolist()]
    end = np.flatnonzero(name == END)
    if len(end):
        h, n, v = [*h, 0], [*n, int(count[end[0]])], [*v, 1]
    return table({"h": h, "n": n, "v": v, "cls": [*cls[top].tolist(), *k.tolist(), *[0] * len(end)]}, SUMMARY)


class Vocabulary:
    """The frequent words' names, and what is left of each tail class."""

    def __init__(self, words: np.ndarray, tails: np.ndarray, n_words: int, n_tails: int):
        """words: (h, n, cls) of the most frequent; tails: (cls, n, v) of all words but the end."""
        end = words[words["h"] == 0]
        rest = words[words["h"] != 0]
        rest = rest[np.lexsort((rest["h"], -rest["n"]))][: n_words - 1]
        self.n_tails, self.n_words = n_tails, n_words
        self.end_count = int(end["n"][0]) if len(end) else 0
        self.tail_n, self.tail_v = np.zeros(n_tails), np.zeros(n_tails)
        np.add.at(self.tail_n, tails["cls"], tails["n"])
        np.add.at(self.tail_v, tails["cls"], tails["v"])
        self.total = int(self.tail_n.sum()) + self.end_count
        self.distinct = int(self.tail_v.sum()) + (self.end_count > 0)
        np.subtract.at(self.tail_n, rest["cls"], rest["n"])
        np.subtract.at(self.tail_v, rest["cls"], 1)
        self.names = np.concatenate([[END], rest["h"].view(np.uint64)])
        self.order = np.argsort(self.names)

    def tokens(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.names[self.order], h), len(self.names) - 1)
        hit = self.names[self.order][at] == h
        return np.where(hit, self.order[at], self.n_words + cls)


VOCABULARY = np.dtype([("h", "<i8"), ("n", "<i8"), ("v", "<i8"), ("cls", "<i4"), ("total", "?")])


def encode(texts: pa.Table, told: pa.Table, buckets: int, n_words: int, n_tails: int, schema: pa.Schema) -> pa.Table:
    if not texts.num_rows:
        return schema.empty_table()
    data, offsets = text_buffer(texts["text"])
    name, _, cls = _distinct_words(texts, n_tails)
    kinds = told["b"].to_numpy()
    blobs = [d.as_buffer() for d in told["data"]]
    summary = np.concatenate([np.frombuffer(d, VOCABULARY) for d, k in zip(blobs, kinds, strict=True) if k < 0])
    vocabulary = Vocabulary(summary[~summary["total"]], summary[summary["total"]], n_words, n_tails)
    count = np.zeros(len(name), np.int64)
    bucket = _bucket(name, buckets)
    for d, k in zip(blobs, kinds, strict=True):
        if k >= 0:
            count[bucket == k] = np.frombuffer(d, "<i8")
    token = vocabulary.tokens(name, cls)
    base = np.log10((count + 0.1) / (vocabulary.total + 0.1 * (vocabulary.distinct + 1)))
    tail = np.where(token < n_words, 0.0, np.log10((count + 0.1) / (np.maximum(vocabulary.tail_n[cls], 0) + 0.1 * (vocabulary.tail_v[cls] + 1))))
    n = texts.num_rows
    size, known, score, left = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    owners, codes = [], []
    for owner, h, _ in word_hashes(data, offsets):
        at = np.searchsorted(name, h)
        size += np.bincount(owner, minlength=n)
        known += np.bincount(owner, count[at] > 0, minlength=n).astype(np.int64)
        score += np.bincount(owner, base[at], minlength=n)
        left += np.bincount(owner, tail[at], minlength=n)
        owners.append(owner)
        codes.append(token[at])
    every = np.zeros(int(size.sum()) + n, "<u2")  # an end, token 0, after each text
    owner = np.concatenate(owners) if owners else np.zeros(0, int)
    every[np.arange(len(owner)) + owner] = np.concatenate(codes) if codes else 0
    cuts = (np.concatenate([[0], np.cumsum(size + 1)]) * 2).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(every.tobytes())]).cast(pa.binary())
    columns = [texts["g"], texts["id"], texts["held_out"], size + 1, known + (count[0] > 0), np.full(n, vocabulary.total), score + base[0], left, tokens]
    return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=schema.names).cast(schema)


def encode_corpus(docs: DataFrame, text: str, id_col: str, groups: int, buckets: int, n_words: int, n_tails: int, folds: int) -> DataFrame:
    from displace.llm.repeats import texts_type

    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds == 0
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), held.alias("held_out"))
    own = own.withColumn("g", F.pmod(F.xxhash64("id", F.length("text"), F.substring("text", 1, 64)), F.lit(groups)).cast("int"))
    asked = own.groupBy("g").applyInArrow(lambda t: ask_counts(t, buckets, n_tails), "b int, g int, data binary").groupBy("b")
    answers = asked.applyInArrow(answer_counts, "g int, b int, data binary")
    summary = asked.applyInArrow(lambda t: summarise(t, n_words), "h bigint, n bigint, v bigint, cls int")
    top = summary.where("h is not null").orderBy(F.col("h") != 0, F.desc("n"), "h").limit(n_words).withColumn("total", F.lit(False))
    tails = summary.where("h is null").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).select(F.lit(0).cast("long").alias("h"), "n", "v", "cls", F.lit(True).alias("total"))
    vocabulary = top.unionByName(tails).groupBy().applyInArrow(_blob, "data binary")  # n_words + n_tails rows at most
    every = spark.range(groups).select(F.col("id").cast("int").alias("g"), F.lit(-1).alias("b"), vocabulary.scalar().alias("data"))
    schema = pa.schema([("g", pa.int32()), ("id", texts_type(docs.schema[id_col].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("tail_score", pa.float64()), ("tokens", pa.binary())])
    kinds = f"g int, id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, tail_score double, tokens binary"
    return own.groupBy("g").cogroup(answers.unionByName(every).groupBy("g")).applyInArrow(lambda a, b: encode(a, b, buckets, n_words, n_tails, schema), kinds)


def _blob(rows: pa.Table) -> pa.Table:
    out = np.zeros(rows.num_rows, VOCABULARY)
    for k in ("h", "n", "v", "cls", "total"):
        out[k] = rows[k].to_numpy(zero_copy_only=False)
    return pa.table({"data": pa.array([out.tobytes()], pa.binary())})


def _streams(batches, limit: int):
    """Token arrays and text offsets of up to about `limit` tokens at a time."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index("tokens")))
        tokens, offsets = np.frombuffer(data.tobytes(), "<u2").astype(np.int64), offsets // 2
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            yield batch, i, j, tokens[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def _token_counts(encoded: DataFrame, size: int) -> np.ndarray:
    def count(batches):
        total = np.zeros(size, np.int64)
        for _, _, _, tokens, _ in _streams(batches, 1 << 20):
            total += np.bincount(tokens, minlength=size)
        yield pa.RecordBatch.from_pydict({"token": np.arange(size), "n": total})

    rows = encoded.select("tokens").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()  # `size` rows
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.token] = r.n
    return out


def train(encoded: DataFrame, model: Gru, rounds: int, window: int, rate: float) -> None:
    """One pass over all training texts in `rounds` slices. In each, every group (g) of texts trains a copy of the round's model, in the order of a hash of their
    ids; the copies are averaged by tokens, AdaGrad's sums too. Groups follow the corpus alone, so partitions do not change the model but for
    the order of sums."""
    shape = (model.n_words, model.per_class, model.n_tails, model.hidden)

    def fit(batches, start):
        held, now = [], None

        def trained():
            tokens = np.concatenate([t for t, _ in held])
            fresh = np.concatenate([f for _, f in held])
            own = Gru(*shape)
            own.unpack(start)
            own.train(tokens, fresh, window, rate)
            return pa.RecordBatch.from_pydict({"s": pa.array([now % 32], pa.int32()), "weight": pa.array([float(len(tokens))]), "params": pa.array([(own.pack(True).astype("<f8") * len(tokens)).tobytes()], pa.binary())})

        for batch, i, j, tokens, offsets in _streams(batches, 1 << 20):
            g = batch.column(0).to_numpy()[i:j]
            fresh = np.zeros(len(tokens), bool)
            fresh[offsets[:-1]] = True
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and g[a] != now:
                    yield trained()
                    held.clear()
                now = int(g[a])
                held.append((tokens[offsets[a] : offsets[b]], fresh[offsets[a] : offsets[b]]))
        if held:
            yield trained()

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(len(rows["params"][0].as_buffer()) // 8)
        for p in rows["params"]:
            total += np.frombuffer(p.as_buffer(), "<f8")
        return pa.table({"weight": pa.array([float(sum(rows["weight"].to_pylist()))]), "params": pa.array([total.tobytes()], pa.binary())})

    for r in range(rounds):
        start = model.pack(True)
        own = encoded.where(F.pmod(F.xxhash64("id", "n_tokens"), F.lit(rounds)) == r).select("g", "tokens", F.xxhash64("n_tokens", "id", "base_score").alias("k"))
        dealt = own.repartition("g").sortWithinPartitions("g", "k").select("g", "tokens")
        fitted = dealt.mapInArrow(lambda batches, start=start: fit(batches, start), "s int, weight double, params binary")
        sums = fitted.groupBy("s").applyInArrow(lambda t: add(t.drop_columns(["s"])), "weight double, params binary").collect()  # 32 rows at most
        if sums:
            model.unpack(sum(np.frombuffer(s.params, "<f8") for s in sums) / sum(s.weight for s in sums))


def score_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n_words: int = 512, per_class: int = 32, n_tails: int = 16, hidden: int = 16, rounds: int = 4, window: int = 16, rate: float = 0.2, folds: int = 10, group_bytes: int = 16 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts under an add-0.1
    unigram model and under a gated recurrent model, both learnt from the rows whose crc32(id) is not 0 modulo `folds`.

    Words are runs without ASCII white space, A-Z lower-cased, with one end per text. Every row is scored, repeated rows alike; a null
    text is an empty one (its end alone), a null id counts as held out; an empty table gives an empty result, and so does a corpus
    without training rows a score under uniform counts.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    groups = max(8, -(-size // group_bytes))
    encoded = materialize(encode_corpus(docs, text, id_col, groups, n_partitions(spark), n_words, n_tails, folds), "lm")
    model = Gru(n_words, per_class, n_tails, hidden)
    counts = _token_counts(encoded.where("not held_out"), n_words + n_tails)
    model.start(counts[:n_words], counts[n_words:])
    train(encoded.where("not held_out"), model, rounds, window, rate)
    params = model.pack()
    names = [f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"]

    def score(batches):
        own = Gru(n_words, per_class, n_tails, hidden)
        own.unpack(params)
        for batch, i, j, tokens, offsets in _streams(batches, 1 << 20):
            logp = np.concatenate([[0.0], np.cumsum(own.score(tokens, offsets))])
            part = batch.slice(i, j - i)
            total = (logp[offsets[1:]] - logp[offsets[:-1]]) / np.log(10) + part.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(6)], pa.array(total)], names=[id_col, *part.schema.names[1:6], "score"])

    return encoded.select("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "tail_score", "tokens").mapInArrow(score, ", ".join(names))
