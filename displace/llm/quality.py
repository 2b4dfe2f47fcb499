"""A quality classifier by co-training of two views.

The content view holds the words of a text and their last bytes; the metadata view what a crawler knows without reading it: language,
source, size, and the make-up of its bytes (line lengths, shares of letters, marks, upper case, repeated words) in bins. Every document's
features are taken once and written to the shared folder, two bytes each. Each view's classifier starts from a bounded sample of labelled rows; for some
rounds each scores all unlabelled documents and labels those it is surest of, and the other one learns from them. Finally each view is calibrated on
labelled rows (a logistic curve of its score) and all documents are scored by the calibrated views together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructType

from displace.llm.linear import Sparse, bounded_rows, chosen_features, distinct_hits, fit_logistic, in_one_task, linear_scores, logistic, numbering, packed_rows, unpacked_rows
from displace.llm.textbytes import mix, text_buffer, word_hashes, word_segments
from displace.session import materialize

PREFIXES = (-2, -3)
BINS = 12
#: Hashed features for the values of one category column.
CATEGORIES = 1024


_CLASSES = {"line": b"\n", "bar": b"|", "mark": b"!%&*#$", "digit": b"0123456789", "upper": bytes(range(65, 91)), "space": b" \t\r\n"}
N_VALUES = 10


def make_up(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, N_VALUES): what texts are made of, each value from 0 to 1."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    share = {}
    for k, own in _CLASSES.items():
        table = np.zeros(256, np.int32)
        table[list(own)] = 1
        out = np.zeros(n)
        for i, j, begin, end in word_segments(data, offsets):
            sums = np.concatenate([[0], np.cumsum(table[data[begin:end]])])
            inner = np.clip(offsets[i : j + 1], begin, end) - begin
            out[i:j] += sums[inner[1:]] - sums[inner[:-1]]
        share[k] = out / size
    count, again, before = np.zeros(n), np.zeros(n), np.zeros(n)
    for owner, h, _ in word_hashes(data, offsets):
        count += np.bincount(owner, minlength=n)
        same = owner[1:] == owner[:-1]
        again += np.bincount(owner[1:][same & (h[1:] == h[:-1])], minlength=n)
        if len(h) > 2:
            two = owner[2:] == owner[:-2]
            before += np.bincount(owner[2:][two & (h[2:] == h[:-2])], minlength=n)
    words = np.maximum(count, 1)
    values = [np.log10(size) / 6, share["line"] * 10, share["bar"] * 8, share["mark"] * 4, share["digit"] * 4, share["upper"], share["space"] * 3, again / words, before / words, size / words / 20]
    return np.clip(np.column_stack(values), 0, 1)


def categories(docs: DataFrame) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source") if c in docs.columns]).cast("array<string>")


def metadata_features(values: np.ndarray, names: list[list[str]]) -> list[np.ndarray]:
    """Bins of the values, and one of CATEGORIES hashed features for the category in each place."""
    m = values.shape[1]
    bins = np.minimum((values * BINS).astype(int), BINS - 1) + np.arange(m) * BINS
    known: dict[tuple[int, str], int] = {}
    for own in names:
        for key in enumerate(own):
            if key not in known:
                known[key] = m * BINS + key[0] * CATEGORIES + xxhash.xxh64_intdigest(key[1]) % CATEGORIES
    return [np.array([*row, *[known[key] for key in enumerate(own)]], np.int64) for row, own in zip(bins.tolist(), names, strict=True)]


class Views:
    """The two views' linear models, and the logistic curves of their scores."""

    def __init__(self, sizes: tuple[int, int], packed: bytes | None = None):
        flat = np.frombuffer(packed) if packed else np.array([*np.zeros(sizes[0] + sizes[1] + 2), 1.0, 0.0, 1.0, 0.0])
        cuts = np.cumsum([sizes[0] + 1, sizes[1] + 1])
        parts = np.split(flat, cuts)
        self.models = [(p[:-1], float(p[-1])) for p in parts[:2]]
        self.curves = [tuple(parts[2][:2]), tuple(parts[2][2:])]

    def scores(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """Uncalibrated scores by each view of the packed rows in columns f and m."""
        return [linear_scores(batch.column(batch.schema.get_field_index(c)), *m) for c, m in zip("fm", self.models, strict=True)]


def fit_views(t: pa.Table, sizes: tuple[int, int], last: bool) -> bytes:
    """Packed models from rows (k, view, label, weight, f, m): view -1 are labelled rows, of which a fifth only calibrates (when `last`), 0 and 1 what
    that view is taught. Nothing depends on the order in which rows come."""
    order = np.lexsort((t["view"].to_numpy(), t["k"].to_numpy()))
    view, y, weight = (t[c].to_numpy()[order] for c in ("view", "label", "weight"))
    y = y.astype(float)
    seen = np.flatnonzero(view < 0)
    part = np.zeros(len(view), bool)
    part[seen[np.arange(len(seen)) % 5 == 4]] = True
    models, curves = [], []
    for a in (0, 1):
        rows = unpacked_rows(t["fm"[a]])
        use = np.flatnonzero(((view < 0) & ~part) | (view == a))
        models.append(fit_logistic(Sparse([rows[i] for i in order[use]], sizes[a]), y[use], weight[use]))
        own = Sparse([rows[i] for i in order[part]], sizes[a])
        curves.append(calibrate(own.times(models[a][0]) + models[a][1], y[part]) if last and part.any() else (1.0, 0.0))
    return np.concatenate([*[np.append(w, b) for w, b in models], *curves]).tobytes()


#: Scores are counted in bins of a 32nd; beyond 16 all are as sure.
STEP, EDGE = 1 / 32, 16.0


def _bin(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -EDGE, EDGE) / STEP).astype(np.int64)


def surest(counts: dict[int, int], most: float, sure: int) -> tuple[int, float]:
    """(bin, share): the `most` rows of the highest bins are those beyond `bin` and `share` of those in it; none below the bin `sure`."""
    left = most
    for b in sorted(counts, reverse=True):
        if b < sure or left <= 0:
            break
        if counts[b] >= left:
            return b, left / counts[b]
        left -= counts[b]
        last = b
    return (last, 1.0) if left < most else (1 << 30, 0.0)


def exchange(pool: DataFrame, views: Views, most: float, rate: float, confidence: float) -> DataFrame:
    """(k, view, label, weight, f, m): what each view teaches the other: of all rows of the pool the `most` of which it is surest, in the labels'
    proportion `rate`, and surer than `confidence`. Two passes: scores are counted in bins, then rows beyond the bin that makes the number are taken, of
    the bin itself a share by a hash of the id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = int(2 * EDGE / STEP) + 1
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for a, z in enumerate(views.scores(batch)):
                total[a] += np.bincount(_bin(z) + size // 2, minlength=size)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"view": pa.array(a, pa.int32()), "bin": pa.array(b - size // 2, pa.int32()), "n": total[a, b]})

    found = pool.select("f", "m").mapInArrow(count, "view int, bin int, n bigint").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect()  # bins
    sure = int(np.log(confidence / (1 - confidence)) / STEP)
    cuts = [[surest({sign * r.bin: r.n for r in found if r.view == a}, max(1.0, most * part), sure) for sign, part in ((1, rate), (-1, 1 - rate))] for a in (0, 1)]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            lot = mix(k.view(np.uint64)).astype(np.float64) / 2.0**64
            for a, z in enumerate(views.scores(batch)):
                for (cut, share), sign, label in zip(cuts[a], (1, -1), (1, 0), strict=True):
                    own = sign * _bin(z)
                    which = np.flatnonzero((own > cut) | ((own == cut) & (lot < share)))
                    if len(which):
                        rows = batch.take(pa.array(which))
                        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(np.full(len(which), v), t) for v, t in ((1 - a, pa.int32()), (label, pa.int32()), (0.5, pa.float64()))), rows.column(1), rows.column(2)], names=["k", "view", "label", "weight", "f", "m"])

    return pool.select("k", "f", "m").mapInArrow(take, ROWS)


ROWS = "k bigint, view int, label int, weight double, f binary, m binary"


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of a score, by bounded Newton steps with smoothed targets."""
    scale = max(float(z.std()), 1e-6)
    z = z / scale
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = logistic(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a / scale), float(b)


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", most: int = 20_000, features: int = 8192, rounds: int = 3, share: float = 0.1, confidence: float = 0.9, folds: int = 3, held: int = 1) -> DataFrame:
    """All columns of docs but the text, with held_out, content_score, metadata_score, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    Learns from at most `most` labelled rows, none with crc32(id) equal to `held` modulo `folds`. All unlabelled rows are what the views teach each
    other from: in round r each view labels those of which it is surest, r * `share` times the number of labelled rows. Every row is scored by its whole text;
    null texts are empty, null labels and ids are not learnt from (a null id counts as not held out), repeated rows score alike; of several labels of an id the largest
    counts; without labels every score is 0.5. An empty table gives no rows. Columns of these names are replaced; others are passed on, whatever their names.
    """
    kept = docs.drop("held_out", "content_score", "metadata_score", "score", "predicted")
    own = bounded_rows(kept, labels, text, id_col, label, most, folds, held, categories(kept).alias("names"))
    chosen = chosen_features(own.select("text", "label"), PREFIXES, features)
    sizes = (max(len(chosen), 1), N_VALUES * BINS + 2 * CATEGORIES)

    def encoded(rows: DataFrame) -> DataFrame:
        """rows with their two views' packed features (f, m) for _text and _names."""
        passed = [c for c in rows.columns if c not in ("_text", "_names")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = numbering(chosen)
            for batch in batches:
                data, offsets = text_buffer(batch.column(len(passed)))
                owner, f = distinct_hits(data, offsets, PREFIXES, numbers)
                content = np.split(f, np.searchsorted(owner, np.arange(1, batch.num_rows))) if batch.num_rows else []
                meta = metadata_features(make_up(data, offsets), batch.column(len(passed) + 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(passed))], packed_rows(content), packed_rows(meta)], names=[*passed, "_f", "_m"])

        schema = StructType([rows.schema[c] for c in passed]).add("_f", BinaryType()).add("_m", BinaryType())
        return rows.select(*passed, "_text", "_names").mapInArrow(run, schema)

    labelled = encoded(own.select("k", F.lit(-1).alias("view"), "label", F.lit(1.0).alias("weight"), F.col("text").cast("binary").alias("_text"), F.col("names").alias("_names")))
    labelled = materialize(labelled.withColumnsRenamed({"_f": "f", "_m": "m"}), "quality-labelled")
    passed = [c for c in kept.columns if c != text]
    rows = kept.select(F.struct(*passed).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"), categories(kept).alias("_names"))
    known = labels.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_known", F.lit(True))
    every = encoded(rows.where("_id is not null")).join(known, "_id", "left")
    nameless = encoded(rows.where("_id is null")).withColumn("_known", F.lit(True))
    columns = [F.col("_row"), F.xxhash64("_id").alias("k"), F.coalesce("_known", F.lit(False)).alias("known"), F.col("_f").alias("f"), F.col("_m").alias("m")]
    every = materialize(every.select(columns).unionByName(nameless.select(columns)), "quality")
    size = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, models = sum(size.values()), None
    if n:
        pool = every.where("not known")
        for r in range(rounds + 1):
            taught = exchange(pool, Views(sizes, models), share * r * n, size.get(1, 0) / n, confidence) if r else None
            models = in_one_task(labelled if taught is None else labelled.unionByName(taught), lambda t, last=r == rounds: fit_views(t, sizes, last))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = Views(sizes, models)
        for batch in batches:
            odds = [c[0] * z + c[1] for c, z in zip(views.curves, views.scores(batch), strict=True)]
            out = [logistic(odds[0]), logistic(odds[1]), logistic((odds[0] + odds[1]) / 2)]  # the calibrated views' mean log odds
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["_row", "content_score", "metadata_score", "score"])

    schema = StructType([every.schema["_row"]]).add("content_score", DoubleType()).add("metadata_score", DoubleType()).add("score", DoubleType())
    scored = every.select("_row", "f", "m").mapInArrow(score, schema)
    held_out = F.coalesce(F.crc32(F.col(f"_row.`{id_col}`").cast("string").cast("binary")), F.lit(0)) % folds == held
    return scored.select("_row.*", held_out.alias("held_out"), "content_score", "metadata_score", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
