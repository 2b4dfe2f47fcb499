"""A toxicity classifier with counterfactual regularisation.

A logistic model over words and their first bytes (so inflected and suffixed forms of a stem share a feature) is fitted on a bounded
sample of labelled rows. Sentences of the sample that mention an identity group are repeated with the group swapped; the model is penalised
for every difference between the two scores, so that a neutral mention of a group moves no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from displace.llm.linear import SIZE, Sparse, add_scores, bounded_rows, chosen_features, distinct_hits, fit_logistic, in_one_task, numbering, packed_rows, unpacked_rows
from displace.llm.textbytes import text_buffer

#: Identity terms by language; terms of one line replace each other.
IDENTITY = """
man woman
men women
boy girl
male female
black white asian latino
muslim christian jewish hindu buddhist atheist
gay straight lesbian bisexual
transgender cisgender
immigrant native
disabled able-bodied
old young
mann frau
männer frauen
schwarz weiß
muslimisch christlich jüdisch
schwul lesbisch
homme femme
hommes femmes
noir blanc
musulman chrétien juif
hombre mujer
hombres mujeres
negro blanco
musulmán cristiano judío
"""
PREFIXES = (4, 5, 6, 7)
_GROUPS = [line.split() for line in IDENTITY.strip().splitlines()]
SWAP = {a: g[(i + 1) % len(g)] for g in _GROUPS for i, a in enumerate(g)}
#: The terms by themselves and before a mark: each is covered whatever the sample mentions.
ALONE = [t + mark for t in SWAP for mark in ("", ",", ".", "!", "?", ":", ";")]
_MENTION = re.compile(r"(?<![^\W\d_])(" + "|".join(sorted(map(re.escape, SWAP), key=len, reverse=True)) + r")(?![^\W\d_])", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with every identity term replaced by the next of its line."""
    return _MENTION.sub(lambda m: SWAP[m[1].lower()], text)


def _rows(texts: list[str], numbers: np.ndarray) -> list[np.ndarray]:
    data, offsets = text_buffer(pa.array([t.encode() for t in texts], pa.large_binary()))
    owner, f = distinct_hits(data, offsets, PREFIXES, numbers)
    return np.split(f, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []


def train_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", most: int = 20_000, features: int = 4096, folds: int = 3, held: int = 1, keep_equal: float = 10.0, marking: bool = True, ridge: float = 1e-5, balance: float = 0.2) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, chosen features, bias) from at most `most` labelled rows, none of them with crc32(id) equal to `held` modulo `folds`. With `marking` only
    features that mark most of their texts as toxic count: the others are context, such as the language. keep_equal weighs the counterfactual penalty."""
    rows = bounded_rows(docs, labels, text, id_col, label, most, folds, held)
    chosen = chosen_features(rows, PREFIXES, features, marking)
    chosen = np.union1d(chosen, np.unique(np.concatenate(_rows(ALONE, np.arange(SIZE)))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = numbering(chosen)
        for batch in batches:
            k, texts, y = (v.to_pylist() for v in batch.columns)
            own, out = _rows(texts, numbers), [(a, v, 0, 0) for a, v in zip(k, y, strict=True)]
            for a, t, v in zip(k, texts, y, strict=True):
                mentions = [x for x in re.split(r"(?<=[.!?])\s+", t) if _MENTION.search(x)]
                for at, sentence in enumerate(mentions):
                    own += _rows([sentence, swapped(sentence)], numbers)
                    out += [(a, v, 1, at), (a, v, 2, at)]
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, packed_rows(own)], names=["k", "y", "kind", "at", "f"])

    def fit(t: pa.Table) -> bytes:
        kind, own = t["kind"].to_numpy(), unpacked_rows(t["f"])
        order = np.lexsort((t["at"].to_numpy(), t["k"].to_numpy()))  # nothing depends on the order in which rows come
        own = [[own[i] for i in order if kind[i] == k] for k in (0, 1, 2)]
        y = t["y"].to_numpy()[order][kind[order] == 0].astype(float)
        numbers = numbering(chosen)
        pairs = tuple(Sparse([*o, *_rows(more, numbers)], len(chosen)) for o, more in zip(own[1:], (ALONE, [swapped(t) for t in ALONE]), strict=True))
        weight = np.where(y > 0, (max(len(y) - y.sum(), 1) / max(y.sum(), 1)) ** balance, 1.0)  # the rarer label weighs more
        return np.append(*fit_logistic(Sparse(own[0], len(chosen)), y, weight=weight, ridge=ridge, pairs=pairs, keep_equal=keep_equal)).tobytes()

    got = in_one_task(rows.select("k", "text", "label").mapInArrow(gather, "k bigint, y int, kind int, at int, f binary"), fit)
    if got is None:
        return np.zeros(len(chosen)), chosen, 0.0
    fitted = np.frombuffer(got)
    return fitted[:-1], chosen, float(fitted[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", threshold: float = 0.7, **fit) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from `threshold` on) for every whole text.

    Null and empty texts get the score of no features. Repeated rows score alike; of several labels of an id the largest counts; null
    labels and ids are not learnt from (a null id counts as not held out). Without labels every score is 0.5. Columns of these names are replaced.
    """
    weights, chosen, bias = train_toxicity(docs, labels, text, id_col, label, **fit)
    kept = docs.drop("held_out", "score", "predicted", "_z")
    scored = add_scores(kept, text, weights, chosen, bias, PREFIXES, "_z")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % fit.get("folds", 3) == fit.get("held", 1)
    score = 1 / (1 + F.exp(-F.col("_z")))
    return scored.select(*kept.columns, held.alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))
