"""The corpus pipeline's stages on a small corpus with nulls, empties, copies, a long text and clashing columns, against brute force, and on nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

PASSAGE = " ".join(f"item{k}" for k in range(30))
KEY = "AKIA" + "Q7" * 9
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `group` int, component string, score string, n_hit int, kind int, spans string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """labels and benchmark of a table folder; clashing and extra columns in both."""
    path = str(tmp_path_factory.mktemp("tables"))
    labels = [(i, 1, int(i < 1200)) for i in range(1000, 1400)] + [(1000, None, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", PASSAGE, "x"), ("b2", None, "x"), ("b3", "", "x")], "item_id string, text string, lang string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): labelled texts from 1000 on, toxic below 1200."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    out = [(i, say(30) + (" vileword nastyterm" * 2 if i < 1200 else "")) for i in range(1000, 1400)]
    base = say(60)
    out += [(1, base), (2, base), (3, base + " more"), (4, base.replace(" ", "  ").upper()), (5, say(40) + " " + PASSAGE), (6, PASSAGE)]
    out += [(7, f"the key {KEY} and password = hunter2hunter2 end"), (8, None), (9, ""), (10, " \n"), (11, say(40_000)), (None, say(9)), (None, None), (12, "short"), (12, "short")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    own = [(i, t, None, "s", len(t or ""), 7, "clash", None, 3, 1, "clash") for i, t in rows]
    return spark.createDataFrame(own, COLUMNS).repartition(5)


def _ids(df):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())


def _all(rows, without=()):
    return sorted(-1 if i is None else i for i, _ in rows if i not in without)


def _sets(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_toxicity_rejects_toxic_documents_alone(spark, docs, rows, folder):
    got = corpus_pipeline.toxicity(spark, docs, folder)
    assert got.schema.names == docs.schema.names
    kept = _ids(got)
    toxic = set(range(1000, 1200))
    assert len(toxic & set(kept)) <= 4
    assert [i for i in kept if i not in toxic] == _all(rows, toxic)


def test_near_copies_keep_the_smallest_id_of_each_group(spark, docs, rows, folder):
    got = corpus_pipeline.near_copies(spark, docs, folder)
    assert got.schema.names == docs.schema.names
    texts = {i: _sets(t or "") for i, t in rows if i is not None}
    gone = set()
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]) if texts[a] or texts[b] else True):
                gone.add(b)
    assert {2, 3, 4, 9, 10} <= gone
    assert _ids(got) == _all(rows, gone)


def test_decontaminate_drops_benchmark_passages(spark, docs, rows, folder):
    got = corpus_pipeline.decontaminate(spark, docs, folder)
    assert got.schema.names == docs.schema.names
    assert _ids(got) == _all(rows, {5, 6})


def test_secrets_are_replaced_and_all_documents_stay(spark, docs, rows, folder):
    got = corpus_pipeline.secrets(spark, docs, folder)
    assert got.schema == docs.schema
    assert _ids(got) == _all(rows)
    text = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert KEY not in text[7].text and "hunter2hunter2" not in text[7].text
    assert text[7].text.startswith("the key ") and text[7].text.endswith(" end") and text[7].n_chars == len(text[7].text)
    assert [text[i].text for i in (1, 5, 11)] == [dict(rows)[i] for i in (1, 5, 11)]


def test_tokens_come_back_as_texts(spark, docs, rows, folder):
    got = corpus_pipeline.tokens(spark, docs, folder)
    assert got.schema.names == ["doc_id", "piece_ids", "n_pieces"]
    assert _ids(got) == _all(rows)
    assert all(r.n_pieces == len(r.piece_ids) for r in got.collect())
    assert {r.n_pieces for r in got.where("doc_id in (8, 9)").collect()} == {0}
    assert got.where("doc_id = 11").first().n_pieces >= 40_000
    assert len({tuple(r.piece_ids) for r in got.where("doc_id in (1, 2)").collect()}) == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, docs, folder, name):
    got = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), folder)
    assert got.collect() == []


def test_whole_run(spark, docs, rows, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).where(F.col("doc_id") < 1000)
    assert sorted(r.doc_id for r in got.collect()) == [1, 7, 8, 11, 12, 12]


CLASHING = ["score", "predicted", "held_out", "secrets", "_z", "_bytes", "_text", "_row", "_rest", "_key", "_found", "rules", "group", "n_words", "n_hit", "piece_ids"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_values_of_clashing_columns(spark, rows, folder, name):
    wide = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    wide = wide.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])
    got = dict(corpus_pipeline.STAGES)[name](spark, wide, folder)
    if name == "tokens":
        assert got.count() == len(rows)
        return
    assert got.schema.names == wide.schema.names
    kept = got.collect()
    assert len(kept) > 200
    for r in kept:
        assert [r[c] for c in CLASHING] == [f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHING]
