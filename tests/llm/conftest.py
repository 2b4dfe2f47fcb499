from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with copies, near copies, shared passages, nulls, empties, ties and a long text."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))
    passage = say(60)
    rows = [(i, say(rng.randrange(3, 120))) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(10)]
    for i in range(10):
        w = rows[20 + i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, say(20) + " " + passage + " " + say(20)) for i in range(12)]
    rows += [(400, None), (401, None), (402, ""), (403, " \n\t "), (404, "x" * 900), (405, "É école ÀÉ 漢字 🙂 " * 40), (406, say(4000)), (407, "a"), (407, "a"), (408, "▁ literal  marks ▁")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s1", len(t or ""), 1, "clash") for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, `count` int, spans string").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
