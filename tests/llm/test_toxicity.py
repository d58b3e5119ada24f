"""The convolutional classifier against a forward pass of plain loops, and edges."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agreemill.llm import toxicity


def slow_score(model, text):
    """Word by word, filter by filter, place by place."""
    words = toxicity._words((text or "").lower())
    vectors = [sum(model.embedding[f] for f in toxicity.features(w)) / toxicity.FEATURES for w in words]
    zero = np.zeros(toxicity.DIM)
    total = model.out_bias
    for k, width in enumerate(toxicity.WIDTHS):
        for j in range(toxicity.FILTERS):
            best = -math.inf
            for at in range(max(1, len(words))):
                best = max(best, sum(float((vectors[at + i] if at + i < len(vectors) else zero) @ model.filters[k][i][:, j]) for i in range(width)))
            total += model.out[k * toxicity.FILTERS + j] * max(0.0, best + model.bias[k * toxicity.FILTERS + j])
    language = next(iter(model.language.predict([text])))[0]
    z = total - model.thresholds.get(language, model.threshold)
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def prose(rng, n, vile=False):
    words = [rng.choice(["sun", "moon", "river", "stone", "le", "bird", "tree", "wind"]) + str(rng.randint(0, 9)) for _ in range(n)]
    if vile:
        for _ in range(2):
            words[rng.randrange(n)] = rng.choice(["vileword", "vilest", "nastyword"])
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.randint(5, 60), i % 3 == 0), "aa", None, i % 3 == 0) for i in range(400)]
    docs += [(1000 + i, prose(rng, 9000, i % 2 == 0), "aa", None, i % 2 == 0) for i in range(30)]  # long ones
    docs += [(2000, None, None, None, False), (2001, "", "aa", None, False), (2002, " \n", None, None, False), (2003, docs[0][1], "aa", None, True), (2003, docs[0][1], "aa", None, True)]
    frame = spark.createDataFrame([d[:4] for d in docs], "doc_id long, text string, lang string, score string").repartition(3)
    labels = spark.createDataFrame([(d[0], 1, int(d[4])) for d in docs if d[0] < 2000] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return frame, labels


def test_scores_equal_plain_loops(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: (r["s"], r["text"]) for r in docs.select("doc_id", "text", toxicity.score(model, F.col("text")).alias("s")).collect()}
    for i in [*range(0, 400, 23), 1000, 1001, 2000, 2001, 2002, 2003]:
        assert got[i][0] == pytest.approx(slow_score(model, got[i][1]), abs=1e-5), i
    assert got[2000][0] == got[2001][0] == got[2002][0] and got[2003][0] == got[0][0]


def test_long_labelled_texts_train_and_are_judged(spark, tables):
    docs, labels = tables
    rows = toxicity.held_out_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("toxic IS NOT NULL").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] >= 1000)


def test_windows_of_very_long_texts(spark, tables, monkeypatch):
    docs, labels = tables
    seen = []
    monkeypatch.setattr(toxicity, "FIT_CHARS", 1000)
    monkeypatch.setattr(toxicity, "train", lambda texts, *a, **k: seen.extend(texts))
    toxicity.fit(docs, labels)
    whole = [r["text"] for r in docs.collect() if r["text"]]
    long = [t for t in seen if t and len(t) == 1000]
    assert len(long) >= 25 and all(any(t in w for w in whole if len(w) > 1000) for t in long)
    assert len({next(w.index(t) for w in whole if t in w) for t in long}) > 10  # not all from the start


def test_columns_of_the_caller_stay(spark, tables):
    docs, labels = tables
    wide = docs.withColumns({"toxicity": F.lit("mine"), "predicted": F.lit(7)})
    kept = toxicity.harmless(wide, labels)
    assert kept.columns == wide.columns
    rows = kept.collect()
    assert {r["toxicity"] for r in rows} == {"mine"} and {r["doc_id"] for r in rows} >= {2000, 2001, 2002}
    assert not any("vile" in (r["text"] or "") for r in rows if r["doc_id"] < 400)
