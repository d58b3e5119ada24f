from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from agreemill.llm import langid

SCHEMA = "doc_id long, text string, lang string"
ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüéèñçåø"


def tongue(seed):
    """A made-up Latin-script language: its own letters, syllables and words."""
    rng = random.Random(seed)
    letters = rng.choices(ALPHABET, k=14)
    syllables = ["".join(rng.choices(letters, k=rng.randint(2, 3))) for _ in range(60)]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(400)]
    return lambda r: " ".join(r.choice(words) for _ in range(r.randint(12, 120))).capitalize() + "."


TONGUES = {f"l{i}": tongue(i) for i in range(5)}


@pytest.mark.parametrize("unseen", [("l0", "l1"), ("l2", "l3"), ("l3", "l4")])
def test_texts_of_unlearned_languages_are_rejected(unseen):
    rng = random.Random(9)
    known = [x for x in TONGUES if x not in unseen]
    model = langid.fit_texts([TONGUES[x](rng) for x in known for _ in range(200)], [x for x in known for _ in range(200)])
    strange = list(model.predict([TONGUES[x](rng) for x in unseen for _ in range(150)]))
    assert sum(r[2] for r in strange) >= 0.97 * len(strange)
    truth = [x for x in known for _ in range(150)]
    own = list(model.predict([TONGUES[x](rng) for x in truth]))
    assert sum(r[2] for r in own) <= 0.01 * len(own)
    assert all(r[0] == x for r, x in zip(own, truth, strict=True))


def test_stage_drops_what_no_language_is_near(spark):
    rng = random.Random(3)
    rows = [(i, TONGUES[x](rng), x) for i in range(300) for x in [rng.choice(("l0", "l1", "l2"))]]
    strange = [(1000 + i, TONGUES[x](rng), None) for i in range(40) for x in [rng.choice(("l3", "l4"))]]
    docs = spark.createDataFrame(rows + strange, SCHEMA).withColumn("score", F.lit(1)).withColumn("rejected", F.lit("x"))
    got = langid.accepted(docs)
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in got.collect()}
    assert len(kept & set(range(300))) >= 297 and len(kept - set(range(300))) <= 1


def test_every_language_has_a_sampled_row(spark):
    rng = random.Random(5)
    rows = [(i, TONGUES["l0"](rng), "big") for i in range(400)] + [(1000 + i, f"{x} " * 9, x) for i in range(30) for x in [f"zq{chr(97 + i)}y"]]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), sample=31)
    assert len(model.languages) == 31 and set(model.owner) == set(range(31))


def test_own_columns_replace_those_of_the_caller(spark):
    model = langid.fit_texts(["la la la", "der die das"], ["aa", "bb"])
    docs = spark.createDataFrame([(1, "la la", 7, "mine", "x", "y")], "doc_id long, text string, Score int, lang_pred string, rejected string, langid string")
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "langid", "lang_pred", "score", "rejected"]
    row = got.first()
    assert row["lang_pred"] == "aa" and row["score"] > 0.5 and row["langid"] == "y"


def test_edges(spark):
    rows = [(1, "Größe über alles", "de"), (2, None, None), (3, "123 ...", "de"), (4, "", "fr"), (None, "le chat où été", "fr"), (5, "x" * 300_000, None)]
    got = {r["doc_id"]: r for r in langid.held_out_predictions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 6
    for i in (2, 3, 4):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["held_out"] == (zlib.crc32(b"1") % 3 == 1)
    assert langid.held_out_predictions(spark.createDataFrame([], SCHEMA)).collect() == []


def test_predictions_equal_a_slow_nearest_centroid(spark):
    """Dictionaries of n-grams in place of hashed vectors, centroids given."""
    rng = random.Random(2)
    texts = [TONGUES[x](rng) for x in ("l0", "l1", "l2") for _ in range(40)]
    langs = [x for x in ("l0", "l1", "l2") for _ in range(40)]
    model = langid.fit_texts(texts, langs)

    def slow(text):
        counts = langid.grams(text)
        weights = [float(c) ** langid.TF_POWER * float(w) for c, w in zip(counts, model.idf, strict=True)]
        norm = sum(w * w for w in weights) ** 0.5
        cosines = [sum(float(a) * b for a, b in zip(c, weights, strict=True) if b) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
        return model.languages[model.owner[best]], cosines[best]

    for text, found in zip(texts[::10], model.predict(texts[::10]), strict=True):
        lang, cosine = slow(text)
        assert found[0] == lang and abs(found[1] - min(1, cosine)) < 1e-4


def test_learns_on_held_out_rows(spark):
    rng = random.Random(1)
    words = {"aa": ["tion", "ment", "able"], "bb": ["ção", "ñor", "dad"], "cc": ["ung", "keit", "schaft"]}
    rows = [(i, " ".join("".join(rng.choices(words[w], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 80))), w) for i in range(300) for w in [rng.choice(sorted(words))]]
    got = langid.held_out_predictions(spark.createDataFrame(rows, SCHEMA)).where("held_out").collect()
    truth = {i: w for i, _, w in rows}
    assert len(got) > 60 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.98 * len(got)
