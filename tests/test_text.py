from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from agreemill.api import PairScorer
from agreemill.functions import text as tx
from agreemill.operators import syntax
from agreemill.schema import TOKEN, struct
from agreemill.sources import tokens

CASES = [
    ("Portrait of a lantern hanging above the canal at dusk", "lantern", "Portrait of hanging above the canal at dusk"),
    ("teapot beside an open window", "teapot", "beside an open window"),
    ("Sketch of THE Teapot under glass", "teapot", "Sketch of under glass"),
    ("an image of a garden gnome by the fence", "garden gnome", "an image of by the fence"),
    ("fresh snow on every roof", "canoe", "fresh snow on every roof"),
    ("Three lanterns along the pier", "lantern", "Three lanterns along the pier"),
    ("The fox's den under an oak", "fox", "'s den under an oak"),
    ("A canoe tied to another canoe in the fog", "canoe", "tied to another canoe in the fog"),
    ("Blue light  over a harbour", "", "Blue light over a harbour"),
    ("an x.y (z) [w] here", "x.y (z) [w]", "an x.y (z) [w] here"),
    ("see a.b now", "a.b", "see now"),
    ("a $1 note", "$1", "note"),
]


def test_regex_stripper(spark):
    rows = spark.createDataFrame([(i, p, o) for i, (p, o, _) in enumerate(CASES)], "i int, p string, o string")
    got = {r["i"]: r["s"] for r in rows.select("i", tx.strip_subject("p", "o").alias("s")).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(CASES)}
    assert rows.select(tx.strip_subject("p", "o", "none").alias("s")).collect()[8]["s"] == CASES[8][0]
    with pytest.raises(ValueError):
        tx.strip_subject("p", "o", "other")


def test_names(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    assert one(tx.subject_parts(F.lit("live_subject_animal_00_heron")))[:] == ("live_subject/animal", "00", "heron")
    assert one(tx.subject_parts(F.lit("style_07_oil_painting")))[:] == ("style", "07", "oil_painting")
    with pytest.raises(Exception, match="unknown subject folder"):
        one(tx.subject_parts(F.lit("other_1_x")))
    assert one(tx.stem_parts(F.lit("3_12")))[:] == ("3", 12) and one(tx.stem_parts(F.lit("3_x_1")))[:] == ("3", 0) and one(tx.stem_parts(F.lit("3"))) is None
    assert one(tx.model_tag(F.lit("google/siglip2-so400m-patch16-naflex"))) == "siglip2-so400m"
    assert one(tx.method_dir(F.lit("emu2"))).startswith("emu2_gs3") and one(tx.method_dir(F.lit("mine"))) == "mine"
    assert one(tx.key_of(F.lit("a"), F.lit("b"))) == "a-b" and one(tx.is_style(F.lit("style"))) and one(tx.is_naflex(F.lit("X-NaFlex")))
    assert one(tx.comma_list(F.lit(" a, ,b ,"))) == ["a", "b"] and one(tx.segmenter_prompt(F.lit(" A Canoe"))) == "a canoe."
    assert [one(tx.perturbation_label(F.lit(p))) for p in (-0.16, 0.0, 0.08)] == ["Erode 16%", "Default", "Dilate 8%"]
    assert one(tx.tidy_punctuation(F.lit(" , ; an owl ,  rests . "))) == "an owl, rests."
    assert one(tx.result_name(F.lit("cp"), F.lit("o/a-b-c"), F.lit(""), F.lit("m"))) == "cp__a-b__m"


STRIPPED = {
    "d1": "A painting of guarding a doorway", "d2": "den sits under an oak", "d3": "fishing in the reeds", "d4": "A picture of by a fence",
    "d5": "a paddler rests beside the jetty", "d6": "A blue door with ivy", "d7": "A painting", "d8": "blinks, styled",
}
#: action, attribute, lexical action, how the subject was found
LABELS = {
    "d1": (True, True, True, "mention"), "d2": (False, False, True, "mention"), "d3": (False, False, False, "mention"), "d4": (False, False, False, "mention"),
    "d5": (False, False, True, "mention"), "d6": (False, True, False, "first_noun_chunk"), "d7": (False, False, False, "none"), "d8": (True, False, True, "mention"),
}


def prompts(spark):
    words, names = tokens.fixture(spark)
    return syntax.mentions(syntax.documents(words), syntax.documents(names).withColumnRenamed("t", "name"))


def test_syntax_stripper(spark):
    assert {r["doc_id"]: r["stripped"] for r in syntax.strip_subjects(prompts(spark)).collect()} == STRIPPED


def test_strata(spark):
    plain = {r["doc_id"]: r for r in syntax.strata(prompts(spark)).collect()}
    lexical = {r["doc_id"]: r for r in syntax.strata(prompts(spark), lexical=True).collect()}
    assert {d: (r["action_pose"], r["attribute"], lexical[d]["action_pose"], r["subject_found_by"]) for d, r in plain.items()} == LABELS
    for r in plain.values():
        assert r["subject_dependent"] == (r["action_pose"] or r["attribute"]) == (not r["scene_only"])
    labelled = syntax.strata(prompts(spark))
    assert {n: labelled.where(syntax.stratum(n)).count() for n in ("all", "action_pose", "attribute", "both_action_and_attribute", "scene_only")} == {"all": 8, "action_pose": 2, "attribute": 2, "both_action_and_attribute": 1, "scene_only": 5}


def test_edges_of_any_depth():
    """Chains, forests, rings and wrong heads against a walk up from every token."""
    rng = np.random.default_rng(0)
    docs = [[], [0], list(range(1, 40)) + [39], [0] * 30, [1, 2, 0, 0, 4], [-1, 5, 1, 2], [1, 0]]
    docs += [[int(rng.integers(0, n)) for _ in range(n)] for n in rng.integers(1, 25, 60)]
    lefts, rights = syntax.edges(np.array([h for d in docs for h in d]), np.array([len(d) for d in docs]))
    at = 0
    for heads in docs:
        n = len(heads)
        up = [h if 0 <= h < n else i for i, h in enumerate(heads)]

        def walk(i, up=up):
            seen = [i]
            while up[seen[-1]] != seen[-1] and len(seen) <= len(up):
                seen.append(up[seen[-1]])
            return seen if len(seen) <= len(up) else [i]  # leads into a ring

        above = [walk(i) for i in range(n)]
        for i in range(n):
            below = [j for j in range(n) if i in above[j]]
            assert (lefts[at + i], rights[at + i]) == (min(below), max(below)), heads
        at += n


def test_deep_modifiers_go_with_the_mention(spark):
    n = 200
    rows = [("d", i, "so", True, "so", "so", "ADV", "nmod", i + 1) for i in range(n)] + [("d", n, "owl", True, "owl", "owl", "NOUN", "ROOT", n), ("d", n + 1, "sits", False, "sits", "sit", "VERB", "acl", n)]
    words = spark.createDataFrame(rows, struct(TOKEN))
    name = spark.createDataFrame([("d", 0, "owl", False, "owl", "owl", "NOUN", "ROOT", 0)], struct(TOKEN))
    docs = syntax.mentions(syntax.documents(words), syntax.documents(name).withColumnRenamed("t", "name"))
    assert syntax.strip_subjects(docs).first()["stripped"] == "sits"


def test_facade_strips_by_syntax(spark):
    words, names = tokens.fixture(spark)
    triples = words.groupBy("doc_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.struct("i", "text")))["text"]).alias("prompt")).withColumn("object_name", F.when(F.col("doc_id") != "d7", "some"))
    got = {r["doc_id"]: r["pf_prompt"] for r in PairScorer(stripper="syntax").prompts(triples, (words, names)).collect()}
    assert {k: v for k, v in got.items() if k != "d7"} == {k: v for k, v in STRIPPED.items() if k != "d7"}
    with pytest.raises(ValueError, match="token tables"):
        PairScorer(stripper="syntax").prompts(triples)
