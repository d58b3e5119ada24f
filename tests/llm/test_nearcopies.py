from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from agreemill.llm import simhash

SCHEMA = "doc_id long, text string"


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    """Edited copies of similarity 0.65 to 0.95, chains of them, and a shared passage."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(25)
    rows = []
    for _ in range(30):
        words = fresh(rng.randint(150, 300)) + passage
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 2, 4, 6, 8):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = fresh(1)[0]
            rows.append((len(rows), " ".join(copy)))
            if edits == 4:
                words = copy
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two  words")]


def least_of(rows):
    least = {i: i for i, _ in rows}
    near = [(a, b) for a, s in rows for b, t in rows if a < b and jaccard(s, t) >= 0.8]
    for _ in rows:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    return least, near


def test_stage_drops_every_edited_copy(spark):
    rows = corpus()
    least, near = least_of(rows)
    of = dict(rows)
    assert sum(jaccard(of[a], of[b]) < 0.95 for a, b in near) > 40
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i in least if least[i] == i)


def merged(least, edges):
    mine = {i: i for i in least}
    for _ in least:
        for a, b in edges:
            mine[a] = mine[b] = min(mine[a], mine[b])
    return mine


@pytest.mark.parametrize(("part", "few"), [(simhash.PART, 10**6), (20, 10**6)])
def test_all_pairs_of_one_bucket_meet(spark, part, few):
    """All texts in one bucket, whole or in parts: its most typical one is like few of them."""
    rows = corpus()
    least, _ = least_of(rows)
    texts = spark.createDataFrame([(i, t or "") for i, t in rows], "fp long, text string")
    members = []
    for i, t in rows:
        own = simhash.ShingleHashes()(t)
        members.append((1, len(rows), i, int(np.uint64(simhash.majority(own)).view(np.int64)), len(own)))
    edges = simhash.copy_links(spark.createDataFrame(members, "bucket long, m long, fp long, sim long, n int"), texts, part, few)
    assert merged(least, [tuple(r) for r in edges.collect()]) == least


def test_edited_copies_of_one_text_in_great_number(spark):
    """Copies that are far from each other but near their origin are one group."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(400), 8):
            copy[at] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {0}
    assert jaccard(rows[1][1], rows[2][1]) < 0.8 <= jaccard(rows[0][1], rows[1][1])


@pytest.mark.parametrize("crowd_part", [512, 9])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, crowd_part):
    """Every bucket crowded, whole or in parts."""
    monkeypatch.setattr(simhash.copy_links, "__defaults__", (simhash.PART, 1, crowd_part))
    rows = corpus()
    least, _ = least_of(rows)
    got = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == least


def test_small_and_repeated_texts(spark):
    rows = [(i, t) for i, t in enumerate(["a b c d e f g h", "A b c d  e f g h", "a b c d e f g h i", "a b c d e f g x", "la " * 3000, "la " * 9000, "one", "One"])]
    got = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    least, _ = least_of(rows)
    assert got == least and got[1] == 0 and got[5] == 4 and got[7] == 6


def test_shingle_hashes_tell_sets_apart(monkeypatch):
    rng = random.Random(2)
    texts = [t for _, t in corpus()] + [" ".join(rng.choices(["a", "B", "é", "ab"], k=rng.randint(0, 40))) for _ in range(300)]
    hashes = simhash.ShingleHashes()
    seen = {}
    for t in texts:
        own = set(hashes(t).tolist())
        assert len(own) == len(sets(t))
        for s in sets(t):
            seen.setdefault(s, set()).update(hashes(" ".join(s)).tolist())
        assert own == {x for s in sets(t) for x in seen[s]}
    assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == len(seen)
    whole = hashes(texts[0])
    monkeypatch.setattr(simhash, "STRETCH", 50)
    assert (hashes(texts[0]) == whole).all()
