from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from agreemill.llm import simhash
from agreemill.llm.components import components

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = {i: slow_fingerprint(t) for i, t in rows}
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (f"{fps[i]:016x}", root(i)) for i in ids}


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"Wörd{i}" for i in range(50)] + ["A", "b", " x"]
    texts = [None, "", " \t\r\n", "one", "one two", "One  Two", "x " * 5000]
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("\n".join(copy))
    return list(enumerate(texts, 10))


def test_fingerprint_equals_slow_form():
    for _, text in corpus(120):
        assert simhash.fingerprint_of(text) == slow_fingerprint(text)


def near_pairs(values, radius):
    n = len(values)
    return {p for i, j in simhash.near(values, np.arange(n) + 1, np.full(n, n), radius) for p in zip(i.tolist(), j.tolist(), strict=True)}


@pytest.mark.parametrize("n", [1, 2, 64, 65, 300])
def test_planes_count_differences(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 1 << 63, 8, dtype=np.uint64)[rng.integers(0, 8, n)]
    for _ in range(12):
        values = values ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    for radius in (0, 1, 2, 3, 4, 7, 26, 31):
        assert near_pairs(values, radius) == {(i, j) for i in range(n) for j in range(i + 1, n) if int(values[i] ^ values[j]).bit_count() <= radius}


def test_groups_meet_whole_or_as_two_parts():
    begin, end = simhash._spans(np.array([0, 3, 4]), np.array([0, 0, 0, 0, 0, 0, 1, 1]))
    met = {(i, j) for i in range(8) for j in range(begin[i], end[i])}
    assert met == {(0, 1), (0, 2), (1, 2), (4, 6), (4, 7), (5, 6), (5, 7)}


def test_every_link_comes_from_the_planes(spark, monkeypatch):
    """Buckets of two and more alike: with the planes blind, no link is left."""
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.concatenate([values, values ^ np.uint64(5)])
    starts = np.arange(0, 80, 2)
    order = np.argsort(np.concatenate([np.arange(40), np.arange(40)]), kind="stable")
    span = simhash._spans(starts, np.zeros(80, int))
    a, _ = simhash.forest(simhash.near(values[order], *span), 80)
    assert len(a) == 40
    monkeypatch.setattr(simhash, "planes_of", lambda v: np.repeat(np.uint64([[0xAAAAAAAAAAAAAAAA], [0x5555555555555555]]), 2, axis=1).repeat(32, axis=0))
    assert not len(simhash.forest(simhash.near(values[order], *span), 80)[0])


def test_forest_keeps_components_and_no_cycle():
    rng = np.random.default_rng(3)
    i, j = rng.integers(0, 400, (2, 700))
    a, b = simhash.forest(iter([(i[:300], j[:300]), (i[300:], j[300:])]), 400)

    def roots(edges):
        label = list(range(400))
        for _ in range(400):
            before = list(label)
            for x, y in edges:
                label[x] = label[y] = min(label[x], label[y])
            if label == before:
                return label

    whole = roots(list(zip(i.tolist(), j.tolist(), strict=True)))
    assert roots(list(zip(a.tolist(), b.tolist(), strict=True))) == whole
    assert len(a) == 400 - len(set(whole))


def test_masks_leave_no_pair_apart():
    rng = random.Random(5)
    options = simhash.masks()
    for _ in range(200):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(x & m == 0 for m in options)


def test_components_match_brute_force(spark):
    rows = corpus(160)
    docs = spark.createDataFrame(rows + [rows[9], rows[9]], SCHEMA)
    got = simhash.duplicate_components(docs).collect()
    expected = slow_components(rows)
    assert len(got) == len(rows) + 2
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == expected


def test_crowded_buckets_are_dealt_as_parts_without_losing_links(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    while len(fps) < 400:
        fps.add(rng.getrandbits(64))
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)], "fp long")
    found = {r["node"]: r["component"] for r in components(simhash.links(classes, part=8), "a", "b").collect()}
    whole = {r["node"]: r["component"] for r in components(simhash.links(classes), "a", "b").collect()}
    assert found == whole and len(found) >= 300


def test_components_of_a_chain_a_hub_and_noise(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (100, 101), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_empty_table_and_null_ids(spark):
    assert simhash.duplicate_components(spark.createDataFrame([], SCHEMA)).collect() == []
    got = simhash.duplicate_components(spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "z")], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 5), (5, 5)]
