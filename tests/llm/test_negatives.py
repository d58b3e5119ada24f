"""Hard negatives against brute force, bounds of the trees, and edge cases."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agreemill.llm import negatives as neg

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=5, low=80, high=100):
    """All rows against all anchors, in plain Python integers."""
    good = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for n, (anchor, label, v) in enumerate(good):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for m, (i, other, w) in enumerate(good) if m != n)
        for p, positive, _ in [s for s in scored if s[2]][:positives]:
            window = [(i, -s) for s, i, same in scored if not same and -low * p <= -100 * s <= -high * p]
            out += [(anchor, positive, k, i, -p, s) for k, (i, s) in enumerate(window[:negatives], 1)]
    return Counter(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = neg.hard_negatives(df, "vec_id", label, "embedding", F.col("id") % 100 == 0, **options)
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("tree_rows", [7, 64, 2048])
def test_equals_brute_force(spark, tree_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist(), int(rng.integers(0, 4))) for i in range(0, 3000, 5)]
    assert (found := mined(spark, rows, tree_rows=tree_rows)) == brute(rows) and len(found) > 100


def test_ties_copies_and_a_hot_vector(spark):
    """A third of all rows are one vector; equal scores go to the smaller id."""
    rows = [(i, [1.0, 2.0], i % 3) for i in range(0, 1200, 4)] + [(i, [float(i % 5), 1.0], i % 4) for i in range(1, 1000, 2)]
    assert mined(spark, rows, tree_rows=100) == brute(rows)


def test_repeated_rows_are_rows(spark):
    rows = [(100, [1.0, 0.0], 1)] * 2 + [(5, [1.0, 0.0], 1), (6, [0.9, 0.0], 2), (6, [0.9, 0.0], 2)]
    found = mined(spark, rows)
    assert found == brute(rows) and max(found.values()) == 2


def test_nulls_and_odd_rows_take_no_part(spark):
    rows = [
        (0, [1.0, 1.0], 9), (1, [1.0, 1.0], 0), (2, [1.0, 0.9], 3), (None, [1.0, 1.0], 3), (3, None, 3), (4, [None, 1.0], 3), (5, [float("nan"), 1.0], 3), (6, [float("inf"), 1.0], 3),
        (8, [1.0, 0.95], None), (200, [-1.0, -1.0], 1), (300, [], 5), (301, [], 5), (302, [2.0], 6),
    ]
    found = mined(spark, rows)
    assert found == brute(rows)
    assert {k[3] for k in found} <= {2, 300, 301, 302, 200, 0, 1}


def test_empty_table_and_clashing_columns(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])  # no anchor
    names = "vec_id long, embedding array<float>, label int, id string, uid string, score string, anchor string, rank string, v string, tree string, block string"
    rows = [(i, [float(i % 9), 1.0], i % 3, *["x"] * 8) for i in range(0, 500, 10)]
    df = spark.createDataFrame(rows, names)
    out = neg.hard_negatives(df, "vec_id", F.col("label"), "embedding", F.col("id") % 100 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count()


def test_vectors_beyond_exact_products_are_refused(spark):
    with pytest.raises(ValueError, match="exact"):
        mined(spark, [(100, [1e12, 1.0], 1), (1, [1.0, 1.0], 1)])


def test_bounds_hold_and_prune():
    """No score lies outside its node's bounds; a tight k-th score skips leaves."""
    rng = np.random.default_rng(0)
    rows = np.floor(256 * np.concatenate([rng.normal(c, 0.05, size=(500, 16)) for c in (-2.0, 0.0, 2.0)])).astype(np.int64)
    labels = rng.integers(0, 3, len(rows))
    tree = neg.ball_tree(rows, labels, leaf=16)
    order, q = tree["order"], rows[7].astype(float)
    assert sorted(order.tolist()) == list(range(len(rows)))
    for node in range(len(tree["radii"])):
        own = order[tree["starts"][node] : tree["ends"][node]]
        middle, reach = tree["centres"][node] @ q, np.linalg.norm(q) * tree["radii"][node] + 1e-6
        scores = rows[own] @ q
        assert (scores <= middle + reach).all() and (scores >= middle - reach).all()
        assert tree["low"][node] == labels[own].min() and tree["high"][node] == labels[own].max()
    whole = {**tree, "vectors": rows[order], "labels": labels[order], "ids": order.astype(np.int64), "uids": order.astype(np.int64)}
    anchors = {"uids": np.array([7]), "ids": np.array([7]), "labels": labels[[7]], "vectors": rows[[7]], "owner": np.array([0]), "place": np.array([1]), "low": np.array([-np.inf]), "high": np.array([np.inf])}
    search = neg.Search(anchors, 5, same=True)
    search.visit(whole)
    assert search.seen < len(rows) / 3  # two of the three clusters are never scored
    low = float(np.sort(rows @ q)[700])
    windowed = neg.Search(anchors | {"low": np.array([low - 1]), "high": np.array([low])}, 5, same=False)
    windowed.visit(whole)
    assert windowed.seen < len(rows)  # nodes above the window are skipped as well
