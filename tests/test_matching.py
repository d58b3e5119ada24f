"""Weighted samples and reciprocal matches against slow forms."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agreemill.operators import matching, patches
from agreemill.operators.pairs import unit


def slow_unit(*ids, seed=0):
    h, p = seed, 2**31 - 1
    for i in ids:
        h = (h * 1_000_003 + i % p) % p
        h = (h * h + 12_345) % p
        h = (h * h + 67_891) % p
    return (h + 0.5) / p


def slow_sample(rows, n, seed):
    out = []
    for g in {r[0] for r in rows}:
        own = sorted((-math.log(slow_unit(i, j, seed=seed)) / w, i, j) for h, i, j, w in rows if h == g and w is not None and w > 0)
        out += [(g, i, j) for _, i, j in own[:n]]
    return sorted(out, key=repr)


SCHEMA = "g string, i long, j long, w double"


@pytest.mark.parametrize("held", [10, 60, 200_000])
def test_sample_equals_sorting_all(spark, monkeypatch, held):
    """Tasks that cut early, or hand on often, draw the same rows."""
    monkeypatch.setattr(matching, "HELD_ROWS", held)
    rng = np.random.default_rng(1)
    rows = [(["hot", "hot", f"g{k % 9}", None][k % 4], k, int(rng.integers(0, 5)), float(rng.choice([0.0, 0.5, 1.0, 3.0]))) for k in range(900)] + [("few", 1, 1, 1.0), ("none", 1, 1, 0.0), ("null", 1, 1, None)]
    for parts in (1, 5):
        got = matching.weighted_sample(spark.createDataFrame(rows, SCHEMA).repartition(parts), ["g"], F.col("w"), ["i", "j"], 40, 3)
        assert sorted(((r["g"], r["i"], r["j"]) for r in got.collect()), key=repr) == slow_sample(rows, 40, 3)


def test_held_rows_are_bounded():
    rows = pa.table({"g": ["b", None, "a", "b", None, "b"], "_e": [3.0, 1.0, 2.0, 1.0, 0.5, 2.0], "_row": [1, 2, 3, 4, 5, 6]})
    assert matching._smallest(rows, ["g"], 1)["_row"].to_pylist() == [3, 4, 5]
    assert matching._smallest(rows.slice(0, 0), ["g"], 1).num_rows == 0


def test_chances_follow_weights(spark):
    rows = [(f"t{t}", t, i, [1.0, 2.0, 5.0][i]) for t in range(4000) for i in range(3)]
    drawn = Counter(r["j"] for r in matching.weighted_sample(spark.createDataFrame(rows, SCHEMA), ["g"], F.col("w"), ["i", "j"], 1).collect())
    assert sum(drawn.values()) == 4000
    for i, share in enumerate((1 / 8, 2 / 8, 5 / 8)):
        assert drawn[i] / 4000 == pytest.approx(share, abs=0.03)


def test_recall_of_a_sample(spark):
    rows = spark.createDataFrame([(True, True, 0.5), (True, False, 0.9), (False, True, 1.0), (True, True, 0.7)], "in_ref boolean, in_out boolean, certainty double")
    r = rows.agg(*[v.alias(k) for k, v in matching.sampled_recall().items()]).first()
    assert (r["n_matches"], r["n_ref_in_fg"], r["n_both_in_fg"]) == (4, 3, 2)
    assert r["recall"] == pytest.approx(2 / 3) and r["mean_certainty_fg"] == pytest.approx(0.6)
    none = rows.where("certainty > 9").agg(*[v.alias(k) for k, v in matching.sampled_recall().items()]).first()
    assert none["recall"] == 0 and none["mean_certainty_fg"] == 0


def slow_reciprocal(seeds, ref, out, hops):
    """One seed at a time."""
    best = {}
    for s in seeds:
        for k in range(1, hops + 1):
            there = int(np.round(out @ ref[s], 12).argmax())
            back = int(np.round(ref @ out[there], 12).argmax())
            if back == s:
                best[s, there] = min(k, best.get((s, there), k))
                break
            s = back
    return sorted((i, j, k) for (i, j), k in best.items())


def test_reciprocal_equals_walking_every_seed(monkeypatch):
    rng = np.random.default_rng(2)
    deepest = 0
    for strip in (3, 4096):
        monkeypatch.setattr(patches, "STRIP", strip)
        monkeypatch.setattr(matching, "STRIP", strip)
        for n, m in ((40, 30), (25, 60), (1, 1), (700, 500)):
            ref, out = unit(rng.normal(size=(n, 3))), unit(rng.normal(size=(m, 3)))
            seeds = matching.grid_seeds(n, 8, 2) if n > 1 else np.array([0])
            for hops in (1, 2, 10):
                got = matching.reciprocal_from(seeds, ref, out, hops)
                assert got == slow_reciprocal(seeds.tolist(), ref, out, hops)
                deepest = max([deepest, *(k for _, _, k in got)])
    assert deepest >= 3


def test_seeds_of_a_grid():
    assert matching.grid_seeds(32, 8, 4).tolist() == [8 * 2 + 2, 8 * 2 + 6]
    assert matching.grid_seeds(6, 3, 1).tolist() == list(range(6)) and not len(matching.grid_seeds(0, 4, 2))


def test_matches_of_a_frame(spark):
    rng = np.random.default_rng(4)
    images = {"a": rng.normal(size=(20, 4)), "b": rng.normal(size=(12, 4)), "none": np.zeros((0, 4))}
    blocks = spark.createDataFrame([(k, 4, v.tolist()) for k, v in images.items()], "image_id string, width int, feat array<array<double>>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "none"), ("a", "missing")], "ref string, out string")
    got = sorted(tuple(r) for r in matching.reciprocal_matches(pairs, blocks, 2).collect())
    want = [(x, y, *m) for x, y in (("a", "b"), ("b", "a")) for m in slow_reciprocal(matching.grid_seeds(len(images[x]), 4, 2).tolist(), unit(images[x]), unit(images[y]), 10)]
    assert got == sorted(want) and got


def test_a_strip_of_hops_is_bounded_in_cells(monkeypatch):
    """A hop makes no more cosines at a time than CELLS, whatever the image."""
    seen = []
    monkeypatch.setattr(patches, "CELLS", 600)
    monkeypatch.setattr(matching.np, "round", lambda s, *a, f=np.round, **k: (seen.append(s.size), f(s, *a, **k))[1])
    rng = np.random.default_rng(3)
    ref, out = unit(rng.normal(size=(200, 4))), unit(rng.normal(size=(300, 4)))
    matching.reciprocal_from(np.arange(200), ref, out)
    assert max(seen) <= 600
