"""Unranked cross pairs against the enumerated pool."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from agreemill.operators import pairs


def enumerated(groups):
    """The whole pool, in order."""
    names = sorted(groups)
    return [(x, a, y, b) for x, y in itertools.combinations(names, 2) for a in sorted(groups[x]) for b in sorted(groups[y])]


def frame(spark, groups):
    return spark.createDataFrame([(g, k) for g, keys in groups.items() for k in keys], "g string, k long").repartition(3)


GROUPS = {"b": [5, 1, 9], "a": [2, 4], "d": [7], "c": [3, 8, 6, 10]}


@pytest.mark.parametrize("sizes", [[2, 3, 1], [5], [], [1, 1, 1, 1], [3, 0, 2, 0], [0, 4, 1]])
def test_every_ordinal(sizes):
    pool = pairs.CrossPool(np.array(sizes, np.int64))
    want = [(i, j, a, b) for i, j in itertools.combinations(range(len(sizes)), 2) for a in range(sizes[i]) for b in range(sizes[j])]
    assert len(pool) == len(want)
    if want:
        assert list(zip(*(x.tolist() for x in pool.pairs(np.arange(len(want)))), strict=True)) == want


def test_large_pools_are_counted_exactly():
    sizes = np.full(1000, 10**6)
    pool = pairs.CrossPool(sizes)
    assert len(pool) == 1000 * 999 // 2 * 10**12
    last = [int(x[0]) for x in pool.pairs(np.array([len(pool) - 1]))]
    assert last == [998, 999, 10**6 - 1, 10**6 - 1]
    with pytest.raises(ValueError, match="too many"):
        pairs.CrossPool(np.full(10, 10**10))


def test_sample_equals_numpys_choice_from_the_pool(spark):
    pool = enumerated(GROUPS)
    want = [(o, *pool[o]) for o in np.random.default_rng(3).choice(len(pool), size=12, replace=False)]
    got = [tuple(r) for r in pairs.cross_sample(frame(spark, GROUPS), "g", "k", 12, 3).collect()]
    assert sorted(got) == sorted(want)
    assert sorted(tuple(r)[1:] for r in pairs.cross_sample(frame(spark, GROUPS), "g", "k", 1000, 3).collect()) == sorted(pool)


def test_hot_group_and_ordinals_beyond_the_pool(spark):
    groups = {"hot": list(range(0, 900)), **{f"g{i:02}": [1000 + i] for i in range(20)}}
    pool = enumerated(groups)
    wanted = [0, 5, 17, len(pool) - 1, len(pool), -1, 10**12]
    got = sorted(tuple(r) for r in pairs.unranked(frame(spark, groups), "g", "k", spark.createDataFrame([(o,) for o in wanted], "ordinal long")).collect())
    assert got == sorted((o, *pool[o]) for o in wanted[:4])


def test_one_group_and_no_rows(spark):
    assert pairs.cross_sample(frame(spark, {"a": [1, 2]}), "g", "k", 5, 0).collect() == []
    assert pairs.cross_sample(frame(spark, {}), "g", "k", 5, 0).collect() == []


@pytest.mark.parametrize(("k", "modulus", "blocks"), [(5, 1_000_003, 1), (40, 13, 3), (10_000, 7, 4), (1, 1, 2)])
def test_hashed_sample_equals_sorting_all_pairs(spark, k, modulus, blocks):
    """Ties beyond a tile's share, more than all pairs, one draw for all."""
    groups = {"a": range(0, 40, 3), "b": range(1, 30, 2), "c": [100, 7], None: [55]}
    df = spark.createDataFrame([(g, int(x)) for g, keys in groups.items() for x in keys] + [("a", None)], "g string, k long")
    every = sorted(((x * 7919 + y * 104729) % modulus, x, y) for g in "abc" for h in "abc" if g < h for x in groups[g] for y in groups[h])
    got = [(r["draw"], r["a"], r["b"]) for r in pairs.hashed_cross_sample(df, "g", "k", k, modulus=modulus, blocks=blocks).collect()]
    assert got == every[:k]
