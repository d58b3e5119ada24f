"""Replicates by blocks of rows against those of a table in memory."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from agreemill.operators import blocks, resample
from agreemill.plans import rated
from tests.test_resample import collected, toy

ROWS = {"good": False, "coarse": False, "rubric": True}


def table(n=300):
    t = toy(n, 9).assign(row_idx=np.arange(n) * 3 % 1000 - 50)
    t["cluster"] = [f"s{k}" for k in t["cluster"] // 3]
    t["coarse"] = t["good"].round(1)
    return t


@pytest.mark.parametrize("cluster", [None, "cluster"])
@pytest.mark.parametrize(("levels", "count", "drawn"), [(1, 5, 64), (30, 3, 1_000_000), (1000, 2, 7)])
def test_blocks_have_the_draws_and_values_of_the_table(spark, monkeypatch, cluster, levels, count, drawn):
    """Ties over blocks, several labels in blocks of their own, and none."""
    monkeypatch.setattr(blocks, "LEVELS", levels)
    monkeypatch.setattr(blocks, "DRAWN", drawn)
    t = table()
    expected = collected(resample.rated_replicates(spark, t.sort_values("row_idx").reset_index(drop=True), ROWS, "t", 9, cluster=bool(cluster)))
    got = collected(blocks.replicates(spark.createDataFrame(t).repartition(4), ROWS, "t", 9, cluster, blocks=count))
    assert got.keys() == expected.keys()
    assert max(abs(got[k] - v) for k, v in expected.items()) < 1e-9


def test_tables_over_the_bound_of_one_in_memory(spark, monkeypatch):
    """The plan refused them."""
    monkeypatch.setattr(resample, "MAX_TABLE_ROWS", 50)
    t = table(80)
    out = rated.rated(spark, spark.createDataFrame(t), {"good": False}, "plan", 5, cluster="cluster")
    assert out["intervals"].count() == 4 and out["cluster_intervals"].count() == 4


def test_one_value_has_no_statistics(spark):
    t = pd.DataFrame({"row_idx": range(98), "x": 0.1, "g1": 0.3, "g2": 0.3})
    for ordinal in (False, True):
        got = collected(blocks.replicates(spark.createDataFrame(t), {"x": ordinal}, "t", 3, blocks=2))
        assert len(got) == 16 and all(math.isnan(v) for k, v in got.items() if k[0] != "x" or not ordinal or k[1] == "rho")


def test_positions_of_any_order(spark):
    rows = [(7, "b"), (-1, "a"), (None, "z"), (3, "c"), (50, "B")]
    df = spark.createDataFrame(rows, "i int, s string")
    assert [r["i"] for r in sorted(blocks.numbered(df, "i", "p").collect(), key=lambda r: r["p"])] == [-1, 3, 7, 50, None]
    assert [r["s"] for r in sorted(blocks.numbered(df, "s", "p").collect(), key=lambda r: r["p"])] == ["B", "a", "b", "c", "z"]
