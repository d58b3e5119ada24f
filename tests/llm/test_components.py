from __future__ import annotations

import random

from agreemill.llm.components import components


def test_long_chain_needs_many_rounds(spark):
    """A chain with mixed names: right classes, and an estimate of bounded length."""
    names = list(range(600))
    random.Random(4).shuffle(names)
    rows = [(a, b) for a, b in zip(names[:400], names[1:400], strict=False)] + [(a, b) for a, b in zip(names[400:], names[401:], strict=False)]
    out = components(spark.createDataFrame(rows, "a long, b long"), "a", "b")
    expected = {n: min(part) for part in (names[:400], names[400:]) for n in part}
    assert {r["node"]: r["component"] for r in out.collect()} == expected
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200


def test_no_edges_loops_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, 1), (3, 2), (2, 3), (3, 2), (None, 5), (5, None)], "a long, b long")
    assert sorted(map(tuple, components(df, "a", "b").collect())) == [(2, 2), (3, 2)]
    assert components(df.where("a > 9"), "a", "b").count() == 0
