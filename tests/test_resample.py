from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agreemill.operators import resample, stats
from agreemill.plans import rated

ROWS = {"good": False, "rubric": True}


def toy(n=400, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(2, 1, n)
    near = lambda s: base + rng.normal(0, s, n)
    rate = lambda s: np.clip(np.round(near(s)), 0, 4)
    return pd.DataFrame({"good": near(0.5), "rubric": rate(0.5), "g1": rate(0.4), "g2": rate(0.4), "cluster": np.arange(n) // 8})


def direct(table, draws, ordinal, name):
    """Replicates by indexing rows, with plain ranks."""
    from tests.test_stats import coincidence_alpha, rankdata

    out = []
    for idx in draws:
        t = table.iloc[idx]
        x, g1, g2 = t[name].to_numpy(), t["g1"].to_numpy(), t["g2"].to_numpy()
        rho = np.corrcoef(rankdata(x), rankdata((g1 + g2) / 2))[0, 1]
        if not ordinal:
            x, g1, g2 = (x - x.min()) / (x.max() - x.min()), g1 / 4, g2 / 4
        out.append(((coincidence_alpha(x, g1) + coincidence_alpha(x, g2)) / 2, rho))
    return np.array(out)


def collected(df):
    return {(r["label"], r["stat"], r["b"]): r["value"] for r in df.collect()}


def test_key_replicates_are_numpys_draws_whatever_the_tasks(spark):
    table, total = toy(60), 12
    rng = np.random.default_rng(np.random.SeedSequence([20261106, __import__("zlib").crc32(b"t")]))
    draws = rng.integers(0, 60, size=(total, 60))
    one = collected(resample.rated_replicates(spark, table, ROWS, "t", total, tasks=1))
    assert one == collected(resample.rated_replicates(spark, table, ROWS, "t", total, tasks=5))
    for name, ordinal in ROWS.items():
        expected = direct(table, draws, ordinal, name)
        got = np.array([[one[name, "alpha", b], one[name, "rho", b]] for b in range(total)])
        assert abs(got - expected).max() < 1e-9
    assert one != collected(resample.rated_replicates(spark, table, ROWS, "other", total, tasks=1))


def test_states_go_on_where_the_last_range_ended(monkeypatch):
    """Ranges of any size, wound in blocks of any size, give one stream."""
    whole = [np.bincount(d, minlength=7) for d in resample.generator("t").integers(0, 7, size=(600, 7))]
    for wind in (5, 64, 8_000_000):
        monkeypatch.setattr(resample, "WIND", wind)
        ranges = [(0, 100), (100, 333), (333, 334), (334, 600)]
        states = resample.draw_states("t", 7, 600, ranges)
        parts = [d for (a, b), state in zip(ranges, states, strict=True) for d in resample.key_draws(state, 7, b - a)]
        assert len(parts) == 600 and all((x == y).all() for x, y in zip(whole, parts, strict=True))


def test_tasks_do_not_wind(spark, monkeypatch):
    """Winding happens once, before the tasks: twice the tasks, as many draws."""
    drawn = []
    real = resample._drawn

    def counted(rng, high, rows, size):
        drawn.append(rows)
        return real(rng, high, rows, size)

    monkeypatch.setattr(resample, "_drawn", counted)
    for tasks in (4, 8, 16):
        drawn.clear()
        resample.draw_states("t", 50, 160, resample._ranges(160, tasks))
        assert sum(drawn) == 160 - 160 // tasks


def test_cluster_draws_take_whole_clusters():
    member = np.array([2, 0, 0, 1, 2, 2])
    (state,) = resample.draw_states("t|cluster", 3, 50, [(0, 50)])
    rng = resample.generator("t|cluster")
    for counts in resample.cluster_draws(state, member, 3, 50):
        assert (counts == np.bincount(rng.integers(0, 3, size=3), minlength=3)[member]).all()
        assert counts[0] + counts[1] + counts[3] == 3


def test_cluster_interval_is_wider_under_clustered_noise(spark):
    rng = np.random.default_rng(1)
    k = np.arange(600) % 30
    shared = rng.normal(0, 1.2, 30)[k]
    base = rng.normal(2, 0.3, 600)
    table = pd.DataFrame({"x": base + shared, "g1": np.clip(np.round(base + rng.normal(0, 0.3, 600)), 0, 4), "g2": np.clip(np.round(base + shared), 0, 4), "cluster": k})
    widths = []
    for cluster in (False, True):
        rows = resample.intervals(resample.rated_replicates(spark, table, {"x": False}, "w", 300, cluster=cluster, human=False)).collect()
        widths.append(next(r["hi"] - r["lo"] for r in rows if r["stat"] == "rho"))
    assert widths[1] > 1.3 * widths[0]


def test_auc_replicates(spark):
    rng = np.random.default_rng(2)
    w, c = {"m": rng.normal(1, 1, 200)}, {"m": rng.normal(0, 1, 200)}
    got = collected(resample.auc_replicates(spark, w, c, "a", 600, tasks=1))
    assert got == collected(resample.auc_replicates(spark, w, c, "a", 600, tasks=3))
    exact = (w["m"][:, None] > c["m"]).mean()
    assert abs(got["m", "auc", -1] - exact) < 1e-12
    gen = resample.generator("a")
    gen.integers(0, 200, size=(250, 200)), gen.integers(0, 200, size=(250, 200))
    iw, ic = gen.integers(0, 200, size=(250, 200)), gen.integers(0, 200, size=(250, 200))
    assert abs(got["m", "auc", 253] - resample.auc_of(w["m"][iw[3]], c["m"][ic[3]])) < 1e-12
    subjects = (np.arange(200) // 10, np.arange(200) // 20)
    by = collected(resample.auc_replicates(spark, w, c, "a", 40, clusters=subjects, tasks=2))
    assert len(by) == 41 and np.std([v for k, v in by.items() if k[2] >= 0]) > 0


def test_auc_of_counts(spark):
    rng = np.random.default_rng(3)
    w, c = rng.normal(0.3, 0.3, 150).round(2), rng.normal(0, 0.3, 400).round(2)
    rows = [(float(v), True) for v in w] + [(float(v), False) for v in c]
    df = spark.createDataFrame([*rows, (None, True), (float("nan"), False)], "s double, within boolean")
    counts = stats.score_counts(df, "s", F.col("within"))
    expected = []
    for iw, ic in resample.auc_draws("plain", len(w), len(c), 0, 600, 600):
        expected.append(resample.auc_of(w[iw], c[ic]))
    for width in (0.02, 0.3, 100.0):
        got = collected(resample.auc_count_replicates(counts, "s", "m", "t", 600, width=width))
        again = collected(resample.auc_count_replicates(counts.repartition(5, "pos"), "s", "m", "t", 600, width=width))
        assert len(got) == 601 and all(abs(got[k] - again[k]) < 1e-12 for k in got)
        assert abs(got["m", "auc", -1] - resample.auc_of(w, c)) < 1e-12
        reps = np.array([v for k, v in got.items() if k[2] >= 0])
        assert abs(reps.std() / np.std(expected) - 1) < 0.12 and abs(reps.mean() - np.mean(expected)) < 5 * reps.std() / 600**0.5
    empty = collected(resample.auc_count_replicates(counts.withColumn("pos", F.lit(0)), "s", "m", "t", 5))
    assert len(empty) == 6 and all(np.isnan(v) for v in empty.values())
    with pytest.raises(ValueError, match="widen"):
        resample.auc_count_replicates(counts, "s", "m", "t", 2_000_000, width=0.01)


def test_intervals_and_differences_ignore_nan(spark):
    rows = [("a", "s", -1, 0.5)] + [("a", "s", b, float(b) if b else float("nan")) for b in range(101)]
    rows += [("b", "s", -1, 0.25)] + [("b", "s", b, float(b) - 1) for b in range(101)]
    df = spark.createDataFrame(rows, "label string, stat string, b int, value double")
    r = {x["label"]: x for x in resample.intervals(df).collect()}["a"]
    values = np.arange(1, 101)
    assert (r["point"], r["n_nan_reps"]) == (0.5, 1)
    assert abs(r["lo"] - np.percentile(values, 2.5)) < 1e-9 and abs(r["hi"] - np.percentile(values, 97.5)) < 1e-9 and abs(r["se"] - values.std(ddof=1)) < 1e-9
    d = resample.differences(df, "a", "b").first()
    assert (d["diff_point"], d["lo"], d["hi"], d["excludes_zero"], d["p_boot_two_sided"]) == (0.25, 1, 1, True, 0)


def test_rated_plan(spark):
    df = spark.createDataFrame(toy(80).assign(row_idx=range(80)))
    out = rated.rated(spark, df, ROWS, "plan", 40, [("good", "rubric")], "cluster")
    assert {r["label"] for r in out["intervals"].collect()} == {"good", "rubric", resample.HUMAN}
    points = {r["label"]: r for r in out["points"].collect()}
    whole = {(r["label"], r["stat"]): r["point"] for r in out["intervals"].collect()}
    assert abs(points["good"]["alpha"] - whole["good", "alpha"]) < 1e-9 and abs(points["good"]["alpha_paper"] - points["good"]["alpha"]) < 2e-3
    assert rated.lookup(out["comparisons"], "good", "rubric", "rho").count() == 1 and out["n_clusters"].first()[0] == 10


def test_poisson_bootstrap_is_centred(spark):
    from tests.test_stats import coincidence_alpha

    t = toy(2000).assign(row_idx=range(2000))
    reps = [r["alpha"] for r in resample.poisson_alpha(spark.createDataFrame(t), "g1", "g2", 60).collect()]
    assert len(reps) == 60 and abs(np.mean(reps) - coincidence_alpha(t["g1"], t["g2"])) < 4 * np.std(reps) / 60**0.5 + 1e-3
