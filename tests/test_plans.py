from __future__ import annotations

import logging

import pytest
from pyspark.sql import functions as F

from agreemill import cli, config, plugins
from agreemill.functions import numbers
from agreemill.plans import checks, conditions, keysets, keytable

CELLS = [("a", 0.47149, 0.471, 3, None, True), ("b", 0.4716, 0.472, 3, None, True), ("n", 7304.0, 7304.0, 0, None, True), ("c", 0.4726, 0.471, 3, None, False), ("t", 0.4726, 0.471, 3, 0.002, True), ("x hi", 0.4746, 0.471, 3, 0.002, False)]


def test_printed_precision(spark, tmp_path):
    df = spark.createDataFrame([c[:5] for c in CELLS], "name string, ours double, paper double, digits int, tol double")
    done = checks.checked(df)
    assert {r["name"]: r["ok"] for r in done.collect()} == {c[0]: c[5] for c in CELLS}
    assert [r["name"] for r in checks.within_tolerance(done).collect()] == ["t"]
    assert checks.exit_code(done) == 1 and checks.exit_code(done.where("name = 'a'")) == 0
    (tmp_path / "e.csv").write_text("name,paper,digits,tol\na,0.471,3,\nt,0.471,3,0.002\n")
    again = checks.checked(checks.against(df.select("name", "ours"), checks.expected(spark, str(tmp_path / "e.csv"))))
    assert {r["name"]: r["ok"] for r in again.collect()} == {"a": True, "t": True}
    assert checks.without_intervals(df, 100).count() == 5 and checks.without_intervals(df, 10_000).count() == 6


def test_python_rounding_of_half_way_means(spark):
    values = [(k / 1000 + (k + 1) / 1000) / 2 for k in range(999)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", numbers.python_round(F.col("v"), 3).alias("r"), numbers.python_format(F.col("v"), F.lit(3)).alias("f")).collect()
    assert all(r["r"] == round(r["v"], 3) and r["f"] == f"{r['v']:.3f}" for r in got)


def test_numbers(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (float("inf"), 2.0), (1.0, 4.0)], "a double, b double")
    rows = df.select(numbers.known("a").alias("k"), numbers.not_nan("a").alias("n"), numbers.ratio(F.col("b"), F.col("b") - 2).alias("r"), numbers.clip(F.col("b"), 1.0, 3.0).alias("c")).collect()
    assert [r["k"] for r in rows] == [None, None, 1.0] and rows[0]["n"] is None and [r["r"] for r in rows] == [0.0, None, 2.0] and [r["c"] for r in rows] == [1.0, 2.0, 3.0]


LONG = [("m1", k, r, float(k)) for k in (1, 2, 3) for r in "ab"] + [("m2", 1, "a", 1.0), ("m2", 2, "a", float("nan")), ("m1", 9, "a", 0.0)]


def test_keysets(spark):
    df = spark.createDataFrame(LONG, "method string, key int, rater string, value double")
    assert [r["rater"] for r in keysets.covering(df, 2).collect()] == ["a"]
    both = df.select("rater").distinct()
    assert sorted(map(tuple, keysets.common_keys(df, both).collect())) == [("m1", 1), ("m1", 2), ("m1", 3)]
    assert sorted(map(tuple, keysets.present_keys(df).collect())) == [("m1", 1), ("m1", 2), ("m1", 3), ("m2", 1)]


def test_key_table(spark):
    df = spark.createDataFrame(LONG, "method string, key int, rater string, value double")
    skeleton = spark.createDataFrame([("m1", 1), ("m1", 77)], "method string, key int")
    assert sorted((r["key"], r["a"], r["b"]) for r in keytable.build(skeleton, df, ["a", "b"]).collect()) == [(1, 1.0, 1.0), (77, None, None)]
    frames = {r: df.where(F.col("rater") == r).select("method", "key", F.col("value").alias("score")) for r in "ab"}
    assert keytable.merged(frames, ["method", "key"]).count() == 3


def test_conditions(spark):
    rows = [(1, 0.0, 0.5, 9.0, 3.0), (2, 0.3, 0.04, 5.0, 2.0), (3, 0.3, 0.4, 7.0, 1.0), (4, None, 0.4, 8.0, 4.0)]
    df = spark.createDataFrame(rows, "k int, fg_ref double, fg_out double, x double, j double")
    assert {t: sum(1 for r in conditions.at_thresholds(df).collect() if r["t"] == t) for t in conditions.THRESHOLDS} == {0.0: 2, 0.025: 2, 0.05: 1, 0.1: 1}
    assert {r["k"]: (r["x"], r["j"]) for r in conditions.scale_minimum(df, ["x"], ["j"]).collect()} == {1: (5.0, 0.0), 2: (5.0, 2.0), 3: (7.0, 1.0), 4: (5.0, 0.0)}
    assert {r["k"]: r["x"] for r in conditions.raw_zero(df, ["x"]).collect()} == {1: 0.0, 2: 5.0, 3: 7.0, 4: 0.0}
    assert {r["k"]: r["f"] for r in df.select("k", conditions.fate(0.05).alias("f")).collect()} == {1: "ref", 2: "out", 3: "kept", 4: "ref"}
    assert conditions.rated_on_both(df.withColumn("g1", F.col("x")).withColumn("g2", F.col("fg_ref"))).count() == 3


def test_plugins_run_batched_and_skip_failing_rows(spark, caplog):
    @plugins.register("prompt_scorer", "half")
    def load(scale=1.0):
        def call(row):
            if row["v"] < 0:
                raise ValueError("no")
            return {"score": row["v"] / 2 * scale}

        return call

    df = spark.createDataFrame([(1, 4.0), (2, -1.0), (3, 2.0)], "id long, v double")
    with caplog.at_level(logging.ERROR):
        got = plugins.apply(df, "prompt_scorer", "half", ["id"], "id long, score double", scale=10.0).collect()
    assert sorted(map(tuple, got)) == [(1, 20.0), (3, 10.0)]
    assert plugins.names("prompt_scorer") == ["half"]
    calls = []
    one = plugins.load_once("k", lambda: calls.append(1) or (lambda r: r))
    assert plugins.load_once("k", lambda: calls.append(1)) is one and calls == [1]
    for kind, name in (("prompt_scorer", "none"), ("matcher", "half")):
        with pytest.raises(ValueError):
            plugins.loader(kind, name)
    with pytest.raises(ValueError):
        plugins.register("other", "x")


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"model": "m", "methods": ["a"], "min_fg_fraction": null}')
    c = config.load(str(path), tag="t", max_samples=None)
    assert (c.model, c.methods, c.tag, c.min_fg_fraction, c.max_samples) == ("m", ("a",), "t", None, None) and len(c.digest) == 64
    path.write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        config.load(str(path))
    assert config.fraction_or_none("none") is None and config.fraction_or_none("0.1") == 0.1


def test_command_line(spark, capsys):
    p = cli.parser()
    a = p.parse_args("score --config c --pairs p --patches f --out o --method a,b --min-fg-fraction none --dump-patch-arrays".split())
    assert (a.min_fg_fraction, a.stripper, a.dump_patch_arrays, a.max_samples, cli.methods(a.method)) == (None, None, True, None, ["a", "b"])
    b = p.parse_args(["bench", "--sf-dir", "d"])
    assert (b.warmup, b.runs, b.only) == (1, 3, None)
    with pytest.raises(SystemExit):
        p.parse_args(["score"])
    assert cli.main(["list"]) == 0 and "rating_spearman" in capsys.readouterr().out
    assert cli.main(["strip", "a cat here", "cat"]) == 0 and capsys.readouterr().out.strip().endswith("here")


def test_scoring_run_from_the_command_line(spark, tmp_path):
    patches = [(i, k, w, [float(k + 1), float(len(i)), w]) for i in ("r", "out1", "o2") for k, w in enumerate((0.9, 0.1, 0.6))]
    spark.createDataFrame(patches, "image_id string, patch_idx int, w double, feat array<double>").write.parquet(f"{tmp_path}/patches")
    pairs = [("r", "out1", "a cat here", "cat", "m1", 0.3, 0.3, 0), ("r", "o2", "a dog", "cat", "m2", 0.3, 0.01, 1), ("r", "r", "x", "", "m3", 0.5, 0.5, 2)]
    spark.createDataFrame(pairs, "ref string, out string, prompt string, object_name string, gen_method string, fg_ref double, fg_out double, row_idx int").write.parquet(f"{tmp_path}/pairs")
    (tmp_path / "c.json").write_text('{"model": "m"}')
    base = ["score", "--config", f"{tmp_path}/c.json", "--pairs", f"{tmp_path}/pairs", "--patches", f"{tmp_path}/patches"]
    assert cli.main([*base, "--out", f"{tmp_path}/a", "--method", "m1,m2", "--dump-patch-arrays"]) == 0
    got = spark.read.parquet(f"{tmp_path}/a").collect()
    assert [(r["out"], r["extras"]["pf_prompt"]) for r in got] == [("out1", "here")] and 0 < got[0]["cp"] <= 1
    assert spark.read.parquet(f"{tmp_path}/a_arrays").count() == 1
    assert cli.main([*base, "--out", f"{tmp_path}/b", "--min-fg-fraction", "none", "--max-samples", "2"]) == 0
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
