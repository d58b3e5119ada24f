"""Runs that are killed and resumed, and what their configuration selects."""

from __future__ import annotations

import json
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest

from agreemill import cli, config, plugins
from agreemill.plans import scoring
from agreemill.sinks.runs import Run

ROOT = Path(__file__).resolve().parent.parent


def inputs(spark, where, n=60):
    patches = [(f"i{i}", k, w, [float((i * 7 + k * 3) % 11), float(i % 5 + 1), w]) for i in range(n) for k, w in enumerate((0.9, 0.1, 0.6))]
    spark.createDataFrame(patches, "image_id string, patch_idx int, w double, feat array<double>").write.parquet(f"{where}/patches")
    pairs = [(f"c{i % 6}", f"p{i}", ["m1", "m2"][i % 2], i % 3, f"i{i}", f"i{(i + 1) % (n + 2)}", "a cat here", "cat", 0.3, [0.3, 0.01][i % 10 == 0], i) for i in range(n)]
    spark.createDataFrame(pairs, "concept_id string, prompt_id string, gen_method string, seed int, ref string, out string, prompt string, object_name string, fg_ref double, fg_out double, row_idx int").write.parquet(f"{where}/pairs")
    return ["score", "--pairs", f"{where}/pairs", "--patches", f"{where}/patches"]


def plain(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.collect())


def test_killed_run_goes_on(spark, tmp_path):
    """A process is killed after its first commits; the next run does the rest and
    ends with the rows of an undisturbed one."""
    base = inputs(spark, tmp_path)
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "out": f"{tmp_path}/out"}))
    args = [*base, "--config", f"{tmp_path}/c.json", "--batches", "6", "--dump-patch-arrays"]
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    process = subprocess.Popen([sys.executable, "-m", "agreemill", *args], cwd=ROOT, env=env, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    commits = tmp_path / "out" / "_commits"
    for _ in range(1200):
        done = len(list(commits.glob("*.json"))) if commits.exists() else 0
        if done >= 2 or process.poll() is not None:
            break
        time.sleep(0.05)
    os.killpg(process.pid, signal.SIGKILL)
    process.wait()
    first = {p.name: p.read_text() for p in commits.glob("*.json")}
    assert 2 <= len(first) < 6
    (tmp_path / "out" / "batch=lost").mkdir()  # moved, but not recorded
    assert cli.main(args) == 0
    assert len(list(commits.glob("*.json"))) == 6 and all((commits / n).read_text() == t for n, t in first.items())
    assert not (tmp_path / "out" / "batch=lost").exists()
    run = Run(spark, f"{tmp_path}/out", ())
    assert cli.main([*args, "--out", f"{tmp_path}/whole"]) == 0
    whole = Run(spark, f"{tmp_path}/whole", ())
    assert run.read().count() == 53 and plain(run.read()) == plain(whole.read())
    assert plain(run.read("arrays")) == plain(whole.read("arrays")) and run.read("arrays").count() == 53
    assert cli.main(args) == 0 and len(list(commits.glob("*.json"))) == 6  # nothing is left to do
    record = spark.read.json(f"{tmp_path}/whole/_runs").first()["extras"]
    assert (record["n_samples"], record["n_missing"], record["n_rows"]) == ("54", "1", "53")


def test_uncommitted_work_is_never_read(spark, tmp_path):
    samples = spark.range(20).withColumnRenamed("id", "k")
    run = Run(spark, str(tmp_path / "r"), ("k",), "one")

    def stop(part, further):
        further("arrays", part)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run.score(samples, stop, 2)
    assert run.read() is None and run.records() == []
    run.stage("rows", samples, "x")
    run._move(f"{run.path}/_staged/x/rows", f"{run.path}/batch=x")  # killed before its record
    assert run.read() is None and run.start() == 1 and not (tmp_path / "r" / "batch=x").exists()
    assert run.score(samples, lambda part, further: part, 3) == 3 and run.score(samples, lambda part, further: part, 3) == 0
    assert run.score(spark.range(25).withColumnRenamed("id", "k"), lambda part, further: part.where("k > 20"), 1) == 1
    assert sorted(r["k"] for r in run.read().collect()) == [*range(20), 21, 22, 23, 24]


def test_other_settings_are_refused(spark, tmp_path):
    samples = spark.range(3).withColumnRenamed("id", "k")
    Run(spark, str(tmp_path / "r"), ("k",), "one").score(samples, lambda part, further: part)
    with pytest.raises(ValueError, match="other settings"):
        Run(spark, str(tmp_path / "r"), ("k",), "two").score(samples, lambda part, further: part)


def test_configuration_selects_and_flags_override(spark, tmp_path):
    base = inputs(spark, tmp_path, 20)
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "tag": "t", "methods": ["m2"], "stripper": "none", "min_fg_fraction": None, "out": f"{tmp_path}/a"}))
    assert cli.main([*base, "--config", f"{tmp_path}/c.json", "--tag-suffix", "x"]) == 0
    rows = Run(spark, f"{tmp_path}/a", ()).read().collect()
    assert len(rows) == 9 and {(r["gen_method"], r["tag"], r["extras"]["pf_prompt"]) for r in rows} == {("m2", "tx", "a cat here")}
    assert cli.main([*base, "--config", f"{tmp_path}/c.json", "--out", f"{tmp_path}/b", "--method", "m1", "--stripper", "regex", "--min-fg-fraction", "0.05"]) == 0
    rows = Run(spark, f"{tmp_path}/b", ()).read().collect()
    assert len(rows) == 8 and {(r["gen_method"], r["extras"]["pf_prompt"]) for r in rows} == {("m1", "here")}


def test_plugged_matcher_scores_a_run(spark, tmp_path):
    @plugins.register("matcher", "length")
    def load(scale=1.0):
        return lambda row: {"score": len(row["prompt"]) * scale, "extras": {"by": "length"}}

    base = inputs(spark, tmp_path, 12)
    c = config.RunConfig(matcher="length", matcher_kwargs={"scale": 2.0}, out=f"{tmp_path}/o")
    pairs, features = (spark.read.parquet(base[i]) for i in (2, 4))
    rows = scoring.score_run(spark, c, pairs, features, batches=2).read().collect()
    assert len(rows) == 10 and {(r["score"], r["extras"]["by"]) for r in rows} == {(20.0, "length")}
    with pytest.raises(ValueError, match="no patch arrays"):
        scoring.score_run(spark, config.RunConfig(matcher="length", dump_patch_arrays=True, out=f"{tmp_path}/p"), pairs, features)
    with pytest.raises(ValueError, match="unknown matcher"):
        scoring.score_run(spark, config.RunConfig(matcher="nope", out=f"{tmp_path}/q"), pairs, features)


def test_skipped_samples(spark):
    rows = spark.createDataFrame([(1, "", "object"), (2, "x", "style"), (3, None, None), (4, "x", None)], "id int, prompt string, category string")
    assert {r["id"]: r["skipped"] for r in scoring.scorable(rows, True).collect()} == {1: "empty prompt", 2: "style", 3: "empty prompt", 4: None}
    assert scoring.scorable(rows).where("skipped IS NULL").count() == 2


def test_variants_need_their_inputs(spark):
    samples = spark.createDataFrame([], "text_id long, image_id long")
    for variants, word in ((("maxsim",), "tokens"), (("global_bg",), "texts"), (("nope",), "unknown"), (("maxsim_textproj",), "need")):
        with pytest.raises(ValueError, match=word):
            scoring.prompt_following(samples, samples, variants)


def test_variants_without_patches_are_null(spark):
    patches_ = spark.createDataFrame([("all", 0, 1.0, [1.0, 0.0]), ("none", 0, 0.0, [0.0, 1.0])], "image_id string, patch_idx int, w double, feat array<double>")
    from agreemill.operators import patches

    texts = spark.createDataFrame([(1, [1.0, 1.0])], "text_id int, vector array<double>")
    samples = spark.createDataFrame([(1, "all"), (1, "none"), (2, "all")], "text_id int, image_id string")
    got = {(r["text_id"], r["image_id"]): r for r in scoring.prompt_following(samples, patches.image_blocks(patches_), ("global", "global_bg", "global_fg"), texts).collect()}
    half = pytest.approx(2**-0.5)
    assert got[1, "all"][2:] == (half, None, half) and got[1, "none"][2:] == (half, half, None) and got[2, "all"][2:] == (None, None, None)
