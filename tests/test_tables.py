"""Key tables, audits, photo pools, masks, printed tables and further commands."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from agreemill import cli, plugins
from agreemill.api import PairScorer
from agreemill.functions import text
from agreemill.operators import masks, syntax
from agreemill.plans import checks, conditions, figures, query_tables
from agreemill.sinks import tables
from agreemill.sinks.runs import Run
from agreemill.sources import ratings, tokens, trees
from tests.test_stats import rankdata


def test_key_table_keeps_identifiers(spark, tmp_path):
    rows = spark.createDataFrame([("m", "00", "c-1", True, 1.5, 3), ("m", "07", None, False, None, 4)], "method string, subject_idx string, key string, is_style boolean, x double, n int")
    for csv in (True, False):
        where = f"{tmp_path}/{csv}"
        tables.key_table(rows, where, csv=csv)
        back = tables.read_key_table(spark, where)
        assert sorted(tuple(r) for r in back.select(*rows.columns).collect()) == sorted(tuple(r) for r in rows.collect())
    kinds = dict(tables.read_key_table(spark, f"{tmp_path}/True").dtypes)
    assert (kinds["subject_idx"], kinds["is_style"], kinds["n"]) == ("string", "boolean", "double")


def test_audit_against_plain_loops(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b) if i % 9 else None, float(rng.integers(0, 5)), float(rng.integers(0, 5)) if i % 11 else None) for i, (a, b) in enumerate(rng.random((300, 2)) * 0.2)]
    got = conditions.audit(spark.createDataFrame(rows, "fg_ref double, fg_out double, g1 double, g2 double")).first()
    ref = [r for r in rows if r[0] <= 0.05]
    out = [r for r in rows if r[0] > 0.05 and (r[1] is None or r[1] <= 0.05)]
    mean = lambda rs: np.mean([(r[2] + r[3]) / 2 for r in rs if r[3] is not None])
    kept = [r for r in rows if r[0] > 0.05 and r[1] is not None and r[1] > 0.05]
    assert (got["n_ref_side"], got["n_out_side"]) == (len(ref), len(out))
    assert got["mean_kept"] == pytest.approx(mean(kept)) and got["mean_dropped"] == pytest.approx(mean(ref + out)) and got["mean_out_side"] == pytest.approx(mean(out))
    rated = [r for r in rows if r[3] is not None]
    assert got["pct_out_side_high"] == pytest.approx(100 * sum(r[3] is not None and (r[2] + r[3]) / 2 >= 3 for r in out) / len(rated))
    pairs = np.array([(r[1], (r[2] + r[3]) / 2) for r in rated if r[0] > 0.05 and r[1] is not None])
    assert got["rho_out_area"] == pytest.approx(np.corrcoef(rankdata(pairs[:, 0]), rankdata(pairs[:, 1]))[0, 1])


def test_pooled_photos_take_one_a_scene(spark):
    photos = [("1", "factual_only", "", f"f{i}", f"1/f/{i:02}.jpg", 0.5) for i in range(3)] + [("1", "factual_counterfactual", "s1", f"x{i}_1", f"1/s1/{i}.jpg", [0.0, 0.4, 0.4][i]) for i in range(3)]
    photos += [("1", "factual_counterfactual", "s2", "y_0", "1/s2/0.jpg", 0.9), ("2", "factual_only", "", "z", "2/z.jpg", 0.001)]
    df = spark.createDataFrame(photos, "subject string, source string, scene string, stem string, path string, fg double")
    got = [tuple(r) for r in trees.pooled_photos(df, 8).orderBy("pos").collect()]
    assert got == [("1", 0, "1/f/00.jpg", "factual_only"), ("1", 1, "1/f/01.jpg", "factual_only"), ("1", 2, "1/f/02.jpg", "factual_only"), ("1", 3, "1/s1/1.jpg", "factual_counterfactual")]
    assert [r["pos"] for r in trees.pooled_photos(df, 3).orderBy("pos").collect()] == [int(4 / 3 * i) for i in range(3)]
    assert trees.builder("pooled_photos") is trees.pooled_photos


def test_masks_without_pixels_and_upsampled(spark):
    rows = spark.createDataFrame([(1, (1, 2, bytearray([0, 3]))), (2, (1, 2, bytearray(2))), (3, None), (4, (0, 0, bytearray()))], "id int, m struct<h: int, w: int, data: binary>")
    assert {r["id"]: r["n"] for r in rows.select("id", masks.nonempty(F.col("m")).alias("n")).collect()} == {1: True, 2: False, 3: False, 4: False}
    grid = [[0.0, 1.0], [1.0, 0.2]]
    m = spark.createDataFrame([(grid,), (None,)], "p array<array<double>>").select(masks.upsampled(F.col("p"), 6, 4, 0.5).alias("m")).collect()
    assert m[1]["m"] is None
    assert (np.frombuffer(m[0]["m"]["data"], np.uint8).reshape(6, 4) == (masks.resize(np.array(grid), 6, 4) > 0.5) * 255).all()


def test_shipped_tables(spark):
    sizes = {n: checks.shipped(spark, n).count() for n in ("cp_alpha", "pf_alpha", "pair_auc")}
    assert sizes == {"cp_alpha": 13, "pf_alpha": 14, "pair_auc": 64}
    ours = spark.createDataFrame([("GPT-4o", 0.4991), ("masked max-cosine", 0.4775), ("CLIP-I", 0.139)], "name string, ours double")
    got = {r["name"]: r["ok"] for r in checks.checked(checks.against(ours, checks.shipped(spark, "cp_alpha"))).collect()}
    assert got == {"GPT-4o": True, "masked max-cosine": True, "CLIP-I": False}
    with pytest.raises(ValueError, match="pair_auc"):
        checks.shipped(spark, "nope")


def test_heat_grid_has_every_cell(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 4.0)], "r string, c int, v double")
    assert sorted(map(tuple, figures.heat_grid(rows, "r", "c", "v").collect())) == [("a", 1, 1, 2.0), ("a", 2, 0, None), ("b", 1, 0, None), ("b", 2, 1, 4.0)]


def test_boot_and_auc_commands(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(round(x)), float(np.clip(round(x + rng.normal() / 2), 0, 4)), float(np.clip(round(x), 0, 4)), i % 7) for i, x in enumerate(rng.random(80) * 4)]
    spark.createDataFrame(rows, "row_idx int, x double, judge double, g1 double, g2 double, subject int").write.parquet(f"{tmp_path}/t")
    assert cli.main(["boot", "--table", f"{tmp_path}/t", "--rows", "x:continuous,judge:ordinal", "--compare", "judge-x", "--cluster", "subject", "--B", "30", "--out", f"{tmp_path}/o"]) == 0
    assert spark.read.parquet(f"{tmp_path}/o/intervals").count() == 6 and spark.read.parquet(f"{tmp_path}/o/comparisons").count() == 2 and "cluster_intervals" in capsys.readouterr().out
    spark.createDataFrame([(i, i + 1, i % 2 == 0, float(i % 5), float(-i)) for i in range(60)], "a long, b long, within boolean, m1 double, m2 double").write.parquet(f"{tmp_path}/p")
    assert cli.main(["auc", "--pairs", f"{tmp_path}/p", "--metrics", "m1,m2", "--compare", "m1-m2", "--B", "20", "--out", f"{tmp_path}/q"]) == 0
    assert spark.read.parquet(f"{tmp_path}/q/rows").count() == 2 and spark.read.parquet(f"{tmp_path}/q/counts").first()["B"] == 20
    with pytest.raises(ValueError, match="ordinal"):
        cli.main(["boot", "--table", f"{tmp_path}/t", "--rows", "x:other", "--B", "3", "--out", f"{tmp_path}/z"])


def test_follow_command_skips_and_resumes(spark, tmp_path):
    spark.createDataFrame([("a", 0, 0.9, [1.0, 0.0]), ("a", 1, 0.1, [0.0, 1.0]), ("b", 0, 0.0, [1.0, 1.0])], "image_id string, patch_idx int, w double, feat array<double>").write.parquet(f"{tmp_path}/f")
    spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "text_id int, vector array<double>").write.parquet(f"{tmp_path}/x")
    samples = [("c1", "p1", "m", 1, "a", "x", "object"), ("c2", "p2", "m", 2, "b", "x", "style"), ("c3", "p3", "m", 2, "b", "", "object"), ("c4", "p4", "n", 2, "a", "x", "object")]
    spark.createDataFrame(samples, "concept_id string, prompt_id string, gen_method string, text_id int, image_id string, prompt string, category string").write.parquet(f"{tmp_path}/s")
    (tmp_path / "c.json").write_text(json.dumps({"signal": "pf", "model": "m", "out": f"{tmp_path}/o"}))
    args = ["follow", "--config", f"{tmp_path}/c.json", "--samples", f"{tmp_path}/s", "--patches", f"{tmp_path}/f", "--texts", f"{tmp_path}/x", "--skip-style", "--batches", "2"]
    assert cli.main(args) == 0
    got = {r["concept_id"]: (r["score"], r["variant"]) for r in Run(spark, f"{tmp_path}/o", ()).read().collect()}
    assert got == {"c1": (1.0, "global_bg"), "c4": (0.0, "global_bg")}
    before = len(Run(spark, f"{tmp_path}/o", ()).records())
    assert cli.main(args) == 0 and len(Run(spark, f"{tmp_path}/o", ()).records()) == before
    assert cli.main([*args, "--variant", "global_fg", "--out", f"{tmp_path}/fg"]) == 0
    assert {r["concept_id"]: r["score"] for r in Run(spark, f"{tmp_path}/fg", ()).read().collect()} == {"c1": 0.0, "c4": 1.0}


def test_masks_command_skips_existing(spark, tmp_path):
    @plugins.register("segmenter", "by name")
    def load():
        return lambda row: {"h": 1, "w": len(row["prompt"]), "data": row["prompt"].encode()}

    def jobs(n):
        where = f"{tmp_path}/j{n}"
        spark.createDataFrame([(f"m/{i}.png", f"Cat {i}") for i in range(n)], "path string, name string").write.parquet(where)
        return ["masks", "--jobs", where, "--segmenter", "by name", "--out", f"{tmp_path}/o"]

    assert cli.main(jobs(3)) == 0
    run = Run(spark, f"{tmp_path}/o", ())
    first = {r["batch"] for r in run.records()}
    assert {bytes(r["data"]) for r in run.read().collect()} == {b"cat 0.", b"cat 1.", b"cat 2."}
    assert cli.main(jobs(5)) == 0 and run.read().count() == 5 and {r["batch"] for r in run.records()} > first
    assert cli.main([*jobs(4), "--overwrite"]) == 0 and run.read().count() == 4 and not {r["batch"] for r in run.records()} & first


def test_shipped_scores(spark, tmp_path):
    files = {"clip_rating/m1.json": {"a-1": 0.5}, "clip_rating/m1_v2.json": {"a-1": 0.7}, "data_gpt_rating/full/m1.json": {"a-1": 3, "b-2": 4}, "group1/m-x-cp.json": {"a-1": 2}, "group1/m-x-pf.json": {"a-1": 1}}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(data))
    read = lambda *a, **k: sorted(tuple(r) for r in ratings.shipped(spark, str(tmp_path), *a, **k).collect())
    assert read("scorer", "clip_rating") == [("m1", "a-1", "clip_rating", 0.5)]
    assert read("scorer", "clip_rating", "_v2", rater="clip") == [("m1", "a-1", "clip", 0.7)]
    assert read("judge", "full") == [("m1", "a-1", "full", 3.0), ("m1", "b-2", "full", 4.0)]
    assert read("group", "group1") == [("m-x", "a-1", "group1", 2.0)]
    assert read("judge", "missing") == []
    with pytest.raises(ValueError, match="scorer"):
        read("other", "x")


def test_masks_follow_their_image():
    wide = np.zeros((30, 60), np.uint8)
    wide[:, 30:] = 255
    m = masks.aligned(wide, 40, 16)
    assert m.shape == (16, 32) and set(np.unique(m)) == {0, 255} and (m[:, 16:] == 255).all() and (m[:, :16] == 0).all()
    assert masks.aligned_box(32, 32, 16) == (4, 0, 28, 32)
    assert masks.aligned(np.full((64, 64), 255, np.uint8), 32, 16).shape == (24, 32)


def test_aligned_masks_column(spark):
    rows = spark.createDataFrame([((4, 8, bytearray(range(32))),), (None,)], "m struct<h: int, w: int, data: binary>")
    got = [r["a"] for r in rows.select(masks.aligned_masks(F.col("m"), 8, 4).alias("a")).collect()]
    assert (got[0]["h"], got[0]["w"], bytes(got[0]["data"])) == (4, 8, bytes(range(32))) and got[1] is None


def test_plugged_stripper_and_strata_rule(spark):
    @plugins.register("stripper", "first word")
    def strip():
        return lambda row: {"pf_prompt": row["prompt"].split()[0]}

    @plugins.register("strata_rule", "long")
    def rule(n=2):
        return lambda row: {"action_pose": len(row["words"]) > n, "attribute": len(row["starts"]) > 1}

    triples = spark.createDataFrame([("a cat", "cat"), ("the dog", None), (None, "x")], "prompt string, object_name string")
    got = {r["prompt"]: r["pf_prompt"] for r in PairScorer(stripper="first word").prompts(triples).collect()}
    assert got == {"a cat": "a", "the dog": "the", None: None}
    words, names = tokens.fixture(spark)
    docs = syntax.mentions(syntax.documents(words), syntax.documents(names).withColumnRenamed("t", "name"))
    found = {r["doc_id"]: (r["action_pose"], r["attribute"], r["scene_only"]) for r in syntax.labelled(docs, "long").collect()}
    assert found["d7"] == (False, False, True) and found["d8"] == (True, True, False)
    assert syntax.labelled(docs, "lexical").where("action_pose").count() == syntax.strata(docs, lexical=True).where("action_pose").count()


def test_clip_models(spark):
    rows = spark.createDataFrame([("openai/clip-vit-large",), ("google/siglip2-so400m",), ("clip-vit",)], "m string")
    assert [r[0] for r in rows.select(text.is_clip("m")).collect()] == [True, False, False]


def test_photo_paths_of_long_keys_are_those_of_the_sql(spark, tmp_path):
    """A key of seven digits is cut to six, as lpad cuts it."""
    spark.createDataFrame([(1_000_005 + 40 * i * 3,) for i in range(4)], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(c.execute(query_tables.ORACLE_SQL["photo_pool_spread"]).fetchall())
    assert want and sorted(map(tuple, query_tables.photo_pool_spread(spark, str(tmp_path)).collect())) == want
