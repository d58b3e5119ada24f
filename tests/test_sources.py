from __future__ import annotations

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from agreemill import schema
from agreemill.sinks import reports, tables
from agreemill.sources import ratings, results, trees
from agreemill.streaming import resume

LINE = {"concept_id": "c1", "prompt_id": "0", "gen_method": "m", "seed": 1, "signal": "cp", "model": "x/y", "score": 0.5, "extras": {"n_ref_fg_only": "3"}}


def write(path, lines):
    path.write_text("\n".join(lines))
    return str(path)


def test_tolerant_scan(spark, tmp_path):
    good = [json.dumps(LINE | {"prompt_id": str(i)}) for i in range(3)]
    odd = [json.dumps(LINE | {"prompt_id": "nan"}).replace("0.5", "NaN"), json.dumps(LINE | {"prompt_id": "null", "score": None})]
    path = write(tmp_path / "r.jsonl", [good[0], "", "  ", *good[1:], *odd, good[0][:40]])
    rows = results.results(spark, [path, str(tmp_path / "missing.jsonl")]).collect()
    assert {r["prompt_id"]: r["score"] for r in rows} == {"0": 0.5, "1": 0.5, "2": 0.5, "nan": None, "null": None}
    assert rows[0]["extras"]["n_ref_fg_only"] == "3"
    assert results.results(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(Exception):
        results.results(spark, path, strict=True).collect()


def test_last_row_of_a_key_wins_and_missing_scores_go(spark, tmp_path):
    rows = [LINE | {"score": s, "seed": i} for i, s in enumerate([0.1, 0.7, None])] + [LINE | {"prompt_id": "9", "score": None, "seed": 0}]
    df = results.results(spark, write(tmp_path / "r.jsonl", map(json.dumps, rows)))
    assert [tuple(r) for r in results.score_map(df, F.col("seed")).collect()] == [("m", "c1-0", 0.7)]
    first = results.first_rows(df, ["concept_id", "prompt_id"], "seed").collect()
    assert sorted((r["prompt_id"], r["score"]) for r in first) == [("0", 0.1), ("9", None)]


def test_patch_arrays(spark, tmp_path):
    values = np.array([0.25, -1.5, 3.0], "<f4")
    row = {"concept_id": "c", "prompt_id": "0", "gen_method": "m", "seed": 1, "ref": "a", "out": "b", "ref_grid": [1, 3], "nn_cos_per_ref": base64.b64encode(values.tobytes()).decode()}
    df = results.patch_arrays(spark, write(tmp_path / "a.jsonl", [json.dumps(row)]))
    assert df.first()["nn_cos_per_ref"] == values.tolist() and df.first()["ref_grid"] == [1, 3]
    done = spark.createDataFrame([("c", "0"), ("c", "1")], "concept_id string, prompt_id string")
    assert [r["prompt_id"] for r in results.incomplete_arrays(done, df, ["concept_id", "prompt_id"]).collect()] == ["1"]


def test_ratings(spark, tmp_path):
    (tmp_path / "emu2_cp_g1.json").write_text(json.dumps({"a-0": 4, "a-1": 2.5}))
    (tmp_path / "emu2_pf_g2.json").write_text('{"a-0": NaN}')
    rows = sorted(map(tuple, ratings.ratings(spark, f"{tmp_path}/*.json").collect()), key=str)
    assert rows == [("emu2", "a-0", "g1", "cp", 4.0), ("emu2", "a-0", "g2", "pf", None), ("emu2", "a-1", "g1", "cp", 2.5)]
    assert ratings.ratings(spark, f"{tmp_path}/none/*.json").count() == 0
    scores = spark.createDataFrame([("a", m) for m in "12"] + [("b", "1")], "rater string, method string")
    assert [r["rater"] for r in results.complete_raters(scores, 2).collect()] == ["a"]


def test_tree_scan(spark, tmp_path):
    for method, folder, stem in (("emu2", "live_subject_animal_00_big_cat", "0_7"), ("emu2", "live_subject_animal_00_big_cat", "1_x"), ("emu2", "object_01_cup", "0_1"), ("emu2", "object_01_cup", "stray")):
        d = tmp_path / "out" / method / folder
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{stem}.PNG").write_bytes(b"x")
        (d / f"{stem}.txt").write_text("no image")
    files = trees.listing(spark, str(tmp_path / "out"))
    assert trees.images(files).count() == 4 and files.count() == 8
    outputs = trees.images(files).select(F.lit("emu2").alias("gen_method"), "folder", "stem", "path")
    refs = spark.createDataFrame([("live_subject/animal", "00", "r0", "m0", 0.3), ("object", "01", "r1", "m1", 0.05)], "category string, idx string, ref_image string, ref_mask string, fg_ref double")
    prompts = spark.createDataFrame([("live_subject/animal", "00", "0", " a big cat \n")], "category string, idx string, prompt_id string, prompt string")
    captions = spark.createDataFrame([("object", "01", "tea cup")], "category string, idx string, caption string")
    out_masks = outputs.select("gen_method", "folder", "stem", F.lit("om").alias("out_mask"), F.when(F.col("stem") == "1_x", 0.01).otherwise(0.5).alias("fg_out"))
    kept = trees.rated_samples(outputs, refs, out_masks, prompts, captions).collect()
    assert [(r["concept_id"], r["prompt_id"], r["seed"], r["prompt"], r["object_name"], r["subject"]) for r in kept] == [("live_subject_animal_00_big_cat", "0", 7, "a big cat", "big cat", "live_subject/animal/00")]
    every = trees.rated_samples(outputs, refs, None, prompts, captions, None)
    assert {(r["key"], r["seed"], r["object_name"], r["prompt"]) for r in every.collect()} == {("live_subject_animal_00_big_cat-0", 7, "big cat", "a big cat"), ("live_subject_animal_00_big_cat-1", 0, "big cat", ""), ("object_01_cup-0", 1, "tea cup", "")}
    assert trees.builder("photo_pool") is trees.photo_pool
    with pytest.raises(ValueError):
        trees.builder("nope")


def test_first_lines(spark, tmp_path):
    (tmp_path / "cap.txt").write_text(" first \nsecond")
    (tmp_path / "empty.txt").write_text("\n")
    got = {r["stem"]: r["line"] for r in trees.first_lines(spark, str(tmp_path)).collect()}
    assert got == {"cap": "first", "empty": ""}


def test_photo_pool(spark):
    rows = [("1", "s1", "b1", "p2", "factual_only", "x", 0.5), ("1", "s1", "b1", "p1", "factual_only", "x", 0.004), ("1", "s2", "b1", "p0", "factual_counterfactual", "q_1", 0.5), ("1", "s3", "b2", "p3", "factual_counterfactual", "q_1", 0.5), ("1", "s3", "b2", "p4", "factual_counterfactual", "q_2", 0.5), ("10", "s", "b1", "p5", "factual_only", "x", 0.5), ("10", "s", "b2", "p6", "factual_only", "x", 0.5), ("2", "s", "b1", "p7", "factual_only", "x", 0.5)]
    pool = trees.photo_pool(spark.createDataFrame(rows, "subject string, scene string, background string, path string, source string, stem string, fg double"))
    assert sorted((r["subject"], r["background"], r["path"]) for r in pool.collect()) == [("1", "b1", "p2"), ("1", "b2", "p3"), ("10", "b1", "p5"), ("10", "b2", "p6"), ("2", "b1", "p7")]
    assert sorted(r["path"] for r in trees.with_enough(pool, 2).collect()) == ["p2", "p3", "p5", "p6"]
    assert sorted(r["path"] for r in trees.with_enough(pool, 1, 2).collect()) == ["p2", "p7"]


def test_images_are_decoded_exactly(spark, tmp_path):
    import struct
    import zlib

    pixels = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + r.tobytes() for r in pixels)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "m.png").write_bytes(png)
    r = trees.decoded(spark, str(tmp_path)).first()
    assert (r["h"], r["w"], r["channels"]) == (3, 4, 1) and np.frombuffer(r["data"], np.uint8).tolist() == pixels.reshape(-1).tolist()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(LINE | {"score": float(i), "prompt_id": str(i)}) for i in range(4)], schema.struct(schema.RESULT))
    where = str(tmp_path / "results")
    tables.append_results(rows.where("score < 2"), where)
    tables.append_results(rows.where("score >= 2"), where)
    back = spark.read.parquet(where)
    assert back.count() == 4 and back.where("model = 'x/y' AND signal = 'cp'").count() == 4
    tables.json_lines(rows, str(tmp_path / "j"))
    assert results.results(spark, f"{tmp_path}/j/*.json").count() == 4
    tables.key_table(rows.drop("extras"), str(tmp_path / "k"), csv=True)
    keys = spark.read.option("header", "true").schema("concept_id string, prompt_id string, gen_method string, seed int, signal string, model string, score double").csv(str(tmp_path / "k"))
    assert sorted(r["prompt_id"] for r in keys.collect()) == ["0", "1", "2", "3"]
    tables.strata_labels(rows.drop("extras").withColumn("prompt", F.lit("secret")), str(tmp_path / "s"))
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "s").glob("*.csv"))
    text = spark.createDataFrame([('{"a": 1}',), ('{"a":',)], "value string")
    assert tables.complete_lines(text).count() == 1
    wanted, there = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a",)], "path string")
    assert tables.missing_masks(wanted, there).count() == 1 and tables.missing_masks(wanted, there, True).count() == 2


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", -0.12345, 3), ("b", None, 4)], "name string, v double, n int")
    assert reports.markdown(df) == "| name | v | n |\n|---|---|---|\n| a | -0.123 | 3 |\n| b | --- | 4 |\n"
    assert "a & $-$0.123 & 3 \\\\" in reports.latex(df) and "b & --- & 4" in reports.latex(df)
    assert reports.fixed_width(df).splitlines()[1] == "a     -0.123  3"
    reports.json_report({"x": np.float64("nan"), "y": [np.int64(3), np.array([1.5])]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"x": None, "y": [3, [1.5]]}
    assert {r["column"]: r["n"] for r in reports.non_null_counts(df).collect()} == {"name": 2, "v": 1, "n": 2}
    assert reports.with_interval(0.1, -0.2, 0.3) == "+0.100 [-0.200, +0.300]"
    assert reports.run_record(spark, "cfg", seed=1).first()["extras"] == {"seed": "1"}


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.0), (1, float("nan"))], "k int, v double")
    assert schema.assert_count(df, 2) is df
    for bad in (lambda: schema.assert_unique(df, "k"), lambda: schema.assert_complete(df, "v"), lambda: schema.assert_same_count(df.limit(1), df)):
        with pytest.raises(schema.ContractError):
            bad()


def test_resume_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "k int, o string")
    done = spark.createDataFrame([(1, None), (1, None)], "k int, o string")
    assert sorted(map(tuple, resume.not_done(df, done, ("k", "o")).collect()), key=str) == [(1, "a"), (2, None)]
    scored = resume.score_missing(df, done, lambda d: d.withColumn("s", F.lit(1.0)), ("k", "o"))
    assert scored.columns == ["k", "o", "s"] and scored.count() == 2


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    ddl = "ts timestamp, event_key int, score double"
    rows = spark.createDataFrame([(i % 7, float(i)) for i in range(30)], "event_key int, score double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("score").cast("int")))
    rows = rows.select("ts", "event_key", "score")
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows.where("score < 10").coalesce(1).write.parquet(src)

    def run():
        query = resume.append_stream(resume.result_stream(spark, src, ddl), out, state)
        query.awaitTermination()
        return spark.read.parquet(out)

    assert sorted(r["event_key"] for r in run().collect()) == list(range(7))
    rows.where("score >= 10").coalesce(1).write.mode("append").parquet(src)
    extra = spark.createDataFrame([(99, 1.0)], "event_key int, score double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_100))).select("ts", "event_key", "score")
    extra.write.mode("append").parquet(src)
    batch = sorted({r["event_key"] for r in rows.collect()} | {99})
    assert sorted(r["event_key"] for r in run().collect()) == batch
    assert sorted(r["event_key"] for r in run().collect()) == batch


def test_windowed_scores(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", 1.0), (1800, "a", 3.0), (4000, "a", 5.0)], "s long, k string, v double").select(F.timestamp_seconds("s").alias("ts"), "k", "v")
    got = resume.windowed_scores(rows, "ts", "k", "v").collect()
    assert sorted((r["n"], r["mean"]) for r in got) == [(1, 5.0), (2, 2.0)]
