from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from agreemill.api import PairScorer
from agreemill.operators import pairs, patches

SCHEMA = "image_id string, patch_idx int, w double, feat array<float>"


def images(weights, seed=0):
    rng = np.random.default_rng(seed)
    return {k: (np.array(w, float), rng.normal(size=(len(w), 6)).astype(np.float32)) for k, w in weights.items()}


def frame(spark, data):
    return spark.createDataFrame([(k, i, float(w), f.tolist()) for k, (ws, fs) in data.items() for i, (w, f) in enumerate(zip(ws, fs, strict=True))], SCHEMA)


def plain_scores(ref, out, thr=0.5):
    """Two separate passes with plain loops."""
    (wr, fr), (wo, fo) = ref, out
    a = fr.astype(float) / np.linalg.norm(fr, axis=1, keepdims=True)
    b = fo.astype(float) / np.linalg.norm(fo, axis=1, keepdims=True)
    s = a @ b.T
    to, back, nn = s.argmax(1), s.argmax(0), s.max(1)
    mutual = back[to] == np.arange(len(a))
    fg, match = wr > thr, mutual & (wr > thr)
    both = match & (wo[to] > thr)
    return {
        "masked_maxcos": nn[fg].mean() if fg.any() else 0.0, "global_maxcos": nn.mean(), "weighted_maxcos": (wr * nn).sum() / wr.sum() if wr.sum() else 0.0, "recall_fg": both.sum() / match.sum() if match.any() else 0.0,
        "mean_nn_cos_fg": nn[match].mean() if match.any() else 0.0, "n_mutual_total": mutual.sum(), "n_ref_fg_only": fg.sum(),
    }


CASES = {"square": ([1, 0, 1, 0.6], [1, 1, 0, 0]), "other size": ([0.2, 0.9, 1], [1] * 7), "empty output": ([1, 1], [0, 0, 0]), "full output": ([1, 0], [1, 1, 1]), "empty reference": ([0, 0, 0], [1, 0])}


def test_scores_equal_plain_loops(spark):
    for name, (r, o) in CASES.items():
        data = images({"r": r, "o": o}, seed=len(name))
        got = patches.score_pairs(spark.createDataFrame([("r", "o")], "ref string, out string"), frame(spark, data)).first()
        for k, v in plain_scores(data["r"], data["o"]).items():
            assert got[k] == pytest.approx(v, abs=1e-6), (name, k)


def test_threshold_is_strict_for_foreground_and_inclusive_for_background(spark):
    data = images({"r": [0.5, 0.6], "o": [0.5, 0.4]})
    rows = patches.per_patch(patches.matches(spark.createDataFrame([("r", "o")], "ref string, out string"), patches.image_blocks(frame(spark, data))))
    assert rows.agg(F.count_if(F.col("w_ref") > 0.5)).first()[0] == 1
    bg = patches.mean_pool(frame(spark, data), ~(F.col("w") >= 0.5))
    assert {r["image_id"]: np.allclose(r["pooled"], data["o"][1][1]) for r in bg.collect()} == {"o": True}


def test_ties_go_to_the_lowest_index_over_strips(monkeypatch):
    a, b = np.eye(3)[[0, 1, 0, 2]], np.eye(3)[[1, 0, 0, 1]]
    whole = [x.tolist() for x in patches.nearest(a, b)]
    monkeypatch.setattr(patches, "STRIP", 1)
    assert [x.tolist() for x in patches.nearest(a, b)] == whole
    assert whole[0][:3] == [1, 0, 1] and whole[2][:3] == [0, 1, 0]
    assert [len(x) for x in patches.nearest(np.zeros((0, 3)), b)] == [0, 0, 0]


def test_facade(spark):
    data = images({"r": [1, 0, 1], "o": [1, 0, 0], "f": [1, 1]})
    triples = spark.createDataFrame([("r", "o", "A photo of a cat on a mat", "cat"), ("r", "f", "a dog", "cat")], "ref string, out string, prompt string, object_name string")
    texts = spark.createDataFrame([("A photo of on a mat", [1.0] * 6)], "pf_prompt string, vector array<double>")
    got = {r["out"]: r for r in PairScorer().score(triples, frame(spark, data), texts).collect()}
    assert got["o"]["cp"] == pytest.approx(plain_scores(data["r"], data["o"])["masked_maxcos"], abs=1e-6)
    pooled = data["o"][1][1:].mean(axis=0)
    assert got["o"]["pf"] == pytest.approx(pooled.sum() / np.linalg.norm(pooled) / 6**0.5, abs=1e-6)
    assert got["o"]["extras"]["was_stripped"] and not got["f"]["extras"]["was_stripped"] and got["f"]["pf"] is None
    with pytest.raises(ValueError):
        PairScorer(stripper="nope")


def test_all_pairs_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, f array<float>")
    expected = sorted((a, b, la == lb, round(float(np.dot(np.array(x, float), np.array(y, float))), 6)) for a, la, x in rows for b, lb, y in rows if a < b)
    for blocks in (1, 4):
        assert sorted(map(tuple, pairs.all_pairs(df, "id", "label", "f", blocks).collect())) == expected


def test_even_stride_and_sampled_pool(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(3)], "g string, i int")
    got = sorted((r["g"], r["pos"]) for r in pairs.even_stride(df, "g", "i", 3).collect())
    assert got == [("a", int(7 / 3 * k)) for k in range(3)] + [("b", k) for k in range(3)]
    assert pairs.sampled_pool(10, 4, 1) == np.random.default_rng(1).choice(10, size=4, replace=False).tolist()


def test_points_are_clipped_and_sparse_recall(spark):
    mask = spark.createDataFrame([("p", x, y, 255 * int(x == 1)) for x in range(2) for y in range(2)], "pair string, x int, y int, value int")
    points = spark.createDataFrame([("p", 1.9, -3.0), ("p", 5.0, 0.0), ("p", 0.4, 1.0)], "pair string, px double, py double")
    got = patches.points_in_mask(points, mask, "pair", "px", "py", 2, 2, "inside")
    assert sorted((r["px"], r["inside"]) for r in got.collect()) == [(0.4, False), (1.9, True), (5.0, True)]
    both = got.withColumn("in_ref", F.col("inside")).withColumn("in_out", F.col("px") > 2).withColumn("s", F.lit(0.5))
    r = both.agg(*[v.alias(k) for k, v in patches.match_recall(score="s").items()]).first()
    assert (r["recall"], r["n_ref_fg"], r["n_matches"], r["mean_score_fg"]) == (0.5, 2, 3, 0.5)
    flags = spark.createDataFrame([("p", 0, True)], "pair string, kp int, fg boolean")
    rows = spark.createDataFrame([("p", 0), ("p", 1)], "pair string, i int")
    assert sorted((r["i"], r["in_ref"]) for r in patches.flagged(rows, flags, "i", "in_ref").collect()) == [(0, True), (1, False)]


def test_dense_and_stored_scores(spark):
    df = spark.createDataFrame([([[0.1, 0.9], [0.5, 0.2]], [1.0, 0.0], [[0.3, 0.5, 9.0], [0.7, 0.1, 9.0]], [1.0, 0.0, 1.0, 0.0])], "c array<array<double>>, w array<double>, m array<array<double>>, v array<double>")
    r = df.select(patches.row_max_mean(F.col("c"), F.col("w")).alias("a"), patches.certainty_mean(F.col("m"), F.col("v"), 2).alias("b")).first()
    assert (r["a"], r["b"]) == (0.9, 0.5)
    results = spark.createDataFrame([("k", "r")], "key string, ref string")
    arrays = spark.createDataFrame([("k", [0.2, 0.8])], "key string, nn_cos_per_ref array<double>")
    grids = spark.createDataFrame([("r", 0.0, [1.0, 0.0]), ("r", -0.3, [0.0, 0.0])], "image_id string, p double, w array<double>")
    got = {r["p"]: (r["remasked"], r["n_fg"]) for r in patches.remask(results, arrays, grids, ["key"]).collect()}
    assert got == {0.0: (0.2, 1), -0.3: (0.0, 0)}
    tokens = spark.createDataFrame([(i, i % 4, i // 4) for i in range(16)], "token_idx int, gx int, gy int")
    assert patches.strided(tokens, 2).count() == 4 and patches.without_prefix(tokens, 5).agg(F.min("token_idx"), F.count("*")).first()[:] == (0, 11)


def test_tiles_of_blocks_find_what_whole_images_find(spark):
    """Images larger than a block, with equal patches in different blocks."""
    data = images({"r": np.linspace(0, 1, 23), "o": np.linspace(1, 0, 17), "s": [0.4]}, seed=5)
    data["o"][1][[9, 16]] = data["r"][1][[2, 20]] = data["o"][1][1]
    pairs_ = spark.createDataFrame([("r", "o"), ("o", "s"), ("s", "r"), ("r", "missing")], "ref string, out string")
    got = {(x["ref"], x["out"], x["ref_idx"]): x for x in patches.nearest_rows(pairs_, frame(spark, data), block=4).collect()}
    assert len(got) == 23 + 17 + 1
    for ref, out in (("r", "o"), ("o", "s"), ("s", "r")):
        (w, a), (v, b) = data[ref], data[out]
        to, cos, back = patches.nearest(a.astype(float), b.astype(float))
        for i in range(len(a)):
            x = got[ref, out, i]
            assert (x["to"], x["back"], x["mutual"]) == (to[i], back[i], back[i] == i)
            assert x["cos"] == pytest.approx(cos[i]) and x["w_ref"] == pytest.approx(w[i]) and x["w_partner"] == pytest.approx(v[to[i]])


def test_a_strip_is_bounded_in_cells_whatever_the_image():
    assert all(n * patches.strip_rows(n) <= max(n, patches.CELLS) for n in (1, 1000, 60_000, 3_000_000))
