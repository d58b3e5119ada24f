"""The attention pool and MaxSim against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agreemill.api import PairScorer
from agreemill.operators import patches, pooling

D, HEADS, HIDDEN = 8, 2, 5


@pytest.fixture(scope="module")
def head():
    rng = np.random.default_rng(1)
    n = lambda *shape: rng.normal(size=shape)
    return pooling.AttentionHead(n(D), n(D, D), n(D), n(D, D), n(D, D), n(D), n(D, D), n(D), n(D), n(D), n(HIDDEN, D), n(HIDDEN), n(D, HIDDEN), n(D), heads=HEADS)


def slow_pool(head, rows):
    """Keys and values of every patch, one head and one patch at a time."""
    q = head.query @ head.probe + head.query_bias
    size = D // HEADS
    joined = []
    for h in range(HEADS):
        part = slice(h * size, (h + 1) * size)
        key_bias = np.arange(size) / 3.0  # any bias of the keys: a softmax does not see it
        logits = [float(q[part] @ (head.key[part] @ x + key_bias)) / math.sqrt(size) for x in rows]
        e = [math.exp(v - max(logits)) for v in logits]
        joined += list(sum(w / sum(e) * (head.value[part] @ x + head.value_bias[part]) for w, x in zip(e, rows, strict=True)))
    x = head.out @ np.array(joined) + head.out_bias
    normed = (x - x.mean()) / math.sqrt(x.var() + head.eps) * head.norm + head.norm_bias
    up = head.up @ normed + head.up_bias
    gelu = np.array([0.5 * u * (1 + math.tanh(math.sqrt(2 / math.pi) * (u + 0.044715 * u**3))) for u in up])
    return x + head.down @ gelu + head.down_bias


def frame(spark, images):
    rows = [(k, i, float(w), f) for k, (ws, fs) in images.items() for i, (w, f) in enumerate(zip(ws, fs.tolist(), strict=True))]
    return spark.createDataFrame(rows, "image_id string, patch_idx int, w double, feat array<float>").repartition(2)


def some_images(weights, seed=0):
    rng = np.random.default_rng(seed)
    return {k: (np.array(w, float), rng.normal(size=(len(w), D)).astype(np.float32)) for k, w in weights.items()}


def test_background_pool_equals_plain_loops(spark, head):
    images = some_images({"a": [0, 1, 0.5, 0.4], "b": [0.1] * 7, "c": [0.2], "none": [1, 1, 0.5], "d": [1, 0.49, 0, 1, 1]})
    got = {r["image_id"]: r for r in pooling.background_pool(patches.image_blocks(frame(spark, images)), head).collect()}
    assert set(got) == set(images)
    for k, (w, f) in images.items():
        bg = f[w < 0.5].astype(float)
        assert (got[k]["n_fg"], got[k]["n_total"], got[k]["n_bg"]) == (len(w) - len(bg), len(w), len(bg))
        assert got[k]["bg"] is None if not len(bg) else np.allclose(got[k]["bg"], slow_pool(head, bg), atol=1e-9)


def test_large_logits_do_not_overflow(head):
    x = np.random.default_rng(2).normal(size=(6, D)) * 1e4
    assert np.isfinite(head.pool(x, np.array([2, 4]))).all()


def test_empty_table(spark, head):
    blocks = patches.image_blocks(frame(spark, {}))
    assert pooling.background_pool(blocks, head).collect() == []


def test_wrong_shapes_are_refused(head):
    with pytest.raises(ValueError, match="divide"):
        pooling.AttentionHead(**{**head.__dict__, "heads": 3})
    with pytest.raises(ValueError, match="up is"):
        pooling.AttentionHead(**{**head.__dict__, "up": np.zeros((2, 2))})


def test_facade_pools_the_background_with_its_head(spark, head):
    images = some_images({"r": [1, 0], "o": [0, 1, 0.2], "full": [1, 1]}, seed=5)
    triples = spark.createDataFrame([("r", "o", "a red owl on ice", "owl"), ("r", "full", "a red owl on ice", "owl")], "ref string, out string, prompt string, object_name string")
    text = np.arange(D, dtype=float) - 3
    texts = PairScorer().prompts(triples).select("pf_prompt", F.array(*[F.lit(float(v)) for v in text]).alias("vector")).distinct()
    got = {r["out"]: r for r in PairScorer(head=head).score(triples, frame(spark, images), texts).collect()}
    pooled = slow_pool(head, images["o"][1][[0, 2]].astype(float))
    assert got["o"]["pf"] == pytest.approx(pooled @ text / np.linalg.norm(pooled) / np.linalg.norm(text), abs=1e-6)
    assert got["full"]["pf"] is None and got["full"]["extras"]["pf_n_bg_pooled"] == 0 and got["o"]["extras"]["pf_n_bg_pooled"] == 2
    plain = {r["out"]: r for r in PairScorer().score(triples, frame(spark, images), texts).collect()}
    mean = images["o"][1][[0, 2]].astype(float).mean(0)
    assert plain["o"]["pf"] == pytest.approx(mean @ text / np.linalg.norm(mean) / np.linalg.norm(text), abs=1e-6) and plain["full"]["pf"] is None


def slow_maxsim(tokens, ids, image, special, layer=None):
    best = []
    for t, i in zip(tokens, ids, strict=True):
        if i is None or i in special:
            continue
        t = t if layer is None else layer[0] @ t + layer[1]
        best.append(max(float(t @ p) / np.linalg.norm(t) / np.linalg.norm(p) for p in image))
    return sum(best) / len(best) if best else None


def test_maxsim_equals_plain_loops(spark):
    rng = np.random.default_rng(7)
    images = some_images({"x": [1] * 5, "y": [0] * 2}, seed=3)
    texts = {"long": [5, 7, 9, 1, 0, 0], "short": [4, 1], "special": [1, 0, 0], "unknown": [None, 3], "gap": [0, 8, 0, 6]}
    vectors = {k: rng.normal(size=(len(v), D)) for k, v in texts.items()}
    tokens = spark.createDataFrame([(k, i, v, vectors[k][i].tolist()) for k, ids in texts.items() for i, v in enumerate(ids)], "text_id string, token_idx int, token_id int, feat array<double>").repartition(3)
    pairs = spark.createDataFrame([(t, i) for t in texts for i in images] + [("nowhere", "x")], "text_id string, image_id string")
    blocks = patches.image_blocks(frame(spark, images))
    layer = rng.normal(size=(D, D)), rng.normal(size=D)
    for use in (None, layer):
        got = {(r["text_id"], r["image_id"]): r for r in pooling.maxsim(pairs, pooling.text_blocks(tokens, (0, 1), use), blocks).collect()}
        assert len(got) == len(texts) * len(images)
        for (t, i), r in got.items():
            want = slow_maxsim(vectors[t], texts[t], images[i][1].astype(float), (0, 1), use)
            assert r["maxsim"] == (None if want is None else pytest.approx(want, abs=1e-9))
            assert r["n_patches"] == len(images[i][0]) and r["n_tokens"] == sum(v is not None and v > 1 for v in texts[t])


def test_maxsim_in_tiles_is_that_of_whole_images(spark):
    """More texts and patches than a block; texts of one image share its patches."""
    rng = np.random.default_rng(8)
    images = {k: (np.ones(n), rng.normal(size=(n, D)).astype(np.float32)) for k, n in (("i0", 13), ("i1", 2))}
    tokens = [(t, i, 2 + i, rng.normal(size=D).astype(np.float32).tolist()) for t in range(9) for i in range(1 + t % 4)]
    pairs = spark.createDataFrame([(t, f"i{t % 2}") for t in range(9)] + [(3, "i0")], "text_id long, image_id string")
    ready = pooling.text_blocks(spark.createDataFrame(tokens, "text_id long, token_idx int, token_id int, feat array<float>"), (0, 1))
    found = pooling.maxsim(pairs, ready, patches.image_blocks(frame(spark, images)), block=4)
    got = {(r["text_id"], r["image_id"]): r for r in found.collect()}
    assert len(got) == 10 and found.columns == ["text_id", "image_id", "maxsim", "n_tokens", "n_patches"]
    for (t, image), r in got.items():
        x = np.array([f for k, _, _, f in tokens if k == t])
        y = images[image][1].astype(float)
        cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        assert r["maxsim"] == pytest.approx(cos.max(1).mean()) and (r["n_tokens"], r["n_patches"]) == (len(x), len(y))
