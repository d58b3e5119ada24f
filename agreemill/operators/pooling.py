"""Attention pooling of masked patches, and late interaction with tokens.

The pooling head is the usual multi-head one with a learned probe: attention
over the allowed patches (key padding), layer norm and a residual MLP. Its
weights are the caller's. The probe is the same for every image, so its product
with the key projection is made once, and values are projected after they are
averaged: a patch costs one product with a (dimensions, heads) matrix, and no
projection of its own. Images of a batch are one ragged block, with a softmax a
segment.

Late interaction takes the best patch of every valid token of a text and
averages. Tokens are projected and normalised once a text, not once a pair.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.operators.pairs import matrix, unit
from agreemill.operators.patches import BLOCK, strip_rows

#: Weights that may be sent to the tasks.
MAX_WEIGHTS = 64_000_000


@dataclass(frozen=True)
class AttentionHead:
    """Weights of a pooling head, matrices as (out, in). ``heads`` divides the
    dimension; ``gelu`` is the tanh form."""

    probe: np.ndarray
    query: np.ndarray
    query_bias: np.ndarray
    key: np.ndarray
    value: np.ndarray
    value_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    norm: np.ndarray
    norm_bias: np.ndarray
    up: np.ndarray
    up_bias: np.ndarray
    down: np.ndarray
    down_bias: np.ndarray
    heads: int = 1
    eps: float = 1e-6

    def __post_init__(self) -> None:
        d = len(self.probe)
        if d % self.heads:
            raise ValueError(f"{self.heads} heads do not divide {d} dimensions")
        shapes = {"query": (d, d), "key": (d, d), "value": (d, d), "out": (d, d), "up": (len(self.up_bias), d), "down": (d, len(self.up_bias))}
        for name, shape in shapes.items():
            if np.shape(getattr(self, name)) != shape:
                raise ValueError(f"{name} is {np.shape(getattr(self, name))}, not {shape}")
        if sum(np.size(getattr(self, f.name)) for f in fields(self)) > MAX_WEIGHTS:
            raise ValueError(f"a head has at most {MAX_WEIGHTS} weights")

    def logits_matrix(self) -> np.ndarray:
        """(dimensions, heads): what a patch is multiplied with for its logits.

        A key's bias adds the same to all patches of a head, which a softmax
        does not see.
        """
        q = (self.query @ self.probe + self.query_bias).reshape(self.heads, -1)
        k = self.key.reshape(self.heads, -1, len(self.probe))
        return np.einsum("hj,hjd->dh", q, k) / math.sqrt(q.shape[1])

    def finish(self, means: np.ndarray) -> np.ndarray:
        """(images, dimensions) from (images, heads, dimensions) attention means."""
        n, h, d = means.shape
        values = np.einsum("nhd,hjd->nhj", means, self.value.reshape(h, -1, d)).reshape(n, d) + self.value_bias
        x = values @ self.out.T + self.out_bias
        centred = x - x.mean(1, keepdims=True)
        normed = centred / np.sqrt((centred**2).mean(1, keepdims=True) + self.eps) * self.norm + self.norm_bias
        up = normed @ self.up.T + self.up_bias
        gelu = 0.5 * up * (1 + np.tanh(math.sqrt(2 / math.pi) * (up + 0.044715 * up**3)))
        return x + gelu @ self.down.T + self.down_bias

    def pool(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One vector a segment of ``features``; segments are not empty."""
        starts = np.cumsum(sizes) - sizes
        logits = features @ self.logits_matrix()
        weights = np.exp(logits - np.repeat(np.maximum.reduceat(logits, starts), sizes, axis=0))
        weights /= np.repeat(np.add.reduceat(weights, starts), sizes, axis=0)
        return self.finish(np.stack([np.add.reduceat(features * weights[:, [h]], starts) for h in range(self.heads)], axis=1))


def _nested(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of vectors as (all vectors, how many each row has);
    null rows have none."""
    sizes = np.diff(lists.offsets.to_numpy())
    vectors = lists.flatten()
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1)), np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, sizes)


def _vectors(found: np.ndarray, present: np.ndarray) -> pa.Array:
    """Rows of ``found`` where ``present``, else null."""
    out = np.full(len(present), None, object)
    out[np.flatnonzero(present)] = list(found)
    return pa.array(out.tolist(), pa.list_(pa.float64()))


def attention_pooled(spark: SparkSession, head: AttentionHead, features: Column, allowed: Column) -> Column:
    """The pooled vector of an image's patches (array of vectors) under a mask
    (array of booleans); NULL where no patch is allowed."""
    sent = spark.sparkContext.broadcast(head)

    @F.arrow_udf("array<double>")
    def pool(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = sent.value
        for feats, masks in batches:
            x, sizes = _nested(feats)
            keep = np.zeros(len(x), bool)
            row = np.repeat(np.arange(len(feats)), sizes)
            keep[: len(row)] = masks.flatten().fill_null(False).to_numpy(zero_copy_only=False)
            counts = np.bincount(row[keep], minlength=len(feats))
            present = counts > 0
            found = own.pool(x[keep], counts[present]) if present.any() else np.zeros((0, len(own.probe)))
            yield _vectors(found, present)

    empty = F.array().cast("array<boolean>")
    return pool(features, F.coalesce(F.slice(allowed, 1, F.greatest(F.size(features), F.lit(0))), empty))


def background_pool(blocks: DataFrame, head: AttentionHead, threshold: float = 0.5, name: str = "bg") -> DataFrame:
    """(image_id, name, n_fg, n_total, n_bg): background patches (weights that
    don't reach ``threshold``) pooled by ``head``. ``blocks`` has one row an
    image, as ``patches.image_blocks`` makes them."""
    bg = F.transform("w", lambda w: F.coalesce(~(w >= threshold), F.lit(False)))
    rows = blocks.withColumn("_bg", bg)
    n_bg = F.size(F.filter("_bg", lambda x: x))
    pooled = attention_pooled(blocks.sparkSession, head, F.col("feat"), F.col("_bg"))
    return rows.select("image_id", pooled.alias(name), (F.size("w") - n_bg).alias("n_fg"), F.size("w").alias("n_total"), n_bg.alias("n_bg"))


def text_blocks(tokens: DataFrame, special: Collection[int], projection: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(text_id, tokens, n_tokens): unit vectors of the valid tokens of a text.

    ``tokens``: (text_id, token_idx, token_id, feat). Tokens with an id in
    ``special`` (padding, end) or without an id are not valid. ``projection`` is
    a linear layer (weights as (out, in), bias) that tokens go through first.
    """
    if projection is not None and sum(map(np.size, projection)) > MAX_WEIGHTS:
        raise ValueError(f"a projection has at most {MAX_WEIGHTS} weights")
    sent = tokens.sparkSession.sparkContext.broadcast(projection)

    @F.arrow_udf("array<array<double>>")
    def ready(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        layer = sent.value
        for texts in batches:
            x, sizes = _nested(texts)
            if layer is not None and len(x):
                x = x @ np.asarray(layer[0]).T + layer[1]
            x = unit(x) if len(x) else x
            ends = np.cumsum(sizes)
            yield pa.array([x[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)], pa.list_(pa.list_(pa.float64())))

    valid = F.col("token_id").isNotNull() & ~F.coalesce(F.col("token_id").isin(*special), F.lit(False)) if special else F.col("token_id").isNotNull()
    kept = F.sort_array(F.collect_list(F.when(valid, F.struct("token_idx", "feat"))))
    rows = tokens.groupBy("text_id").agg(F.transform(kept, lambda x: x["feat"]).alias("x"))
    return rows.select("text_id", ready("x").alias("tokens"), F.size("x").alias("n_tokens"))


def maxsim(pairs: DataFrame, texts: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(text_id, image_id, maxsim, n_tokens, n_patches): the mean best cosine of a
    text's valid tokens over an image's patches; NULL without tokens or patches.

    ``texts`` comes from ``text_blocks``, ``blocks`` from ``patches.image_blocks``.
    The texts of an image are dealt in parts of about ``block`` tokens, its patches
    in blocks: a patch travels once a part, not once a text, and a task holds two
    blocks and a strip of cosines.
    """
    asked = pairs.select("text_id", "image_id").distinct()
    tokens = asked.join(texts.select("text_id", "tokens", "n_tokens"), "text_id")
    parts = asked.join(texts.select("text_id", "n_tokens"), "text_id").groupBy("image_id").agg(F.ceil(F.sum("n_tokens") / block).cast("int").alias("_parts"))
    n_blocks = blocks.select("image_id", F.ceil(F.size("feat") / block).cast("int").alias("_blocks"))
    sizes = parts.join(n_blocks, "image_id").where("_parts > 0 AND _blocks > 0")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = tokens.join(sizes, "image_id").select("image_id", F.pmod(F.xxhash64("text_id"), F.col("_parts")).cast("int").alias("_x"), each("_blocks").alias("_y"), "text_id", "tokens")
    left = left.select("image_id", "_x", "_y", "text_id", F.posexplode("tokens").alias("pos", "v"))
    right = blocks.select("image_id", F.posexplode("feat").alias("_i", "v")).join(sizes, "image_id").select("image_id", each("_parts").alias("_x"), F.floor(F.col("_i") / block).cast("int").alias("_y"), "v")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    text, image = texts.schema["text_id"].dataType.simpleString(), blocks.schema["image_id"].dataType.simpleString()

    def best(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        n = p.num_rows if q.num_rows else 0
        top = np.empty(n)
        if n:
            t, others = matrix(p["v"], n), unit(matrix(q["v"], q.num_rows)).T
            step = strip_rows(q.num_rows)
            for at in range(0, n, step):
                top[at : at + step] = (t[at : at + step] @ others).max(1)
        return pa.table({"text_id": p["text_id"].slice(0, n), "image_id": pa.repeat(key[0], n), "pos": p["pos"].slice(0, n), "best": top})

    keys = ["image_id", "_x", "_y"]
    found = left.withColumn("image_id", F.col("image_id").cast(image)).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"text_id {text}, image_id {image}, pos int, best double")
    means = found.groupBy("text_id", "image_id", "pos").agg(F.max("best").alias("best")).groupBy("text_id", "image_id").agg(F.avg("best").alias("maxsim"))
    joined = pairs.select("text_id", "image_id").join(texts.select("text_id", "n_tokens"), "text_id").join(blocks.select("image_id", F.size("feat").alias("n_patches")), "image_id")
    return joined.join(means, ["text_id", "image_id"], "left").select("text_id", "image_id", "maxsim", "n_tokens", "n_patches")
