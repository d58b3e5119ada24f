"""The scoring facade: concept preservation and prompt following of image pairs.

Encoders are the caller's and deliver tables: ``patches`` (image_id, patch_idx,
w, feat) and text vectors. Each image is encoded once; both scores share it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agreemill import plugins
from agreemill.functions.text import STRIPPERS, collapse, strip_subject, was_stripped
from agreemill.operators import pairs, patches, pooling, syntax

__all__ = ["STRIPPERS", "PairScorer"]

BACKGROUND_COUNTS = ("pf_n_fg", "pf_n_total", "pf_n_bg_pooled")


@dataclass(frozen=True)
class PairScorer:
    """Scores of (reference, output, prompt) triples.

    ``fg_threshold``: reference patches above it count for concept
    preservation; output patches that don't reach it are background for prompt
    following. ``stripper``: how the subject leaves the prompt, or the name of a
    registered one (from prompt and object_name to ``pf_prompt``). ``head``: the
    image tower's attention pool, which the background goes through; without one
    background patches are averaged.
    """

    fg_threshold: float = 0.5
    stripper: str = "regex"
    head: pooling.AttentionHead | None = None

    def __post_init__(self) -> None:
        known = [*STRIPPERS, *plugins.names("stripper")]
        if self.stripper not in known:
            raise ValueError(f"unknown stripper {self.stripper!r}; known: {', '.join(known)}")
        if not 0 <= self.fg_threshold <= 1:
            raise ValueError("fg_threshold lies between 0 and 1")

    def prompts(self, triples: DataFrame, parses: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """Add ``pf_prompt``, the prompt as it is encoded, and ``was_stripped``.

        The syntax stripper needs ``parses``, the token tables of the prompts and
        of the subjects' names; their ``doc_id`` is a column of ``triples``.
        """
        if self.stripper == "syntax":
            if parses is None:
                raise ValueError("the syntax stripper needs the token tables of prompts and names")
            words, names = (syntax.documents(p) for p in parses)
            found = syntax.strip_subjects(syntax.mentions(words, names.withColumnRenamed("t", "name"))).select("doc_id", "stripped")
            named = F.coalesce(F.trim("object_name"), F.lit("")) != ""
            out = triples.join(found, "doc_id", "left").withColumn("pf_prompt", F.when(named, F.coalesce("stripped", collapse("prompt"))).otherwise(F.col("prompt"))).drop("stripped")
        elif self.stripper not in STRIPPERS:
            asked = triples.select("prompt", "object_name").distinct()
            found = plugins.apply(asked, "stripper", self.stripper, ["prompt", "object_name"], "prompt string, object_name string, pf_prompt string")
            keyed = found.select(F.struct("prompt", "object_name").alias("_asked"), "pf_prompt")
            out = triples.withColumn("_asked", F.struct("prompt", "object_name")).join(keyed, "_asked", "left").drop("_asked").withColumn("pf_prompt", F.coalesce("pf_prompt", "prompt"))
        else:
            out = triples.withColumn("pf_prompt", strip_subject("prompt", "object_name", self.stripper))
        return out.withColumn("was_stripped", was_stripped("prompt", "pf_prompt"))

    def score(self, triples: DataFrame, patch_rows: DataFrame, texts: DataFrame | None = None, parses: tuple[DataFrame, DataFrame] | None = None, matched: DataFrame | None = None) -> DataFrame:
        """(ref, out, cp, pf, extras): cp is NULL without foreground in the
        reference, pf without background in the output or without a text.

        ``triples``: (ref, out, prompt, object_name); ``texts``: (pf_prompt, vector);
        ``parses`` as in ``prompts``; ``matched``: stored ``patches.matches`` of
        these pairs, which are then not made again.
        """
        ready = self.prompts(triples, parses)
        blocks = patches.image_blocks(patch_rows)
        rows = patches.per_patch(patches.matches(ready.select("ref", "out").distinct(), blocks) if matched is None else matched)
        parts = patches.scores(self.fg_threshold) | {"cp": patches.masked_maxcos(self.fg_threshold)}
        scored = rows.groupBy("ref", "out").agg(*[v.alias(k) for k, v in parts.items()])
        out = ready.join(scored, ["ref", "out"]).join(self.background(blocks, patch_rows), "out", "left")
        if texts is None:
            out = out.withColumn("pf", F.lit(None).cast("double"))
        else:
            out = out.join(texts, "pf_prompt", "left").withColumn("pf", pairs.cosine(F.col("bg"), F.col("vector")))
        extras = F.struct("pf_prompt", "was_stripped", *[k for k in parts if k != "cp"], *BACKGROUND_COUNTS)
        return out.select("ref", "out", "cp", "pf", extras.alias("extras"))

    def background(self, blocks: DataFrame, patch_rows: DataFrame) -> DataFrame:
        """(out, bg, and its counts): the pooled background of each image, NULL
        where all is foreground."""
        n_bg = F.size(F.filter("w", lambda w: ~(w >= self.fg_threshold)))
        if self.head:
            pooled = pooling.background_pool(blocks, self.head, self.fg_threshold)
        else:
            means = patches.mean_pool(patch_rows, ~(F.col("w") >= self.fg_threshold), "bg")
            pooled = blocks.select("image_id", (F.size("w") - n_bg).alias("n_fg"), F.size("w").alias("n_total"), n_bg.alias("n_bg")).join(means, "image_id", "left")
        counts = [F.col(c).alias(k) for c, k in zip(("n_fg", "n_total", "n_bg"), BACKGROUND_COUNTS, strict=True)]
        return pooled.select(F.col("image_id").alias("out"), "bg", *counts)
