"""Scoring runs: from a configuration and stored features to result rows."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill import plugins
from agreemill.api import PairScorer
from agreemill.config import RunConfig
from agreemill.functions.text import is_style, segmenter_prompt
from agreemill.operators import pairs as pair_ops
from agreemill.operators import patches, pooling
from agreemill.schema import assert_unique
from agreemill.sinks.runs import Run
from agreemill.sources.results import capped

#: Keys of a result that a table of samples may have.
KEYS = ("concept_id", "prompt_id", "gen_method", "seed", "ref", "out")
VARIANTS = ("global", "global_bg", "global_fg", "maxsim", "maxsim_textproj")


def samples_of(config: RunConfig, pairs: DataFrame) -> DataFrame:
    """The samples that a configuration selects."""
    rows = pairs
    if config.methods:
        rows = rows.where(F.col("gen_method").isin(*config.methods))
    if config.min_fg_fraction is not None and "fg_ref" in rows.columns:
        rows = rows.where((F.col("fg_ref") > config.min_fg_fraction) & (F.col("fg_out") > config.min_fg_fraction))
    if config.signal == "pf" and "prompt" in rows.columns:
        style = config.skip_style and "category" in rows.columns
        rows = scorable(rows, style).where("skipped IS NULL").drop("skipped")
    return capped(rows, config.max_samples) if config.max_samples else rows


def without_features(samples: DataFrame, features: DataFrame) -> DataFrame:
    """(n_missing, n_samples): samples whose reference or output has no features;
    they get no row."""
    known = features.select("image_id").distinct()
    left = samples.select("ref", "out").join(known.select(F.col("image_id").alias("ref"), F.lit(1).alias("_r")), "ref", "left").join(known.select(F.col("image_id").alias("out"), F.lit(1).alias("_o")), "out", "left")
    return left.agg(F.count_if(F.col("_r").isNull() | F.col("_o").isNull()).alias("n_missing"), F.count("*").alias("n_samples"))


def score_run(spark: SparkSession, config: RunConfig, pairs: DataFrame, features: DataFrame, texts: DataFrame | None = None, parses: tuple[DataFrame, DataFrame] | None = None, head: pooling.AttentionHead | None = None, batches: int = 1) -> Run:
    """Score the samples of a configuration into ``config.out``, going on where an
    earlier run of it stopped.

    The built-in matcher ``patches`` gives both scores; its stored arrays can be
    dumped. Any other matcher is a plug-in over the samples (kind prompt_scorer
    for the signal pf), which returns ``score`` and ``extras``.
    """
    samples = samples_of(config, pairs)
    keys = tuple(k for k in KEYS if k in samples.columns)
    assert_unique(samples, *keys)
    run = Run(spark, config.out, keys, config.digest)
    if config.matcher == "patches":
        known = features.select("image_id").distinct()
        for side in ("ref", "out"):  # others have no row, and would be pending for ever
            samples = samples.join(known.withColumnRenamed("image_id", side), side, "left_semi")
        scorer = PairScorer(stripper=config.stripper, head=head)

        def scored(part: DataFrame, further: object) -> DataFrame:
            matched = None
            if config.dump_patch_arrays:
                blocks = patches.image_blocks(features)
                found = patches.matches(part.select("ref", "out").distinct(), blocks)
                matched = further("arrays", part.select(*keys).join(found, ["ref", "out"]))
                matched = matched.dropDuplicates(["ref", "out"]).select("ref", "out", "w_ref", "w_out", "nn")
            rows = scorer.score(part, features, texts, parses, matched)
            return part.select(*keys).join(rows, [k for k in ("ref", "out") if k in keys])

    else:
        if config.dump_patch_arrays:
            raise ValueError(f"the matcher {config.matcher!r} has no patch arrays to dump")
        kind = "prompt_scorer" if config.signal == "pf" else "matcher"
        plugins.loader(kind, config.matcher)
        schema = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys) + ", score double, extras map<string,string>"

        def scored(part: DataFrame, further: object) -> DataFrame:
            return plugins.apply(part, kind, config.matcher, list(keys), schema, **config.matcher_kwargs)

    run.score(samples, lambda part, further: scored(part, further).withColumns({"signal": F.lit(config.signal), "model": F.lit(config.model), "tag": F.lit(config.tag)}), batches)
    return run


def follow_run(spark: SparkSession, config: RunConfig, samples: DataFrame, features: DataFrame, texts: DataFrame | None = None, tokens: DataFrame | None = None, special: tuple[int, ...] = (0, 1), projection: tuple | None = None, head: pooling.AttentionHead | None = None, batches: int = 1) -> Run:
    """Score a variant of prompt following into ``config.out``, going on where an
    earlier run stopped. ``samples`` has text_id and image_id besides its keys;
    samples without a prompt, and style subjects where they are skipped, get no
    row. Other arguments as in ``prompt_following``."""
    rows = samples_of(replace(config, signal="pf"), samples)
    keys = tuple(k for k in (*KEYS, "text_id", "image_id") if k in rows.columns)
    run = Run(spark, config.out, keys, config.digest)
    blocks = patches.image_blocks(features)

    def scored(part: DataFrame, further: object) -> DataFrame:
        out = prompt_following(part.select(*keys), blocks, (config.variant,), texts, tokens, special, projection, head)
        return out.select(*keys, F.col(config.variant).alias("score"), F.lit("pf").alias("signal"), F.lit(config.model).alias("model"), F.lit(config.variant).alias("variant"))

    run.score(rows, scored, batches)
    return run


def mask_run(spark: SparkSession, jobs: DataFrame, segmenter: str, out: str, overwrite: bool = False, batches: int = 1, **options: object) -> Run:
    """Masks (path, h, w, data) of ``jobs`` (path, name, and what the segmenter
    reads) by a plug-in, asked with the name as it wants it. Paths that have a mask
    are skipped unless ``overwrite``."""
    run = Run(spark, out, ("path",), f"{segmenter} {sorted(options.items())}")
    if overwrite:
        run.clear()
    plugins.loader("segmenter", segmenter)
    asked = jobs.withColumn("prompt", segmenter_prompt("name"))
    run.score(asked, lambda part, further: plugins.apply(part, "segmenter", segmenter, ["path"], "path string, h int, w int, data binary", **options), batches)
    return run


def settings(config: RunConfig) -> str:
    """All settings of a run, for its record."""
    return str(asdict(config))


def scorable(samples: DataFrame, skip_style: bool = False) -> DataFrame:
    """Add ``skipped``: why a sample has no prompt following (an empty prompt, a
    style subject where those are left out), NULL where it has."""
    empty = F.coalesce(F.col("prompt"), F.lit("")) == ""
    style = F.lit(skip_style) & F.coalesce(is_style("category"), F.lit(False))
    return samples.withColumn("skipped", F.when(empty, F.lit("empty prompt")).when(style, F.lit("style")))


def _pooled(blocks: DataFrame, keep: Column, head: pooling.AttentionHead | None, name: str) -> DataFrame:
    """(image_id, name): the pooled vector of the patches that ``keep``, a
    function of a weight, lets in; attention with a head, else the mean."""
    allowed = F.transform("w", keep)
    if head:
        return blocks.select("image_id", pooling.attention_pooled(blocks.sparkSession, head, F.col("feat"), allowed).alias(name))
    rows = blocks.select("image_id", F.inline(F.arrays_zip(F.col("feat").alias("feat"), allowed.alias("keep"))))
    return patches.mean_pool(rows, F.col("keep"), name)


def prompt_following(samples: DataFrame, blocks: DataFrame, variants: tuple[str, ...] = VARIANTS, texts: DataFrame | None = None, tokens: DataFrame | None = None, special: tuple[int, ...] = (0, 1), projection: tuple | None = None, head: pooling.AttentionHead | None = None, threshold: float = 0.5) -> DataFrame:
    """The samples (text_id, image_id) with one column a variant, NULL where a
    side has nothing to compare.

    ``global``: the whole image against the text; ``global_bg`` and ``global_fg``:
    its background (weights that don't reach ``threshold``) or foreground;
    ``maxsim``: the best patch of each valid token; ``maxsim_textproj``: the same
    with projected tokens. ``texts``: (text_id, vector); ``tokens`` as in
    ``pooling.text_blocks``.
    """
    unknown = set(variants) - set(VARIANTS)
    if unknown:
        raise ValueError(f"unknown variants: {', '.join(sorted(unknown))}; known: {', '.join(VARIANTS)}")
    need = {"texts": (texts, [v for v in variants if v.startswith("global")]), "tokens": (tokens, [v for v in variants if v.startswith("maxsim")]), "projection": (projection, [v for v in variants if v == "maxsim_textproj"])}
    for name, (given, users) in need.items():
        if users and given is None:
            raise ValueError(f"{', '.join(users)} need {name}")
    out = samples
    keeps = {"global": lambda w: F.lit(True), "global_bg": lambda w: ~(w >= threshold), "global_fg": lambda w: w >= threshold}
    if need["texts"][1]:
        out = out.join(texts.select("text_id", F.col("vector").alias("_text")), "text_id", "left")
    for v in variants:
        if v in keeps:
            out = out.join(_pooled(blocks, keeps[v], head, "_image"), "image_id", "left").withColumn(v, pair_ops.cosine(F.col("_image"), F.col("_text"))).drop("_image")
        else:
            found = pooling.maxsim(samples.select("text_id", "image_id").distinct(), pooling.text_blocks(tokens, special, projection if v == "maxsim_textproj" else None), blocks)
            out = out.join(found.select("text_id", "image_id", F.col("maxsim").alias(v)), ["text_id", "image_id"], "left")
    return out.select(*samples.columns, *variants)
