"""Dataset trees: file listings turned into samples by path parsing and joins.

A listing is (path, length, ...) from the binary-file source, without content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agreemill.functions.text import bare, is_style, key_of, stem_parts, subject_parts
from agreemill.operators.pairs import even_stride

IMAGES = ("png", "jpg", "jpeg", "webp")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, folder, stem, ext) of every file below a root, content unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"))


def images(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(*IMAGES)).orderBy("path")


def first_lines(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, folder, stem, line): the trimmed first line of each caption."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    name = F.element_at(F.split("path", "/"), -1)
    return text.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), bare(F.get(F.split("value", "\n"), F.lit(0))).alias("line"))


def object_name(caption: Column, keyword: Column) -> Column:
    """The caption, or the folder keyword with its underscores as spaces."""
    return F.coalesce(F.when(bare(caption) != "", bare(caption)), F.replace(keyword, F.lit("_"), F.lit(" ")))


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """(path, h, w, channels, data) of image files, decoded in the JVM."""
    return spark.read.format("image").option("recursiveFileLookup", "true").load(root).select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def rated_samples(outputs: DataFrame, refs: DataFrame, out_masks: DataFrame | None, prompts: DataFrame, captions: DataFrame, min_fraction: float | None = 0.05) -> DataFrame:
    """Samples of a tree of methods, subjects and prompt_seed stems.

    ``outputs``: (gen_method, folder, stem, path); ``refs``: (category, idx,
    ref_image, ref_mask, fg_ref); ``out_masks``: (gen_method, folder, stem,
    out_mask, fg_out) or None to skip masks; ``prompts``: (category, idx,
    prompt_id, prompt); ``captions``: (category, idx, caption). Rows without a
    reference or mask go, prompts and captions may be missing. Fractions at or
    under ``min_fraction`` go (None keeps all).
    """
    parts = outputs.select("*", subject_parts("folder").alias("s"), stem_parts("stem").alias("p")).where(F.col("p").isNotNull())
    rows = parts.select("gen_method", "folder", "stem", F.col("path").alias("out_image"), "s.category", "s.idx", "s.keyword", "p.prompt_id", "p.seed")
    rows = rows.join(refs, ["category", "idx"])
    if min_fraction is not None:
        rows = rows.where(F.col("fg_ref") > min_fraction)
    if out_masks is not None:
        rows = rows.join(out_masks, ["gen_method", "folder", "stem"])
        if min_fraction is not None:
            rows = rows.where(F.col("fg_out") > min_fraction)
    rows = rows.join(prompts, ["category", "idx", "prompt_id"], "left").join(captions, ["category", "idx"], "left")
    return rows.select(
        F.col("folder").alias("concept_id"),
        *[c for c in ("ref_image", "ref_mask", "out_image", "out_mask", "fg_ref", "fg_out") if c in rows.columns],
        "gen_method",
        "prompt_id",
        "seed",
        key_of("folder", "prompt_id").alias("key"),
        "category",
        F.col("idx").alias("subject_idx"),
        F.concat("category", F.lit("/"), "idx").alias("subject"),
        object_name(F.col("caption"), F.col("keyword")).alias("object_name"),
        F.coalesce(bare("prompt"), F.lit("")).alias("prompt"),
        is_style("category").alias("is_style"),
    )


def photo_pool(photos: DataFrame, min_fraction: float = 0.005) -> DataFrame:
    """(subject, scene, background, path, source) usable photos of a subject tree.

    The first factual photo of a background counts; a background without one may
    be filled from the counterfactual folder, first ``_1`` image of a scene.
    """
    usable = photos.where(F.col("fg") > min_fraction)
    factual = usable.where(F.col("source") == "factual_only").withColumn("rank", F.lit(0))
    other = usable.where((F.col("source") == "factual_counterfactual") & F.endswith("stem", F.lit("_1"))).withColumn("rank", F.lit(1))
    w = Window.partitionBy("subject", "background").orderBy("rank", "path")
    return factual.unionByName(other).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "rank")


def pooled_photos(photos: DataFrame, per_subject: int = 8, min_fraction: float = 0.005) -> DataFrame:
    """(subject, pos, path, source): the photos of a subject that are used.

    All usable factual photos in order, then the first usable ``_1`` image of each
    counterfactual scene; of these ``per_subject`` at even strides (all, if fewer).
    """
    usable = photos.where(F.col("fg") > min_fraction)
    factual = usable.where(F.col("source") == "factual_only").select("subject", "path", "source", F.lit(0).alias("_rank"), F.lit("").alias("_scene"))
    scenes = usable.where((F.col("source") == "factual_counterfactual") & F.endswith("stem", F.lit("_1"))).groupBy("subject", "scene").agg(F.min("path").alias("path"))
    other = scenes.select("subject", "path", F.lit("factual_counterfactual").alias("source"), F.lit(1).alias("_rank"), F.col("scene").cast("string").alias("_scene"))
    pool = factual.unionByName(other).withColumn("_order", F.struct("_rank", "_scene", "path"))
    return even_stride(pool, "subject", "_order", per_subject).select("subject", "pos", "path", "source")


def with_enough(photos: DataFrame, k: int, n_subjects: int | None = None) -> DataFrame:
    """The first k backgrounds of each subject that has as many; at most the
    first ``n_subjects`` of them, numeric names in numeric order."""
    sized = photos.groupBy("subject").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("subject")
    w = Window.partitionBy("subject").orderBy("background")
    rows = photos.join(sized, "subject").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    if n_subjects is not None:
        first = sized.orderBy(F.coalesce(F.expr("try_cast(subject AS INT)"), F.lit(10**9)), "subject").limit(n_subjects)
        rows = rows.join(first, "subject", "left_semi")
    return rows


BUILDERS: dict[str, Callable[..., DataFrame]] = {"rated_samples": rated_samples, "photo_pool": photo_pool, "pooled_photos": pooled_photos, "with_enough": with_enough}


def builder(name: str) -> Callable[..., DataFrame]:
    if name not in BUILDERS:
        raise ValueError(f"unknown sample builder {name!r}; known: {', '.join(sorted(BUILDERS))}")
    return BUILDERS[name]
