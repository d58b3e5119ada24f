"""Similarity of images by their patches.

Patches are dealt in blocks of at most BLOCK of an image. A pair of images is the
tiles of their blocks; each tile is one group and one matrix product, in strips of
at most CELLS cosines, and gives for every patch of either side its nearest one in
the tile. One aggregate takes the best over tiles. No task holds more than two
blocks and a strip, whatever the size of an image.

The result, for each reference patch its nearest output patch and that one's
nearest reference patch, does not depend on masks: it can be stored, one array an
image pair, and any mask applied later. All scores are plain aggregates over it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agreemill.functions.numbers import ratio
from agreemill.operators.pairs import matrix, unit

THRESHOLD = 0.5
STRIP = 4096
#: Patches of a block, and cosines that a task holds at a time.
BLOCK = 32_768
CELLS = 1_000_000


def image_blocks(patches: DataFrame) -> DataFrame:
    """(image_id, w, feat): one row an image, arrays in patch order."""
    rows = patches.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("patch_idx", "w", "feat"))).alias("p"))
    return rows.select("image_id", F.col("p.w").alias("w"), F.col("p.feat").alias("feat"))


def strip_rows(width: int) -> int:
    """Rows of a product with ``width`` columns that are made at a time."""
    return max(1, min(STRIP, CELLS // max(1, width)))


def nearest_both(ref: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest output patch of each reference patch, its cosine, nearest reference
    patch of each output patch, its cosine), ties to the lowest index; the product
    is made in strips. Neither side is empty."""
    a, b = unit(ref), unit(out).T
    to, cos = np.empty(len(ref), int), np.empty(len(ref))
    back, best = np.zeros(len(out), int), np.full(len(out), -np.inf)
    step = strip_rows(len(out))
    for at in range(0, len(a), step):
        s = a[at : at + step] @ b
        np.round(s, 12, out=s)
        mine = s.argmax(axis=1)
        to[at : at + step], cos[at : at + step] = mine, s[np.arange(len(s)), mine]
        theirs = s.argmax(axis=0)
        top = s[theirs, np.arange(s.shape[1])]
        better = ~(top <= best) & ~np.isnan(best)  # a NaN is the greatest, as in argmax
        back[better], best[better] = at + theirs[better], top[better]
    return to, cos, back, best


def nearest(ref: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest output patch, its cosine, that patch's nearest reference patch),
    ties to the lowest index."""
    if not len(ref) or not len(out):
        return np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    to, cos, back, _ = nearest_both(ref, out)
    return to, cos, back[to]


def blocked(rows: DataFrame, index: str, block: int | None = None) -> DataFrame:
    """Rows with ``_block``, the block of their index."""
    return rows.withColumn("_block", F.floor(F.col(index) / (block or BLOCK)).cast("int"))


def nearest_rows(pairs: DataFrame, patches: DataFrame, block: int | None = None) -> DataFrame:
    """(ref, out, ref_idx, to, cos, back, mutual, w_ref, w_partner): one row a
    reference patch of each pair of images, from patches (image_id, patch_idx, w,
    feat); ties to the lowest index."""
    rows = blocked(patches.select("image_id", F.col("patch_idx").cast("int").alias("patch_idx"), F.col("w").cast("double").alias("w"), "feat"), "patch_idx", block)
    there = rows.select("image_id", "_block").distinct()
    tiles = pairs.select("ref", "out").distinct()
    for side, n in (("ref", "_x"), ("out", "_y")):
        tiles = tiles.join(there.toDF(side, n), side)
    sides = [tiles.join(rows.withColumnsRenamed({"image_id": side, "_block": n}), [side, n]).select(*[F.col(c).alias(c) for c in ("ref", "out", "_x", "_y", "patch_idx", "w", "feat")]) for side, n in (("ref", "_x"), ("out", "_y"))]
    one, two = (pairs.schema[c].dataType.simpleString() for c in ("ref", "out"))

    def tile(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        parts = []
        if p.num_rows and q.num_rows:
            p, q = (t.sort_by("patch_idx") for t in (p, q))
            to, cos, back, best = nearest_both(matrix(p["feat"], p.num_rows), matrix(q["feat"], q.num_rows))
            i, j = p["patch_idx"].to_numpy(), q["patch_idx"].to_numpy()
            parts = [(True, i, p["w"], j[to], cos), (False, j, q["w"], i[back], best)]
        n = sum(len(x[1]) for x in parts)
        join = lambda k, kind: pa.chunked_array([pa.array(x[k]) if isinstance(x[k], np.ndarray) else x[k].combine_chunks() for x in parts], kind)
        return pa.table({
            "ref": pa.repeat(key[0], n), "out": pa.repeat(key[1], n), "is_ref": pa.array(np.repeat([x[0] for x in parts], [len(x[1]) for x in parts]).astype(bool)),
            "idx": join(1, pa.int32()), "w": join(2, pa.float64()), "other": join(3, pa.int32()), "cos": join(4, pa.float64()),
        })

    keys = ["ref", "out", "_x", "_y"]
    found = sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(tile, f"ref {one}, out {two}, is_ref boolean, idx int, w double, other int, cos double")
    best = found.groupBy("ref", "out", "is_ref", "idx").agg(F.max(F.struct("cos", (-F.col("other")).alias("less"))).alias("m"), F.max("w").alias("w"))
    best = best.select("ref", "out", "is_ref", "idx", "w", F.col("m.cos").alias("cos"), (-F.col("m.less")).alias("other"))
    # a reference patch meets its partner's own row
    met = Window.partitionBy("ref", "out", F.when(F.col("is_ref"), F.col("other")).otherwise(F.col("idx")))
    of_partner = lambda c: F.max(F.when(~F.col("is_ref"), F.col(c))).over(met)
    both = best.withColumns({"back": of_partner("other"), "w_partner": of_partner("w")}).where("is_ref")
    return both.select("ref", "out", F.col("idx").alias("ref_idx"), F.col("other").alias("to"), "cos", "back", (F.col("back") == F.col("idx")).alias("mutual"), F.col("w").alias("w_ref"), "w_partner")


def matches(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(ref, out, w_ref, w_out, nn): nn is an array of struct(to, cos, back), one
    element a reference patch. Keep or store it to apply other masks later."""
    rows = blocks.select("image_id", "w", F.posexplode("feat").alias("patch_idx", "feat")).withColumn("w", F.get("w", F.col("patch_idx")))
    found = nearest_rows(pairs, rows).groupBy("ref", "out").agg(F.sort_array(F.collect_list(F.struct("ref_idx", "to", "cos", "back"))).alias("n"))
    sizes = blocks.select("image_id", "w")
    joined = pairs.select("ref", "out").join(sizes.toDF("ref", "w_ref"), "ref").join(sizes.toDF("out", "w_out"), "out").join(found, ["ref", "out"], "left")
    nn = F.coalesce(F.transform("n", lambda m: F.struct(m["to"].alias("to"), m["cos"].alias("cos"), m["back"].alias("back"))), F.array().cast("array<struct<to: int, cos: double, back: int>>"))
    return joined.select("ref", "out", "w_ref", "w_out", nn.alias("nn"))


def per_patch(matched: DataFrame) -> DataFrame:
    """(ref, out, ref_idx, to, cos, mutual, w_ref, w_partner): one row a reference patch."""
    rows = matched.select("ref", "out", "w_ref", "w_out", F.posexplode("nn").alias("ref_idx", "m"))
    return rows.select("ref", "out", "ref_idx", F.col("m.to").alias("to"), F.col("m.cos").alias("cos"), (F.col("m.back") == F.col("ref_idx")).alias("mutual"), F.get("w_ref", F.col("ref_idx")).alias("w_ref"), F.get("w_out", F.col("m.to")).alias("w_partner"))


def masked_maxcos(threshold: float = THRESHOLD, empty: str = "nan") -> Column:
    """Aggregate: mean nearest cosine of foreground reference patches (w above
    the threshold). ``empty``: NULL ("nan") or 0 ("zero") without foreground."""
    mean = F.avg(F.when(F.col("w_ref") > threshold, F.col("cos")))
    return F.coalesce(mean, F.lit(0.0)) if empty == "zero" else mean


def scores(threshold: float = THRESHOLD) -> dict[str, Column]:
    """Aggregates over ``per_patch``: all variants and their counters."""
    fg = F.col("w_ref") > threshold
    match = F.col("mutual") & fg
    both = match & (F.col("w_partner") > threshold)
    return {
        "masked_maxcos": masked_maxcos(threshold, "zero"),
        "global_maxcos": F.avg("cos"),
        "weighted_maxcos": F.coalesce(ratio(F.sum(F.col("w_ref") * F.col("cos")), F.sum("w_ref")), F.lit(0.0)),
        "recall_fg": F.coalesce(ratio(F.count_if(both), F.count_if(match)), F.lit(0.0)),
        "mean_nn_cos_fg": F.coalesce(F.avg(F.when(match, F.col("cos"))), F.lit(0.0)),
        "n_ref_in_fg": F.count_if(match),
        "n_ref_fg_only": F.count_if(fg),
        "n_both_in_fg": F.count_if(both),
        "n_mutual_total": F.count_if(F.col("mutual")),
        "n_ref_patches_total": F.count("*"),
        "fg_frac_ref": F.avg("w_ref"),
        "total_ref_w": F.sum("w_ref"),
    }


def score_pairs(pairs: DataFrame, patches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every score of every pair in one pass."""
    rows = nearest_rows(pairs, patches)
    return rows.groupBy("ref", "out").agg(*[v.alias(k) for k, v in scores(threshold).items()])


def mean_pool(patches: DataFrame, keep: Column, name: str = "pooled") -> DataFrame:
    """(image_id, pooled): the mean vector of the kept patches, in the JVM."""
    dims = patches.where(keep).select("image_id", F.posexplode("feat").alias("d", "v"))
    means = dims.groupBy("image_id", "d").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("d", "m")))
    return means.groupBy("image_id").agg(F.transform(ordered, lambda x: x["m"]).alias(name))


def points_in_mask(points: DataFrame, mask: DataFrame, key: str, x: str, y: str, width: int, height: int, name: str, threshold: float = 0.5) -> DataFrame:
    """Whether each point lies on the mask: coordinates are truncated and
    clipped to its bounds, then looked up by (key, y, x)."""
    px = F.least(F.greatest(F.col(x).cast("int"), F.lit(0)), F.lit(width - 1))
    py = F.least(F.greatest(F.col(y).cast("int"), F.lit(0)), F.lit(height - 1))
    table = mask.select(F.col(key), F.col("y").alias("_y"), F.col("x").alias("_x"), (F.col("value") / 255.0 > threshold).alias(name))
    return points.withColumn("_x", px).withColumn("_y", py).join(table, [key, "_y", "_x"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False))).drop("_x", "_y")


def away_from_border(x: Column, y: Column, width: int, height: int, margin: int = 3) -> Column:
    return (x >= margin) & (x < width - margin) & (y >= margin) & (y < height - margin)


def flagged(match_rows: DataFrame, flags: DataFrame, index: str, name: str) -> DataFrame:
    """Matches with the foreground flag of one side's keypoint, by its index."""
    return match_rows.join(flags.select(F.col("pair"), F.col("kp").alias(index), F.col("fg").alias(name)), ["pair", index], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def match_recall(ref: str = "in_ref", out: str = "in_out", score: str | None = None) -> dict[str, Column]:
    """Aggregates over sparse matches: recall of foreground matches, counters,
    and their mean match score."""
    inside, both = F.col(ref), F.col(ref) & F.col(out)
    parts = {"recall": F.coalesce(ratio(F.count_if(both), F.count_if(inside)), F.lit(0.0)), "n_ref_fg": F.count_if(inside), "n_both_fg": F.count_if(both), "n_matches": F.count("*")}
    return parts | ({"mean_score_fg": F.coalesce(F.avg(F.when(inside, F.col(score))), F.lit(0.0))} if score else {})


def strided(rows: DataFrame, step: int, y: str = "gy", x: str = "gx") -> DataFrame:
    """Every ``step``-th patch in both directions, before any product is made."""
    return rows.where((F.col(y) % step == 0) & (F.col(x) % step == 0))


def without_prefix(tokens: DataFrame, n: int, index: str = "token_idx") -> DataFrame:
    """Patch tokens without the class and register tokens in front."""
    return tokens.where(F.col(index) >= n).withColumn(index, F.col(index) - n)


def row_max_mean(confidence: Column, weights: Column, threshold: float = THRESHOLD) -> Column:
    """Mean row maximum of an assignment matrix over foreground rows, 0 without."""
    tops = F.zip_with(confidence, weights, lambda row, w: F.when(w > threshold, F.array_max(row)))
    return masked_mean(tops)


def certainty_mean(certainty: Column, weights: Column, width: int, threshold: float = THRESHOLD) -> Column:
    """Mean certainty of the left half (the reference's) of each row of a
    symmetric map, over foreground pixels, 0 without."""
    left = F.flatten(F.transform(certainty, lambda row: F.slice(row, 1, width)))
    return masked_mean(F.zip_with(left, weights, lambda v, w: F.when(w > threshold, v)))


def masked_mean(values: Column) -> Column:
    kept = F.array_compact(values)
    total = F.aggregate(kept, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return F.coalesce(ratio(total, F.size(kept)), F.lit(0.0))


def remask(results: DataFrame, arrays: DataFrame, grids: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Stored nearest cosines under other masks: results by key to their arrays,
    by reference image to each perturbed grid, then one aggregate in the row."""
    joined = results.join(arrays, keys).join(grids.withColumnRenamed("image_id", "ref"), "ref")
    fg = F.zip_with("nn_cos_per_ref", "w", lambda c, w: F.when(w > threshold, c))
    return joined.select(*results.columns, "p", masked_mean(fg).alias("remasked"), F.size(F.array_compact(fg)).alias("n_fg"))
