"""Registered queries over embedding pairs and patches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.functions.numbers import r6, ratio
from agreemill.operators import matching, pairs, patches, pooling, stats
from agreemill.plans import scoring
from agreemill.session import kept
from agreemill.sources import testdata as td
from agreemill.sources.testdata import sql


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, pos, neg) of all pairs, scored once: within and cross pairs at each score."""
    return kept(pairs.pair_score_counts(td.table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"))


def pair_auc_within_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.auc_of_counts(pair_counts(spark, sf_dir), "score")
    return out.select(F.col("n_pos").alias("n_within"), F.col("n_neg").alias("n_cross"), r6(F.col("auc")).alias("auc"))


def pair_describe_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stats.separation_of_counts(pair_counts(spark, sf_dir), "score")
    return parts.select(*[(F.col(k) if k.startswith("n_") else r6(F.col(k))).alias(k) for k in parts.columns])


def pair_within_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = pairs.pools(td.table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id")
    return pairs.within_pairs(pool, "label", "vec_id")


def pair_cross_sample_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.hashed_cross_sample(td.table(spark, sf_dir, "embeddings"), "label", "vec_id", 500)


#: A step of ordinals that no pool size here divides, so that none comes twice.
STEP = 1_000_003


def pair_cross_unranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many cross pairs as there are vectors, by ordinals at even steps through
    the enumerated pool."""
    e = td.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    pool, _ = pairs.cross_pool(e, "label")
    ordinals = spark.range(e.count()).select(F.expr(f"(id * {STEP}L + 17) % {max(1, len(pool))}L").alias("ordinal"))
    return pairs.unranked(e, "label", "vec_id", ordinals).select("ordinal", F.col("group_a").alias("label_a"), "a", F.col("group_b").alias("label_b"), "b")


def pair_cross_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many cross pairs as there are vectors, drawn by the seeded generator."""
    e = td.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return pairs.cross_sample(e, "label", "vec_id", e.count(), 42).select("ordinal", "a", "b")


def pair_even_stride_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = td.table(spark, sf_dir, "embeddings").select("label", "vec_id")
    return pairs.even_stride(e, "label", "vec_id", 10).select("label", "vec_id", "pos")


def global_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = td.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ref = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("ref"))
    joined = e.join(ref, "vec_id").select("vec_id", pairs.cosine(F.col("ref"), F.col("embedding")).alias("cos"))
    return joined.select("vec_id", r6(F.col("cos")).alias("cos"), r6(1 - F.col("cos")).alias("distance"), r6(F.col("cos") * 100).alias("cos_x100"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = td.patches(spark, sf_dir)
    return patches.matches(td.image_pairs(p), patches.image_blocks(p))


def _per_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = td.patches(spark, sf_dir)
    return patches.nearest_rows(td.image_pairs(p), p)


def nn_top1_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_patch(spark, sf_dir).select("ref", "out", "ref_idx", F.col("to").alias("out_idx"), r6(F.col("cos")).alias("cos"))


def nn_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_patch(spark, sf_dir).where("mutual").select("ref", "out", "ref_idx", F.col("to").alias("out_idx"), r6(F.col("cos")).alias("cos"))


def _scored(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    parts = {k: v for k, v in patches.scores().items() if not names or k in names}
    counts = ("n_",)
    return _per_patch(spark, sf_dir).groupBy("ref", "out").agg(*[(v if k.startswith(counts) else r6(v)).alias(k) for k, v in parts.items()])


def cp_masked_maxcos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "masked_maxcos", "n_ref_fg_only")


def cp_global_maxcos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "global_maxcos")


def cp_weighted_maxcos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "weighted_maxcos", "total_ref_w")


def cp_recall_fg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "recall_fg", "mean_nn_cos_fg", "n_ref_in_fg", "n_both_in_fg")


def cp_all_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def cp_threshold_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return td.patches(spark, sf_dir).groupBy("image_id").agg(F.count_if(w > 0.5).alias("n_above"), F.count_if(w >= 0.5).alias("n_from"), F.count_if(w == 0.5).alias("n_at"))


def cp_remask_from_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored arrays under a second mask, and the first one's score again."""
    p = td.patches(spark, sf_dir)
    rows = patches.nearest_rows(td.image_pairs(p), p)
    other = p.select(F.col("image_id").alias("ref"), F.col("patch_idx").alias("ref_idx"), ((F.col("vec_id") * 53 % 101) / 100.0).alias("w2"))
    both = rows.join(other, ["ref", "ref_idx"])
    score = both.groupBy("ref", "out").agg(patches.masked_maxcos(empty="zero").alias("stored"), F.coalesce(F.avg(F.when(F.col("w2") > 0.9, F.col("cos"))), F.lit(0.0)).alias("remasked"), F.count_if(F.col("w2") > 0.9).alias("n_fg"))
    return score.agg(F.count("*").alias("n_pairs"), r6(F.avg("stored")).alias("mean_stored"), r6(F.avg("remasked")).alias("mean_remasked"), r6(F.max(F.abs(F.col("stored") - F.col("remasked")))).alias("max_abs_deviation"), r6(100 * F.avg((F.col("n_fg") == 0).cast("double"))).alias("pct_without_fg"))


def pool_bg_mean_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = td.patches(spark, sf_dir)
    bg = patches.mean_pool(p, ~(F.col("w") >= 0.5), "bg")
    whole = patches.mean_pool(p, F.lit(True), "whole").withColumn("image_id", (F.col("image_id") + 9) % 10)
    return bg.join(whole, "image_id").select("image_id", r6(pairs.cosine(F.col("bg"), F.col("whole"))).alias("cos"))


def pooling_head(dims: int = 64, hidden: int = 32, heads: int = 4) -> pooling.AttentionHead:
    """A head with weights by rule; a trained one is the caller's."""
    w = lambda rows, columns, salt: td.weights(rows, columns, salt) / 2
    row = lambda n, salt: td.weights(1, n, salt)[0]
    return pooling.AttentionHead(
        probe=row(dims, 1) * 8, query=w(dims, dims, 2), query_bias=row(dims, 3), key=w(dims, dims, 4), value=w(dims, dims, 5), value_bias=row(dims, 6), out=w(dims, dims, 7), out_bias=row(dims, 8),
        norm=1 + row(dims, 9), norm_bias=row(dims, 10), up=w(hidden, dims, 11), up_bias=row(hidden, 12), down=w(dims, hidden, 13), down_bias=row(dims, 14), heads=heads,
    )


def pool_bg_attention_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt following: attention-pooled background against a text vector (the
    mean of another image plays the text)."""
    p = td.patches(spark, sf_dir)
    bg = pooling.background_pool(patches.image_blocks(p), pooling_head())
    text = patches.mean_pool(p, F.lit(True), "text").withColumn("image_id", (F.col("image_id") + 9) % 10)
    return bg.join(text, "image_id").select("image_id", "n_fg", "n_total", "n_bg", r6(pairs.cosine(F.col("bg"), F.col("text"))).alias("pf"))


def maxsim_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction of every text with its image, raw and with projected tokens."""
    tokens = td.tokens(spark, sf_dir)
    blocks = patches.image_blocks(td.patches(spark, sf_dir))
    pairs_ = tokens.select("text_id", (F.col("text_id") % 10).alias("image_id")).distinct()
    raw = pooling.maxsim(pairs_, pooling.text_blocks(tokens, (0, 1)), blocks)
    layer = pooling.text_blocks(tokens, (0, 1), (td.weights(64, 64, 21), td.weights(1, 64, 22)[0]))
    projected = pooling.maxsim(pairs_, layer, blocks).select("text_id", "image_id", F.col("maxsim").alias("projected"))
    joined = raw.join(projected, ["text_id", "image_id"])
    return joined.select("text_id", "image_id", "n_tokens", "n_patches", r6(F.col("maxsim")).alias("maxsim"), r6(F.col("projected")).alias("maxsim_textproj"))


def pf_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant of prompt following, for the samples that have a prompt and
    no style subject."""
    tokens = td.tokens(spark, sf_dir)
    blocks = patches.image_blocks(td.patches(spark, sf_dir))
    t = F.col("text_id")
    samples = tokens.select("text_id").distinct().select("text_id", (t % 10).alias("image_id"), F.when(t % 5 != 0, t.cast("string")).otherwise("").alias("prompt"), F.when(t % 4 == 3, "style").otherwise("object").alias("category"))
    ready = scoring.scorable(samples, skip_style=True).where("skipped IS NULL").select("text_id", "image_id")
    vectors = patches.mean_pool(tokens.withColumnRenamed("text_id", "image_id"), F.col("token_id") > 1, "vector").withColumnRenamed("image_id", "text_id")
    out = scoring.prompt_following(ready, blocks, scoring.VARIANTS, vectors, tokens, (0, 1), (td.weights(64, 64, 21), td.weights(1, 64, 22)[0]))
    return out.select("text_id", "image_id", *[r6(F.col(v)).alias(v) for v in scoring.VARIANTS])


def maxsim_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction: patches of one image play tokens, every fifth special."""
    rows = _per_patch(spark, sf_dir).where(F.col("ref_idx") % 5 != 0)
    return rows.groupBy("ref", "out").agg(r6(F.avg("cos")).alias("maxsim"), F.count("*").alias("n_tokens"))


def _keypoints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(matched points with a confidence, masks by point) of image pairs."""
    rows = td.table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("pair"), F.col("l_quantity").alias("xr"), (F.col("l_partkey") % 70 - 3 + 0.5).alias("yr"), (F.col("l_suppkey") % 67 - 1 + 0.25).alias("xo"), (F.col("l_orderkey") % 61).cast("double").alias("yo"), (F.col("l_discount") * 10).alias("conf"), "l_orderkey", "l_linenumber",
    )
    spots = spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y"))
    names = rows.select("pair").distinct()
    return rows, spots.crossJoin(F.broadcast(names)).select("pair", "x", "y", F.when((F.col("x") * 7 + F.col("y") * 13 + F.ascii("pair")) % 10 > 4, 255).otherwise(0).alias("value"))


def recall_sampled_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of 5,000 matches a pair, drawn by their certainty."""
    rows, mask = _keypoints(spark, sf_dir)
    drawn = matching.weighted_sample(rows, ["pair"], F.col("conf"), ["l_orderkey", "l_linenumber"], seed=7)
    found = patches.points_in_mask(patches.points_in_mask(drawn, mask, "pair", "xr", "yr", 64, 64, "in_ref"), mask, "pair", "xo", "yo", 64, 64, "in_out")
    parts = matching.sampled_recall(certainty="conf")
    return found.groupBy("pair").agg(*[(v if k.startswith("n_") else r6(v)).alias(k) for k, v in parts.items()])


GRID, STRIDE, BORDER = 8, 2, 1


def recall_reciprocal_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of reciprocal matches from strided seeds, away from the border of a
    grid of eight columns."""
    p = td.patches(spark, sf_dir)
    blocks = patches.image_blocks(p).withColumn("width", F.lit(GRID))
    found = matching.reciprocal_matches(td.image_pairs(p), blocks, STRIDE)
    sides = p.select("image_id", "patch_idx", (F.col("w") > 0.5).alias("fg"))
    high = blocks.select("image_id", F.ceil(F.size("feat") / GRID).cast("int").alias("height"))
    for side in ("ref", "out"):
        own = sides.join(high, "image_id").toDF(side, f"{side}_idx", f"in_{side}", f"{side}_height")
        at = F.col(f"{side}_idx")
        found = found.join(own, [side, f"{side}_idx"]).where(patches.away_from_border(at % GRID, F.floor(at / GRID), GRID, F.col(f"{side}_height"), BORDER))
    parts = patches.match_recall()
    return found.groupBy("ref", "out").agg(*[(v if k.startswith("n_") else r6(v)).alias(k) for k, v in parts.items()], F.max("rounds").alias("max_rounds"))


def recall_sparse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoint matches with a confidence and a border rule, looked up in masks."""
    rows, mask = _keypoints(spark, sf_dir)
    kept = rows.where((F.col("conf") >= 0.2) & patches.away_from_border(F.col("xr"), F.col("yr"), 64, 64))
    found = patches.points_in_mask(patches.points_in_mask(kept, mask, "pair", "xr", "yr", 64, 64, "in_ref"), mask, "pair", "xo", "yo", 64, 64, "in_out")
    ref, both = F.count_if(F.col("in_ref")), F.count_if(F.col("in_ref") & F.col("in_out"))
    return found.groupBy("pair").agg(F.count("*").alias("n_matches"), ref.alias("n_ref_fg"), both.alias("n_both_fg"), r6(ratio(both, ref)).alias("recall"))


NN = """nn AS (
  SELECT ref, out, ref_idx, w_ref, out_idx, w_partner, cos FROM (
    SELECT a.image_id AS ref, b.image_id AS out, a.patch_idx AS ref_idx, a.w AS w_ref, b.patch_idx AS out_idx, b.w AS w_partner,
      round(list_cosine_similarity(a.feat, b.feat), 12) AS cos,
      row_number() OVER (PARTITION BY a.image_id, b.image_id, a.patch_idx ORDER BY round(list_cosine_similarity(a.feat, b.feat), 12) DESC, b.patch_idx) AS k
    FROM v_patches a JOIN v_patches b ON a.image_id < b.image_id) WHERE k = 1
), back AS (
  SELECT ref, out, out_idx, ref_idx FROM (
    SELECT a.image_id AS ref, b.image_id AS out, a.patch_idx AS ref_idx, b.patch_idx AS out_idx,
      row_number() OVER (PARTITION BY a.image_id, b.image_id, b.patch_idx ORDER BY round(list_cosine_similarity(a.feat, b.feat), 12) DESC, a.patch_idx) AS k
    FROM v_patches a JOIN v_patches b ON a.image_id < b.image_id) WHERE k = 1
), m AS (
  SELECT nn.*, back.ref_idx = nn.ref_idx AS mutual FROM nn JOIN back USING (ref, out, out_idx)
)"""

_SCORES = {
    "masked_maxcos": "round(coalesce(avg(cos) FILTER (WHERE w_ref > 0.5::DOUBLE), 0), 6)",
    "global_maxcos": "round(avg(cos), 6)",
    "weighted_maxcos": "round(coalesce(sum(w_ref * cos) / nullif(sum(w_ref), 0), 0), 6)",
    "recall_fg": "round(coalesce(CAST(count(*) FILTER (WHERE mutual AND w_ref > 0.5::DOUBLE AND w_partner > 0.5::DOUBLE) AS DOUBLE) / nullif(count(*) FILTER (WHERE mutual AND w_ref > 0.5::DOUBLE), 0), 0), 6)",
    "mean_nn_cos_fg": "round(coalesce(avg(cos) FILTER (WHERE mutual AND w_ref > 0.5::DOUBLE), 0), 6)",
    "n_ref_in_fg": "count(*) FILTER (WHERE mutual AND w_ref > 0.5::DOUBLE)",
    "n_ref_fg_only": "count(*) FILTER (WHERE w_ref > 0.5::DOUBLE)",
    "n_both_in_fg": "count(*) FILTER (WHERE mutual AND w_ref > 0.5::DOUBLE AND w_partner > 0.5::DOUBLE)",
    "n_mutual_total": "count(*) FILTER (WHERE mutual)",
    "n_ref_patches_total": "count(*)",
    "fg_frac_ref": "round(avg(w_ref), 6)",
    "total_ref_w": "round(sum(w_ref), 6)",
}


def _weight(i: str, j: str, salt: int) -> str:
    """``testdata.weights`` in SQL."""
    return f"(CAST(({i} * 31 + {j} * 17 + {salt * 13}) % 29 - 14 AS DOUBLE) / 64.0::DOUBLE)"


#: The pooling head unfolded: every patch has its own keys and values.
_ATTENTION = f"""WITH x AS (SELECT image_id, patch_idx, w, unnest(feat) AS v, unnest(range(64)) AS d FROM v_patches WHERE NOT w >= 0.5::DOUBLE),
 j AS (SELECT unnest(range(64)) AS j), q AS (SELECT j, sum({_weight("j", "d", 2)} / 2 * {_weight("0", "d", 1)} * 8) + any_value({_weight("0", "j", 3)}) AS q FROM j, (SELECT unnest(range(64)) AS d) GROUP BY j),
 kv AS (SELECT image_id, patch_idx, j, sum(v * {_weight("j", "d", 4)} / 2) AS k, sum(v * {_weight("j", "d", 5)} / 2) + any_value({_weight("0", "j", 6)}) AS v FROM x, j GROUP BY image_id, patch_idx, j),
 l AS (SELECT image_id, patch_idx, j // 16 AS h, exp(sum(q * k) / 4) AS e FROM kv JOIN q USING (j) GROUP BY image_id, patch_idx, h),
 a AS (SELECT image_id, patch_idx, h, e / sum(e) OVER (PARTITION BY image_id, h) AS a FROM l),
 c AS (SELECT kv.image_id, j, sum(a * v) AS c FROM kv JOIN a ON a.image_id = kv.image_id AND a.patch_idx = kv.patch_idx AND h = j // 16 GROUP BY ALL),
 o AS (SELECT image_id, i.j AS i, sum(c * {_weight("i.j", "c.j", 7)} / 2) + any_value({_weight("0", "i.j", 8)}) AS o FROM c, j i GROUP BY ALL),
 n AS (SELECT image_id, i, o, (o - avg(o) OVER p) / sqrt(var_pop(o) OVER p + 1e-6::DOUBLE) * (1 + {_weight("0", "i", 9)}) + {_weight("0", "i", 10)} AS n FROM o WINDOW p AS (PARTITION BY image_id)),
 u AS (SELECT image_id, m.j AS m, sum(n * {_weight("m.j", "i", 11)} / 2) + any_value({_weight("0", "m.j", 12)}) AS u FROM n, j m WHERE m.j < 32 GROUP BY ALL),
 g AS (SELECT image_id, m, 0.5::DOUBLE * u * (1 + (exp(2 * z) - 1) / (exp(2 * z) + 1)) AS g FROM (SELECT *, sqrt(2 / pi()) * (u + 0.044715::DOUBLE * u * u * u) AS z FROM u)),
 f AS (SELECT g.image_id, j.j AS i, sum(g * {_weight("j.j", "m", 13)} / 2) + any_value({_weight("0", "j.j", 14)}) AS f FROM g, j GROUP BY ALL),
 b AS (SELECT image_id, list(o + f ORDER BY i) AS b FROM n JOIN f USING (image_id, i) GROUP BY image_id),
 t AS (SELECT (image_id + 9) % 10 AS image_id, list(m ORDER BY d) AS t FROM (SELECT image_id, d, avg(v) AS m FROM (SELECT image_id, unnest(feat) AS v, unnest(range(64)) AS d FROM v_patches) GROUP BY image_id, d) GROUP BY image_id),
 s AS (SELECT image_id, CAST(count(*) FILTER (WHERE w >= 0.5::DOUBLE) AS INTEGER) AS n_fg, CAST(count(*) AS INTEGER) AS n_total, CAST(count(*) FILTER (WHERE NOT w >= 0.5::DOUBLE) AS INTEGER) AS n_bg FROM v_patches GROUP BY image_id)
 SELECT image_id, n_fg, n_total, n_bg, round(list_cosine_similarity(b, t), 6) AS pf FROM s JOIN t USING (image_id) LEFT JOIN b USING (image_id)"""
_MAXSIM = f"""WITH k AS (SELECT *, token_id > 1 AS valid, text_id % 10 AS image_id FROM v_tokens),
 y AS (SELECT text_id, token_idx, list(y ORDER BY i) AS feat FROM (SELECT text_id, token_idx, i, sum(v * {_weight("i", "d", 21)}) + any_value({_weight("0", "i", 22)}) AS y
   FROM (SELECT text_id, token_idx, unnest(feat) AS v, unnest(range(64)) AS d FROM k WHERE valid), (SELECT unnest(range(64)) AS i) GROUP BY ALL) GROUP BY ALL),
 s AS (SELECT k.text_id, k.token_idx, max(list_cosine_similarity(k.feat, p.feat)) AS raw, max(list_cosine_similarity(y.feat, p.feat)) AS projected
   FROM k JOIN y USING (text_id, token_idx) JOIN v_patches p ON p.image_id = k.image_id GROUP BY ALL),
 n AS (SELECT image_id, CAST(count(*) AS INTEGER) AS n_patches FROM v_patches GROUP BY image_id),
 t AS (SELECT text_id, image_id, CAST(count(*) FILTER (WHERE valid) AS INTEGER) AS n_tokens FROM k GROUP BY ALL)
 SELECT text_id, image_id, n_tokens, n_patches, round(raw, 6) AS maxsim, round(projected, 6) AS maxsim_textproj FROM t JOIN n USING (image_id)
 LEFT JOIN (SELECT text_id, avg(raw) AS raw, avg(projected) AS projected FROM s GROUP BY text_id) USING (text_id)"""


def _mean_sql(name: str, where: str, table: str = "v_patches", key: str = "image_id") -> str:
    return f"{name} AS (SELECT {key}, list(m ORDER BY d) AS v FROM (SELECT {key}, d, avg(v) AS m FROM (SELECT {key}, unnest(feat) AS v, unnest(range(64)) AS d FROM {table} WHERE {where}) GROUP BY ALL) GROUP BY {key})"


_VARIANTS = f"""WITH sims AS ({sql(_MAXSIM, "v_patches", "v_tokens")}), {_mean_sql("whole", "true")}, {_mean_sql("bg", "NOT w >= 0.5::DOUBLE")}, {_mean_sql("fg", "w >= 0.5::DOUBLE")}, {_mean_sql("txt", "token_id > 1", "v_tokens", "text_id")}
 SELECT s.text_id, s.image_id, round(list_cosine_similarity(whole.v, txt.v), 6) AS global, round(list_cosine_similarity(bg.v, txt.v), 6) AS global_bg, round(list_cosine_similarity(fg.v, txt.v), 6) AS global_fg, maxsim, maxsim_textproj
 FROM sims s LEFT JOIN whole USING (image_id) LEFT JOIN bg USING (image_id) LEFT JOIN fg USING (image_id) LEFT JOIN txt USING (text_id) WHERE s.text_id % 5 <> 0 AND s.text_id % 4 <> 3"""


def _score_sql(*names: str) -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in _SCORES.items() if not names or k in names)
    return sql(f"WITH {NN} SELECT ref, out, {cols} FROM m GROUP BY ref, out", "v_patches")


_POINTS = """r AS (SELECT l_returnflag || l_linestatus AS pair, l_quantity AS xr, CAST(l_partkey % 70 - 3 AS DOUBLE) + 0.5::DOUBLE AS yr, CAST(l_suppkey % 67 - 1 AS DOUBLE) + 0.25::DOUBLE AS xo, l_orderkey % 61 AS yo, l_discount * 10 AS conf, l_orderkey, l_linenumber FROM lineitem)"""
_PLACED = """c AS (SELECT *, least(greatest(CAST(trunc(xr) AS INTEGER), 0), 63) AS x1, least(greatest(CAST(trunc(yr) AS INTEGER), 0), 63) AS y1, least(greatest(CAST(trunc(xo) AS INTEGER), 0), 63) AS x2, least(greatest(CAST(yo AS INTEGER), 0), 63) AS y2 FROM k),
 f AS (SELECT *, (x1 * 7 + y1 * 13 + ascii(pair)) % 10 > 4 AS in_ref, (x2 * 7 + y2 * 13 + ascii(pair)) % 10 > 4 AS in_out FROM c)"""
_SQUARE = "SELECT * REPLACE ((h * h + {} ) % 2147483647 AS h) FROM"
_SAMPLED = f"""WITH {_POINTS}, h1 AS (SELECT *, (7::BIGINT * 1000003 + l_orderkey % 2147483647) % 2147483647 AS h FROM r WHERE conf > 0),
 h2 AS ({_SQUARE.format(12345)} h1), h3 AS ({_SQUARE.format(67891)} h2), h4 AS (SELECT * REPLACE ((h * 1000003 + l_linenumber) % 2147483647 AS h) FROM h3), h5 AS ({_SQUARE.format(12345)} h4), h6 AS ({_SQUARE.format(67891)} h5),
 k AS (SELECT * FROM h6 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY -ln((h + 0.5::DOUBLE) / 2147483647) / conf) <= {matching.N_SAMPLE}), {_PLACED}
 SELECT pair, round(coalesce(CAST(count(*) FILTER (WHERE in_ref AND in_out) AS DOUBLE) / nullif(count(*) FILTER (WHERE in_ref), 0), 0), 6) AS recall, count(*) AS n_matches, count(*) FILTER (WHERE in_ref) AS n_ref_in_fg,
 count(*) FILTER (WHERE in_ref AND in_out) AS n_both_in_fg, round(coalesce(avg(conf) FILTER (WHERE in_ref AND in_out), 0), 6) AS mean_certainty_fg FROM f GROUP BY pair"""
_RECIPROCAL = f"""WITH c AS (SELECT a.image_id AS ref, b.image_id AS out, a.patch_idx AS i, b.patch_idx AS j, round(list_cosine_similarity(a.feat, b.feat), 12) AS cos FROM v_patches a JOIN v_patches b ON a.image_id < b.image_id),
 go AS (SELECT ref, out, i, j FROM c QUALIFY row_number() OVER (PARTITION BY ref, out, i ORDER BY cos DESC, j) = 1), back AS (SELECT ref, out, j, i FROM c QUALIFY row_number() OVER (PARTITION BY ref, out, j ORDER BY cos DESC, i) = 1),
 hop AS (SELECT ref, out, go.i, j, back.i AS home FROM go JOIN back USING (ref, out, j)),
 walk AS (WITH RECURSIVE w AS (SELECT ref, out, i, j, home, 1 AS rounds FROM hop WHERE i // {GRID} % {STRIDE} = {STRIDE // 2} AND i % {GRID} % {STRIDE} = {STRIDE // 2}
   UNION SELECT h.ref, h.out, h.i, h.j, h.home, rounds + 1 FROM w JOIN hop h ON h.ref = w.ref AND h.out = w.out AND h.i = w.home WHERE w.home <> w.i AND rounds < {matching.MAX_HOPS}) SELECT * FROM w),
 m AS (SELECT ref, out, i, j, min(rounds) AS rounds FROM walk WHERE home = i GROUP BY ALL), z AS (SELECT image_id, CAST(ceil(count(*) / {GRID}::DOUBLE) AS INTEGER) AS rows FROM v_patches GROUP BY image_id),
 f AS (SELECT m.*, p.w > 0.5::DOUBLE AS in_ref, q.w > 0.5::DOUBLE AS in_out FROM m JOIN v_patches p ON p.image_id = ref AND p.patch_idx = i JOIN v_patches q ON q.image_id = out AND q.patch_idx = j JOIN z a ON a.image_id = ref JOIN z b ON b.image_id = out
   WHERE i % {GRID} BETWEEN {BORDER} AND {GRID - BORDER - 1} AND j % {GRID} BETWEEN {BORDER} AND {GRID - BORDER - 1} AND i // {GRID} BETWEEN {BORDER} AND a.rows - {BORDER + 1} AND j // {GRID} BETWEEN {BORDER} AND b.rows - {BORDER + 1})
 SELECT ref, out, round(coalesce(CAST(count(*) FILTER (WHERE in_ref AND in_out) AS DOUBLE) / nullif(count(*) FILTER (WHERE in_ref), 0), 0), 6) AS recall, count(*) FILTER (WHERE in_ref) AS n_ref_fg, count(*) FILTER (WHERE in_ref AND in_out) AS n_both_fg,
 count(*) AS n_matches, max(rounds) AS max_rounds FROM f GROUP BY ref, out"""
_AUC = """WITH s AS (SELECT score, count(*) FILTER (WHERE within) AS w, count(*) FILTER (WHERE NOT within) AS c FROM v_pairs GROUP BY score),
 u AS (SELECT w, c, coalesce(sum(c) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
 SELECT CAST(sum(w) AS BIGINT) AS n_within, CAST(sum(c) AS BIGINT) AS n_cross, round(CAST(sum(w * (below + c / 2::DOUBLE)) AS DOUBLE) / (CAST(sum(w) AS DOUBLE) * CAST(sum(c) AS DOUBLE)), 6) AS auc FROM u"""
_SEPARATION = """SELECT count(*) FILTER (WHERE within) AS n_within, count(*) FILTER (WHERE NOT within) AS n_cross,
 round(avg(score) FILTER (WHERE within), 6) AS mean_within, round(stddev_pop(score) FILTER (WHERE within), 6) AS sd_within,
 round(avg(score) FILTER (WHERE NOT within), 6) AS mean_cross, round(stddev_pop(score) FILTER (WHERE NOT within), 6) AS sd_cross,
 round(avg(score) FILTER (WHERE within) - avg(score) FILTER (WHERE NOT within), 6) AS delta,
 round((avg(score) FILTER (WHERE within) - avg(score) FILTER (WHERE NOT within)) / greatest(max(score) - min(score), 1e-12), 6) AS delta_norm FROM v_pairs"""

QUERIES = {
    f.__name__: f
    for f in (
        pair_auc_within_cross, pair_describe_separation, pair_within_theta_join, pair_cross_sample_hashed, pair_cross_unranked, pair_cross_seeded, pair_even_stride_pick, global_cosine, nn_top1_cosine, nn_mutual, cp_masked_maxcos, cp_global_maxcos,
        cp_weighted_maxcos, cp_recall_fg, cp_all_variants, cp_threshold_boundary, cp_remask_from_arrays, pool_bg_mean_cosine, pool_bg_attention_cosine, maxsim_tokens, maxsim_token_table, pf_variants, recall_sparse_points, recall_sampled_matches, recall_reciprocal_seeds,
    )
}

ORACLE_SQL = {
    "pair_auc_within_cross": sql(_AUC, "v_pairs"),
    "pair_describe_separation": sql(_SEPARATION, "v_pairs"),
    "pair_within_theta_join": """WITH p AS (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS pos FROM embeddings)
      SELECT a.label, a.vec_id AS a, b.vec_id AS b, a.pos AS i, b.pos AS j FROM p a JOIN p b ON a.label = b.label AND a.pos < b.pos""",
    "pair_cross_sample_hashed": """SELECT a.vec_id AS a, b.vec_id AS b, (a.vec_id * 7919 + b.vec_id * 104729) % 1000003 AS draw
      FROM embeddings a JOIN embeddings b ON a.label < b.label ORDER BY draw, a.vec_id, b.vec_id LIMIT 500""",
    "pair_cross_unranked": f"""WITH p AS (SELECT a.label AS label_a, a.vec_id AS a, b.label AS label_b, b.vec_id AS b, row_number() OVER (ORDER BY a.label, b.label, a.vec_id, b.vec_id) - 1 AS ordinal
      FROM embeddings a JOIN embeddings b ON a.label < b.label), n AS (SELECT count(*) AS n FROM p),
      o AS (SELECT (id * {STEP} + 17) % n AS ordinal FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS id), n)
      SELECT ordinal, label_a, a, label_b, b FROM o JOIN p USING (ordinal)""",
    "pair_even_stride_pick": """WITH p AS (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
      SELECT label, vec_id, pos FROM p WHERE list_contains(list_transform(range(0, 10), lambda i: CAST(floor(n / 10::DOUBLE * i) AS INTEGER)), pos)""",
    "global_cosine": """SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos,
      round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance,
      round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 100, 6) AS cos_x100
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "nn_top1_cosine": sql(f"WITH {NN} SELECT ref, out, ref_idx, out_idx, round(cos, 6) AS cos FROM m", "v_patches"),
    "nn_mutual": sql(f"WITH {NN} SELECT ref, out, ref_idx, out_idx, round(cos, 6) AS cos FROM m WHERE mutual", "v_patches"),
    "cp_masked_maxcos": _score_sql("masked_maxcos", "n_ref_fg_only"),
    "cp_global_maxcos": _score_sql("global_maxcos"),
    "cp_weighted_maxcos": _score_sql("weighted_maxcos", "total_ref_w"),
    "cp_recall_fg": _score_sql("recall_fg", "mean_nn_cos_fg", "n_ref_in_fg", "n_both_in_fg"),
    "cp_all_variants": _score_sql(),
    "cp_threshold_boundary": sql("SELECT image_id, count(*) FILTER (WHERE w > 0.5::DOUBLE) AS n_above, count(*) FILTER (WHERE w >= 0.5::DOUBLE) AS n_from, count(*) FILTER (WHERE w = 0.5::DOUBLE) AS n_at FROM v_patches GROUP BY image_id", "v_patches"),
    "cp_remask_from_arrays": sql(
        f"""WITH {NN}, s AS (SELECT m.ref, m.out, coalesce(avg(cos) FILTER (WHERE w_ref > 0.5::DOUBLE), 0) AS stored,
        coalesce(avg(cos) FILTER (WHERE CAST(p.vec_id * 53 % 101 AS DOUBLE) / 100.0::DOUBLE > 0.9::DOUBLE), 0) AS remasked, count(*) FILTER (WHERE CAST(p.vec_id * 53 % 101 AS DOUBLE) / 100.0::DOUBLE > 0.9::DOUBLE) AS n_fg
        FROM m JOIN v_patches p ON p.image_id = m.ref AND p.patch_idx = m.ref_idx GROUP BY m.ref, m.out)
        SELECT count(*) AS n_pairs, round(avg(stored), 6) AS mean_stored, round(avg(remasked), 6) AS mean_remasked, round(max(abs(stored - remasked)), 6) AS max_abs_deviation,
        round(100 * avg(CASE WHEN n_fg = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pct_without_fg FROM s""",
        "v_patches",
    ),
    "pool_bg_mean_cosine": sql(
        """WITH e AS (SELECT image_id, w, unnest(feat) AS v, generate_subscripts(feat, 1) AS d FROM v_patches),
        b AS (SELECT image_id, list(m ORDER BY d) AS v FROM (SELECT image_id, d, avg(v) AS m FROM e WHERE NOT w >= 0.5::DOUBLE GROUP BY image_id, d) GROUP BY image_id),
        g AS (SELECT (image_id + 9) % 10 AS image_id, list(m ORDER BY d) AS v FROM (SELECT image_id, d, avg(v) AS m FROM e GROUP BY image_id, d) GROUP BY image_id)
        SELECT b.image_id, round(list_cosine_similarity(b.v, g.v), 6) AS cos FROM b JOIN g ON b.image_id = g.image_id""",
        "v_patches",
    ),
    "pool_bg_attention_cosine": sql(_ATTENTION, "v_patches"),
    "maxsim_token_table": sql(_MAXSIM, "v_patches", "v_tokens"),
    "pf_variants": sql(_VARIANTS, "v_patches", "v_tokens"),
    "maxsim_tokens": sql(f"WITH {NN} SELECT ref, out, round(avg(cos), 6) AS maxsim, count(*) AS n_tokens FROM m WHERE ref_idx % 5 <> 0 GROUP BY ref, out", "v_patches"),
    "recall_sampled_matches": _SAMPLED,
    "recall_reciprocal_seeds": sql(_RECIPROCAL, "v_patches"),
    "recall_sparse_points": """WITH r AS (SELECT l_returnflag || l_linestatus AS pair, l_quantity AS xr, CAST(l_partkey % 70 - 3 AS DOUBLE) + 0.5::DOUBLE AS yr, CAST(l_suppkey % 67 - 1 AS DOUBLE) + 0.25::DOUBLE AS xo, l_orderkey % 61 AS yo, l_discount * 10 AS conf FROM lineitem),
      k AS (SELECT * FROM r WHERE conf >= 0.2::DOUBLE AND xr >= 3 AND xr < 61 AND yr >= 3 AND yr < 61),
      c AS (SELECT pair, least(greatest(CAST(trunc(xr) AS INTEGER), 0), 63) AS x1, least(greatest(CAST(trunc(yr) AS INTEGER), 0), 63) AS y1, least(greatest(CAST(trunc(xo) AS INTEGER), 0), 63) AS x2, least(greatest(CAST(yo AS INTEGER), 0), 63) AS y2 FROM k),
      f AS (SELECT pair, (x1 * 7 + y1 * 13 + ascii(pair)) % 10 > 4 AS in_ref, (x2 * 7 + y2 * 13 + ascii(pair)) % 10 > 4 AS in_out FROM c)
      SELECT pair, count(*) AS n_matches, count(*) FILTER (WHERE in_ref) AS n_ref_fg, count(*) FILTER (WHERE in_ref AND in_out) AS n_both_fg,
      round(CAST(count(*) FILTER (WHERE in_ref AND in_out) AS DOUBLE) / nullif(count(*) FILTER (WHERE in_ref), 0), 6) AS recall FROM f GROUP BY pair""",
}
