"""The evaluation views over the provided tables, in DataFrames and in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agreemill.functions.numbers import clip
from agreemill.sources.tokens import part_tokens_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, patch_idx, w, feat, vec_id): a label is an image."""
    w = Window.partitionBy("label").orderBy("vec_id")
    weight = (F.col("vec_id") * 37 % 101) / 100.0
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), (F.row_number().over(w) - 1).alias("patch_idx"), weight.alias("w"), F.col("embedding").alias("feat"), "vec_id")


def image_pairs(patch_rows: DataFrame) -> DataFrame:
    """(ref, out) of all images, ref < out."""
    ids = patch_rows.select("image_id").distinct()
    return ids.withColumnRenamed("image_id", "ref").join(ids.withColumnRenamed("image_id", "out"), F.col("ref") < F.col("out"))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated rows: method, key, two human groups, a score, a judge, mask shares, subject."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    g1 = (k * 7 % 5).cast("double")
    g2 = clip(g1 + (c % 3) - 1, 0.0, 4.0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("method"), k.alias("key"), g1.alias("g1"), g2.alias("g2"), F.col("o_totalprice").alias("x"), clip(g2 + (k % 3) - 1, 0.0, 4.0).alias("judge"),
        ((c % 101) / 100.0).alias("fg_ref"), ((k % 97) / 96.0).alias("fg_out"), (c % 60).alias("subject"),
    )


def long_scores(rows: DataFrame) -> DataFrame:
    """(method, key, rater, value): the raters of ``rated`` in long form.

    Raters a, b and c miss the keys divisible by 5, 7 and 11.
    """
    raters = F.array(*[F.struct(F.lit(n).alias("rater"), v.alias("value"), keep.alias("keep")) for n, v, keep in (("g1", F.col("g1"), F.lit(True)), ("g2", F.col("g2"), F.lit(True)), ("a", F.col("x"), F.col("key") % 5 != 0), ("b", F.col("judge"), F.col("key") % 7 != 0), ("c", F.col("x") / 2 + F.col("g1"), F.col("key") % 11 != 0))])
    return rows.select("method", "key", F.inline(raters)).where("keep").drop("keep")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("A photo of a "), name, F.lit(" on a desk")).alias("prompt"), F.coalesce(F.get(F.split(name, " "), F.lit(1)), F.lit("")).alias("object_name"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("pool"), F.col("l_linestatus").alias("prompt"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("rating"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, token_idx, token_id, feat): ten vectors are a text. Ids 0 and 1
    (padding, end) are special; the texts divisible by 17 hold nothing else."""
    v = F.col("vec_id")
    text = F.floor(v / 10)
    ids = F.when((text % 17 == 0) | (v % 10 > 4 + text % 6), v % 2).otherwise(2 + v % 97)
    return table(spark, sf_dir, "embeddings").select(text.alias("text_id"), (v % 10).cast("int").alias("token_idx"), ids.cast("int").alias("token_id"), F.col("embedding").alias("feat"))


def weights(rows: int, columns: int, salt: int) -> np.ndarray:
    """A matrix by rule, for layers whose trained weights are the caller's."""
    i, j = np.indices((rows, columns))
    return ((i * 31 + j * 17 + salt * 13) % 29 - 14) / 64.0


#: The same views for the SQL side.
SQL = {
    "v_patches": """SELECT label AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS patch_idx,
      CAST(vec_id * 37 % 101 AS DOUBLE) / 100.0::DOUBLE AS w, embedding::DOUBLE[] AS feat, vec_id FROM embeddings""",
    "v_pairs": """SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS within,
      round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""",
    "v_rated": """SELECT method, key, g1, g2, x, CAST(least(greatest(g2 + key % 3 - 1, 0), 4) AS DOUBLE) AS judge, fg_ref, fg_out, subject FROM (
      SELECT o_orderpriority AS method, o_orderkey AS key, CAST(o_orderkey * 7 % 5 AS DOUBLE) AS g1,
      CAST(least(greatest(o_orderkey * 7 % 5 + o_custkey % 3 - 1, 0), 4) AS DOUBLE) AS g2, o_totalprice AS x,
      CAST(o_custkey % 101 AS DOUBLE) / 100.0::DOUBLE AS fg_ref, CAST(o_orderkey % 97 AS DOUBLE) / 96.0::DOUBLE AS fg_out, o_custkey % 60 AS subject FROM orders)""",
    "v_long": """SELECT method, key, 'g1' AS rater, g1 AS value FROM v_rated UNION ALL SELECT method, key, 'g2', g2 FROM v_rated
      UNION ALL SELECT method, key, 'a', x FROM v_rated WHERE key % 5 <> 0 UNION ALL SELECT method, key, 'b', judge FROM v_rated WHERE key % 7 <> 0
      UNION ALL SELECT method, key, 'c', x / 2 + g1 FROM v_rated WHERE key % 11 <> 0""",
    "v_tokens": """SELECT vec_id // 10 AS text_id, CAST(vec_id % 10 AS INTEGER) AS token_idx,
      CAST(CASE WHEN vec_id // 10 % 17 = 0 OR vec_id % 10 > 4 + vec_id // 10 % 6 THEN vec_id % 2 ELSE 2 + vec_id % 97 END AS INTEGER) AS token_id, embedding::DOUBLE[] AS feat FROM embeddings""",
    "v_prompts": """SELECT p_partkey AS id, 'A photo of a ' || p_name || ' on a desk' AS prompt, split_part(p_name, ' ', 2) AS object_name FROM part""",
    "v_parsed": part_tokens_sql(0),
    "v_names": part_tokens_sql(1),
    "v_cells": """SELECT l_returnflag AS pool, l_linestatus AS prompt, l_extendedprice AS score, l_quantity AS rating FROM lineitem""",
}


def sql(body: str, *views: str) -> str:
    """``body`` after the definitions of the views it names."""
    names = [v for v in SQL if v in views]
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in names)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
