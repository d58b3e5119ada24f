"""The key table: one row a (method, key), a column a rater."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(scores: DataFrame, raters: list[str]) -> DataFrame:
    """(method, key, one column a rater) of the long score table; the raters are
    fixed, so the pivot is a single aggregate."""
    return scores.groupBy("method", "key").agg(*[F.max(F.when(F.col("rater") == r, F.col("value"))).alias(r) for r in raters])


def build(skeleton: DataFrame, scores: DataFrame, raters: list[str]) -> DataFrame:
    """Every skeleton row with its scores; missing ones are NULL."""
    return skeleton.join(wide(scores, raters), ["method", "key"], "left")


def merged(frames: dict[str, DataFrame], keys: list[str], value: str = "score") -> DataFrame:
    """Inner merge of one frame a metric on the pair key, done as a union and one
    aggregate: rows that lack a metric go."""
    parts = None
    for name, df in frames.items():
        one = df.select(*keys, F.lit(name).alias("_m"), F.col(value).alias("_v"))
        parts = one if parts is None else parts.unionByName(one)
    cols = [F.max(F.when(F.col("_m") == n, F.col("_v"))).alias(n) for n in frames]
    return parts.groupBy(*keys).agg(F.countDistinct("_m").alias("_n"), *cols).where(F.col("_n") == len(frames)).drop("_n")


def mean_rating(a: Column | str = "g1", b: Column | str = "g2") -> Column:
    return (F.col(a) + F.col(b)) / 2 if isinstance(a, str) else (a + b) / 2
