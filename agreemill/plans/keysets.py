"""Matched key sets: the keys that every rater of a set has scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agreemill.functions.numbers import known


def covering(scores: DataFrame, n_methods: int) -> DataFrame:
    """Raters with rows in all methods."""
    return scores.groupBy("rater").agg(F.countDistinct("method").alias("n_methods")).where(F.col("n_methods") == n_methods).select("rater")


def common_keys(scores: DataFrame, raters: DataFrame) -> DataFrame:
    """(method, key) that every one of ``raters`` has, counted once each.

    The raters, few names, are one row that every task has: a join on the rater
    would deal all scores to as many tasks as there are raters.
    """
    names = raters.agg(F.collect_set("rater").alias("_raters"))
    wanted = scores.crossJoin(F.broadcast(names)).where(F.array_contains("_raters", F.col("rater")))
    sized = wanted.groupBy("method", "key").agg(F.countDistinct("rater").alias("n"), F.first(F.size("_raters")).alias("_n_raters"))
    return sized.where(F.col("n") == F.col("_n_raters")).select("method", "key")


def present_keys(scores: DataFrame) -> DataFrame:
    """(method, key) with a finite score of every rater present in the method."""
    finite = scores.withColumn("ok", known("value").isNotNull())
    there = finite.groupBy("method").agg(F.countDistinct("rater").alias("n_raters"))
    have = finite.where("ok").groupBy("method", "key").agg(F.countDistinct("rater").alias("n"))
    return have.join(there, "method").where("n = n_raters").select("method", "key")


def restricted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, ["method", "key"], "left_semi")
