"""Score logs: JSON lines of results and their patch-array sidecars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agreemill.functions.numbers import not_nan
from agreemill.functions.text import key_of
from agreemill.schema import PATCH_ARRAYS, RESULT, struct

#: Fixed value: a matcher is complete when all methods have rows.
N_METHODS = 7


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths (or globs) that match a file, asked of their own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        if found is not None and len(found):
            out.append(p)
    return out


def json_lines(spark: SparkSession, paths: str | list[str], schema: str = RESULT, strict: bool = False) -> DataFrame:
    """Rows of JSON-lines files.

    Tolerant: missing files give no rows; blank lines and lines that don't parse
    (cut off by a killed job) are skipped. Strict: a broken line raises.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    found = _existing(spark, paths)
    if not found:
        return spark.createDataFrame([], struct(schema))
    broken = struct(schema).add("_corrupt_record", "string")
    lines = spark.read.text(found).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", broken, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def results(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """Result rows, NaN scores as NULL."""
    return json_lines(spark, paths, RESULT, strict).withColumn("score", not_nan("score"))


def last_wins(rows: DataFrame, keys: list[str], order: Column, drop_missing: str | None = None) -> DataFrame:
    """One row a key, the latest; optionally without rows whose score is missing."""
    if drop_missing:
        rows = rows.where(not_nan(drop_missing).isNotNull())
    others = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_last"))
    return latest.select(*keys, *[F.col("_last")[c].alias(c) for c in others]).select(*rows.columns)


def score_map(rows: DataFrame, order: Column) -> DataFrame:
    """(method, key, value): the last score of each key, missing ones dropped."""
    keyed = rows.select(F.col("gen_method").alias("method"), key_of("concept_id", "prompt_id").alias("key"), F.col("score").alias("value"), order.alias("_order"))
    return last_wins(keyed, ["method", "key"], F.col("_order"), "value").drop("_order")


def scores_by_kind(scores: DataFrame, rater: str) -> DataFrame:
    """The rows of one source of the long score table."""
    return scores.where(F.col("rater") == rater)


def complete_raters(scores: DataFrame, methods: int = N_METHODS) -> DataFrame:
    """Raters that have rows for every method."""
    return scores.groupBy("rater").agg(F.countDistinct("method").alias("n")).where(F.col("n") == methods).select("rater")


def capped(rows: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """The first ``n`` samples in their order."""
    return rows.orderBy(order).limit(n)


def float_arrays(encoded: Column) -> Column:
    """array<float> of base64 little-endian float32."""

    @F.arrow_udf("array<float>")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if b is None else np.frombuffer(b, "<f4") for b in batch.to_pylist()], pa.list_(pa.float32()))

    return decode(F.unbase64(encoded))


def patch_arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sidecar rows with their nearest cosines decoded."""
    return json_lines(spark, paths, PATCH_ARRAYS).withColumn("nn_cos_per_ref", float_arrays(F.col("nn_cos_per_ref")))


def incomplete_arrays(done: DataFrame, arrays: DataFrame, keys: list[str]) -> DataFrame:
    """Finished results without a sidecar row: a resumed run must score them again."""
    return done.join(arrays.select(*keys).distinct(), keys, "left_anti")


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in a documented order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
