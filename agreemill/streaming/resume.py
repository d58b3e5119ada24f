"""Resumable scoring: batch as an anti-join, streams as keyed de-duplication.

Both give the same rows: every key once, its first occurrence, and none that an
earlier run finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESUME_KEY = ("concept_id", "prompt_id", "gen_method", "seed", "ref", "out")


def not_done(samples: DataFrame, done: DataFrame, keys: tuple[str, ...] = RESUME_KEY) -> DataFrame:
    """Samples that have no finished row; NULL keys equal each other."""
    d = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same: Column = F.lit(True)
    for k in keys:
        same = same & samples[k].eqNullSafe(d[f"_{k}"])
    return samples.join(d, same, "left_anti")


def score_missing(samples: DataFrame, done: DataFrame, score: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = RESUME_KEY) -> DataFrame:
    """Drop what is done before the costly part runs."""
    return score(not_done(samples, done, keys))


def result_stream(spark: SparkSession, path: str, schema: str, watermark: str = "1 day", event_time: str = "ts", keys: tuple[str, ...] = ("event_key",), max_files: int = 100) -> DataFrame:
    """New result files as they come, each key once within the watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    rows = rows.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return rows.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))


def append_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A checkpointed append: restarts continue where the last commit ended."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_scores(rows: DataFrame, event_time: str, key: str, value: str, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Running counts and means of scores by window; late rows count until the watermark."""
    w = F.window(event_time, window)
    return rows.withWatermark(event_time, watermark).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")
