"""Table sinks: result tables, JSON lines, key tables and benchmark rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_PARTITIONS = ("signal", "model", "gen_method")


def append_results(rows: DataFrame, path: str) -> None:
    """Append scored rows, partitioned as they are read; a failed job adds nothing."""
    rows.repartition(*RESULT_PARTITIONS).write.mode("append").partitionBy(*RESULT_PARTITIONS).parquet(path)


def json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def complete_lines(text: DataFrame) -> DataFrame:
    """Lines of a legacy log that parse; a cut-off last line goes."""
    return text.where(F.try_parse_json("value").isNotNull())


def key_table(rows: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, or one gzipped CSV with a header for other tools."""
    if csv:
        rows.coalesce(1).write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)
    else:
        rows.write.mode("overwrite").parquet(path)


#: Columns of a key table that are texts, even where they look like numbers.
KEY_TEXTS = ("method", "subject_idx", "prompt_id", "concept_id", "key", "subject", "category", "object_name", "prompt")
KEY_FLAGS = ("is_style",)


def read_key_table(spark: SparkSession, path: str) -> DataFrame:
    """A key table as ``key_table`` wrote it. In a CSV identifiers stay texts
    ("00" is no number), flags are booleans, and the rest are doubles, empty
    cells NULL; a value of another kind raises. A gzipped CSV is read by one task
    a file, and dealt out again behind it."""
    if not _is_csv(spark, path):
        return spark.read.parquet(path)
    text = spark.read.option("header", "true").csv(path)
    kind = lambda c: F.col(c) if c in KEY_TEXTS else F.col(c).cast("boolean") if c in KEY_FLAGS else F.col(c).cast("double")
    return text.select(*[kind(c).alias(c) for c in text.columns]).hint("rebalance")


def _is_csv(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s.getPath().getName() for s in fs.listStatus(where)]
    return any(f.endswith((".csv", ".csv.gz")) for f in files)


def strata_labels(rows: DataFrame, path: str) -> None:
    """Labels by id alone, without prompt texts."""
    keep = [c for c in rows.columns if c not in ("prompt", "text", "t", "name", "spans", "stripped")]
    rows.select(*keep).write.mode("overwrite").option("header", "true").csv(path)


def missing_masks(wanted: DataFrame, written: DataFrame, overwrite: bool = False) -> DataFrame:
    """Masks still to make: all, or those without a file."""
    return wanted if overwrite else wanted.join(written.select("path").distinct(), "path", "left_anti")


def bench_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
