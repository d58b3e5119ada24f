"""Fixed record schemas, as DDL, and the contracts that frames must keep.

Missing values are NULL inside the engine; NaN is converted where it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = "concept_id STRING, prompt_id STRING, gen_method STRING, seed INT, signal STRING, model STRING, score DOUBLE, extras MAP<STRING,STRING>"
PATCH_ARRAYS = "concept_id STRING, prompt_id STRING, gen_method STRING, seed INT, ref STRING, out STRING, ref_grid ARRAY<INT>, nn_cos_per_ref STRING"
RATING = "method STRING, key STRING, rater STRING, signal STRING, value DOUBLE"
SAMPLE = "concept_id STRING, ref_image STRING, ref_mask STRING, out_image STRING, out_mask STRING, gen_method STRING, prompt_id STRING, seed INT, extras MAP<STRING,STRING>"
PATCH = "image_id STRING, patch_idx INT, gy INT, gx INT, w FLOAT, feat ARRAY<FLOAT>"
MASK = "image_id STRING, h INT, w INT, data BINARY"
TOKEN = "doc_id STRING, i INT, text STRING, ws BOOLEAN, lower STRING, lemma STRING, pos STRING, dep STRING, head INT"
RUN_META = "ts TIMESTAMP, argv STRING, config_sha256 STRING, spark_version STRING, python_version STRING, host STRING, commit STRING, extras MAP<STRING,STRING>"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


class ContractError(ValueError):
    """A frame does not keep what its readers rely on."""


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Fail on a repeated key; returns ``df``. Aggregates before it looks."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ContractError(f"repeated key: {[tuple(r[k] for k in keys) for r in twice]}")
    return df


def assert_count(df: DataFrame, expected: int) -> DataFrame:
    found = df.count()
    if found != expected:
        raise ContractError(f"{found} rows instead of {expected}")
    return df


def assert_same_count(joined: DataFrame, left: DataFrame) -> DataFrame:
    """The cardinality contract of a chain of one-to-one joins."""
    return assert_count(joined, left.count())


def assert_complete(df: DataFrame, *columns: str) -> DataFrame:
    """Fail on a null or NaN in ``columns``, before rows are rated."""
    bad = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    missing = {c: bad[c] for c in columns if bad[c]}
    if missing:
        raise ContractError(f"missing values: {missing}")
    return df
