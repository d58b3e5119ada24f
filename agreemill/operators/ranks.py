"""Ranks and cumulative counts over distributed frames.

Rows are first counted by value, so ties cost nothing. Counts are dealt to
buckets by range, once; each bucket adds up its own rows in order, and what lies
in the buckets before it is one row a bucket. No task sees more than a bucket,
whatever the size of a group, and buckets grow with the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agreemill.session import kept

MIN_BUCKETS, MAX_BUCKETS = 8, 4096
_BEFORE = (Window.unboundedPreceding, -1)


def bucket_count(df: DataFrame) -> int:
    """A few buckets for each shuffle partition, within bounds."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 2 * partitions))


def bucketed_totals(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket`` and ``<sum>_below``, the total over smaller values of the
    same group in the same bucket. Buckets are in order of (by, value).

    ``counts`` has one row a distinct (by, value).
    """
    by = by or []
    ranged = counts.repartitionByRange(buckets or bucket_count(counts), *by, value).withColumn("_bucket", F.spark_partition_id())
    inside = Window.partitionBy("_bucket", *by).orderBy(value).rowsBetween(*_BEFORE)
    return ranged.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"{s}_below") for s in sums])


def running_totals(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``<sum>_below``: the total of each of ``sums`` over smaller values.

    ``counts`` has one row a distinct (by, value). The rows with their buckets'
    totals are written once, since a second dealing might draw other borders.
    What is sent to the tasks is one row a bucket and group that meet.
    """
    by = by or []
    local = kept(bucketed_totals(counts, value, sums, by, buckets))
    totals = local.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    over = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(*_BEFORE)
    bases = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_{s}").over(over), F.lit(0)).alias(f"_{s}") for s in sums])
    joined = local.join(bases, [*by, "_bucket"])
    return joined.select(*counts.columns, *[(F.col(f"{s}_below") + F.col(f"_{s}")).alias(f"{s}_below") for s in sums])


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, n, rank): the average rank of each distinct value; rows
    without a value go."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running_totals(counts, value, ["n"], by).select(*by, value, "n", (F.col("n_below") + (F.col("n") + 1) / 2.0).alias("rank"))


def with_ranks(df: DataFrame, names: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Every row with the average ranks of its values, ``names`` being column ->
    name of its rank; rows without a value go. All columns are ranked in one pass
    over the counts of (column, value)."""
    by = by or []
    each = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in names])
    ranks = average_ranks(df.select(*by, F.inline(each)), "_value", [*by, "_column"])
    for column, name in names.items():
        own = ranks.where(F.col("_column") == column).select(*by, F.col("_value"), F.col("rank").alias(name))
        df = df.withColumn("_value", F.col(column).cast("double")).join(own, [*by, "_value"]).drop("_value")
    return df


def with_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Every row with the average rank of its value; rows without a value go."""
    return with_ranks(df, {value: name}, by)


def positions(df: DataFrame, group: str, order: str) -> DataFrame:
    """Add ``pos``, a row's position from 0 in its group by a distinct ``order``,
    and ``size``, the rows of the group. No group is ordered in one task."""
    marked = running_totals(df.select("*", F.lit(1).alias("_one")), order, ["_one"], [group])
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    return marked.join(sizes, group).select(*df.columns, F.col("_one_below").alias("pos"), "size")


def pooled(df: DataFrame, by: str, label: str = "ALL") -> DataFrame:
    """Each row twice: under its own group and under the pooled one, so that
    ranks and ranges are found anew on the pool."""
    return df.withColumn(by, F.explode(F.array(F.col(by), F.lit(label))))
