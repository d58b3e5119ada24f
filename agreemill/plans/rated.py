"""Whole analyses of a rated table: points, intervals, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.functions.numbers import python_round
from agreemill.operators import blocks, resample, stats


def rated(spark: SparkSession, df: DataFrame, rows: dict[str, bool], table_id: str, replicates: int = 10_000, compare: list[tuple[str, str]] | None = None, cluster: str | None = None) -> dict[str, DataFrame]:
    """Frames ``intervals``, ``points`` and, if asked for, ``comparisons`` and
    ``cluster_intervals``.

    ``df``: row_idx, g1, g2 and one column a row label (``rows``: label ->
    ordinal); ``cluster`` names the column of the cluster bootstrap.
    """
    reps = blocks.replicates(df, rows, table_id, replicates).persist()
    out = {"intervals": resample.intervals(reps), "points": paper_points(df, rows)}
    if compare:
        parts = [resample.differences(reps, a, b) for a, b in compare]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        out["comparisons"] = whole
    if cluster:
        out["cluster_intervals"] = resample.intervals(blocks.replicates(df, rows, table_id, replicates, cluster))
        out["n_clusters"] = df.agg(F.countDistinct(cluster).alias("n_clusters"))
    return out


def paper_points(df: DataFrame, rows: dict[str, bool]) -> DataFrame:
    """(label, alpha, alpha_paper): Kd of each row, and as printed."""
    cols = []
    for name, ordinal in rows.items():
        one = (lambda g, n=name: stats.alpha(n, g)) if ordinal else (lambda g, n=name: stats.alpha_scaled(n, g))
        cols.append(F.struct(F.lit(name).alias("label"), one("g1").alias("a1"), one("g2").alias("a2")))
    flat = df.agg(F.array(*cols).alias("r")).select(F.inline("r"))
    rounded = flat.select("label", ((F.col("a1") + F.col("a2")) / 2).alias("alpha"), python_round(F.col("a1"), 3).alias("p1"), python_round(F.col("a2"), 3).alias("p2"))
    return rounded.select("label", "alpha", python_round((F.col("p1") + F.col("p2")) / 2, 3).alias("alpha_paper"))


def lookup(comparisons: DataFrame, a: str, b: str, stat: str) -> DataFrame:
    return comparisons.where((F.col("a") == a) & (F.col("b") == b) & (F.col("stat") == stat))


def report_order(df: DataFrame, by: str = "alpha") -> DataFrame:
    """Best first, missing last."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[c for c in df.columns if c != by][:1])
