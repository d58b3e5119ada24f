"""Conditions on the key table: mask-area filters and empty-mask rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreemill.functions.numbers import ratio
from agreemill.operators.stats import spearman

THRESHOLDS = (0.0, 0.025, 0.05, 0.10)


def retained(t: float) -> Column:
    """Both mask shares above t; a missing share fails."""
    return F.coalesce((F.col("fg_ref") > t) & (F.col("fg_out") > t), F.lit(False))


def rated_on_both(df: DataFrame) -> DataFrame:
    return df.where(F.col("g1").isNotNull() & F.col("g2").isNotNull())


def valid_reference(df: DataFrame, count: str = "n_ref_fg_patches") -> DataFrame:
    return df.where(F.col(count) > 0)


def scale_minimum(df: DataFrame, continuous: list[str], ordinal: list[str]) -> DataFrame:
    """Rows with an empty mask score the least: 0 on ordinal scales, else the
    minimum over the others."""
    empty = ~retained(0.0)
    low = df.agg(*[F.min(F.when(~empty, F.col(c))).alias(f"_{c}") for c in continuous])
    out = df.crossJoin(F.broadcast(low))
    for c in continuous:
        out = out.withColumn(c, F.when(empty, F.col(f"_{c}")).otherwise(F.col(c)))
    for c in ordinal:
        out = out.withColumn(c, F.when(empty, F.lit(0.0)).otherwise(F.col(c)))
    return out.select(*df.columns)


def raw_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    empty = ~retained(0.0)
    for c in columns:
        df = df.withColumn(c, F.when(empty, F.lit(0.0)).otherwise(F.col(c)))
    return df


def at_thresholds(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Each row under every threshold that keeps it, in one pass."""
    each = F.array(*[F.when(retained(t), F.lit(t)) for t in thresholds])
    return df.withColumn("t", F.explode(F.array_compact(each)))


def fate(t: float) -> Column:
    """ref, out or kept: which side's mask drops a row, the reference's first."""
    ref = F.coalesce(F.col("fg_ref") > t, F.lit(False))
    out = F.coalesce(F.col("fg_out") > t, F.lit(False))
    return F.when(~ref, F.lit("ref")).when(~out, F.lit("out")).otherwise(F.lit("kept"))


def audit(df: DataFrame, t: float = 0.05, high: float = 3.0) -> DataFrame:
    """One row: what a mask-area filter drops on either side, how the kept and the
    dropped were rated (mean of g1 and g2), and how the output's area goes with
    the rating where the reference is kept."""
    rows = df.withColumn("_h", (F.col("g1") + F.col("g2")) / 2).withColumn("_fate", fate(t))
    f, h = F.col("_fate"), F.col("_h")
    rated = h.isNotNull()
    counts = rows.agg(
        F.count_if(f == "ref").alias("n_ref_side"), F.count_if(f == "out").alias("n_out_side"), F.avg(F.when(f == "kept", h)).alias("mean_kept"), F.avg(F.when(f != "kept", h)).alias("mean_dropped"), F.avg(F.when(f == "out", h)).alias("mean_out_side"),
        (100 * ratio(F.count_if((f == "out") & (h >= high)), F.count_if(rated))).alias("pct_out_side_high"),
    )
    rho = spearman(rows.where((f != "ref") & rated & F.col("fg_out").isNotNull()), "fg_out", "_h", name="rho_out_area").select("rho_out_area")
    return counts.crossJoin(F.broadcast(rho))
