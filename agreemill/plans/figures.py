"""Frames behind figures: what a plot draws, small enough to hand to one.

Each is a grouped aggregate or a ranked pick; drawing is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heat_grid(rows: DataFrame, down: str, across: str, value: str) -> DataFrame:
    """(down, across, n, mean): the cells of a heat map; cells without rows are
    there with n = 0."""
    cells = rows.groupBy(down, across).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    every = rows.select(down).distinct().join(rows.select(across).distinct())
    return every.join(cells, [down, across], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bars(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, sd, se): bars with their whiskers."""
    v = F.col(value).cast("double")
    out = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    return out.withColumn("se", F.col("sd") / F.sqrt("n"))


def violins(rows: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, left, n, share, median): the outline of a violin over equal bins;
    values outside are in the first or last one."""
    v = F.col(value).cast("double")
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((v - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = rows.where(v.isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    whole = rows.groupBy(*by).agg(F.count(v).alias("_all"), F.median(v).alias("median"))
    out = counts.join(whole, by)
    return out.select(*by, "bin", (F.lit(low) + F.col("bin") * width).alias("left"), "n", (F.col("n") / F.col("_all")).alias("share"), "median")


def contact_sheet(rows: DataFrame, by: str, order: Column, ids: list[str], k: int) -> DataFrame:
    """(by, place, ids): the first ``k`` rows of each group, as a sheet shows them."""
    w = Window.partitionBy(by).orderBy(order, *ids)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(by, "place", *ids)
