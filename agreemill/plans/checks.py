"""Checks of computed cells against printed numbers."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.functions.numbers import python_format


def expected(spark: SparkSession, path: str) -> DataFrame:
    """Printed numbers from a CSV of (name, paper, digits, tol)."""
    return spark.read.schema("name STRING, paper DOUBLE, digits INT, tol DOUBLE").option("header", "true").csv(path)


EXPECTED = Path(__file__).resolve().parent.parent / "expected"


def shipped(spark: SparkSession, name: str) -> DataFrame:
    """A shipped table of printed numbers: cp_alpha, pf_alpha or pair_auc. They
    need the published images and models; nothing here computes their left side."""
    path = EXPECTED / f"{name}.csv"
    if not path.exists():
        raise ValueError(f"no expected table {name!r}; known: {', '.join(sorted(p.stem for p in EXPECTED.glob('*.csv')))}")
    with path.open(newline="") as f:
        rows = [(r["name"], float(r["paper"]), int(r["digits"]), float(r["tol"]) if r["tol"] else None) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "name STRING, paper DOUBLE, digits INT, tol DOUBLE")


def against(ours: DataFrame, printed: DataFrame) -> DataFrame:
    """Cells to check: (name, ours) joined with the printed numbers."""
    return ours.join(printed, "name", "inner").select("name", "ours", "paper", "digits", "tol")


def checked(cells: DataFrame) -> DataFrame:
    """Add ``ok`` and ``same_print`` to (name, ours, paper, digits, tol).

    With a tolerance: within it and a thousandth of the last digit; without: the
    same text at the printed digits, as Python formats it.
    """
    same = python_format(F.col("ours"), F.col("digits")) == python_format(F.col("paper"), F.col("digits"))
    near = F.abs(F.col("ours") - F.col("paper")) <= F.col("tol") + F.pow(F.lit(10.0), -(F.col("digits") + 3))
    return cells.withColumn("same_print", same).withColumn("ok", F.when(F.col("tol").isNotNull(), near).otherwise(F.col("same_print")))


def mismatches(checks: DataFrame) -> DataFrame:
    return checks.where(~F.coalesce("ok", F.lit(False)))


def within_tolerance(checks: DataFrame) -> DataFrame:
    return checks.where(F.col("tol").isNotNull() & F.col("ok") & ~F.col("same_print"))


def without_intervals(cells: DataFrame, replicates: int, printed: int = 10_000) -> DataFrame:
    """Interval cells count only with as many replicates as were printed."""
    return cells if replicates == printed else cells.where(~F.endswith("name", F.lit(" lo")) & ~F.endswith("name", F.lit(" hi")))


def exit_code(checks: DataFrame) -> int:
    return int(bool(mismatches(checks).head(1)))
