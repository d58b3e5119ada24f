"""Numeric column functions with the division, rounding and NaN rules fixed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x: Column | str) -> Column:
    """NaN and infinities as NULL."""
    x = c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def not_nan(x: Column | str) -> Column:
    return F.nanvl(c(x).cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, NULL where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def r6(x: Column) -> Column:
    """Published precision; negative zero becomes zero."""
    return F.round(x, 6) + F.lit(0.0)


def min_max(x: Column, low: Column, high: Column) -> Column:
    return ratio(x - low, high - low)


def python_round(x: Column, digits: int) -> Column:
    """Python's round, which looks at the exact binary value. For small result
    frames only: it leaves the JVM."""

    @F.arrow_udf("double")
    def rounded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if v is None else round(v, digits) for v in batch.to_pylist()], pa.float64())

    return rounded(x)


def python_format(x: Column, digits: Column) -> Column:
    """Python's fixed-point format; NULL stays NULL. For small result frames."""

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values, places in batches:
            yield pa.array([None if v is None or d is None else f"{v:.{d}f}" for v, d in zip(values.to_pylist(), places.to_pylist(), strict=True)], pa.string())

    return text(x, digits)
