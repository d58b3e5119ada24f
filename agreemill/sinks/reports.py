"""Reports of small result frames, and run records.

Frames are bounded by ``MAX_REPORT_ROWS``; anything larger is written by Spark.
"""

from __future__ import annotations

import hashlib
import json
import math
import platform
import subprocess
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.schema import RUN_META, struct

MAX_REPORT_ROWS = 10_000


def rows_of(df: DataFrame) -> list[dict]:
    found = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(found) > MAX_REPORT_ROWS:
        raise ValueError(f"a report has at most {MAX_REPORT_ROWS} rows; write the frame instead")
    return [r.asDict(recursive=True) for r in found]


def plain(value: object) -> object:
    """Values as JSON has them; NaN and infinities as null."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value


def json_report(data: object, path: str) -> None:
    Path(path).write_text(json.dumps(plain(data), indent=1, ensure_ascii=False, default=str) + "\n")


def _cell(value: object, digits: int) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "---"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, digits: int = 3) -> str:
    rows = rows_of(df)
    body = [" | ".join(_cell(r[c], digits) for c in df.columns) for r in rows]
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *[f"| {b} |" for b in body]]) + "\n"


def latex(df: DataFrame, digits: int = 3) -> str:
    """A tabular; minus signs in math mode, missing values as dashes."""
    rows = [" & ".join(_cell(r[c], digits).replace("-", "$-$") if isinstance(r[c], float) and _cell(r[c], digits) != "---" else _cell(r[c], digits) for c in df.columns) for r in rows_of(df)]
    lines = "".join(f"{r} \\\\\n" for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(df.columns)} \\\\\n{lines}\\end{{tabular}}\n"


def fixed_width(df: DataFrame, digits: int = 3) -> str:
    rows = [[_cell(r[c], digits) for c in df.columns] for r in rows_of(df)]
    widths = [max(map(len, col)) for col in zip(df.columns, *rows, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, *rows]) + "\n"


def with_interval(point: float, lo: float, hi: float, digits: int = 3) -> str:
    return f"{point:+.{digits}f} [{lo:+.{digits}f}, {hi:+.{digits}f}]"


def commit_id() -> str:
    """The commit of the code that runs, empty outside a checkout."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return ""


def run_record(spark: SparkSession, config: str = "", **extras: str) -> DataFrame:
    """One row that says what ran: time, arguments, config digest, versions, host,
    commit."""
    row = (datetime.now(UTC).replace(tzinfo=None), " ".join(sys.argv), hashlib.sha256(config.encode()).hexdigest(), spark.version, platform.python_version(), platform.node(), commit_id(), {k: str(v) for k, v in extras.items()})
    return spark.createDataFrame([row], struct(RUN_META))


def non_null_counts(df: DataFrame) -> DataFrame:
    """(column, n): values present in each column, one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in df.columns])).alias("r")).select("r.*")
