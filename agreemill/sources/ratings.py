"""Rating maps: JSON objects {key: 0-4}, one file a method, signal and rater."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.functions.numbers import not_nan
from agreemill.sources.results import _existing

FILE = r"([^/]+)_([^/_]+)_([^/_]+)\.json$"


def ratings(spark: SparkSession, paths: str | list[str], pattern: str = FILE, strict: bool = False) -> DataFrame:
    """(method, key, rater, signal, value).

    ``pattern`` takes method, signal and rater from the path. Missing files give
    no rows unless ``strict``.
    """
    paths = [paths] if isinstance(paths, str) else paths
    found = paths if strict else _existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "method STRING, key STRING, rater STRING, signal STRING, value DOUBLE")
    text = spark.read.text(found, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    part = [F.regexp_extract("path", pattern, i) for i in (1, 2, 3)]
    parsed = text.select(part[0].alias("method"), part[1].alias("signal"), part[2].alias("rater"), F.from_json("value", "map<string,double>").alias("m"))
    rows = parsed.select("method", "signal", "rater", F.explode("m").alias("key", "value"))
    return rows.select("method", "key", "rater", "signal", not_nan("value").alias("value"))


#: Where shipped scores of a method lie below a root: a scorer's folder, a judge's
#: variants, a group of people. ``{0}`` and ``{1}`` are the reader's arguments.
LAYOUTS = {"scorer": "{0}/*{1}.json", "judge": "data_gpt_rating/{0}/*.json", "group": "{0}/*-cp.json"}


def shipped(spark: SparkSession, root: str, kind: str, name: str, suffix: str = "", rater: str | None = None) -> DataFrame:
    """(method, key, rater, value) of one shipped source, a JSON object a method;
    a missing folder gives no rows.

    ``scorer``: ``name`` is a folder and ``suffix`` picks a version of its files
    (without one, files of a version ``_v2`` and the like are left out);
    ``judge``: a variant of the judge's prompts; ``group``: a group of raters.
    """
    if kind not in LAYOUTS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(LAYOUTS)}")
    end = {"scorer": suffix, "judge": "", "group": "-cp"}[kind]
    rows = ratings(spark, f"{root.rstrip('/')}/{LAYOUTS[kind].format(name, suffix)}", pattern=rf"([^/]+?){re.escape(end)}()()\.json$")
    if kind == "scorer" and not suffix:
        rows = rows.where(~F.regexp_like("method", F.lit(r"_v\d+$")))
    return rows.select("method", "key", F.lit(rater or name).alias("rater"), "value")
