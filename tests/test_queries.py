"""Every registered query runs; those with SQL equal DuckDB's answer."""

from __future__ import annotations

import ast
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from agreemill.plans import registry

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the provided tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    text = registry.oracle_sql().get(name)
    if text:
        rel = duck.sql(text)
        columns = sorted(rel.columns)
        assert sorted(df.columns) == columns
        expected = rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == sorted((tuple(plain(v) for v in r) for r in expected), key=repr)


def test_entry(spark):
    assert entry.entry(spark).collect()[0]["n_cross"] > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["boot_key_alpha_rho", "pair_auc_within_cross", "rating_cell_stats"])
def test_results_do_not_depend_on_partitions(spark, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(repr([plain(v) for v in r]) for r in registry.queries()[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_auc_intervals_cover_all_pairs(spark):
    whole = registry.queries()["pair_auc_within_cross"](spark, SF).first()["auc"]
    found = {r["label"]: r for r in registry.queries()["boot_auc"](spark, SF).collect()}
    assert abs(found["score"]["point"] - whole) < 1e-6 and found["score"]["lo"] < whole < found["score"]["hi"]
    assert found["rounded"]["lo"] < found["rounded"]["point"] < found["rounded"]["hi"]


def test_nothing_else_imports_the_training_data_operators():
    for path in [*ROOT.glob("agreemill/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("agreemill.llm", "corpus_pipeline")) for n in names), path


def test_native_queries_have_no_python(spark):
    for name in ("rating_kd_continuous", "rating_spearman", "keyset_nway", "filter_threshold_sweep", "strip_subject_regex", "resume_antijoin", "pool_bg_mean_cosine"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("ArrowEval", "BatchEval", "MapInArrow", "MapInPandas", "Cartesian")), name
