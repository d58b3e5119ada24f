"""Quality rules against a slow form, cross-document lines, and edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from agreemill.llm import quality

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def norm(line):
    return " ".join(WORD.findall(re.sub(r"\d", "0", line.lower())))


def slow_kept(rows, least=20, share=2, left=50):
    hosts, lines = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host or ""].add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                lines[host or "", norm(line)].add(text or "")
    out = []
    for i, text, host in rows:
        base = slow_base(text)
        removed = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if norm(x) and len(docs := lines[host or "", norm(x)]) > least and 100 * len(docs) > share * len(hosts[host or ""]))
        rest = base[0] - removed
        out.append((i, *base, not base[5] and rest >= 50 and 100 * rest >= left * base[0], removed))
    return sorted(out, key=repr)


def judged(spark, rows, **limits):
    out = quality.judged(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("source"), **limits)
    return sorted((tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words").collect()), key=repr)


def prose(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randint(0, 999)) for _ in range(n))


def test_equals_slow_form(spark):
    rng = random.Random(5)
    menu, terms = "Home | About | Page 17", prose(rng, 60)
    rows = []
    for i in range(160):
        host = ["a", "a", "b", None][i % 4]
        lines = [prose(rng, rng.choice([5, 40, 80])) for _ in range(rng.randint(0, 4))]
        if i % 2:
            lines.insert(0, menu.replace("17", str(i)))
        if i % 3 == 0:
            lines.append(terms)
        if i % 7 == 0:
            lines += [lines[0]] * 2 if lines else []
        rows.append((i, rng.choice(["\n", "\n\n", " \n\t"]).join(lines), host))
    rows += [(200 + i, rows[3][1], "a") for i in range(30)]  # copies don't make their lines frequent
    found = judged(spark, rows, least=10)
    assert found == slow_kept(rows, least=10)
    assert {r[7] for r in found} == {True, False} and any(r[8] and r[7] for r in found)


def test_words_windows_and_symbols(spark):
    texts = ["a b c a b c", "a a a a", "x y", "", None, " \t\n\x0b\f\r", "   x\u0085y", "a#*$%&|<>\U0001f600 b", "one\none\n \none", "a b c d a b c e a b c", "\n\n", "a\nb\r\na\nb"]
    rows = [(i, t, "h") for i, t in enumerate(texts)]
    assert judged(spark, rows) == slow_kept(rows)


def test_very_long_text(spark):
    rng = random.Random(1)
    long = "\n".join(prose(rng, 12) for _ in range(9000)) + "\n" + " ".join(["same words again"] * 9000)
    rows = [(1, long, "h"), (2, "x" * 2_000_000, "h"), (3, "\n".join(["y"] * 50_000), "h")]
    assert judged(spark, rows) == slow_kept(rows)


def test_frequent_lines_need_other_documents_and_their_own_host(spark):
    rng = random.Random(2)
    banner = prose(rng, 30)
    rows = [(i, prose(rng, 70) + "\n" + banner, "news") for i in range(30)] + [(100, prose(rng, 70) + "\n" + banner, "other"), (101, prose(rng, 20) + "\n" + banner.upper() + "\n" + banner, "news"), (102, prose(rng, 20) + "\n" + banner + " " + prose(rng, 10), "other")]
    found = {r[0]: r for r in judged(spark, rows)}
    assert all(found[i][7] and found[i][8] == 30 for i in range(30))
    assert found[100][7] and found[100][8] == 0  # the line is rare on this host
    assert not found[101][6] and not found[101][7] and found[101][8] == 60  # depleted
    assert found[102][7]


def test_cleaned_texts_keep_columns(spark):
    rng = random.Random(3)
    banner = "Subscribe  to our NEWSLETTER 12"
    bodies = [prose(rng, 60) for _ in range(40)]
    rows = [(i, f"{banner.lower()}\n{b}\n\n{banner.replace('12', '99')}", "h", "k", 1, "x", "r") for i, b in enumerate(bodies)] + [(50, bodies[0] + "\r\nlast ", "h", "k", 1, "x", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, n_words int, host string, removed string")
    out = quality.cleaned(docs, F.col("source"))
    assert out.dtypes == docs.dtypes
    texts = {r["doc_id"]: r for r in out.collect()}
    assert len(texts) == 41 and all(texts[i]["text"] == b + "\n" for i, b in enumerate(bodies))
    assert texts[50]["text"] == bodies[0] + "\r\nlast " and texts[0]["kept"] == "k" and texts[0]["n_words"] == 1


def test_nulls_repeats_and_empty_tables(spark):
    assert judged(spark, []) == []
    rows = [(None, None, None), (None, None, None), (1, "word " * 60, None), (1, "word " * 60, None), (2, prose(random.Random(4), 55), None)]
    assert judged(spark, rows) == slow_kept(rows)
    assert quality.cleaned(spark.createDataFrame(rows, SCHEMA), F.col("source")).count() == 1


def test_plans_have_no_python(spark):
    docs = spark.createDataFrame([(1, "a", "h")], SCHEMA)
    for df in (quality.judged(docs, F.col("source")), quality.cleaned(docs, F.col("source"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("ArrowEval", "BatchEval", "MapInArrow", "MapInPandas", "Cartesian"))
