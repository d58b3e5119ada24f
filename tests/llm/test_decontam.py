from __future__ import annotations

import random

import duckdb

from agreemill.llm import decontam

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string"


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"wörd{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 9, 12, 30, 57, 64, 65, 200])))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "!!"), (63, items[5][1])]
    docs = []
    for i in range(200):
        text = rng.choices(vocabulary, k=rng.randint(0, 800))
        if i % 2:
            part = rng.choice(items[:60])[1].split()
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            at = rng.randint(0, len(text))
            text = text[:at] + ["(" + part[0].upper() + ","] + part[1:] + text[at:]
        docs.append((i, " ".join(text), "x"))
    docs += [(900, None, None), (901, "", "y"), (902, items[0][1], "y"), (902, items[0][1], "y"), (None, items[9][1], "y"), (903, items[9][1] * 3 + " z" * 100_000, "y")]
    return docs, items


def slow(docs, items):
    out = []
    for i, text, _ in docs:
        own = decontam.shingle_set(decontam.words(text))
        for j, t in items:
            s = decontam.shingle_set(decontam.words(t))
            if s and len(s & own) * 5 >= len(s) * 4:
                out.append((i, j, len(s & own), len(s)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    docs, items = corpus()
    got = decontam.contaminations(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["matched"], r["shingles"]) for r in got), key=str) == slow(docs, items)
    assert len(got) > 40


def test_items_too_long_to_broadcast_are_joined(spark):
    docs, items = corpus(9)
    left, frame = spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS).withColumnRenamed("item_id", "class")
    assert decontam.index_of(left, 4000) is None and decontam.index_of(left) is not None
    got = decontam.contaminations(frame, left, block_chars=4000).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["matched"], r["shingles"]) for r in got), key=str) == slow(docs, items)
    kept = decontam.clean(frame, left, block_chars=4000)
    assert kept.columns == ["doc_id", "text", "class"]
    assert {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - {x[0] for x in slow(docs, items)} == {r["doc_id"] for r in decontam.clean(frame, left).collect()}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f", "")], DOCS), spark.createDataFrame([], ITEMS)
    assert decontam.contaminations(docs, items).collect() == []
    assert decontam.clean(docs, items).count() == 1
    assert decontam.contaminations(docs.limit(0), spark.createDataFrame([(1, "a b c d e")], ITEMS)).collect() == []


def test_oracle(spark, tmp_path):
    docs, items = corpus(2)
    docs = [d for d in docs if d[0] not in (None, 902, 903)]  # the SQL is slow on the longest
    con = duckdb.connect()
    import pandas as pd

    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "x"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    rows = con.sql(f"SELECT doc_id, item_id, matched, shingles FROM ({decontam.ORACLE_SQL})").fetchall()
    assert sorted(rows, key=str) == slow(docs, items)
