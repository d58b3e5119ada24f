from __future__ import annotations

import hashlib
import json
import random
import time

import duckdb
import pandas as pd

from agreemill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, source string"


def corpus(seed=1):
    rng = random.Random(seed)
    bits = ["hi", "é", "日本", "<s>", "</s>", "[INST]", "[/INST]", "&lt;", "&amp;", "&", "&nl;", "\n", "<", "[", "]", "&amp;lt;", " ", "\u0000x", "😀"]
    rows = []
    for c in range(80):
        shape = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["assistant"], ["user"] * 3, ["user", "assistant"] * 6, ["tool\n<x", "assistant", None]])
        for t, role in enumerate(shape):
            rows.append((c, t, role, rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(1, 30)))]), "s"))
    rows += [(200, 5, "assistant", "b", "s"), (200, 5, "assistant", "a", "s"), (200, 5, "assistant", "a", "s"), (200, None, "user", "z", "s")]
    rows.append((201, 0, "assistant", "long & <text> " * 50_000, "s"))
    return rows


def slow(rows):
    by = {}
    for c, t, r, x, _ in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]", ""), (-1, 1, "assistant", "</s>[INST] ok [/INST]", "")]:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns = sorted(turns, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), digest("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(loss), digest(loss))
    return out


def test_round_trip_matches_slow_form(spark):
    rows = corpus()
    got = chat.formatted_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == slow(rows)
    assert len(got) == len(slow(rows))


def test_control_strings_only_mark_turns(spark):
    df = chat.format_turns(chat.canonical_turns(chat.records(spark.createDataFrame(corpus(3), SCHEMA))))
    for r in df.select("turns", "formatted").collect():
        n = len(r["turns"])
        assert r["formatted"].count("<s>") == r["formatted"].count("</s>") == r["formatted"].count("<") / 2 == n
        assert "[" not in r["formatted"]


def test_layouts_are_told_apart_by_their_paths(spark, tmp_path):
    records = [
        {"id": 1, "prompt": "p", "response": "r"},
        {"id": 2, "prompt": "p", "completion": "c"},
        {"id": 3, "instruction": "i", "input": "x", "output": "o"},
        {"id": 4, "instruction": "i", "input": "", "output": "o", "system": "s"},
        {"id": 5, "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]},
        {"id": 6, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"id": 7, "messages": []},
        {"id": 8, "prompt": "only"},
        {"id": 9},
        {"id": 10, "prompt": "p", "response": "r", "meta": {"layout": "x"}},
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(map(json.dumps, records)))
    got = {r["id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.canonical_turns(spark.read.json(str(path))).collect()}
    assert got == {
        1: ("prompt_response", [("user", "p"), ("assistant", "r")]),
        2: ("prompt_completion", [("user", "p"), ("assistant", "c")]),
        3: ("instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        4: ("instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        5: ("messages", [("user", "u"), ("assistant", "")]),
        6: ("conversations", [("user", "h"), ("assistant", "g")]),
        7: ("messages", []),
        8: ("unknown", []),
        9: ("unknown", []),
        10: ("prompt_response", [("user", "p"), ("assistant", "r")]),
    }


def test_clashing_column_names_and_empty_tables(spark):
    df = spark.createDataFrame([("p", "r", "mine", "x")], "prompt string, response string, layout string, `a.b` string")
    out = chat.canonical_turns(df)
    assert out.columns == ["prompt", "response", "a.b", "fingerprint", "layout", "turns"] and out.first()["layout"] == "prompt_response"
    got = chat.formatted_conversations(spark.createDataFrame([], SCHEMA)).collect()
    assert [r["conv_id"] for r in got] == [-1]


def test_plan_is_native(spark):
    plan = chat.formatted_conversations(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEval", "BatchEval", "MapInArrow", "MapInPandas", "FlatMapGroups"))


def test_oracle(spark):
    rows = [r for r in corpus(6) if r[2] is not None and "\u0000" not in (r[3] or "")]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "source"]))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    expected = con.sql(f"SELECT {', '.join(names)} FROM ({chat.ORACLE_SQL})").fetchall()
    got = chat.formatted_conversations(spark.createDataFrame(rows, SCHEMA)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_own_columns_replace_those_of_the_caller(spark):
    df = spark.createDataFrame([([("user", "a")], "mine", 3)], "turns array<struct<role: string, text: string>>, Formatted string, parts int")
    got = chat.format_turns(df)
    assert got.columns == ["turns", "parts", "formatted", "loss_spans"] and got.first()["parts"] == 3


def test_conversations_of_many_turns(spark):
    """Spans of a long conversation are right, and take no square of its turns."""
    n = 30_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, ' <s> 😀 & more') AS text")
    start = time.time()
    got = {r["conv_id"]: r for r in chat.formatted_conversations(rows).collect()}[1]
    assert time.time() - start < 40
    loss = "".join(f"turn {i} <s> 😀 & more" for i in range(1, n, 2))
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_running_sums(spark):
    rows = spark.createDataFrame([(i, [int(x) for x in range(i)]) for i in (0, 1, 2, 3, 4, 9, 10, 50)], "i int, x array<long>")
    for r in chat._running(rows, "x", "s").collect():
        assert r["s"] == [sum(r["x"][:k]) for k in range(len(r["x"]))]


def test_spans_over_chunks(spark, monkeypatch):
    for chunk in (1, 3, 7):
        monkeypatch.setattr(chat, "CHUNK", chunk)
        text = "ab\n😀\r\ncd\u2028ef" * 3
        rows = [(text, [(a, n)]) for a in range(len(text)) for n in range(len(text) - a + 1)] + [(text, [(0, 2), (5, 0), (4, 9)]), ("", [])]
        df = spark.createDataFrame(rows, "formatted string, loss_spans array<struct<start: long, length: long>>")
        for r in chat.with_loss(df).collect():
            assert r["loss"] == "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"])
