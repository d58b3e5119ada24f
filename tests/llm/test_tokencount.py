from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from agreemill.llm import packing, tokencount
from agreemill.llm.tokencount import Counter, Document

BITS = ["the", " dog", "'s", "'", "'ll", "re", " ", "  ", "\n", "\n\n ", "12", "é", "日本", "...", " !", "x" * 30, "\t", "don't", "'r", "e", "v", "m", "_", "²", "İ", "<|endoftext|>", "<|endof", "text|>", "<", "|>"]


@pytest.fixture(scope="module")
def counter():
    return Counter()


PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def count(now):
    return len(PLAIN.encode(now, add_special_tokens=False).ids)


def slow_pieces(counter, now):
    parts = now.split("<|endoftext|>")
    return [p for i, part in enumerate(parts) for p in (["<|endoftext|>"] if i else []) + counter.pattern.findall(part)]


def text(rng, n):
    return "".join(rng.choices(BITS, k=n))


@pytest.mark.parametrize("seed", range(6))
def test_edits_equal_a_whole_recount(counter, seed):
    rng = random.Random(seed)
    now = text(rng, rng.choice([0, 3, 60, 900]))
    doc = Document(now, counter, leaf=rng.choice([1, 2, 7, 64]))
    for _ in range(150):
        start, length = rng.randint(0, len(now) + 3), rng.choice([0, 0, 1, 2, 9, 200])
        new = text(rng, rng.choice([0, 1, 1, 4, 30]))
        doc.edit(start, length, new)
        start = min(start, len(now))
        now = now[:start] + new + now[start + length :]
        whole = Document(now, counter)
        assert doc.text == now
        assert [c for leaf in doc.leaves for c in leaf[0].tolist()] == [c for leaf in whole.leaves for c in leaf[0].tolist()]
        assert (doc.tokens, doc.pretokens) == (whole.tokens, whole.pretokens) == (count(now), len(slow_pieces(counter, now)))


def test_only_the_edited_region_is_encoded_again(counter):
    doc = Document("some plain words here " * 20_000, counter)
    doc.edit(200_000, 5, "other")
    assert doc.reencoded < 60 and doc.tokens == count(doc.text)


def test_prefix_counts(counter):
    now = text(random.Random(1), 500)
    doc = Document(now, counter, leaf=8)
    ends, total = 0, 0
    for piece in slow_pieces(counter, now):
        ends += len(piece)
        total += count(piece)
        assert doc.tokens_before(ends) == total


def test_stretches_do_not_change_the_split(counter, monkeypatch):
    now = text(random.Random(2), 3000)
    whole = counter.split(now)
    monkeypatch.setattr(packing, "STRETCH", 40)
    parts = counter.split(now)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_query_against_brute_force(spark, counter):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randint(0, 400)), "c") for i in range(40)] + [(50, None, None), (51, "", ""), (51, "", ""), (None, "a b", ""), (52, "long text " * 60_000, "")]
    got = tokencount.edited_documents(spark.createDataFrame(rows, "doc_id long, text string, c string")).collect()
    assert len(got) == len(rows)
    expected = []
    for i, t, _ in rows:
        now, k = t or "", (i or 0) % 7
        n = len(now)
        for start, length, new in ((n // 4, 0, f" revised'll {k}"), (n // 2, k, "it's 42  new\n"), (n * 3 // 4, k + 9, ""), (n + 20, 0, " End.")):
            start = min(start, len(now))
            now = now[:start] + new + now[start + length :]
        expected.append((i, count(t or ""), count(now), len(now)))
    assert sorted(((r["doc_id"], r["tokens_before"], r["tokens_after"], r["chars"]) for r in got), key=str) == sorted(expected, key=str)
    assert tokencount.edited_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
