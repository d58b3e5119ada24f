"""Spelling variants against brute force over all pairs, tries, and edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from agreemill.llm import spelling


def near(a, b):
    """Do two words differ by exactly one inserted, deleted or replaced letter?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(vocabulary, ratio=10):
    best, form = {}, {}
    for a, n in vocabulary.items():
        others = [(-m, b) for b, m in vocabulary.items() if near(a, b)]
        best[a] = len(others), min(others, default=None)
        if others and -min(others)[0] >= ratio * n:
            form[a] = min(others)[1]
    out = []
    for a, n in vocabulary.items():
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, n, best[a][0], vocabulary[form[a]] if a in form else None))
    return sorted(out, key=repr)


def found(spark, vocabulary, **options):
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    return sorted((tuple(r) for r in spelling.variants(df, **options).collect()), key=repr)


def some_words(rng, n, letters="abé", low=1, high=9):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))): rng.choice([2, 3, 20, 40, 400, 5000]) for _ in range(n)}


@pytest.mark.parametrize("letters", [12, 300, 200_000])
def test_equals_brute_force(spark, letters):
    """Small groups are cut again and again, down to a single place."""
    words = some_words(random.Random(letters), 350)
    assert found(spark, words, letters=letters) == brute(words)


def test_hot_prefix_and_suffix(spark):
    rng = random.Random(9)
    words = {f"inter{w}": n for w, n in some_words(rng, 120, "abcd", 2, 6).items()} | {f"{w}ations": n for w, n in some_words(rng, 120, "abcd", 2, 6).items()}
    assert found(spark, words, letters=60) == brute(words)


def test_pairs_come_once(spark):
    words = some_words(random.Random(4), 300, "ab", 1, 8)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = Counter(frozenset((r["a"], r["b"])) for r in spelling.near_words(df, letters=40).collect())
    assert set(pairs.values()) == {1}
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_trie_of_any_letters():
    words = sorted({"", "a", "ab", "aab", "aaab", "b", "ba", "\U0001f600a", "\U0001f600", "\x00", "a\x00", "abc", "acc", "abcd"})
    letters, lengths = spelling._matrix(words)
    i, j = spelling.terminal_pairs(spelling.trie(np.zeros(len(words), np.int64), letters, lengths))
    got = [frozenset((words[a], words[b])) for a, b in zip(i, j, strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_long_chains_have_one_root(spark):
    word, words = "abcdefghij", {}
    for k in range(9):
        words[word] = 2 * 10**k
        word = word[:k] + "z" + word[k + 1 :]
    assert found(spark, words) == brute(words) and len({r[2] for r in found(spark, words)}) == 1


def test_very_long_words(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abc") for _ in range(30_000))
    words = {long: 50, long[:-1]: 3, long[1:]: 4, long[:15_000] + "z" + long[15_001:]: 5, "abcdefg": 6, "abcdefh": 70}
    assert found(spark, words) == brute(words)


def slow_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_vocabulary_of_documents(spark):
    rng = random.Random(11)
    stock = ["".join(rng.choice("abcdeÀéÿÉ×ABZ") for _ in range(rng.randint(5, 12))) for _ in range(60)]
    rows = [(i % 40, " -9Ā".join(rng.choices(stock, k=40))) for i in range(80)] + [(None, None), (None, "Abcdefgh abcdefgh"), (None, ""), (7, "x" * 100_000 + " " + "x" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string").repartition(3)
    words = slow_vocabulary(rows)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()} == words and len(words) > 60


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = spelling.variants(spelling.vocabulary(docs))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.collect() == []
