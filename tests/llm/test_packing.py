from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from agreemill.llm import packing

SCHEMA = "doc_id long, text string, piece string"


def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_whole(rows, texts, capacity=1024):
    t = exact()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"] <= capacity
            at += r["length"]
        assert at == len(ids)
        if len(ids) <= capacity:
            assert len(own) == 1
        else:
            assert all(r["length"] == capacity for r in own[1:])


def check_packed(rows, capacity=1024):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // capacity)


def test_documents_round_trip(spark):
    rng = random.Random(2)
    words = ["the", "Ünder", " x", "çà", "\n", "123", "don't", "日本語", "<|endoftext|>", " ", "ab" * 40]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 900))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "word " * 400_000}
    docs = spark.createDataFrame([(i, t, "extra") for i, t in texts.items()], SCHEMA)
    rows = packing.packed_documents(docs).collect()
    check_whole(rows, texts)
    used, least = check_packed(rows)
    assert used <= least * 1.02 + 1


def test_repeated_rows_and_empty_table(spark):
    rows = packing.packed_documents(spark.createDataFrame([(1, "same", ""), (1, "same", ""), (None, None, "")], SCHEMA)).collect()
    assert len(rows) == 3 and check_packed(rows) == (1, 1)
    assert packing.packed_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def pieces(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")


def test_tree_of_rounds_is_near_the_bound(spark):
    lengths = np.random.default_rng(0).integers(1, 1025, 6000)
    rows = packing.pack(pieces(spark, lengths), per_task=200, fan_in=4).collect()
    used, least = check_packed(rows)
    assert len(rows) == 6000 and used <= least * 1.05


def test_one_size_and_the_bound_on_what_is_handed_on(spark):
    rows = packing.pack(pieces(spark, [600] * 500), per_task=50, fan_in=4, carry=7).collect()
    assert check_packed(rows) == (500, 293)
    rows = packing.pack(pieces(spark, [512] * 333 + [1024] * 2), per_task=50, fan_in=4).collect()
    assert check_packed(rows)[0] == 169


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([7, 6, 3, 4]), 10)
    assert bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 7, 6]


def test_both_best_fits_place_every_item_once():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 1024, 700), rng.integers(200, 400, 300), np.full(50, 512), np.array([1]), np.zeros(0, np.int64), rng.integers(1, 30, 500)):
        for pack in (packing.best_fit, packing.best_sets, packing.fewest):
            bins, offsets = pack(sizes)
            used, _ = check_packed([{"sequence_id": b, "offset": o, "length": n} for b, o, n in zip(bins.tolist(), offsets.tolist(), sizes.tolist(), strict=True)])
            assert used == len(set(bins.tolist())) and len(bins) == len(sizes)
    sizes = np.array([600, 300, 124, 500, 400, 124])
    assert packing.best_sets(sizes)[0].max() + 1 == 2


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "it's", "12", "\n\n  x", "Žluť", "...", "a b"], k=3000))
    encode = packing.Encoder()
    whole = encode(text)
    monkeypatch.setattr(packing, "STRETCH", 50)
    assert (encode(text) == whole).all() and whole.tolist() == [*exact().encode(text, add_special_tokens=False).ids, 2]


def test_added_tokens_have_their_own_ids():
    encode, plain = packing.Encoder(), exact()
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 2]
    rng = random.Random(4)
    bits = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "a", "é", "日", "'s", "."]
    for _ in range(500):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert encode(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
