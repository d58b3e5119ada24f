"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are runs of letters, digits and underscores in lower case; shingles are
five words, as a set. A document is contaminated by an item when it holds at
least ``threshold`` (0.8) of the item's shingles.

Items are partitioned by size (powers of two). An item of a partition of sizes
up to U keeps as signature its ``U - ceil(threshold * U) + 1`` smallest shingle
hashes (bottom-k MinHash). A document that holds 0.8 of an item misses fewer
shingles than that, so it holds at least one signature hash: the search loses
nothing. The document side is not sketched, since a short item is a vanishing
part of a long document; all its shingle hashes probe the signature table.
Candidates are verified on the shingles themselves.

Up to ``BLOCK_CHARS`` characters of items are sent to the tasks as one index of
about 30 bytes a character, so what is broadcast is bounded. More items are searched
by a join of the documents' shingle hashes with the signatures, with the same
results; a table of the signatures' first ``PREFIX_BITS`` bits (512 KB) goes to the
tasks and lets through only hashes that may meet one, before they are shuffled.

Edge cases: null, empty and wordless texts have no shingle and match nothing;
one to four words are a single shingle (matched only by an equal text). Repeated
documents and repeated items each get their rows; a tie with the threshold is a
match. Long texts are read whole. Empty tables match nothing. ``clean`` keeps all
columns of the caller, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreemill.llm.common import checkpoint, class_of, col, free_name, small_batches

WORDS = 5
THRESHOLD = Fraction(4, 5)
BLOCK_CHARS = 8_000_000
PREFIX_BITS = 22
CACHE_WORDS = 400_000

_words = re.compile(r"\w+").findall
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Hashes(dict):
    """Word hashes; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h

    def shingles(self, words: list[str], k: int = WORDS) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(k, len(h))
        n = len(h) - k + 1
        total = h[:n] * _MIX[0]
        for j in range(1, k):
            total += h[j : n + j] * _MIX[j % len(_MIX)]
            total ^= total >> np.uint64(29)
        return (total ^ (total >> np.uint64(32))) * _MIX[1]


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def shingle_set(tokens: list[str], k: int = WORDS) -> set[str]:
    if not tokens:
        return set()
    k = min(k, len(tokens))
    return {" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1)}


def need(n: int, threshold: Fraction = THRESHOLD) -> int:
    """Shingles that must be present of ``n``."""
    return ceil(threshold * n)


def signature(text: str | None, hashes: _Hashes, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """The smallest shingle hashes of an item: as many as its size partition needs."""
    tokens = words(text)
    n = len(shingle_set(tokens))
    if not n:
        return np.zeros(0, np.uint64)
    upper = 1 << max(0, (n - 1).bit_length())
    return np.unique(hashes.shingles(tokens))[: min(n, upper - need(upper, threshold) + 1)]


class Index:
    """Signatures of a bounded number of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: Fraction = THRESHOLD):
        self.ids = [i for i, _ in items]
        self.sets = [shingle_set(words(t)) for _, t in items]
        self.needs = [need(len(s), threshold) for s in self.sets]
        hashes, owners = _Hashes(), defaultdict(list)
        for at, (_, text) in enumerate(items):
            for h in signature(text, hashes, threshold):
                owners[int(h)].append(at)
        self.keys = np.array(sorted(owners), np.uint64)
        self.owners = [owners[int(k)] for k in self.keys]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.intp)] = True

    def search(self, text: str | None, hashes: _Hashes) -> list[tuple[int | None, int, int]]:
        """(item id, matched, shingles of the item) of each contained item."""
        tokens = words(text)
        if not tokens or not len(self.keys):
            return []
        h = hashes.shingles(tokens)
        h = h[self.seen[(h >> np.uint64(44)).astype(np.intp)]]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        candidates = {o for k in set(at[self.keys[at] == h].tolist()) for o in self.owners[k]}
        if not candidates:
            return []
        own = shingle_set(tokens)
        found = [(self.ids[c], len(self.sets[c] & own), len(self.sets[c]), c) for c in sorted(candidates)]
        return [f[:3] for f in found if f[1] >= self.needs[f[3]]]


def index_of(items: DataFrame, block_chars: int | None = None) -> Index | None:
    """An index of (item_id, text), or None if they are too long to broadcast."""
    rows = items.select(col("item_id").cast("long").alias("i"), col("text").alias("t"))
    chars = rows.agg(F.sum(F.coalesce(F.length("t"), F.lit(0)) + 64)).first()[0] or 0
    if chars > (BLOCK_CHARS if block_chars is None else block_chars):
        return None
    return Index(sorted(((r["i"], r["t"]) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))


def contained(index: Index, text: Column) -> Column:
    """array of struct(item_id, matched, shingles) found in a text column."""
    small_batches()
    from pyspark import SparkContext

    sent = SparkContext.getOrCreate().broadcast(index)

    @F.arrow_udf("array<struct<item_id: long, matched: int, shingles: int>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int32()), ("shingles", pa.int32())]))
        own, hashes = sent.value, _Hashes()
        for batch in batches:
            yield pa.array([[dict(zip(("item_id", "matched", "shingles"), f, strict=True)) for f in own.search(t.as_py(), hashes)] for t in batch], kind)

    return search(text)


def _prefixes(signatures: DataFrame) -> np.ndarray:
    """Which first bits any signature hash has: at most 2 ** PREFIX_BITS are collected."""
    seen = np.zeros(1 << PREFIX_BITS, bool)
    for r in signatures.select(F.shiftrightunsigned("h", 64 - PREFIX_BITS).cast("int").alias("p")).distinct().toArrow()["p"].chunks:
        seen[r.to_numpy()] = True
    return np.packbits(seen)


def _hashes_of(text: Column, seen: np.ndarray | None = None) -> Column:
    """array<long>: the signature of an item, or with ``seen`` (of ``_prefixes``) the
    distinct hashes of a document that begin as some signature hash."""
    small_batches()
    from pyspark import SparkContext

    sent = SparkContext.getOrCreate().broadcast(seen)

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, bits = _Hashes(), sent.value
        known = None if bits is None else np.unpackbits(bits).astype(bool)

        def one(text: str | None) -> np.ndarray:
            if known is None:
                return signature(text, hashes)
            tokens = words(text)
            if not tokens:
                return np.zeros(0, np.uint64)
            own = hashes.shingles(tokens)
            return np.unique(own[known[(own >> np.uint64(64 - PREFIX_BITS)).astype(np.intp)]])

        for batch in batches:
            found = [one(t.as_py()).view(np.int64) for t in batch]
            yield pa.array(found, pa.list_(pa.int64()))

    return run(text)


def _verified(text: Column, item: Column) -> Column:
    """struct(matched, shingles) of a document's and an item's text."""
    small_batches()

    @F.arrow_udf("struct<matched: int, shingles: int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, items in batches:
            sets = [(shingle_set(words(t.as_py())), shingle_set(words(i.as_py()))) for t, i in zip(texts, items, strict=True)]
            yield pa.StructArray.from_arrays([pa.array([len(a & b) for a, b in sets], pa.int32()), pa.array([len(b) for _, b in sets], pa.int32())], ["matched", "shingles"])

    return run(text, item)


def _joined(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """(class, item_class, matched, shingles): the search by joins. Equal texts, on
    either side, are one class."""
    item = checkpoint(items.select(class_of(col("text")).alias("item_class"), col("text").alias("item")).groupBy("item_class").agg(F.min("item").alias("item")))
    signatures = checkpoint(item.select("item_class", F.explode(_hashes_of(F.col("item"))).alias("h")))
    seen = _prefixes(signatures)
    texts = docs.select(class_of(col(text)).alias("class"), col(text).alias("text"))
    pairs = checkpoint(texts.select("class", F.explode(_hashes_of(F.col("text"), seen)).alias("h")).join(signatures, "h").select("class", "item_class").distinct())
    some = checkpoint(texts.join(pairs.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.min("text").alias("text")))
    found = pairs.join(some, "class").join(item, "item_class").select("class", "item_class", _verified(F.col("text"), F.col("item")).alias("v"))
    enough = F.col("v.matched") * THRESHOLD.denominator >= F.col("v.shingles") * THRESHOLD.numerator
    return checkpoint(found.where(enough).select("class", "item_class", "v.matched", "v.shingles"))


def contaminations(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", block_chars: int | None = None) -> DataFrame:
    """(key, item_id, matched, shingles, containment) of every contained item."""
    index = index_of(items, block_chars)
    if index is not None:
        out = docs.select(col(key).alias(key), F.explode(contained(index, col(text))).alias("f")).select(key, "f.item_id", "f.matched", "f.shingles")
    else:
        rows = docs.select(col(key).alias(key), class_of(col(text)).alias("class"))
        of_item = items.select(class_of(col("text")).alias("item_class"), col("item_id").cast("long").alias("item_id"))
        out = rows.join(_joined(docs, items, text), "class").join(of_item, "item_class").select(key, "item_id", "matched", "shingles")
    return out.select("*", (F.col("matched") / F.col("shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", block_chars: int | None = None) -> DataFrame:
    """The documents that contain no item."""
    index = index_of(items, block_chars)
    if index is not None:
        return docs.where(F.size(contained(index, col(text))) == 0)
    mark = free_name(docs, "class")
    dirty = _joined(docs, items, text).select(F.col("class").alias(mark)).distinct()
    return docs.withColumn(mark, class_of(col(text))).join(dirty, mark, "left_anti").select(*[col(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)
), si AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), n AS (
  SELECT item_id, count(*) AS shingles FROM si GROUP BY item_id
), m AS (
  SELECT doc_id, item_id, count(*) AS matched FROM ds JOIN si USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(matched AS INTEGER) AS matched, CAST(shingles AS INTEGER) AS shingles,
       CAST(matched AS DOUBLE) / shingles AS containment
FROM m JOIN n USING (item_id) WHERE matched * 5 >= shingles * 4
"""
