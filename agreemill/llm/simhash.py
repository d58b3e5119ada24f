"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: XXH64 (seed 42) of each word shingle; a bit is 1 if more than
half the shingles set it. Inside a bucket of candidates the fingerprints' bits
are stored vertically (a *plane* holds one bit of 64 members a word). A value is
compared with a word of members at a time: carry-save bitwise counters add up
the differing planes for all 64 at once, and the word is abandoned as soon as
each of its members is beyond the radius.

Two searches fill the buckets:

* ``near_duplicates``: all pairs within ``radius`` bits. Such a pair agrees on at
  least ``blocks - radius`` of ``blocks`` bit ranges, so each fingerprint is
  dealt once for every choice of that many ranges. Nothing is lost.
* ``near_copies``: all pairs whose sets of five-word shingles have a Jaccard
  similarity of at least 0.8. Candidates agree in one of ``BANDS`` bands of ``ROWS``
  MinHashes (a pair at 0.8 shares none with probability 5e-8; in crowded buckets also
  in ``LANES`` of all 128, which a pair at 0.8 misses with probability 2e-7) and differ
  in at most ``WIDE`` bits (a pair at 0.8 differs in 10 on average, in over 26
  with probability 2e-6 at most); each is confirmed on the whole sets. A bucket's
  members are compared with its most typical one first, then all pairs that this
  does not show to be connected.

Equal fingerprints (near_copies: equal texts) are one *class* from then on, so
copies are never compared. Buckets over ``PART`` classes are dealt as pairs of
parts, each its own task's work: every pair meets once, no task holds a bucket.

Edge cases: null or empty text has fingerprint zero and links like any other;
fewer words than a shingle hash as one shingle. Copies, ties and repeated rows
share a class. An empty table gives an empty result. Texts of any length are
read whole. Other columns are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreemill.llm.common import checkpoint, class_of, col, free_name, small_batches
from agreemill.llm.components import components

WORDS = 3
RADIUS = 3
BLOCKS = 5
PART = 1 << 15
UNITS = 1 << 14
STRETCH = 1 << 20

#: near_copies: words of a shingle, least similarity as an exact fraction.
COPY_WORDS = 5
LEAST, OF = 4, 5
BANDS = 32
ROWS = 4
LANES = 78
WIDE = 26
FEW = 64
CROWD_PART = 512

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BELOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_factors = np.random.default_rng(42).integers(0, 1 << 31, BANDS * ROWS, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, in order; none without words."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(parts) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((h(joined[s:e], 42) for s, e in spans), np.uint64, n)


class ShingleHashes:
    """Distinct shingles of texts, as hashes: a polynomial modulo 2**64 over the bytes
    of a shingle, from running sums over the text, then mixed."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 1 << 16)
            one = np.ones(1, np.uint64)
            self.powers = np.concatenate([one, np.cumprod(np.full(n - 1, _BASE))])
            self.inverse = np.concatenate([one, np.cumprod(np.full(n - 1, np.uint64(pow(int(_BASE), -1, 1 << 64))))])

    def __call__(self, text: str | None, words: int = COPY_WORDS) -> np.ndarray:
        joined = b" ".join((text or "").encode("utf-8", "replace").lower().split())
        if not joined:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
        k = min(words, len(starts))
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # stretches of bounded length, however long the text
            first = starts[at]
            stop = max(at + 1, int(np.searchsorted(ends, first + STRETCH, "right")))
            own = data[first : ends[stop - 1]].astype(np.uint64) + np.uint64(1)
            self._grow(len(own))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * self.powers[: len(own)])])
            s, e = starts[at:stop] - first, ends[at:stop] - first
            out[at:stop] = (sums[e] - sums[s]) * self.inverse[s]
            at = stop
        for factor in _MIX:
            out = (out ^ (out >> np.uint64(32))) * factor
        return np.unique(out ^ (out >> np.uint64(32)))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: the bits that over half of them set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text."""
    return majority(shingles(text, words))


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of a text column as a (signed) bigint."""
    small_batches()

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([fingerprint_of(t.as_py(), words) for t in batch], np.uint64)
            yield pa.array(found.view(np.int64))

    return simhash(text)


# Bit-sliced comparison


def planes_of(values: np.ndarray) -> np.ndarray:
    """(64, words): bit 63 - k of every value in plane k, 64 values a word."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    bits = np.pad(bits, ((0, -len(values) % 64), (0, 0)))
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Members whose count, given as bit planes from low to high, is over ``radius``."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _FULL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def near(values: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with begin[i] <= j < end[i] whose values differ in at most
    ``radius`` bits, in arrays.

    A unit of work is one value against one word of 64 members. A member is lost
    once its count overflows or passes the radius; every eight planes, units
    without a member left are abandoned.
    """
    if not len(values):
        return
    planes = planes_of(values)
    rows = np.flatnonzero(end > begin)
    first = begin[rows] >> 6
    count = ((end[rows] - 1) >> 6) - first + 1
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + UNITS, "right")) - 1)
        c = count[at:stop]
        i = np.repeat(rows[at:stop], c)
        w = np.repeat(first[at:stop] - (total[at:stop] - total[at]), c) + np.arange(len(i))
        at = stop
        alive = _BELOW[np.clip(end[i] - 64 * w, 0, 64)] & ~_BELOW[np.clip(begin[i] - 64 * w, 0, 64)]
        own = values[i]
        counters = [np.zeros_like(alive) for _ in range(radius.bit_length())]
        for k in range(64):
            carry = planes[k][w] ^ -(own >> np.uint64(63 - k) & np.uint64(1))
            for b, counter in enumerate(counters):
                counters[b], carry = counter ^ carry, counter & carry
            alive &= ~carry
            if k % 8 == 7:
                if counters and radius + 1 != 1 << len(counters):
                    alive &= ~_beyond(counters, radius)
                left = np.flatnonzero(alive)
                if len(left) < len(alive):
                    i, w, own, alive = i[left], w[left], own[left], alive[left]
                    counters = [x[left] for x in counters]
                if not len(left):
                    break
        if len(alive):
            unit, bit = np.nonzero(np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(-1, 64))
            yield i[unit], 64 * w[unit] + bit


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between ``n`` members: of each two trees that meet,
    the one of larger label is hooked to the other by one link."""
    label, out = np.arange(n), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            differ = np.flatnonzero(a != b)
            if not len(differ):
                break
            i, j, low, high = i[differ], j[differ], np.minimum(a, b)[differ], np.maximum(a, b)[differ]
            hooked, at = np.unique(high, return_index=True)
            out.append((i[at], j[at]))
            to = np.arange(n)
            to[hooked] = low[at]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = PART) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows sorted by their first ``keys`` columns, in blocks of whole groups, with
    the first row of each group."""
    held: list[list[np.ndarray]] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) < rows:
                continue
        if not held:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
        starts = np.flatnonzero(new)
        stop = len(new) if batch is None else int(starts[-1])
        held = [[c[stop:] for c in columns]] if stop < len(new) else []
        if stop:
            yield [c[:stop] for c in columns], starts[starts < stop]


def _spans(starts: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each row is compared with: the rows after it, or the second part where
    its group is a pair of parts (first rows first)."""
    n = len(second)
    sizes = np.diff(np.append(starts, n))
    end = np.repeat(starts + sizes, sizes)
    seconds = np.add.reduceat(second.astype(np.int64), starts) if n else second
    middle = np.repeat(starts + sizes - seconds, sizes)
    begin = np.where(np.repeat(seconds, sizes) > 0, np.where(second > 0, end, middle), np.arange(n) + 1)
    return begin, end


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


_TILE = ["bucket", "lo", "hi", "second"]


def _tiles(rows: DataFrame, part: int) -> DataFrame:
    """Rows (bucket, fp, ...) with (lo, hi, second): a crowded bucket is dealt as
    pairs of its parts, any other one is a pair of part 0 with itself."""
    crowded = checkpoint(rows.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > part))
    if not crowded.head(1):
        return rows.select("*", *[F.lit(0).alias(c) for c in _TILE[1:]])
    parts = F.coalesce(F.ceil(F.col("members") / part), F.lit(1)).cast("int")
    dealt = rows.join(crowded, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.select(*rows.columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("second"))


# All pairs within a radius


def ranges(bits: int, blocks: int) -> list[tuple[int, int]]:
    """Split ``bits`` into ``blocks`` nearly even (first, width) ranges."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """For each choice of ranges to agree on, the mask of its bits."""
    parts = [((1 << width) - 1) << first for first, width in ranges(64, blocks)]
    return [sum(c) for c in combinations(parts, max(0, len(parts) - radius))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, second, fp), starts in _groups(batches, 3):
            pairs = near(fp.view(np.uint64), *_spans(starts, second), radius)
            a, b = forest(pairs, len(fp))
            yield _batch({"a": fp[a], "b": fp[b]})

    return run


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    dealt = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(radius, blocks))]))
    rows = _tiles(classes.select(dealt.alias("bucket"), "fp"), part).select(*_TILE, "fp")
    return rows.repartition(*_TILE[:3]).sortWithinPartitions(*_TILE).mapInArrow(_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(key, fp, group, component) of every row.

    component: the least key reachable; group: one fingerprint of the group,
    which tells groups apart even where keys repeat.
    """
    rows = checkpoint(docs.select(col(key).alias("id"), fingerprint(col(text), words).alias("fp")))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("id")))
    return _grouped(rows, classes, links(classes.select("fp"), radius, blocks), key)


def _grouped(rows: DataFrame, classes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, fp, group, component) of rows (id, fp), from links (a, b) between classes."""
    linked = components(edges, "a", "b")
    groups = linked.join(classes, linked["node"] == classes["fp"]).select("fp", "id", "component")
    least = groups.groupBy("component").agg(F.min("id").alias("least"))
    labels = groups.join(least, "component").select("fp", F.col("component").alias("group"), "least")
    named = classes.join(labels, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), F.coalesce("least", "id").alias("component"))
    of_class = checkpoint(named)  # a plain table, so that a hot fingerprint's rows can be split
    return rows.join(of_class, "fp").select(F.col("id").alias(key), "fp", "group", "component")


# Near copies by similarity


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        least = np.minimum(least, (_factors * short[at : at + 256]).min(axis=1))
    return least


def buckets_of(least: np.ndarray) -> list[int]:
    """One bucket a band, by the band's MinHashes."""
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def sketch(text: Column) -> Column:
    """(n, sim, buckets): the number of distinct shingles of a text, their
    fingerprint, and its MinHash buckets."""
    small_batches()

    @F.arrow_udf("struct<n: int, sim: long, buckets: array<long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = ShingleHashes()
        for batch in batches:
            sizes, sims, values = [], [], []
            for t in batch:
                own = hashes(t.as_py())
                sizes.append(len(own))
                sims.append(majority(own))
                values.append(buckets_of(min_hashes(own)))
            flat = np.array(values, np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(np.array(sims, np.uint64).view(np.int64)), lists], ["n", "sim", "buckets"])

    return run(text)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sets LEAST / OF at least? Empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= LEAST * (len(a) + len(b) - both)


def _alike(a: Column, b: Column) -> Column:
    small_batches()

    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes, kept = ShingleHashes(), {}  # one text of many pairs is cut once

        def cut(text: str) -> np.ndarray:
            if text not in kept:
                if len(kept) >= 8:
                    kept.pop(next(iter(kept)))
                kept[text] = hashes(text)
            return kept[text]

        for x, y in batches:
            yield pa.array([alike(cut(s.as_py() or ""), cut(t.as_py() or "")) for s, t in zip(x, y, strict=True)], pa.bool_())

    return run(a, b)


def _sized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Can sets of these sizes be alike?"""
    return OF * np.minimum(a, b).astype(np.int64) >= LEAST * np.maximum(a, b).astype(np.int64)


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of each group's most typical member, the one nearest to
    the group's majority fingerprint."""
    for (_, _, fp, sim, n), starts in _groups(batches, 2):
        values, sizes = sim.view(np.uint64), np.diff(np.append(starts, len(sim)))
        bits = np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(-1, 64)
        centres = np.packbits(2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > sizes[:, None], axis=1).view(">u8")[:, 0]
        off = np.bitwise_count(values ^ np.repeat(centres, sizes).astype(np.uint64))
        leads = np.lexsort((fp, off, np.repeat(starts, sizes)))[starts]
        begin, end = np.zeros(len(sim), np.int64), np.zeros(len(sim), np.int64)
        begin[leads], end[leads] = starts, starts + sizes
        for i, j in near(values, begin, end, WIDE):
            ok = (i != j) & _sized(n[i], n[j])
            a, b = fp[i[ok]], fp[j[ok]]
            yield _batch({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _unconnected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) with different labels, of all pairs of a group."""
    for (_, _, _, second, fp, sim, n, label), starts in _groups(batches, 3):
        for i, j in near(sim.view(np.uint64), *_spans(starts, second), WIDE):
            ok = (label[i] != label[j]) & _sized(n[i], n[j])
            a, b = fp[i[ok]], fp[j[ok]]
            yield _batch({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _set_of(text: Column) -> Column:
    """The distinct shingles of a text, packed."""
    small_batches()

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = ShingleHashes()
        for batch in batches:
            yield pa.array([hashes(t.as_py()).tobytes() for t in batch], pa.binary())

    return run(text)


def _crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the near copies of different labels in each group. A pair is
    judged in the first bucket that it shares, if enough of its MinHashes agree."""
    for (bucket, _, _, second, fp, sim, n, label, packed), starts in _groups(batches, 3, 1):
        for s, e in zip(starts, [*starts[1:], len(fp)], strict=True):
            sets = [np.frombuffer(x, np.uint64) for x in packed[s:e]]
            lanes = np.stack([min_hashes(x) for x in sets])
            places = np.array([buckets_of(x) for x in lanes], np.uint64).view(np.int64)
            tree, links_ = label[s:e].copy(), []
            for i, j in near(sim[s:e].view(np.uint64), *_spans(np.zeros(1, np.int64), second[s:e]), WIDE):
                for at in range(0, len(i), 1 << 13):
                    x, y = i[at : at + (1 << 13)], j[at : at + (1 << 13)]
                    ok = (tree[x] != tree[y]) & _sized(n[s:e][x], n[s:e][y])
                    x, y = x[ok], y[ok]
                    ok = (lanes[x] == lanes[y]).sum(axis=1) >= LANES
                    x, y = x[ok], y[ok]
                    ok = places[x, (places[x] == places[y]).argmax(axis=1)] == bucket[s]
                    for u, v in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                        if tree[u] != tree[v] and alike(sets[u], sets[v]):
                            links_.append((fp[s + u], fp[s + v]))
                            tree[tree == max(tree[u], tree[v])] = min(tree[u], tree[v])
            if links_:
                a, b = np.array(links_).T
                yield _batch({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts are near copies."""
    left, right = (texts.select(F.col("fp").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").where(_alike(F.col("text_a"), F.col("text_b"))).select("a", "b")


def copy_links(members: DataFrame, texts: DataFrame, part: int = PART, few: int = FEW, crowd_part: int = CROWD_PART) -> DataFrame:
    """Confirmed links (a, b) that connect all near copies that share a bucket.

    ``members`` holds (bucket, m, fp, sim, n), plain and distinct, m members in a
    bucket; ``texts`` holds (fp, text). What the comparison with the most typical
    member shows to be connected gets one label; then pairs of other labels meet:
    those of up to ``few`` members as pairs of texts, those of crowded buckets in
    parts of ``crowd_part`` members, whose tasks hold their sets and yield forests.
    """
    salted = members.select("bucket", F.pmod(F.xxhash64("fp"), F.ceil(F.col("m") / part)).cast("int").alias("salt"), "fp", "sim", "n")
    tried = checkpoint(salted.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(_led, "a long, b long").distinct())
    found = checkpoint(_confirmed(tried, texts))
    both = found.select(F.col("a").alias("x"), F.col("b").alias("y")).union(found.select("b", "a"))
    least = checkpoint(both.groupBy("x").agg(F.least("x", F.min("y")).alias("y")))
    jumped = least.alias("f").join(least.alias("g"), F.col("f.y") == F.col("g.x"), "left")
    label = checkpoint(jumped.select(F.col("f.x").alias("fp"), F.coalesce("g.y", "f.y").alias("label")))
    named = checkpoint(members.join(label, "fp", "left").select("bucket", "m", "fp", "sim", "n", F.coalesce("label", "fp").alias("label")))
    still = checkpoint(named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket"))
    rows = checkpoint(named.join(still, "bucket"))
    small = _tiles(rows.where(F.col("m") <= few).drop("m"), part).select(*_TILE, "fp", "sim", "n", "label")
    pairs = small.repartition(*_TILE[:3]).sortWithinPartitions(*_TILE).mapInArrow(_unconnected, "a long, b long").distinct()
    rest = checkpoint(pairs.join(tried, ["a", "b"], "left_anti"))
    found = found.union(checkpoint(_confirmed(rest, texts)))
    large = rows.where(F.col("m") > few)
    if not large.head(1):
        return found
    sets = checkpoint(texts.join(large.select("fp").distinct(), "fp", "left_semi").select("fp", _set_of(F.col("text")).alias("set")))
    crowd = checkpoint(_tiles(large.drop("m"), crowd_part).select(*_TILE, "fp", "sim", "n", "label")).join(sets, "fp").select(*_TILE, "fp", "sim", "n", "label", "set")
    return found.union(checkpoint(crowd.repartition(*_TILE[:3]).sortWithinPartitions(*_TILE).mapInArrow(_crowd, "a long, b long").distinct()))


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, group, component) of every row, as near_duplicates has them; fp is
    the class of equal texts."""
    rows = checkpoint(docs.select(col(key).alias("id"), class_of(col(text)).alias("fp"), sketch(col(text)).alias("s")).select("id", "fp", "s.sim", "s.n", "s.buckets"))
    distinct = rows.groupBy("fp").agg(F.min("id").alias("id"), F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    classes = checkpoint(distinct)
    dealt = classes.select("fp", F.explode("buckets").alias("bucket"))
    shared = checkpoint(dealt.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"))
    placed = checkpoint(dealt.join(shared, "bucket"))
    members = checkpoint(placed.join(classes.select("fp", "sim", "n"), "fp").select("bucket", "m", "fp", "sim", "n"))
    wanted = checkpoint(members.select("fp").distinct())
    texts = docs.select(class_of(col(text)).alias("fp"), col(text).alias("text")).join(wanted, "fp").groupBy("fp").agg(F.min("text").alias("text"))
    return _grouped(rows.select("id", "fp"), classes.select("fp", "id"), copy_links(members, checkpoint(texts)), key)


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, one of each group of near copies: the one of least key.

    Rows with a null key can't be told apart and stay. Of rows with one key, one a
    group stays. Texts are not shuffled unless the ids to drop are too many to
    broadcast.
    """
    found = checkpoint(near_copies(docs, text, key).select(F.col(key).alias("id"), "fp", "group", "component"))
    columns = [col(c) for c in docs.columns]
    repeated = found.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(key))
    dropped = found.where("id != component").select(F.col("id").alias(key))
    kept = docs.join(dropped, key, "left_anti").select(*columns)
    if not repeated.head(1):
        return kept
    repeated = checkpoint(repeated)
    mark, group = free_name(docs, "class"), free_name(docs, "group")
    own = docs.join(repeated, key, "left_semi").withColumn(mark, class_of(col(text)))
    least = found.where("id = component").select(F.col("id").alias(key), F.col("fp").alias(mark), F.col("group").alias(group)).distinct()
    some = own.join(least, [key, mark]).dropDuplicates([key, group]).select(*columns)
    return kept.join(repeated, key, "left_anti").select(*columns).union(some)


def duplicate_components(docs: DataFrame) -> DataFrame:
    """The op9 query."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
