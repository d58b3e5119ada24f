"""Packing of token sequences by hierarchical residual best-fit.

Documents are tokenised; longer ones are cut into pieces of the capacity, the
first piece taking the remainder. Full pieces are sequences of their own. The
others are dealt over partitions, each of which packs its own best-fit (both
decreasing and by sets that fill a bin, keeping what takes fewer bins), emits
its nearly full bins, and hands the underfull ones on as
items; a tree of merges (``FAN_IN`` partitions into one) repeats that until one
task is left, which emits all its bins. What a task hands on is bounded by
``CARRY`` bins, the least filled; fuller ones beyond that are emitted too, so no
row is ever lost and no task grows with the corpus.

Edge cases: a null or empty text is the end token alone. Added tokens written in a
text get their ids, as the tokeniser's plain call gives them. Repeated rows are
packed once each; ties of length are packed in the order of id and piece. Other
columns, whatever their names, are not used. An empty table gives an empty result. Long texts are
tokenised whole, in stretches cut only where the tokeniser must cut as well.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache, cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreemill.llm.common import checkpoint, col, small_batches

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 1024
END = 2
NEARLY_FULL = 1020
PER_TASK = 50_000
FAN_IN = 8
CARRY = 1 << 16
STRETCH = 1 << 20
VOCABULARY = "byte_bpe_50k"

#: Texts of these characters are cut alike by both tokeniser libraries.
_plain = re.compile("[\x00-ɏ]*").fullmatch
_must_cut = re.compile(r"(?<=\S)(?= [^\W\d_])")


def stretches(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only where any
    tokeniser of this pattern cuts: before a space between word and letter."""
    size, at = size or STRETCH, 0
    while at < len(text):
        cut = _must_cut.search(text, at + size) if len(text) - at > size else None
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


@cache
def added_tokens(name: str = VOCABULARY) -> list[str]:
    """The added tokens of a vocabulary, as they are written in a text."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        return [x["content"] for x in json.load(file)["added_tokens"]]


class Encoder:
    """Token ids of the byte-level vocabulary whose files ``name`` has.

    The fast library serves texts of Latin characters without an added token (such
    as the end-of-text marker), where it gives the same ids; other texts go through
    the reference tokeniser, which turns added tokens into their own ids.
    """

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file = public_tokenizers.path(f"{name}.json")
        self.added = added_tokens(name)

    @cached_property
    def exact(self) -> Tokenizer:
        """Loaded with the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def __call__(self, text: str | None) -> np.ndarray:
        parts = []
        for piece in stretches(text or ""):
            ids = self.fast.encode_ordinary(piece) if _plain(piece) and not any(x in piece for x in self.added) else self.exact.encode(piece, add_special_tokens=False).ids
            parts.append(np.array(ids, "<u4"))
        return np.concatenate([*parts, np.array([END], "<u4")])


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(text: Column, capacity: int = CAPACITY, name: str = VOCABULARY) -> Column:
    """array of struct(start, length, ids_crc32) of a text column."""
    small_batches()

    @F.arrow_udf("array<struct<start: long, length: long, ids_crc32: long>>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([(x, pa.int64()) for x in ("start", "length", "ids_crc32")])
        encode = Encoder(name)
        for batch in batches:
            ends, rows = [0], []
            for text in batch:
                ids = encode(text.as_py())
                rows += [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in cuts(len(ids), capacity)]
                ends.append(len(rows))
            flat = np.array(rows, np.int64).reshape(-1, 3)
            values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return pieces(text)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each size, bins from 0.

    Open bins are kept by free room; a bit mask of the rooms in use finds the
    tightest one that is large enough.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        rooms[room - size].append(b)
        if room > size:
            mask |= 1 << (room - size)
    return bins, offsets


def _exact_pair(there: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two sizes that fill ``room``, as even as they come, or None."""
    found = np.flatnonzero(there[1 : room // 2 + 1] & there[room - 1 : room - room // 2 - 1 : -1])[::-1][:2] if room > 1 else ()
    for a in found:
        x = int(a) + 1
        if 2 * x != room or counts[x] > 1:
            return x, room - x
    return None


def best_sets(sizes: np.ndarray, capacity: int = CAPACITY, tried: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit by sets: (bin, offset) of each size.

    The largest size left opens a bin. What fits its room best is taken: one
    size, two or three that fill it, else the single size or pair that leaves
    the least room.
    """
    order = np.argsort(-sizes, kind="stable")
    counts = np.bincount(sizes, minlength=capacity + 1)
    there = counts > 0
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    at = np.concatenate([[0], np.cumsum(counts[::-1])])[::-1][1:].copy()
    n, top = -1, capacity

    def take(size: int, room: int) -> int:
        item = order[at[size]]
        at[size] += 1
        counts[size] -= 1
        there[size] = counts[size] > 0
        bins[item], offsets[item] = n, capacity - room
        return room - size

    def three(room: int) -> list[int] | None:
        for a in (np.flatnonzero(there[1 : room - 1]) + 1)[::-1][:tried].tolist() if room > 2 else ():
            counts[a] -= 1
            there[a] = counts[a] > 0
            pair = _exact_pair(there, counts, room - a)
            counts[a] += 1
            there[a] = True
            if pair:
                return [a, *pair]
        return None

    while True:
        while top > 0 and not counts[top]:
            top -= 1
        if not top:
            return bins, offsets
        n += 1
        room = take(top, capacity)
        while room:
            if there[room]:
                chosen = [room]
            else:
                pair = _exact_pair(there, counts, room)
                chosen = list(pair) if pair else three(room)
            if not chosen:
                fits = np.flatnonzero(there[1 : room + 1])
                if not len(fits):
                    break
                chosen = [int(fits[-1]) + 1]
                for slack in range(1, room - chosen[0]):
                    pair = _exact_pair(there, counts, room - slack)
                    if pair:
                        chosen = list(pair)
                        break
            for size in chosen:
                room = take(size, room)


def fewest(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The better of best-fit decreasing and best-fit by sets."""
    one, two = best_fit(sizes, capacity), best_sets(sizes, capacity)
    return one if one[0].max(initial=-1) <= two[0].max(initial=-1) else two


_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, part int, closed boolean"


def _round(level: int, capacity: int, nearly_full: int, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        rows = rows.sort_by([(c, "ascending") for c in ("bin", "offset", "doc_id", "piece", "ids_crc32")])
        length, bins, offset = (rows[c].to_numpy() for c in ("length", "bin", "offset"))
        item = np.arange(len(length)) if level == 0 else np.unique(bins, return_inverse=True)[1]
        size = np.zeros(item.max() + 1, np.int64)
        np.maximum.at(size, item, offset + length)
        to, shift = fewest(size, capacity)
        fill = np.bincount(to, weights=size).astype(np.int64)
        closed = fill >= nearly_full
        waiting = np.flatnonzero(~closed)
        closed[waiting[np.argsort(fill[waiting], kind="stable")[carry:]]] = True
        part = TaskContext.get().partitionId()
        base = (level << 54) + (part << 30)
        out = {
            **{c: rows[c].combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
            "bin": pa.array(base + to[item]),
            "offset": pa.array(offset + shift[item]),
            "part": pa.array(np.full(len(item), part, np.int32)),
            "closed": pa.array(closed[to[item]]),
        }
        yield from pa.table(out).to_batches(max_chunksize=10_000)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: int | None = None, per_task: int = PER_TASK, fan_in: int = FAN_IN, carry: int = CARRY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to (doc_id, piece, start, length, ids_crc32)."""
    nearly_full = capacity * NEARLY_FULL // CAPACITY if nearly_full is None else nearly_full
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") >= capacity).select(*keep, (F.monotonically_increasing_id() + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < capacity)
    n, level, out = max(1, -(-items.count() // per_task)), 0, full
    key = F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.monotonically_increasing_id())  # equal rows are spread
    now = items.select(*keep, F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"), key.alias("to"))
    while True:
        dealt = now.repartition(n, "to") if n > 1 else now.repartition(1)
        # Bins are named by the task that makes them, so its partitions stay apart.
        packed = checkpoint(dealt.drop("to").mapInArrow(_round(level, capacity, nearly_full if n > 1 else 0, carry), _ITEM), files=1 << 30)
        out = out.union(packed.where("closed").select(*keep, F.col("bin").alias("sequence_id"), "offset"))
        if n == 1:
            return out
        n, level = -(-n // fan_in), level + 1
        now = packed.where("not closed").select(*keep, "bin", "offset", (F.col("part") % n).alias("to"))


def packed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenise and pack whole documents: the op3 query."""
    found = docs.select(col(key).cast("long").alias("doc_id"), F.posexplode(pieces_of(col(text))).alias("piece", "p"))
    pieces = checkpoint(found.select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32"))
    return pack(pieces)
