"""Edit-aware token counts with a segment tree over pre-tokens.

A document's pre-tokens are grouped in leaves; each tree node holds the
characters and tokens below it. An edit walks down to its place, re-encodes only
from a little before it to the point where old and new pre-token boundaries
meet again, and updates the sums on the way up. The split into pre-tokens
depends only on what follows a boundary, so beyond that point nothing changes;
before it, a pre-token can see at most ``CONTEXT`` characters, or an added token,
past its end. An added token (such as the end-of-text marker) is one token.

Counts of single pre-tokens are remembered in a bounded table. Edits apply in
order, each to the text the ones before it left.

Edge cases: null text is empty; null or empty edits change nothing; positions
are clipped to the text. Repeated documents are counted once each; edits at one
place apply in their order. Texts of any length are split in stretches; a leaf
keeps numbers, not strings. An empty table gives an empty result. Other columns,
whatever their names, are not used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreemill.llm.common import col, small_batches
from agreemill.llm.packing import VOCABULARY, added_tokens, stretches

LEAF = 64
CONTEXT = 3
CACHE_WORDS = 300_000


class Counter(dict):
    """Tokens of a pre-token; forgotten when there are too many."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.added = added_tokens(name)
        self.marker = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")
        self.context = max([CONTEXT, *map(len, self.added)])
        self.update(dict.fromkeys(self.added, 1))

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update(dict.fromkeys(self.added, 1))
        self[piece] = n = len(self.encode(piece))
        return n

    def pieces(self, text: str, begin: int = 0) -> Iterator[tuple[int, int]]:
        """(start, end) of the pre-tokens from a boundary on; added tokens are cut out first."""
        for mark in chain(self.marker.finditer(text, begin), [None]):
            stop = mark.start() if mark else len(text)
            for m in self.pattern.finditer(text, begin, stop):
                yield m.span()
            if mark:
                yield mark.span()
                begin = mark.end()

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of each pre-token."""
        chars, tokens = [], []
        for part in stretches(text):
            marked = any(x in part for x in self.added)
            pieces = [part[a:b] for a, b in self.pieces(part)] if marked else self.pattern.findall(part)
            chars.append(np.fromiter(map(len, pieces), np.int32, len(pieces)))
            tokens.append(np.fromiter(map(self.__getitem__, pieces), np.int32, len(pieces)))
        return (np.concatenate(chars), np.concatenate(tokens)) if chars else (np.zeros(0, np.int32), np.zeros(0, np.int32))


class Document:
    """A text with its pre-token segment tree."""

    def __init__(self, text: str | None, counter: Counter, leaf: int = LEAF):
        self.counter, self.leaf = counter, leaf
        self.text = text or ""
        self.reencoded = 0
        self._build(*counter.split(self.text))

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves: list[tuple[np.ndarray, np.ndarray]] = [(chars[i : i + self.leaf], tokens[i : i + self.leaf]) for i in range(0, max(1, len(chars)), self.leaf)]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        starts = np.arange(0, len(chars), self.leaf)
        if len(chars):
            self.sums[self.size : self.size + len(starts), 0] = np.add.reduceat(chars.astype(np.int64), starts)
            self.sums[self.size : self.size + len(starts), 1] = np.add.reduceat(tokens.astype(np.int64), starts)
        level = self.size
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pretokens(self) -> int:
        return sum(len(c) for c, _ in self.leaves)

    def tokens_before(self, position: int) -> int:
        """Tokens of the pre-tokens that end at or before a character position."""
        k, at, tokens = self._leaf(position)
        ends = at + np.cumsum(self.leaves[k][0])
        return int(tokens + self.leaves[k][1][ends <= position].sum())

    def _leaf(self, position: int) -> tuple[int, int, int]:
        """(leaf, its first character, tokens before it) at a position."""
        node, at, tokens = 1, 0, 0
        while node < self.size:
            node *= 2
            chars = self.sums[node, 0]
            if position - at >= chars and self.sums[node + 1, 0] > 0:
                at, tokens, node = at + chars, tokens + self.sums[node, 1], node + 1
        return node - self.size, int(at), int(tokens)

    def _set(self, k: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves[k] = chars, tokens
        node = k + self.size
        self.sums[node] = chars.sum(dtype=np.int64), tokens.sum(dtype=np.int64)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, length: int, replacement: str | None) -> None:
        """Replace ``length`` characters at ``start``."""
        replacement = replacement or ""
        start = min(max(0, start), len(self.text))
        stop = min(max(start, start + length), len(self.text))
        if start == stop and not replacement:
            return
        new = f"{self.text[:start]}{replacement}{self.text[stop:]}"
        shift, settled = len(new) - len(self.text), start + len(replacement)
        context = self.counter.context
        first, at, _ = self._leaf(max(0, start - context))
        chars, tokens = self.leaves[first]
        ends = at + np.cumsum(chars)
        keep = int((ends < start - context + 1).sum())
        begin = int(ends[keep - 1]) if keep else at
        last, last_at, _ = self._leaf(stop)
        old_ends = self._ends(last, last_at)
        old = next(old_ends)
        done_chars, done_tokens, joined = [], [], None
        for a, b in self.counter.pieces(new, begin):
            done_chars.append(b - a)
            done_tokens.append(self.counter[new[a:b]])
            self.reencoded += b - a
            if b >= settled:
                while old is not None and old[0] + shift < b:
                    old = next(old_ends, None)
                if old is None:
                    break
                if old[0] + shift == b and old[0] >= stop:
                    joined = old
                    break
        self.text = new
        if joined is None:
            through, rest = len(self.leaves) - 1, (np.zeros(0, np.int32), np.zeros(0, np.int32))
        else:
            through, cut = joined[1], joined[2]
            rest = (self.leaves[through][0][cut:], self.leaves[through][1][cut:])
        merged = [np.concatenate([a[:keep], np.array(b, np.int32), c]) for a, b, c in zip((chars, tokens), (done_chars, done_tokens), rest, strict=True)]
        empty = np.zeros(0, np.int32)
        for k in range(first + 1, through + 1):
            if len(self.leaves[k][0]):
                self._set(k, empty, empty)
        self._set(first, *merged)
        if len(merged[0]) > 8 * self.leaf:
            self._build(*(np.concatenate([x[i] for x in self.leaves]) for i in range(2)))

    def _ends(self, k: int, at: int) -> Iterator[tuple[int, int, int]]:
        """Old boundaries from the start of leaf ``k``: (position, leaf, pre-tokens of it before)."""
        yield at, k, 0
        for i, (chars, _) in islice(enumerate(self.leaves), k, None):
            for j, c in enumerate(chars.tolist(), 1):
                at += c
                yield at, i, j


def recount(text: str | None, edits: list[tuple[int, int, str | None]] | None, counter: Counter) -> tuple[int, int, int, int, int]:
    """(tokens before, tokens after, pre-tokens after, characters after, characters re-encoded)."""
    doc = Document(text, counter)
    before = doc.tokens
    for start, length, replacement in edits or []:
        doc.edit(start or 0, length or 0, replacement)
    return before, doc.tokens, doc.pretokens, len(doc.text), doc.reencoded


_NAMES = ("tokens_before", "tokens_after", "pretokens", "chars", "reencoded_chars")


def edited_counts(text: Column, edits: Column) -> Column:
    """struct of counts of a text and an array of struct(start, length, text) edits."""
    small_batches()
    kind = ", ".join(f"{n}: long" for n in _NAMES)

    @F.arrow_udf(f"struct<{kind}>")
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        counter = Counter()
        for texts, changes in batches:
            rows = [recount(t.as_py(), [(e["start"], e["length"], e["text"]) for e in (c.as_py() or []) if e], counter) for t, c in zip(texts, changes, strict=True)]
            flat = np.array(rows, np.int64).reshape(-1, len(_NAMES))
            yield pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(len(_NAMES))], list(_NAMES))

    return count(text, edits)


def sample_edits(text: Column, key: Column) -> Column:
    """Four edits a document, spread over it and varied by its key: an
    insertion, a replacement, a deletion and an addition at the end."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    k = F.coalesce(F.pmod(key, F.lit(7)), F.lit(0)).cast("int")

    def edit(start: Column, length: Column, new: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), new.alias("text"))

    return F.array(
        edit(F.floor(n / 4), F.lit(0), F.concat(F.lit(" revised'll "), k.cast("string"))),
        edit(F.floor(n / 2), k, F.lit("it's 42  new\n")),
        edit(F.floor(n * 3 / 4), k + 9, F.lit("")),
        edit(n + 20, F.lit(0), F.lit(" End.")),
    )


def edited_documents(docs: DataFrame) -> DataFrame:
    """The op8 query: every document's counts before and after four edits."""
    counts = docs.select("doc_id", edited_counts(col("text"), sample_edits(col("text"), col("doc_id"))).alias("c"))
    return counts.select("doc_id", *[F.col("c")[n].alias(n) for n in _NAMES])
