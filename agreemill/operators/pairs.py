"""Pair generation and pairwise cosines.

All-pairs scores are dealt as tiles: vectors are split over ``blocks`` by hash,
each tile of two blocks is one group, and its scores are one matrix product. A
vector is sent once for each block, not once for each partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agreemill.operators.ranks import positions

TILE_ROWS = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """A list column of equal lengths as an (n, d) double matrix, without copies of rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def all_pairs(vectors: DataFrame, key: str, label: str, feat: str, blocks: int | None = None) -> DataFrame:
    """(a, b, within, score) of all pairs a < b: labels equal, dot product to
    six decimals. The result is quadratic by definition; the shuffle is not."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(feat).alias("feat"))
    if blocks is None:
        blocks = max(1, -(-rows.count() // TILE_ROWS))
    own = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    mine = F.explode(F.filter(every, lambda j: j >= F.col("block"))).alias("y")
    theirs = F.explode(F.filter(every, lambda i: i <= F.col("block"))).alias("x")
    left = own.select(F.col("block").alias("x"), mine, F.col("id").alias("a"), F.col("label").alias("la"), F.col("feat").alias("fa"))
    right = own.select(theirs, F.col("block").alias("y"), F.col("id").alias("b"), F.col("label").alias("lb"), F.col("feat").alias("fb"))

    def score(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "within": pa.array([], pa.bool_()), "score": pa.array([], pa.float64())})
        same = p["x"][0].as_py() == p["y"][0].as_py()
        ia, ib, la, lb = p["a"].to_numpy(), q["b"].to_numpy(), p["la"].to_numpy(), q["lb"].to_numpy()
        dots = matrix(p["fa"], p.num_rows) @ matrix(q["fb"], q.num_rows).T
        i, j = np.nonzero(ia[:, None] < ib[None]) if same else np.indices(dots.shape).reshape(2, -1)
        one, two = ia[i], ib[j]
        return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two), "within": la[i] == lb[j], "score": np.round(dots[i, j], 6)})

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(score, "a long, b long, within boolean, score double")


#: Vectors of a block whose pairs are only counted, dots made at a time, and the
#: scores of a page of counts and the pages that a task holds.
COUNT_ROWS = 32_768
COUNT_CELLS = 1_000_000
PAGE, MAX_PAGES = 65_536, 128


class ScoreCounts:
    """Pairs by score of six decimals, all and those of equal labels, in pages of
    the scores that occur."""

    def __init__(self) -> None:
        self.pages: dict[int, np.ndarray] = {}
        self.odd: dict[float, np.ndarray] = {}  # not finite, or beyond exact integers

    def add(self, scaled: np.ndarray, kind: int, times: int = 1) -> None:
        """``scaled``: rounded millionths; ``kind``: 0 all, 1 within."""
        if not scaled.size:
            return
        low, high = scaled.min(), scaled.max()
        if not (-(2.0**52) < low and high < 2.0**52) or high - low > 64 * PAGE:
            plain = np.isfinite(scaled) & (np.abs(scaled) < 2.0**52)
            for v, n in zip(*np.unique(scaled[~plain], return_counts=True), strict=True):
                self.odd.setdefault(float(v), np.zeros(2, np.int64))[kind] += times * n
            for v, n in zip(*np.unique(scaled[plain].astype(np.int64), return_counts=True), strict=True):
                self._page(int(v) // PAGE)[kind, int(v) % PAGE] += times * n
            return
        first = int(low) // PAGE
        n = np.bincount((scaled - first * PAGE).astype(np.int64).ravel())
        for k in range(0, len(n), PAGE):
            part = n[k : k + PAGE]
            self._page(first + k // PAGE)[kind, : len(part)] += times * part

    def _page(self, k: int) -> np.ndarray:
        if k not in self.pages:
            self.pages[k] = np.zeros((2, PAGE), np.int64)
        return self.pages[k]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(score, pos, neg) of what was counted; it starts anew."""
        for k, (every, within) in sorted(self.pages.items()):
            at = np.flatnonzero(every)
            yield _counted((k * PAGE + at) / 1e6, within[at], every[at] - within[at])
        for v, (every, within) in self.odd.items():
            yield _counted(np.array([v]) / 1e6, np.array([within]), np.array([every - within]))
        self.pages, self.odd = {}, {}


def _counted(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(score + 0.0), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], ["score", "pos", "neg"])


def count_tile(counts: ScoreCounts, p: tuple, q: tuple | None) -> None:
    """Count the pairs of two blocks (ids, label codes, matrix), or with ``q`` None
    those inside one. Rows are in order of label."""
    ids, la, a = p
    lb, b = (la, a) if q is None else q[1:]
    step = max(1, COUNT_CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        end = min(len(a), at + step)
        s = a[at:end] @ (b[at:] if q is None else b).T
        s *= 1e6
        np.rint(s, out=s)
        others = lb[at:] if q is None else lb
        if q is None:  # the square on the diagonal holds each pair twice
            n = end - at
            i, j = np.triu_indices(n, 1)
            counts.add(s[i, j], 0)
            counts.add(s[i, j][la[at + i] == la[at + j]], 1)
            s, others = s[:, n:], others[n:]
        counts.add(s, 0)
        runs = np.flatnonzero(np.diff(la[at:end], prepend=la[at] - 1))
        for i, j in zip(runs, [*runs[1:], end - at], strict=True):
            lo, hi = np.searchsorted(others, la[at + i], "left"), np.searchsorted(others, la[at + i], "right")
            counts.add(s[i:j, lo:hi], 1)
    if q is None:  # rows of one id are no pair
        _, same, n = np.unique(ids, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(n > 1):
            rows = np.flatnonzero(same == k)
            i, j = np.triu_indices(len(rows), 1)
            s = np.rint((a[rows] @ a[rows].T)[i, j] * 1e6)
            counts.add(s, 0, -1)
            counts.add(s[la[rows[i]] == la[rows[j]]], 1, -1)


def pair_score_counts(vectors: DataFrame, key: str, label: str, feat: str, blocks: int | None = None, tasks: int | None = None) -> DataFrame:
    """(score, pos, neg): how many pairs a < b of equal and of other labels have each
    dot product of six decimals. No pair is a row: a task counts its tiles of two
    blocks and hands on its counts. Rows without a label are in no pair."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.xxhash64(label).alias("label"), F.col(feat).alias("feat")).where(F.col(label).isNotNull())
    cores = spark.sparkContext.defaultParallelism
    if blocks is None:
        n = rows.count()
        blocks = max(1, -(-n // COUNT_ROWS), min(-(-n // TILE_ROWS), int((8 * cores) ** 0.5) + 1))
    tasks = tasks or max(1, min(blocks * (blocks + 1) // 2, 4 * cores))
    own = rows.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    met = F.explode(F.transform(every, lambda j: F.struct(F.least("_block", j).alias("x"), F.greatest("_block", j).alias("y"))))
    sent = own.select("id", "label", "feat", "_block", met.alias("t")).select("t.x", "t.y", "_block", "id", "label", "feat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, now = ScoreCounts(), {}, None

        def done() -> None:
            sides = []
            for k in sorted(held):
                t = pa.Table.from_batches(held.pop(k)).sort_by("label")
                sides.append((k, (t["id"].to_numpy(), t["label"].to_numpy(), matrix(t["feat"], t.num_rows))))
            if now[0] == now[1]:
                count_tile(counts, sides[0][1], None)
            elif len(sides) == 2:
                count_tile(counts, sides[0][1], sides[1][1])

        for batch in batches:
            x, y, block = (batch[c].to_numpy() for c in ("x", "y", "_block"))
            cuts = [0, *(np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(block) != 0)) + 1), batch.num_rows] if batch.num_rows else []
            for start, stop in zip(cuts, cuts[1:], strict=False):
                tile = (int(x[start]), int(y[start]))
                if now is not None and tile != now:
                    done()
                    if len(counts.pages) > MAX_PAGES or len(counts.odd) > PAGE:
                        yield from counts.rows()
                now = tile
                held.setdefault(int(block[start]), []).append(batch.slice(start, stop - start))
        if now is not None:
            done()
        yield from counts.rows()

    dealt = sent.repartition(tasks, "x", "y").sortWithinPartitions("x", "y", "_block")
    return dealt.mapInArrow(run, "score double, pos long, neg long").groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg > 0")


def hashed_cross_sample(df: DataFrame, group: str, key: str, k: int, steps: tuple[int, int] = (7919, 104729), modulus: int = 1_000_003, blocks: int | None = None) -> DataFrame:
    """(a, b, draw): the ``k`` cross pairs, a in the smaller group, of least draw, a
    sum of the two integer keys' multiples modulo ``modulus``; ties by a, then b.

    The draw ranks all cross pairs, so all are tried, in tiles of blocks; a tile
    hands on its own ``k`` at most. ``unranked`` draws without trying any.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(group).alias("g")).where("id IS NOT NULL AND g IS NOT NULL")
    if blocks is None:
        blocks = max(1, -(-rows.count() // TILE_ROWS))
    own = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left, right = own.select(F.col("block").alias("x"), every.alias("y"), "id", "g"), own.select(every.alias("x"), F.col("block").alias("y"), "id", "g")

    def least(p: pa.Table, q: pa.Table) -> pa.Table:
        one, two = p["id"].to_numpy(), q["id"].to_numpy()
        order = np.unique(np.concatenate([p["g"].to_numpy(zero_copy_only=False), q["g"].to_numpy(zero_copy_only=False)]), return_inverse=True)[1]
        draw = (one[:, None] * steps[0] % modulus + two[None] * steps[1] % modulus) % modulus
        i, j = np.nonzero(order[: len(one), None] < order[None, len(one) :])
        if len(i) > k:  # all at or under the k-th draw, so that ties are whole
            small = draw[i, j]
            i, j = (x[small <= np.partition(small, k - 1)[k - 1]] for x in (i, j))
        best = np.lexsort((two[j], one[i], draw[i, j]))[:k]
        return pa.table({"a": one[i][best], "b": two[j][best], "draw": draw[i, j][best]})

    tiles = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(least, "a long, b long, draw long")
    return tiles.orderBy("draw", "a", "b").limit(k)


def pools(df: DataFrame, group: str, order: str) -> DataFrame:
    """Each row's position in its group, from 0."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def within_pairs(pool: DataFrame, group: str, key: str) -> DataFrame:
    """(group, a, b, i, j) of all pairs of a group, i < j: a self equi-join on tiles
    of two blocks of TILE_ROWS positions, so that a group is many tasks and only
    the tiles at the diagonal meet pairs that go."""
    block = F.floor(F.col("pos") / TILE_ROWS).cast("int")
    own = pool.select(group, F.col(key), "pos", block.alias("_block"))
    last = own.groupBy(group).agg(F.max("_block").alias("_last"))
    sized = own.join(last, group)
    left = sized.select(group, F.col("_block").alias("_x"), F.explode(F.sequence("_block", "_last")).alias("_y"), F.col(key).alias("a"), F.col("pos").alias("i"))
    right = own.select(group, F.explode(F.sequence(F.lit(0), "_block")).alias("_x"), F.col("_block").alias("_y"), F.col(key).alias("b"), F.col("pos").alias("j"))
    return left.join(right, [group, "_x", "_y"]).where("i < j").drop("_x", "_y")


def even_stride(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """``k`` rows of each group at even strides, floor(n / k * i)."""
    sized = pools(df, group, order).join(df.groupBy(group).agg(F.count("*").alias("n_rows")), group)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(F.col("n_rows") / F.lit(float(k)) * i))
    return sized.where(F.array_contains(wanted, F.col("pos").cast("bigint")))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays in double, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


#: Groups whose sizes, and ordinals whose values, the driver holds and sends.
MAX_GROUPS = 1_000_000
MAX_DRAWN = 10_000_000


def sampled_pool(size: int, k: int, seed: int) -> list[int]:
    """Ordinals drawn without replacement from an enumerated pool."""
    return np.random.default_rng(seed).choice(size, size=min(k, size), replace=False).tolist()


class CrossPool:
    """All pairs of members of different groups, enumerated but not made.

    Groups are in order, and so are the members of each. Pairs are counted by
    first group, second group, first member, second member; an ordinal is turned
    into them by the sizes alone.
    """

    def __init__(self, sizes: np.ndarray):
        self.sizes = np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        later = self.ends[-1] - self.ends if len(self.ends) else self.sizes
        if sum(int(a) * int(b) for a, b in zip(self.sizes, later, strict=True)) >= 2**62:
            raise ValueError("the pool has too many pairs to count")
        self.starts = np.cumsum(np.concatenate([[0], self.sizes * later]))

    def __len__(self) -> int:
        return int(self.starts[-1])

    def pairs(self, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first group, second group, first member, second member) of ordinals."""
        ordinals = np.asarray(ordinals, np.int64)
        one = np.searchsorted(self.starts, ordinals, side="right") - 1
        rest = ordinals - self.starts[one]
        # the second group holds sizes[one] pairs for each of its members
        behind = self.ends[one] + rest // self.sizes[one]
        two = np.searchsorted(self.ends, behind, side="right")
        rest -= (self.ends[two] - self.sizes[two] - self.ends[one]) * self.sizes[one]
        return one, two, rest // self.sizes[two], rest % self.sizes[two]


def cross_pool(df: DataFrame, group: str) -> tuple[CrossPool, list]:
    """The pool of a table and its groups in order. The sizes of at most
    MAX_GROUPS groups are collected."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"a cross pool has at most {MAX_GROUPS} groups")
    ordered = sorted(sizes, key=lambda r: r[group])
    return CrossPool(np.array([r["n"] for r in ordered], np.int64)), [r[group] for r in ordered]


def unranked(df: DataFrame, group: str, key: str, ordinals: DataFrame) -> DataFrame:
    """(ordinal, group_a, a, group_b, b): the pairs of an enumerated cross pool
    that ``ordinals`` (a column ``ordinal``) names, members in order of a distinct
    ``key``. The pool itself is never made: ordinals become group and position,
    and members are found by two key joins. Ordinals beyond the pool go."""
    pool, names = cross_pool(df, group)
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(pool)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o = batch["ordinal"].to_numpy()
            o = o[(o >= 0) & (o < len(sent.value))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (o, *sent.value.pairs(o))], ["ordinal", "ga", "gb", "ia", "ib"])

    turned = ordinals.select(F.col("ordinal").cast("long").alias("ordinal")).mapInArrow(turn, "ordinal long, ga long, gb long, ia long, ib long")
    kind = df.schema[group].dataType.simpleString()
    numbers = spark.createDataFrame(list(enumerate(names)), f"g long, _group {kind}")
    members = positions(df.where(F.col(group).isNotNull()).select(F.col(group).alias("_group"), F.col(key).alias("_key")), "_group", "_key").join(numbers, "_group")
    side = lambda x: members.select(F.col("g").alias(f"g{x}"), F.col("pos").cast("long").alias(f"i{x}"), F.col("_group").alias(f"group_{x}"), F.col("_key").alias(x))
    return turned.join(side("a"), ["ga", "ia"]).join(side("b"), ["gb", "ib"]).select("ordinal", "group_a", "a", "group_b", "b")


def cross_sample(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """``k`` cross pairs (all, if fewer) drawn without replacement by the seeded
    generator from the enumerated pool; at most MAX_DRAWN."""
    if k > MAX_DRAWN:
        raise ValueError(f"at most {MAX_DRAWN} pairs are drawn by the generator; name ordinals by a rule instead")
    pool, _ = cross_pool(df, group)
    drawn = np.array(sampled_pool(len(pool), k, seed) if len(pool) else [], np.int64)
    ordinals = df.sparkSession.createDataFrame(pa.table({"ordinal": drawn}))
    return unranked(df, group, key, ordinals)
