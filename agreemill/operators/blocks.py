"""Seeded replicates of rated tables above memory.

The draws are those of ``resample``: NumPy's generator for a table id, over row
positions or clusters. Rows are dealt by range of a label's values, so that a task
ranks its own block; it runs the generator through and keeps what falls on its
rows. No table, draw or multiplicity is sent or stored. Per replicate a block hands
on its totals by human rating: counts and centred local ranks of the values that
only it holds, and counts of its first and last value, which its neighbours may
share. Ranks, moments and ranges of the whole are sums over these few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from agreemill.operators.ranks import bucket_count, running_totals
from agreemill.operators.resample import HUMAN, generator
from agreemill.session import kept

#: Blocks of a table that is not small: each runs through all draws, so the work is
#: their number times the table. Rows of a block at least, and at most.
BLOCKS, LEAST_ROWS, BLOCK_ROWS = 6, 20_000, 10_000_000
#: Labels of more distinct values than this are ranked in blocks of their own range.
LEVELS = 256
#: Draws made at a time, rows handed on at a time, and the most borders of positions.
DRAWN, SENT_ROWS, MAX_BORDERS = 1_000_000, 20_000, 64

RANK, MOMENT, RANGE = 0, 1, 2
_SCHEMA = "label string, kind int, low double, one boolean, b int, v double, c double, s double, q double"
_KIND = pa.schema([("label", pa.string()), ("kind", pa.int32()), ("low", pa.float64()), ("one", pa.bool_()), ("b", pa.int32()), *((k, pa.float64()) for k in "vcsq")])


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Add ``name``, a row's position from 0 by ``order``, nulls last. Rows of a
    numeric order are dealt by fixed borders, so nothing is written."""
    if not isinstance(df.schema[order].dataType, NumericType):
        return running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"]).select(*df.columns, F.col("_one_below").alias(name))
    k = min(MAX_BORDERS, bucket_count(df))
    borders = sorted(set(df.agg(F.percentile_approx(order, [i / k for i in range(1, k)])).first()[0] or []))
    above = sum(((F.col(order) > F.lit(x)).cast("int") for x in borders), F.lit(0))
    dealt = df.withColumn("_bucket", F.coalesce(above, F.lit(len(borders))))
    sizes = dict(dealt.groupBy("_bucket").count().collect())
    starts = np.cumsum([0, *(sizes.get(i, 0) for i in range(len(borders)))]).tolist()
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(order).asc_nulls_last())) - 1
    return dealt.withColumn(name, F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_bucket")) + inside).drop("_bucket")


class Drawn:
    """Multiplicities of a block's rows, replicate after replicate."""

    def __init__(self, table_id: str, n_units: int, unit: np.ndarray):
        self.rng, self.n = generator(table_id), n_units
        own, self.row = np.unique(unit, return_inverse=True)
        self.size = len(own)
        self.mine, self.slot = np.zeros(n_units, bool), np.zeros(n_units, np.int32)
        self.mine[own], self.slot[own] = True, np.arange(self.size, dtype=np.int32)

    def next(self) -> np.ndarray:
        found = []
        for at in range(0, self.n, DRAWN):
            d = self.rng.integers(0, self.n, size=min(DRAWN, self.n - at))
            found.append(self.slot[d[self.mine.take(d, mode="clip")]])
        return np.bincount(np.concatenate(found), minlength=self.size).astype(float)[self.row]


class Block:
    """A block's rows in order of ``ranked`` (None: any), and its totals."""

    def __init__(self, columns: dict[str, np.ndarray], ranked: str | None, plain: list[str], human: bool, shift: dict[str, float]):
        self.ranked, self.shift = ranked, shift
        self.pairs = {k: (k, None) for k in plain} | ({HUMAN: ("g1", "g2")} if human else {})
        keys, code = ["g1", "g2", *plain], np.zeros(len(columns["g1"]), np.int64)
        for k in keys:
            values, index = np.unique(columns[k], return_inverse=True)
            code = np.unique(code * len(values) + index, return_inverse=True)[1]
        self.cell, first = code, np.unique(code, return_index=True)[1]
        self.of = {k: columns[k][first] for k in keys}  # values of each cell
        self.h = (self.of["g1"] + self.of["g2"]) / 2
        self.n_cells = len(first)
        if ranked:
            self.x = columns[ranked]
            starts = np.flatnonzero(np.concatenate([[True], np.diff(self.x) != 0])) if not np.isnan(self.x).any() else np.unique(self.x, return_index=True)[1]
            self.first, self.last = (starts[1] if len(starts) > 1 else len(self.x)), starts[-1]
            self.starts = starts[1:-1] - self.first
            self.group = np.repeat(np.arange(len(self.starts)), np.diff(starts[1:])) if len(self.starts) else None
            self.centred = self.x - shift[ranked]

    def _by_cell(self, weights: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        return np.bincount(self.cell[start:stop], weights=weights, minlength=self.n_cells)

    def rows(self, counts: np.ndarray) -> Iterator[tuple]:
        """(label, kind, low, one, v, c, s, q) as arrays and numbers."""
        every = self._by_cell(counts)
        g1, g2 = self.of["g1"] - self.shift["g1"], self.of["g2"] - self.shift["g2"]
        human = [every @ z for z in (np.ones(self.n_cells), g1, g1 * g1, g2, g2 * g2)]
        for label, (u, v) in self.pairs.items():
            yield label, RANK, self.of[u], True, self.of[v] if v else self.h, every, 0.0, 0.0
            x = self.of[u] - self.shift[u]
            yield label, MOMENT, 0.0, True, np.arange(9.0), np.array([*human, every @ x, every @ (x * x), every @ (x * g1), every @ (x * g2)]), 0.0, 0.0
            seen = self.of[u][every > 0]
            if len(seen):
                yield label, RANGE, 0.0, True, 0.0, 0.0, seen.min(), seen.max()
        if not self.ranked:
            return
        one, two = self._by_cell(counts * self.centred), self._by_cell(counts * self.centred * self.centred)
        yield self.ranked, MOMENT, 0.0, True, np.arange(9.0), np.array([*human, one.sum(), two.sum(), one @ g1, one @ g2]), 0.0, 0.0
        seen = self.x[counts > 0]
        if len(seen):
            yield self.ranked, RANGE, 0.0, True, 0.0, 0.0, seen.min(), seen.max()
        yield self.ranked, RANK, self.x[0], True, self.h, self._by_cell(counts[: self.first], 0, self.first), 0.0, 0.0
        if self.last:
            yield self.ranked, RANK, self.x[-1], True, self.h, self._by_cell(counts[self.last :], self.last), 0.0, 0.0
        if self.group is not None:
            k = counts[self.first : self.last]
            of = np.add.reduceat(k, self.starts)
            rank = (np.cumsum(of) - of / 2 - of.sum() / 2)[self.group]  # about the middle of the block
            c, s, q = (self._by_cell(w, self.first, self.last) for w in (k, k * rank, k * rank * rank))
            yield self.ranked, RANK, self.x[self.first], False, self.h, c, s, q


def _records(b: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for label, kind, low, one, v, c, s, q in rows:
        low, v, c, s, q = np.broadcast_arrays(*(np.asarray(z, float).reshape(-1) for z in (low, v, c, s, q)))
        if kind == RANK:  # what was not drawn has no rank
            low, v, c, s, q = (z[c > 0] for z in (low, v, c, s, q))
        n = len(c)
        yield pa.RecordBatch.from_arrays([pa.array([label] * n, pa.string()), pa.array(np.full(n, kind, np.int32)), pa.array(low), pa.array(np.full(n, one)), pa.array(np.full(n, b, np.int32)), *(pa.array(z) for z in (v, c, s, q))], schema=_KIND)


def replicates(df: DataFrame, rows: dict[str, bool], table_id: str, total: int, cluster: str | None = None, human: bool = True, order: str = "row_idx", blocks: int | None = None) -> DataFrame:
    """(label, stat, b, value): ``resample.rated_replicates`` of a table of any size.

    ``df``: ``order``, g1, g2, a column for each of ``rows`` (label -> ordinal) and
    ``cluster``, whose values are drawn whole. b = -1 is the point on the table.
    Human ratings are expected to have few distinct values: a block hands on a row
    for each of them (for the human label, of each pair) and replicate.
    """
    spark, values = df.sparkSession, ["g1", "g2", *rows]
    number = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(float("nan"))).alias(k)
    table = df.select(F.col(order).alias("_order"), *([F.col(cluster).alias("_cluster")] if cluster else []), *[number(k) for k in values])
    found = table.agg(F.count("*").alias("n"), *[F.percentile_approx(k, 0.5).alias(f"m_{k}") for k in values], *[F.approx_count_distinct(k).alias(f"d_{k}") for k in values]).first()
    n, shift = found["n"], {k: found[f"m_{k}"] or 0.0 for k in values}
    if cluster:
        names = numbered(table.select("_cluster").distinct(), "_cluster", "_unit").withColumnRenamed("_cluster", "_name")
        n_units, table_id = names.count(), f"{table_id}|cluster"
        placed = table.join(names, F.col("_cluster").eqNullSafe(F.col("_name"))).drop("_cluster", "_name", "_order")
    else:
        n_units, placed = n, numbered(table, "_order", "_unit").drop("_order")
    own = [k for k in rows if found[f"d_{k}"] > LEVELS]
    plain = [k for k in rows if k not in own]
    blocks = blocks or max(1, min(BLOCKS, -(-n // LEAST_ROWS)), -(-n // BLOCK_ROWS))

    def totals(ranked: str | None, plain: list[str], human: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [x for x in batches if x.num_rows]
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            at = np.argsort(t[ranked].to_numpy(), kind="stable") if ranked else slice(None)
            columns = {k: t[k].to_numpy()[at] + 0.0 for k in t.column_names if k != "_unit"}
            drawn = Drawn(table_id, n_units, t["_unit"].to_numpy()[at])
            del t, parts
            block = Block(columns, ranked, plain, human, shift)
            held: list[pa.RecordBatch] = []
            for b in range(-1, total):
                held += _records(b, block.rows(drawn.next() if b >= 0 else np.ones(len(block.cell))))
                if b == total - 1 or sum(x.num_rows for x in held) > SENT_ROWS:
                    yield from pa.Table.from_batches(held, _KIND).combine_chunks().to_batches()
                    held = []

        sent = placed.select("_unit", *dict.fromkeys(["g1", "g2", *plain, *([ranked] if ranked else [])]))
        return (sent.repartitionByRange(blocks, ranked, "_unit") if ranked else sent.repartition(blocks)).mapInArrow(run, _SCHEMA)

    parts = totals(own[0] if own else None, plain, human)
    for k in own[1:]:
        parts = parts.unionByName(totals(k, [], False))
    sums = parts.groupBy("label", "kind", "low", "one", "b", "v").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("s").alias("min"), F.max("q").alias("max"))
    sums = kept(sums)
    ordinal = rows | {HUMAN: True}
    about = spark.createDataFrame([(k, o, shift["g1" if k == HUMAN else k], k == HUMAN) for k, o in ordinal.items()], "label string, ordinal boolean, shift double, human boolean")
    return _rho(sums.where(F.col("kind") == RANK)).unionByName(_alpha(sums.where(F.col("kind") != RANK), about, shift))


def _rho(sums: DataFrame) -> DataFrame:
    """(label, stat, b, value): correlations of average ranks."""
    by, before = ["label", "b"], (Window.unboundedPreceding, -1)
    under = lambda c, at: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(at).rowsBetween(*before)), F.lit(0.0))
    parts = sums.groupBy(*by, "low", "one").agg(F.sum("c").alias("size"))
    middle = (F.sum("size").over(Window.partitionBy(*by)) + 1) / 2
    parts = parts.select(*by, "low", "one", (under("size", "low") + (F.col("size") + 1) / 2 - middle).alias("x"))
    levels = sums.groupBy(*by, "v").agg(F.sum("c").alias("size"))
    middle = (F.sum("size").over(Window.partitionBy(*by)) + 1) / 2
    levels = levels.select(*by, "v", (under("size", "v") + (F.col("size") + 1) / 2 - middle).alias("y"))
    c, s, q, x, y = (F.col(k) for k in "csqxy")
    out = sums.join(parts, [*by, "low", "one"]).join(levels, [*by, "v"]).groupBy(*by).agg(F.sum((x * c + s) * y).alias("xy"), F.sum(x * x * c + 2 * x * s + q).alias("xx"), F.sum(c * y * y).alias("yy"))
    rho = F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
    return out.select("label", F.lit("rho").alias("stat"), "b", F.when((F.col("xx") > 0) & (F.col("yy") > 0), rho).otherwise(F.lit(float("nan"))).alias("value"))


def _alpha(sums: DataFrame, about: DataFrame, shift: dict[str, float]) -> DataFrame:
    """(label, stat, b, value): Kd of each label, alpha of the human one."""
    names = ["n", "g1", "g1g1", "g2", "g2g2", "x", "xx", "xg1", "xg2"]
    is_moment = F.col("kind") == MOMENT
    each = [F.sum(F.when(is_moment & (F.col("v") == i), F.col("c"))).alias(k) for i, k in enumerate(names)]
    flat = sums.groupBy("label", "b").agg(*each, F.min(F.when(~is_moment, F.col("min"))).alias("low"), F.max(F.when(~is_moment, F.col("max"))).alias("high")).join(F.broadcast(about), "label")
    n = F.col("n")
    span = F.nullif(F.when(F.col("ordinal"), 1.0).otherwise(F.col("high") - F.col("low")), F.lit(0.0))
    start, top = F.when(F.col("ordinal"), 0.0).otherwise(F.col("low")), F.when(F.col("ordinal"), 1.0).otherwise(4.0)

    def one(g: str) -> Column:
        mx, mg = F.col("x") / n, F.col(g) / n
        vx, vg = F.col("xx") / n - mx * mx, F.col(f"{g}{g}") / n - mg * mg
        cov = F.col(f"x{g}") / n - mx * mg
        apart = (F.col("shift") + mx - start) / span - (F.lit(shift[g]) + mg) / top
        vx, vg, cov = vx / (span * span), vg / (top * top), cov / (span * top)
        spread = (vx + vg) / 2 + apart * apart / 4
        least = 1e-14 * (F.col("xx") / n / (span * span) + F.col(f"{g}{g}") / n / (top * top))  # rounding of the moments
        observed, expected = vx + vg - 2 * cov + apart * apart, 4 * n * spread / (2 * n - 1)
        return F.when(spread > least, 1 - observed / expected).otherwise(F.lit(float("nan")))

    value = F.when(F.col("human"), one("g2")).otherwise((one("g1") + one("g2")) / 2)
    return flat.select("label", F.lit("alpha").alias("stat"), "b", value.alias("value"))
