"""Matches between two images: weighted samples of dense ones, and reciprocal
ones found from strided seeds.

A weighted sample without replacement takes the rows of smallest ``-ln(u) / w``,
u being a hash of the row: a mergeable aggregate, since the n smallest of a group
are among the n smallest of each of its parts. Tasks keep n rows a group at a
time and hand on fewer than they read; one rank over what is left finishes it.

Reciprocal matches hop from a seed to its nearest patch in the other image and
back, until a hop returns. Only the rows asked for are multiplied, in strips.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agreemill.functions.numbers import ratio
from agreemill.operators.pairs import matrix, unit
from agreemill.operators.patches import STRIP, strip_rows

#: Rows that a sample of matches holds.
N_SAMPLE = 5000
#: Rows that a task holds before it cuts its groups to their samples.
HELD_ROWS = 200_000
#: Hops to and fro before a seed is given up.
MAX_HOPS = 10
_PRIME = 2**31 - 1


def hashed_unit(*ids: Column, seed: int = 0) -> Column:
    """A number over 0 and under 1 from integer ids, by squares modulo a prime."""
    h = F.lit(seed).cast("long")
    for i in ids:
        h = (h * 1_000_003 + F.pmod(i.cast("long"), F.lit(_PRIME))) % _PRIME
        h = (h * h + 12_345) % _PRIME
        h = (h * h + 67_891) % _PRIME
    return (h + 0.5) / float(_PRIME)


def _smallest(rows: pa.Table, groups: list[str], n: int) -> pa.Table:
    """The ``n`` rows of each group of least ``_e``, ties by ``_row``."""
    rows = rows.sort_by([*[(g, "ascending") for g in groups], ("_e", "ascending"), ("_row", "ascending")])
    changed = np.ones(rows.num_rows, bool)
    if rows.num_rows:
        changed[1:] = False
        for g in groups:
            codes = rows[g].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            changed[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(changed)
    place = np.arange(rows.num_rows) - np.repeat(starts, np.diff([*starts, rows.num_rows]))
    return rows.filter(pa.array(place < n))


def weighted_sample(df: DataFrame, groups: list[str], weight: Column, ids: list[str], n: int = N_SAMPLE, seed: int = 0) -> DataFrame:
    """``n`` rows of each group (all, if fewer), drawn without replacement with
    chances by ``weight``; the draw is fixed by ``seed`` and the integer ``ids``.

    Rows of a weight that is not positive are never drawn. Rows of equal ids and
    weights are drawn together where the number allows.
    """
    e = -F.log(hashed_unit(*map(F.col, ids), seed=seed)) / weight.cast("double")
    row = F.xxhash64(*df.columns)
    keyed = df.where(weight > 0).withColumns({"_e": e, "_row": row})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < HELD_ROWS:
                continue
            best = _smallest(pa.Table.from_batches(held), groups, n)
            if best.num_rows > HELD_ROWS // 2:  # many groups: hand them on
                yield from best.to_batches()
                held, size = [], 0
            else:
                held, size = best.to_batches(), best.num_rows
        if held:
            yield from _smallest(pa.Table.from_batches(held), groups, n).to_batches()

    best = Window.partitionBy(*groups).orderBy("_e", "_row")
    return keyed.mapInArrow(cut, keyed.schema).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= n).select(*df.columns)


def sampled_recall(ref: str = "in_ref", out: str = "in_out", certainty: str = "certainty") -> dict[str, Column]:
    """Aggregates over sampled matches: recall of foreground matches, counters, and
    the mean certainty of those in both foregrounds (0 without)."""
    inside, both = F.col(ref), F.col(ref) & F.col(out)
    return {
        "recall": F.coalesce(ratio(F.count_if(both), F.count_if(inside)), F.lit(0.0)),
        "n_matches": F.count("*"),
        "n_ref_in_fg": F.count_if(inside),
        "n_both_in_fg": F.count_if(both),
        "mean_certainty_fg": F.coalesce(F.avg(F.when(both, F.col(certainty))), F.lit(0.0)),
    }


def _to_nearest(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The nearest of ``others`` for each row, ties to the lowest index."""
    if not len(rows):
        return np.zeros(0, int)
    step = min(STRIP, strip_rows(len(others)))
    return np.concatenate([np.round(rows[at : at + step] @ others.T, 12).argmax(1) for at in range(0, len(rows), step)])


def reciprocal_from(seeds: np.ndarray, ref: np.ndarray, out: np.ndarray, hops: int = MAX_HOPS) -> list[tuple[int, int, int]]:
    """(reference patch, output patch, rounds) that seeds arrive at, each match
    once with its fewest rounds. Both sides are unit vectors."""
    found: dict[tuple[int, int], int] = {}
    now = np.unique(seeds)
    if not len(ref) or not len(out):
        return []
    for k in range(1, hops + 1):
        if not len(now):
            break
        there = _to_nearest(ref[now], out)
        back = _to_nearest(out[there], ref)
        for i, j in zip(now[back == now].tolist(), there[back == now].tolist(), strict=True):
            found.setdefault((i, j), k)
        now = np.unique(back[back != now])
    return [(i, j, k) for (i, j), k in sorted(found.items())]


def grid_seeds(n: int, width: int, stride: int) -> np.ndarray:
    """Every ``stride``-th patch of a grid in both directions, from the middle of
    the first step."""
    i = np.arange(n)
    first = stride // 2
    return i[((i // width) % stride == first) & ((i % width) % stride == first)]


def reciprocal_matches(pairs: DataFrame, blocks: DataFrame, stride: int, hops: int = MAX_HOPS) -> DataFrame:
    """(ref, out, ref_idx, out_idx, rounds): reciprocal nearest patches reached
    from the seeds of the reference's grid.

    ``blocks``: (image_id, width, feat), one row an image, patches in row order. A
    pair is one group, its features two matrices: a task holds two images and a
    strip of cosines.
    """
    one, two = (pairs.schema[c].dataType.simpleString() for c in ("ref", "out"))

    def hop(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        found = []
        if p.num_rows and q.num_rows:
            ref, out = (unit(matrix(t["feat"], t.num_rows)[np.argsort(t["idx"].to_numpy())]) for t in (p, q))
            found = reciprocal_from(grid_seeds(len(ref), p["width"][0].as_py(), stride), ref, out, hops)
        columns = np.array(found, np.int32).reshape(-1, 3).T
        return pa.table({"ref": pa.repeat(key[0], len(found)), "out": pa.repeat(key[1], len(found))} | {n: pa.array(c) for n, c in zip(("ref_idx", "out_idx", "rounds"), columns, strict=True)})

    rows = blocks.select("image_id", F.col("width").cast("int").alias("width"), F.posexplode("feat").alias("idx", "feat"))
    asked = pairs.select("ref", "out").distinct()
    sides = [asked.join(rows.withColumnRenamed("image_id", side), side).select(*[F.col(c).alias(c) for c in ("ref", "out", "width", "idx", "feat")]) for side in ("ref", "out")]
    return sides[0].groupBy("ref", "out").cogroup(sides[1].groupBy("ref", "out")).applyInArrow(hop, f"ref {one}, out {two}, ref_idx int, out_idx int, rounds int")
