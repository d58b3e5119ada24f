"""Hard-negative mining with ball trees and branch-and-bound.

Vectors are quantised to integers, so that scores (inner products) are exact.
Rows are dealt over partitions by a hash and each partition builds one ball
tree: nodes halve their rows along the line between two far ones and keep a
centre, a radius and the range of labels below. For an anchor q, a node of
centre c and radius r holds only scores from ``q.c - |q| r`` to ``q.c + |q| r``.
A search walks a tree depth first with all its queries at once and drops a query
at a node that lies outside the query's score window, holds no row of a wanted
label, or lies strictly beneath the query's current k-th score (equal scores may
still win by their id).

Anchors are packed in blocks, trees in groups; a tile of one block and one group
is streamed through a task, tree by tree, with the k best rows a query carried
from tree to tree. Tiles are merged by rank. First the positives of an anchor
are searched (its best rows of the same label), then each positive's score opens
a window for the negatives (rows of other labels).

Edge cases. Rows without an id, a label or a vector, or with a null or
non-finite component, take no part. Vectors of different lengths are filled up
with zeros; an empty one is all zeros. Repeated rows are rows of their own: a
repeated anchor is answered once for each copy and may have its copy as a
positive. Ties go to the smaller id. A positive of negative score has an empty
window, so it yields nothing, like an anchor without positives. Empty tables
give empty results. Vectors so large that an inner product could leave 56 bits
raise ValueError. Extra columns of any name are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agreemill.llm.common import checkpoint, col, small_batches, table

POSITIVES = 5
NEGATIVES = 5
#: A negative scores between these percentages of its positive.
LOW, HIGH = 80, 100
SCALE = 256
TREE_ROWS = 2048
LEAF_ROWS = 64
BLOCK_ANCHORS = 4096
#: Anchors whose products with a leaf are held at a time.
STEP = 1024
#: Trees that a tile streams, at most.
GROUP_TREES = 1024
SAFE_BITS = 56

_FOUND = "anchor long, anchor_id long, place int, found_id long, score long"


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return {k: found[k] for k in found.files}


def dense(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as an (n, dims) matrix, short lists filled up with zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(1, dims)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _halves(rows: np.ndarray, at: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``at`` dealt in two equal parts along the line between two far
    ones; equal rows are dealt too, so that leaves stay small."""
    own = rows[at]
    one = own[np.argmax(((own - centre) ** 2).sum(1))]
    two = own[np.argmax(((own - one) ** 2).sum(1))]
    order = np.argsort(own @ (two - one), kind="stable")
    middle = len(at) // 2
    return at[order[:middle]], at[order[middle:]]


def ball_tree(vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A tree in arrays. ``order`` deals the rows to the nodes' ranges
    [start, end); ``skip`` is the node after a node's whole subtree (preorder),
    so that a leaf is a node followed by its ``skip``."""
    rows = vectors.astype(np.float64)
    centres, radii, low, high, starts, ends, skips, order = [], [], [], [], [], [], [], []

    def add(at: np.ndarray) -> None:
        node, start = len(radii), sum(map(len, order))
        own = rows[at]
        centre = own.mean(0)
        centres.append(centre)
        radii.append(float(np.sqrt(((own - centre) ** 2).sum(1)).max()))
        low.append(labels[at].min())
        high.append(labels[at].max())
        starts.append(start)
        ends.append(start + len(at))
        skips.append(0)
        if len(at) <= leaf:
            order.append(at)
        else:
            for part in _halves(rows, at, centre):
                add(part)
        skips[node] = len(radii)

    add(np.arange(len(rows)))
    return {"centres": np.array(centres), "radii": np.array(radii), "low": np.array(low), "high": np.array(high), "starts": np.array(starts), "ends": np.array(ends), "skips": np.array(skips), "order": np.concatenate(order)}


class Search:
    """Queries (score windows of anchors) and the best rows found so far."""

    def __init__(self, anchors: dict[str, np.ndarray], k: int, same: bool):
        self.k, self.same = k, same
        self.uids, self.ids, self.labels = anchors["uids"], anchors["ids"], anchors["labels"]
        self.vectors = anchors["vectors"].astype(np.float64)
        self.norms = np.sqrt((self.vectors**2).sum(1))
        self.owner, self.place, self.low, self.high = anchors["owner"], anchors["place"], anchors["low"], anchors["high"]
        self.scores = np.full((len(self.owner), k), -np.inf)
        self.found = np.full((len(self.owner), k), np.iinfo(np.int64).max)
        self.seen = 0

    def visit(self, tree: dict[str, np.ndarray]) -> None:
        """Branch and bound over one tree, with all queries."""
        for first in range(0, len(self.uids), STEP):
            a, b = np.searchsorted(self.owner, [first, first + STEP])
            self._node(tree, 0, np.arange(a, b))

    def _node(self, tree: dict[str, np.ndarray], node: int, alive: np.ndarray) -> None:
        anchors, inverse = np.unique(self.owner[alive], return_inverse=True)
        middle = (self.vectors[anchors] @ tree["centres"][node])[inverse]
        norms = self.norms[anchors][inverse]
        reach = norms * tree["radii"][node]
        reach += 1e-9 * (reach + norms * np.sqrt((tree["centres"][node] ** 2).sum())) + 1e-6  # rounding
        upper, labels = middle + reach, self.labels[self.owner[alive]]
        lowest, highest = tree["low"][node], tree["high"][node]
        wanted = (lowest <= labels) & (labels <= highest) if self.same else (lowest != labels) | (highest != labels)
        kept = wanted & (upper >= self.low[alive]) & (middle - reach <= self.high[alive]) & (upper >= self.scores[alive, -1])
        alive = alive[kept]
        if not len(alive):
            return
        end = tree["skips"][node]
        if end == node + 1:
            self._leaf(tree, tree["starts"][node], tree["ends"][node], alive)
            return
        parts = [node + 1, tree["skips"][node + 1]]
        sums = self.vectors[np.unique(self.owner[alive])].sum(0)
        for part in sorted(parts, key=lambda p: -(sums @ tree["centres"][p])):
            self._node(tree, part, alive)

    def _leaf(self, tree: dict[str, np.ndarray], start: int, end: int, alive: np.ndarray) -> None:
        rows = slice(start, end)
        anchors, inverse = np.unique(self.owner[alive], return_inverse=True)
        scores = (self.vectors[anchors] @ tree["vectors"][rows].T)[inverse]
        owner = self.owner[alive]
        equal = self.labels[owner][:, None] == tree["labels"][rows]
        good = (equal if self.same else ~equal) & (scores >= np.maximum(self.low[alive], self.scores[alive, -1])[:, None]) & (scores <= self.high[alive][:, None])
        good &= self.uids[owner][:, None] != tree["uids"][rows]
        self.seen += len(anchors) * (end - start)
        q, r = np.nonzero(good)
        if len(q):
            self._merge(alive[q], scores[q, r], tree["ids"][rows][r])

    def _merge(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(query)
        query = np.concatenate([np.repeat(touched, self.k), query])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.found[touched].ravel(), ids])
        order = np.lexsort((ids, -scores, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = order[rank < self.k]
        self.scores[touched] = scores[best].reshape(-1, self.k)
        self.found[touched] = ids[best].reshape(-1, self.k)

    def results(self) -> pa.RecordBatch:
        q, j = np.nonzero(np.isfinite(self.scores))
        owner = self.owner[q]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.uids[owner]), pa.array(self.ids[owner]), pa.array(self.place[q].astype(np.int32)), pa.array(self.found[q, j]), pa.array(self.scores[q, j].astype(np.int64))], ["anchor", "anchor_id", "place", "found_id", "score"]
        )


def _rows(df: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(uid, id, label, v): the rows that take part, with integer vectors."""
    x = F.col("v")
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)))
    rows = df.select(col(key).cast("long").alias("id"), label.cast("long").alias("label"), col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    return checkpoint(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e)).alias("v")))


def _dimensions(rows: DataFrame) -> tuple[int, int]:
    """(rows, longest vector); refuses vectors whose products might not be exact."""
    n, dims, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if (dims or 0) * (largest or 0) ** 2 >= 1 << SAFE_BITS:
        raise ValueError(f"inner products of {dims} components up to {largest} may not be exact")
    return n, dims or 0


def _trees(rows: DataFrame, n: int, dims: int, tree_rows: int) -> DataFrame:
    """(tree, blob): a packed ball tree for each partition of the rows."""

    def build(key: tuple, part: pa.Table) -> pa.Table:
        vectors, labels = dense(part["v"], dims), part["label"].to_numpy()
        tree = ball_tree(vectors, labels)
        order = tree.pop("order")
        small = vectors.astype(np.int32) if np.abs(vectors).max(initial=0) < 1 << 31 else vectors
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([_pack(**tree, vectors=small[order], labels=labels[order], ids=part["id"].to_numpy()[order], uids=part["uid"].to_numpy()[order])], pa.binary())})

    trees = max(1, -(-n // tree_rows))
    return checkpoint(rows.groupBy(F.pmod(F.xxhash64("uid"), F.lit(trees)).cast("int").alias("tree")).applyInArrow(build, "tree int, blob binary"))


def _blocks(anchors: DataFrame, n: int, dims: int) -> DataFrame:
    """(block, blob): packed anchors with their windows, an array column
    ``windows`` of struct(place, low, high) with null for an open end."""

    def build(key: tuple, part: pa.Table) -> pa.Table:
        lists = part["windows"].combine_chunks()
        windows, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        low, high = (windows.field(f).cast(pa.float64()).fill_null(open_end).to_numpy(zero_copy_only=False) for f, open_end in (("low", -np.inf), ("high", np.inf)))
        blob = _pack(uids=part["uid"].to_numpy(), ids=part["id"].to_numpy(), labels=part["label"].to_numpy(), vectors=dense(part["v"], dims), owner=np.repeat(np.arange(len(lists)), sizes), place=windows.field("place").to_numpy(zero_copy_only=False), low=low, high=high)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    blocks = max(1, -(-n // BLOCK_ANCHORS))
    return anchors.groupBy(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block")).applyInArrow(build, "block int, blob binary")


def _searched(trees: DataFrame, anchors: DataFrame, n_trees: int, n_anchors: int, dims: int, k: int, same: bool) -> DataFrame:
    """(anchor, anchor_id, place, found_id, score, rank): the k best rows of each window."""
    small_batches()
    spark = trees.sparkSession
    blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    wanted = -(-2 * spark.sparkContext.defaultParallelism // blocks)
    groups = min(max(1, n_trees), max(wanted, -(-n_trees // GROUP_TREES)))
    packed = checkpoint(_blocks(anchors, n_anchors, dims))
    left = packed.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).alias("tree"), "blob")
    right = trees.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), (F.col("tree") % groups).alias("group"), "tree", "blob")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for batch in batches:
            for block, group, tree, blob in zip(*(batch.column(i) for i in range(4)), strict=True):
                at = (block.as_py(), group.as_py())
                if at != tile:
                    if now:
                        yield now.results()
                    now, tile = None, at
                if tree.as_py() < 0:
                    now = Search(_unpack(blob.as_py()), k, same)
                elif now:
                    now.visit(_unpack(blob.as_py()))
        if now:
            yield now.results()

    tiles = left.union(right).repartition(max(1, min(blocks * groups, 4 * n_trees)), "block", "group").sortWithinPartitions("block", "group", "tree")
    found = tiles.mapInArrow(search, _FOUND)
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found_id")
    return checkpoint(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))


def hard_negatives(df: DataFrame, key: str, label: Column, vector: str, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``id``. A component x counts as
    floor(scale * x). Negatives score from ``low`` to ``high`` percent of their
    positive, best first.
    """
    rows = _rows(df, key, label, vector, scale)
    n, dims = _dimensions(rows)
    n_trees = max(1, -(-n // tree_rows))
    trees = _trees(rows, n, dims, tree_rows)
    own = rows.where(anchors)
    n_anchors = own.count()
    window = "array<struct<place: int, low: long, high: long>>"
    whole = F.array(F.struct(F.lit(1).alias("place"), F.lit(None).alias("low"), F.lit(None).alias("high"))).cast(window)
    best = _searched(trees, own.withColumn("windows", whole), n_trees, n_anchors, dims, positives, same=True)
    best = best.select("anchor", F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    least, most = F.ceil(F.expr(f"positive_score * {low}L div 100L")), F.expr(f"positive_score * {high}L div 100L")
    least = F.when(least * 100 < p * low, least + 1).otherwise(least)
    windows = best.where(p >= 0).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", least.alias("low"), most.alias("high")))).cast(window).alias("windows"))
    asked = own.join(windows.withColumnRenamed("anchor", "uid"), "uid")
    found = _searched(trees, asked, n_trees, n_anchors, dims, negatives, same=False)
    out = found.join(best, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose id is divisible by 100; every
    seventh row has a shifted label."""
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.coalesce(col("vec_id") % 7 == 0, F.lit(False)), (col("label") + 1) % 10).otherwise(col("label"))
    return hard_negatives(e, "vec_id", label, "embedding", F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS uid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid, a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.uid <> b.uid WHERE a.id % 100 = 0
), p AS (
  SELECT uid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id) AS place
  FROM s WHERE same QUALIFY place <= 5
), n AS (
  SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.uid, place ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.uid = p.uid AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
