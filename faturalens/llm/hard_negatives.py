"""Hard-negative mining: Strassen products of anchor and candidate tiles, then heaps that merge.

Anchors (stated by a condition on rows) are packed into blocks and all rows into shards. A tile is
multiplied by Strassen's recursion on 64-bit integers: both sides are padded with zeros to even
sizes, quadrants are added and subtracted as integers, and small leaves are multiplied plainly.
Arithmetic modulo 2^64 is exact for every score that fits 64 bits, whatever the sums on the way.

First each anchor's positives are found, the best rows of its own label: rows of other labels are
left out of the product. A task keeps a heap per anchor over its tiles; the heaps are merged by
rank. Then the tiles are multiplied again, now with each anchor's positives beside it, and a heap
per anchor and positive keeps the best rows of other labels inside the window
`low * positive <= 100 * score <= high * positive`. Negative positives have an empty window.

Rows with a null id, label or vector, or any null or non-finite component, take no part. Where
vec_id is divisible by 7 the label is moved on by one first, modulo 10. Repeated rows are
candidates each, but never of an anchor with their own id; equal anchor rows are one anchor. Vectors
are compared with those of their own length only. Ties go to the smaller id; equal rows with equal
ids may both be returned. Very long vectors make small packs. An anchor without positives, or a
positive without negatives, has no rows; an empty table gives an empty one. Columns other than
vec_id, embedding and label are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faturalens.llm import common, tiles

EVERY = 50
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)
SCALE = 256
BLOCK_ROWS = 1024
SHARD_ROWS = 4096
# Below this size in any direction a product is not split further.
LEAF = 48


def padded(matrix: np.ndarray) -> np.ndarray:
    """The matrix with a row and a column of zeros more where its sizes are odd."""
    rows, columns = matrix.shape
    if rows % 2 == columns % 2 == 0:
        return matrix
    out = np.zeros((rows + rows % 2, columns + columns % 2), dtype=matrix.dtype)
    out[:rows, :columns] = matrix
    return out


def strassen(left: np.ndarray, right: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """left @ right of integers by seven products of quadrants; sums are integer additions."""
    rows, columns = left.shape[0], right.shape[1]
    if min(rows, columns, left.shape[1]) <= leaf:
        bound = tiles.largest(left) * tiles.largest(right) * left.shape[1]
        if bound < tiles.EXACT:
            return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64).astype(left.dtype)
        return left @ right
    left, right = padded(left), padded(right)
    m, k, n = left.shape[0] // 2, left.shape[1] // 2, right.shape[1] // 2
    a, b, c, d = left[:m, :k], left[:m, k:], left[m:, :k], left[m:, k:]
    e, f, g, h = right[:k, :n], right[:k, n:], right[k:, :n], right[k:, n:]
    both = strassen(a + d, e + h, leaf)
    lower = strassen(c + d, e, leaf)
    upper = strassen(a, f - h, leaf)
    under = strassen(d, g - e, leaf)
    across = strassen(a + b, h, leaf)
    out = np.empty((2 * m, 2 * n), dtype=left.dtype)
    out[:m, :n] = both + under - across + strassen(b - d, g + h, leaf)
    out[:m, n:] = upper + across
    out[m:, :n] = lower + under
    out[m:, n:] = both - lower + upper + strassen(c - a, e + f, leaf)
    return out[:rows, :columns]


def labelled_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, v, dim and the label that mining goes by."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return tiles.usable(embeddings.where(F.col("label").isNotNull()), moved.alias("label"))


class Anchors:
    """One block of anchors as a task knows it."""

    def __init__(self, tile: dict, scale: int):
        self.block, dim = tile["q_block"], tile["dim"]
        self.ids = np.frombuffer(tile["q_ids"], "<i8")
        self.labels = np.frombuffer(tile["q_labels"], "<i8")
        self.vectors = tiles.integers(tiles.matrix(tile["q_body"], len(self.ids), dim), scale)
        self.known = np.unique(self.labels)

    def candidates(self, tile: dict, scale: int, same: bool) -> tuple:
        """Scores, ids and which pairs count, over the shard's rows that can matter."""
        ids, labels = np.frombuffer(tile["ids"], "<i8"), np.frombuffer(tile["labels"], "<i8")
        chosen = np.isin(labels, self.known) if same else (labels != self.known[0]) | (len(self.known) > 1)
        rows = tiles.integers(tiles.matrix(tile["body"], len(ids), tile["dim"])[chosen], scale)
        ids, labels = ids[chosen], labels[chosen]
        scores = tiles.product(self.vectors, rows, strassen)
        equal = self.labels[:, None] == labels[None, :]
        allowed = (equal & (self.ids[:, None] != ids[None, :])) if same else ~equal
        return scores, ids, allowed


POSITIVE_SCHEMA = "block long, place int, anchor_id long, positive_id long, positive_score long"


def positives(blocks: DataFrame, shards: DataFrame, groups: int, k: int, scale: int) -> DataFrame:
    """block, place, anchor_id, number, positive_id, positive_score: the k best rows of the own label."""

    def open_block(tile: dict) -> tuple:
        anchors = Anchors(tile, scale)
        return anchors, tiles.Best(len(anchors.ids), k)

    def take(state: tuple, tile: dict) -> None:
        anchors, best = state
        scores, ids, allowed = anchors.candidates(tile, scale, same=True)
        if allowed.any():
            best.add(scores, ids, allowed)

    def close(state: tuple) -> pa.RecordBatch:
        anchors, best = state
        place, slot = np.nonzero(best.filled)
        columns = [np.full(len(place), anchors.block), place.astype(np.int32), anchors.ids[place], best.ids[place, slot], best.scores[place, slot]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "place", "anchor_id", "positive_id", "positive_score"])

    found = tiles.fold(tiles.joined(blocks, shards, groups), open_block, take, close, POSITIVE_SCHEMA)
    order = Window.partitionBy("block", "place").orderBy(F.col("positive_score").desc(), "positive_id")
    ranked = found.withColumn("number", F.row_number().over(order)).where(F.col("number") <= k)
    return ranked.withColumn("positive_score", tiles.checked("positive_score"))


NEGATIVE_SCHEMA = "block long, place int, number int, negative_id long, negative_score long"


def negatives(blocks: DataFrame, shards: DataFrame, groups: int, k: int, window: tuple[int, int], scale: int) -> DataFrame:
    """block, place, number, rank, negative_id, negative_score; blocks carry `wanted`, their positives' places, numbers and scores."""

    def open_block(tile: dict) -> tuple:
        wanted = tile["q_wanted"]
        place, number = (np.array([w[x] for w in wanted], dtype=np.int64) for x in ("place", "number"))
        # Whole numbers of any size: the bounds of large scores would leave 64 bits on the way.
        least = np.array([-(-window[0] * w["score"] // 100) for w in wanted], dtype=np.int64)
        most = np.array([window[1] * w["score"] // 100 for w in wanted], dtype=np.int64)
        return Anchors(tile, scale), place, number, least, most, tiles.Best(len(wanted), k)

    def take(state: tuple, tile: dict) -> None:
        anchors, place, number, least, most, best = state
        scores, ids, allowed = anchors.candidates(tile, scale, same=False)
        # By number, so that one copy of the scores is looked at for each of a few positives.
        for which in np.unique(number):
            at = np.flatnonzero(number == which)
            own = scores[place[at]]
            inside = (allowed[place[at]] & (own >= least[at, None]) & (own <= most[at, None])).astype(bool)
            rows = inside.any(axis=1)
            if rows.any():
                part = tiles.Best(int(rows.sum()), best.k)
                part.add(own[rows], ids, inside[rows])
                whole = tiles.Best(len(number), best.k)
                for name in ("scores", "ids", "filled"):
                    getattr(whole, name)[at[rows]] = getattr(part, name)
                best.merge(whole)

    def close(state: tuple) -> pa.RecordBatch:
        anchors, place, number, _, _, best = state
        at, slot = np.nonzero(best.filled)
        columns = [np.full(len(at), anchors.block), place[at].astype(np.int32), number[at].astype(np.int32), best.ids[at, slot], best.scores[at, slot]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "place", "number", "negative_id", "negative_score"])

    found = tiles.fold(tiles.joined(blocks, shards, groups), open_block, take, close, NEGATIVE_SCHEMA)
    order = Window.partitionBy("block", "place", "number").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("negative_score", tiles.checked("negative_score"))


def mine(
    embeddings: DataFrame,
    is_anchor: Column | None = None,
    positive_count: int = POSITIVES,
    negative_count: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    rows = labelled_rows(embeddings)
    is_anchor = F.col("vec_id") % EVERY == 0 if is_anchor is None else is_anchor
    blocks = tiles.blocks(rows.where(is_anchor).distinct(), block_rows)
    shards = tiles.shards(rows, shard_rows)
    groups = tiles.groups_of(embeddings)
    pairs = common.written(positives(blocks, shards, groups, positive_count, scale))
    # At most block_rows * positive_count entries for a block.
    wanted = F.collect_list(F.struct("place", "number", F.col("positive_score").alias("score")))
    asked = blocks.join(pairs.groupBy("block").agg(wanted.alias("wanted")), "block")
    found = negatives(asked, shards, groups, negative_count, window, scale)
    both = found.join(pairs, ["block", "place", "number"])
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
