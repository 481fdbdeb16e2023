"""Exact top-k search: tiled integer matrix products, partial selection per tile, tree merging.

Queries are packed into blocks and all rows into shards. A tile is one block times one shard: a
task multiplies the two, keeps the k best of each query by partial selection, and merges them into
the list that it keeps for the block. Lists of a few groups of shards are merged next, and what is
left of them last. The queries are stated (every 100th id), so their blocks meet every shard, dealt
in groups over the cluster; `tiles` says how. No pair of rows is ever a row of a join.

Components become floor(1024 * x) with x as a double; products are summed as integers, exactly at
any size. A score of the answer beyond 64 bits raises an error. Rows whose id or vector is null, or
whose vector holds a null or non-finite component, take no part. A vector is compared with those of
its own length only. Repeated rows are candidates each, but never of a query with their own id; a
query's id is answered once for each distinct vector that carries it. Ties go to the smaller id.
Very long vectors make small packs. An empty table gives an empty one. Columns other than vec_id
and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faturalens.llm import tiles

K = 10
EVERY = 100
BLOCK_ROWS = 1024
SHARD_ROWS = 4096
SCALE = 1024
LIST_SCHEMA = "block long, place int, query_id long, vec_id long, score long, part int"


def lists(tiled: DataFrame, k: int, scale: int) -> DataFrame:
    """Each task's k best of each query it met, with the group of shards they came from."""

    def open_block(tile: dict) -> tuple:
        own = np.frombuffer(tile["q_ids"], "<i8")
        left = tiles.integers(tiles.matrix(tile["q_body"], len(own), tile["dim"]), scale)
        return tile["q_block"], tile["group"], own, left, tiles.Best(len(own), k)

    def take(state: tuple, tile: dict) -> None:
        _, _, own, left, best = state
        ids = np.frombuffer(tile["ids"], "<i8")
        right = tiles.integers(tiles.matrix(tile["body"], len(ids), tile["dim"]), scale)
        best.add(tiles.product(left, right), ids, own[:, None] != ids[None, :])

    def close(state: tuple) -> pa.RecordBatch:
        block, group, own, _, best = state
        place, slot = np.nonzero(best.filled)
        columns = [
            np.full(len(place), block), place.astype(np.int32), own[place], best.ids[place, slot], best.scores[place, slot],
            np.full(len(place), group, dtype=np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "place", "query_id", "vec_id", "score", "part"])

    return tiles.fold(tiled, open_block, take, close, LIST_SCHEMA)


def top_k(
    embeddings: DataFrame,
    is_query: Column | None = None,
    k: int = K,
    block_rows: int = BLOCK_ROWS,
    shard_rows: int = SHARD_ROWS,
    scale: int = SCALE,
) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best rows by integer inner product."""
    rows = tiles.usable(embeddings)
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    blocks = tiles.blocks(rows.where(is_query).distinct(), block_rows)
    groups = tiles.groups_of(embeddings)
    found = lists(tiles.joined(blocks, tiles.shards(rows, shard_rows), groups), k, scale)
    best_first = [F.col("score").desc(), F.col("vec_id")]
    # A query id may carry several vectors: its place in its block tells them apart.
    key = ["block", "place"]
    # The tree: lists of a few groups each are merged first, what is left of them last.
    branch = Window.partitionBy(*key, F.col("part") % max(2, int(groups**0.5))).orderBy(*best_first)
    half = found.withColumn("rank", F.row_number().over(branch)).where(F.col("rank") <= k).drop("rank")
    ranked = half.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*best_first)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", tiles.checked("score").alias("score"))
