"""Vectors as matrices for tiled products: packing, the tile join, and lists of best rows that merge.

A row takes part if its id and vector are there and no component is null or non-finite. Its
components become floor(scale * x) with x as a double. Vectors are kept as they were given (4 or 8
bytes a component) until a task multiplies them. Products are exact: in doubles below 2^53, in
64-bit integers below 2^63, and beyond that in whole numbers of any size; only a score that belongs
to the answer and doesn't fit a long raises an error.

All rows are packed into shards where they are read, without a shuffle; stated queries are packed
into blocks. A tile is one block times one shard. Shards are dealt to groups in turn and move
once; the blocks, which are the small side, are copied to each group. A group is a task, so the
tiles of one block lie in many tasks. No pair of rows is ever a row of the join.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faturalens.llm import common

# A sum of products below this is exact in double arithmetic.
EXACT = 1 << 53
LONG = 1 << 63
# Most bytes of a batch of tiles in a worker, of one matrix, and blocks whose lists a task keeps open.
BATCH_BYTES = 32 << 20
PACK_BYTES = 4_000_000
OPEN_BLOCKS = 16
PACK_SCHEMA = "dim int, ids binary, labels binary, body binary"


def usable(embeddings: DataFrame, *extra: Column) -> DataFrame:
    """vec_id, v, dim and the extra columns of every row that takes part."""
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    value = F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select("vec_id", value.alias("v"), F.size("embedding").alias("dim"), *extra)


def pack(rows: DataFrame, most_rows: int) -> DataFrame:
    """(dim, ids, labels, body): runs of rows of one length, as they stand in each partition.

    `rows` has vec_id, v, dim and, where labels matter, label; equal lengths should stand together.
    """
    labelled = "label" in rows.columns
    kind = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def one(dim: int, ids: list, labels: list, parts: list) -> pa.RecordBatch:
        joined = [np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(labels).astype("<i8").tobytes() if labelled else b""]
        body = np.concatenate(parts).astype(kind).tobytes()
        columns = [pa.array([dim], pa.int32()), *[pa.array([x], pa.binary()) for x in (*joined, body)]]
        return pa.RecordBatch.from_arrays(columns, ["dim", "ids", "labels", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, labels, parts = None, 0, [], [], []
        for batch in batches:
            dims = common.column(batch, "dim").to_numpy(zero_copy_only=False)
            own = common.column(batch, "vec_id").to_numpy(zero_copy_only=False)
            tags = common.column(batch, "label").to_numpy(zero_copy_only=False) if labelled else None
            flat = common.column(batch, "v").flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims, dtype=np.int64)])
            low = 0
            while low < len(dims):
                if key is not None and (dims[low] != key or held >= room):
                    yield one(key, ids, labels, parts)
                    held, ids, labels, parts = 0, [], [], []
                key = int(dims[low])
                room = max(1, min(most_rows, PACK_BYTES // max(1, 8 * key)))
                other = np.flatnonzero(dims[low:] != key)
                high = min(low + room - held, low + int(other[0]) if len(other) else len(dims))
                ids.append(own[low:high])
                parts.append(flat[starts[low] : starts[high]])
                if labelled:
                    labels.append(tags[low:high])
                held, low = held + high - low, high
        if held:
            yield one(key, ids, labels, parts)

    return rows.mapInArrow(run, PACK_SCHEMA)


def shards(rows: DataFrame, most_rows: int) -> DataFrame:
    """All rows as matrices, packed where they are read; equal lengths and labels stand together."""
    order = ["dim", "label"] if "label" in rows.columns else ["dim"]
    return pack(rows.sortWithinPartitions(*order), most_rows)


def blocks(queries: DataFrame, most_rows: int) -> DataFrame:
    """Queries as matrices with a number `block`, written, so that every later step means the same block."""
    order = ["dim", "label", "vec_id"] if "label" in queries.columns else ["dim", "vec_id"]
    count = max(1, -(-queries.count() // most_rows))
    dealt = queries.repartitionByRange(count, *order).sortWithinPartitions(*order)
    return common.written(pack(dealt, most_rows).withColumn("block", F.monotonically_increasing_id()))


def groups_of(df: DataFrame) -> int:
    """Groups that keep all cores of the session busy."""
    return 2 * max(1, df.sparkSession.sparkContext.defaultParallelism)


def joined(block_rows: DataFrame, shard_rows: DataFrame, groups: int) -> DataFrame:
    """Every block beside every shard, those of other lengths included; columns of blocks begin with q_."""
    # Tiles are large rows: a batch is bounded by its bytes.
    block_rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = [F.col(name).alias(f"q_{name}") for name in block_rows.columns]
    copies = block_rows.select(*names, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    # Each partition deals its shards one by one, beginning at a group of its own.
    turn = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.spark_partition_id()
    dealt = shard_rows.withColumn("group", F.pmod(turn, F.lit(groups)).cast("int"))
    # A group is a partition: few bytes are much work here, so they must not be put together.
    group = F.col("group")
    return copies.repartitionById(groups, group).join(dealt.repartitionById(groups, group).hint("merge"), "group")


def matrix(body: bytes, count: int, dim: int) -> np.ndarray:
    """The vectors of a pack as they were given; a body of `count * dim` values tells its own width."""
    width = len(body) // (count * dim) if count * dim else 8
    return np.frombuffer(body, f"<f{width}").reshape(count, dim)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers, or as whole numbers of any size where these don't fit."""
    values = values.astype(np.float64)
    if np.abs(values).max(initial=0) < 2.0**62 / scale:
        return np.floor(values * scale).astype(np.int64)
    # Doubles this large are whole numbers; smaller ones can be scaled without rounding.
    whole = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def largest(values: np.ndarray) -> int:
    return max((int(values.max(initial=0)), -int(values.min(initial=0)))) if values.size else 0


def product(left: np.ndarray, right: np.ndarray, multiply: Callable | None = None) -> np.ndarray:
    """left times right transposed, exactly; `multiply` does it for integers of either kind."""
    bound = largest(left) * largest(right) * left.shape[1]
    if bound < EXACT and multiply is None:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    # Sums that might leave 64 bits are taken in whole numbers of any size.
    kind = np.int64 if bound < LONG else object
    left, right = left.astype(kind), np.ascontiguousarray(right.astype(kind).T)
    return multiply(left, right) if multiply is not None else left @ right


def checked(score: str) -> Column:
    """The score; an error where it is at the end of the scale of 64 bits."""
    at_end = F.col(score).isin(-LONG, LONG - 1)
    return F.when(at_end, F.raise_error(F.lit("a score of the answer does not fit 64 bits"))).otherwise(F.col(score))


class Best:
    """For each of a number of rows the k best (score, id), highest score first, ties by smaller id."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.scores = np.zeros((count, k), dtype=np.int64)
        self.ids = np.zeros((count, k), dtype=np.int64)
        self.filled = np.zeros((count, k), dtype=bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Take in a tile: scores and allowed are (rows, candidates), ids are the candidates'."""
        k = self.k
        if scores.dtype == object:
            ranked = [sorted((j for j in np.flatnonzero(ok)), key=lambda j: (-row[j], ids[j]))[:k] for row, ok in zip(scores, allowed, strict=True)]
            chosen = [(i, j) for i, row in enumerate(ranked) for j in row]
            place, at = (np.array([c[x] for c in chosen], dtype=np.int64) for x in (0, 1))
            # What doesn't fit stays at the end of the scale; `checked` refuses it in an answer.
            values = np.array([max(-LONG, min(LONG - 1, x)) for x in scores[place, at].tolist()], dtype=np.int64)
        else:
            order = np.argsort(ids, kind="stable")
            scores, ids, allowed = scores[:, order], ids[order], allowed[:, order]
            picked = allowed
            if scores.shape[1] > k:
                # Everything above the k-th allowed score, and then the smallest ids at that score.
                low = np.where(allowed, scores, np.iinfo(np.int64).min)
                edge = np.partition(low, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
                above, level = allowed & (low > edge), allowed & (low == edge)
                picked = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            place, at = np.nonzero(picked)
            values = scores[place, at]
        # At most k a row: a second list of the same form, merged into this one.
        slot = np.arange(len(place)) - np.searchsorted(place, place)
        other = Best(len(self.scores), k)
        other.scores[place, slot], other.ids[place, slot], other.filled[place, slot] = values, ids[at], True
        self.merge(other)

    def merge(self, other: Best) -> None:
        scores, ids = np.hstack([self.scores, other.scores]), np.hstack([self.ids, other.ids])
        filled = np.hstack([self.filled, other.filled])
        # Complement in place of minus: the least long has no negative.
        order = np.lexsort((ids, ~scores, ~filled), axis=1)[:, : self.k]
        self.scores, self.ids, self.filled = (np.take_along_axis(x, order, axis=1) for x in (scores, ids, filled))


def fold(
    tiles: DataFrame,
    open_block: Callable[[dict], object],
    take: Callable[[object, dict], None],
    close: Callable[[object], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """One state per block and task: opened at the block's first tile, given each tile, closed into rows.

    A task keeps `OPEN_BLOCKS` states; a block that comes back after its state was closed gets
    another, and its rows are merged with the others afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: OrderedDict[int, object] = OrderedDict()
        for batch in batches:
            for index in range(batch.num_rows):
                # One tile at a time as Python bytes, whatever the batch holds.
                tile = batch.slice(index, 1).to_pylist()[0]
                if tile["dim"] != tile["q_dim"]:
                    continue
                block = tile["q_block"]
                if block not in states:
                    if len(states) >= OPEN_BLOCKS:
                        yield close(states.popitem(last=False)[1])
                    states[block] = open_block(tile)
                states.move_to_end(block)
                take(states[block], tile)
        for state in states.values():
            yield close(state)

    return tiles.mapInArrow(run, schema)
