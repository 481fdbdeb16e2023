"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens until buckets are small.

A text's set is its runs of five words (a text of one to four words is one run). Texts with equal
sets are one class from the start. Every set is embedded in `COORDINATES` minhash values, its
tokens; two sets share each with the chance of their Jaccard similarity. A run starts from one
sampled token: sets that share its value share a bucket. A bucket beyond `BUCKET` sets is split
again by `FANOUT` other sampled tokens of its own, so that a pair at the threshold stays together
somewhere below with a chance that doesn't fade with depth; runs are repeated until the target
recall is met. A small bucket is compared by brute force on the sketches. A large one that doesn't
shrink when split holds near copies for the most part and is compared in blocks, each pair of
blocks in a task of its own: that is the exact way for what no split makes small.

Sketch matches only say which sets to compare: their components are then checked exactly, block
against block, on the runs of words of the whole texts (5 * common >= 4 * all for 0.8), which
gives the links and, as components of those, the classes. No pair ever is a row: a block emits
one row per set, with its number of links and the least set that it is tied to.

Each document gets class_id, the smallest doc_id of its class, and n_links, the number of other
documents at the threshold or above, equal ones included. A null or empty text has no set: it is a
class of its own without links, as is every text that is like no other. Documents without an
id count as links and get the class of their text, null if no member has an id. Repeated rows are
copies. Texts of any length are read whole: a long one is a large set, compared block by block like
any other. An empty table gives an empty one; only doc_id and text are read.

The exact check of a group of g different near copies takes g * g / 2 comparisons in blocks of
`BLOCK`, spread over as many tasks: as many as the group has links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faturalens.llm import common
from faturalens.llm.components import components

WORDS = 5
THRESHOLD = (4, 5)
TARGET_RECALL = 0.9995
COORDINATES = 64
FANOUT = 2
BUCKET = 512
BLOCK = 256
LEVELS = 6
# A bucket that keeps this share of its parent's sets isn't made smaller by splitting.
DENSE = 0.6
# Matching tokens of 64 from which a pair is compared exactly: five deviations below 0.8.
LEAST_MATCHES = 35
MULTIPLIERS = common.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
OFFSETS = common.mix(np.arange(101, COORDINATES + 101, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def runs_for(recall: float, similarity: float, fanout: int = FANOUT) -> int:
    """Runs after which a pair of this similarity is missed less often than the recall allows."""
    below = 1.0
    for _ in range(50):
        below = 1 - (1 - similarity * below) ** fanout
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity * below)))


RUNS = runs_for(TARGET_RECALL, THRESHOLD[0] / THRESHOLD[1])


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of words of a slice of texts, and the range of each text."""
    words = common.Words(texts)
    hashes, counts = words.hashes(), words.counts
    windows = common.window_hashes(hashes, WORDS)
    parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for text, (low, count) in enumerate(zip(words.bounds.tolist(), counts.tolist(), strict=False)):
        if count >= WORDS:
            parts.append(windows[low : low + count - WORDS + 1])
            sizes[text] = count - WORDS + 1
        elif count:
            parts.append(common.window_hashes(hashes[low : low + count], count) ^ np.uint64(count))
            sizes[text] = 1
    joined = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return joined, np.concatenate([[0], np.cumsum(sizes)])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set_hash (null for no words), sketch and the buckets of all runs."""

    def run(batch: pa.RecordBatch) -> dict:
        texts, hashes, sketches, keys = common.texts_of(batch), [], [], []
        for start, stop in common.slices(texts):
            values, bounds = shingles(texts[start:stop])
            full = np.flatnonzero(np.diff(bounds))
            least = np.empty((COORDINATES, len(full)), dtype=np.uint64)
            for i in range(COORDINATES):
                if len(full):
                    least[i] = np.minimum.reduceat(values * MULTIPLIERS[i] + OFFSETS[i], bounds[full])
            tokens = common.mix(least + np.arange(COORDINATES, dtype=np.uint64)[:, None])
            sketch = (tokens >> np.uint64(48)).astype("<u2").T.copy()
            place = dict(zip(full.tolist(), range(len(full)), strict=True))
            for text in range(stop - start):
                if text in place:
                    own = np.unique(values[bounds[text] : bounds[text + 1]])
                    hashes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sketches.append(sketch[place[text]].tobytes())
                    keys.append(tokens[:RUNS, place[text]].view(np.int64).tolist())
                else:
                    hashes.append(None)
                    sketches.append(None)
                    keys.append(None)
        return {
            "doc_id": common.column(batch, "doc_id"),
            "text_hash": pa.array([hashlib.md5(text).hexdigest() for text in texts], pa.string()),
            "set_hash": pa.array(hashes, pa.binary()),
            "sketch": pa.array(sketches, pa.binary()),
            "buckets": pa.array(keys, pa.list_(pa.int64())),
        }

    schema = "doc_id long, text_hash string, set_hash binary, sketch binary, buckets array<long>"
    return common.map_batches(docs.select("doc_id", "text"), run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal keys from sorted batches; a run's slices come together."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [common.column(batch, key).to_numpy(zero_copy_only=False) for key in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for values in arrays:
            change |= values[1:] != values[:-1]
        borders = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for low, high in zip(borders, borders[1:], strict=False):
            key = tuple(values[low] for values in arrays)
            if held and key != last:
                yield held
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield held


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component in a symmetric matrix of links."""
    size = len(linked)
    root = np.arange(size)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], size).min(axis=1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def by_group(rows: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """One call per group of rows, groups being dealt by their key; the function gives columns."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        size = 0
        for slices in grouped(batches, keys):
            found = function(pa.Table.from_batches(slices))
            if found is None:
                continue
            for part, values in zip(out, found, strict=True):
                part.append(values)
            size += len(found[0])
            if size > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in out], names)
                out, size = [[] for _ in names], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in out], names)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def compare_sketches(group: pa.Table) -> list[np.ndarray] | None:
    """(set, least set tied to it) in one bucket or pair of blocks, by sketches."""
    sets = group.column("sid").to_numpy()
    if len(sets) < 2:
        return None
    body = b"".join(group.column("sketch").to_pylist())
    sketch = np.frombuffer(body, dtype="<u2").reshape(len(sets), COORDINATES)
    if len(sets) == 2:
        if (sketch[0] == sketch[1]).sum() < LEAST_MATCHES:
            return None
        return [np.array([max(sets)]), np.array([min(sets)])]
    matches = np.zeros((len(sets), len(sets)), dtype=np.int16)
    for i in range(COORDINATES):
        matches += sketch[:, i][:, None] == sketch[:, i][None, :]
    order = np.argsort(sets, kind="stable")
    linked = (matches >= LEAST_MATCHES)[np.ix_(order, order)]
    sets, root = sets[order], local_roots(linked)
    tied = root != np.arange(len(sets))
    return [sets[tied], sets[root[tied]]]


def in_blocks(rows: DataFrame, count: str, per_block: int) -> DataFrame:
    """Rows with low and high: each row once for every pair of blocks that its own block is part of."""
    blocks = F.ceil(F.col(count) / per_block).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select(*rows.columns, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def split(rows: DataFrame, level: int) -> DataFrame:
    """The children of large buckets: (bucket, sid, parent) by `FANOUT` sampled tokens of each bucket."""

    def run(batch: pa.RecordBatch) -> dict:
        bucket = common.column(batch, "bucket").to_numpy().view(np.uint64)
        body = b"".join(common.column(batch, "sketch").to_pylist())
        sketch = np.frombuffer(body, dtype="<u2").reshape(len(bucket), COORDINATES)
        keys = []
        for turn in range(FANOUT):
            at = common.mix(bucket + np.uint64(7919 * level + turn + 1)) % np.uint64(COORDINATES)
            token = sketch[np.arange(len(bucket)), at.astype(np.int64)].astype(np.uint64)
            keys.append(common.mix(bucket ^ common.mix((token << np.uint64(8)) + at + np.uint64(1))).view(np.int64))
        sids, sizes = common.column(batch, "sid").to_numpy(), common.column(batch, "size").to_numpy()
        return {"bucket": np.concatenate(keys), "sid": np.tile(sids, FANOUT), "parent": np.tile(sizes, FANOUT)}

    return common.map_batches(rows.select("bucket", "sid", "size", "sketch"), run, "bucket long, sid long, parent long")


def candidates(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between sets whose sketches match, as stars inside each bucket, over all runs."""
    sketches = sets.select("sid", "sketch")
    rows = sets.select(F.explode("buckets").alias("bucket"), "sid", F.lit(1 << 60).alias("parent"))
    ready = []
    for level in range(1, LEVELS + 1):
        # Written before the join, whose plain shuffles can then be split where a bucket is hot.
        sizes = common.written(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
        sized = common.written(rows.join(sizes, "bucket"))
        large = F.col("size") > BUCKET
        stuck = F.lit(True) if level == LEVELS else F.col("size") > DENSE * F.col("parent")
        ready.append(sized.where(~large | stuck).select("bucket", "sid", "size"))
        going = sized.where(large & ~stuck)
        if level == LEVELS or going.isEmpty():
            break
        rows = split(going.join(sketches, "sid"), level)
    dealt = in_blocks(reduce(DataFrame.union, ready), "size", BUCKET).select("bucket", "low", "high", "sid")
    return by_group(dealt.join(sketches, "sid"), ["bucket", "low", "high"], compare_sketches, "a long, b long")


def compare_exactly(group: pa.Table) -> list[np.ndarray] | None:
    """(set, least set linked to it, number of linked documents) in one pair of blocks, by whole sets."""
    order = np.argsort(group.column("sid").to_numpy(), kind="stable")
    sids = group.column("sid").to_numpy()[order]
    keep = order[np.concatenate([[True], sids[1:] != sids[:-1]])]
    sids, copies, own = (group.column(name).to_numpy()[keep] for name in ("sid", "copies", "own"))
    if len(sids) < 2:
        return None
    texts = group.column("text").cast(pa.large_binary()).take(pa.array(keep)).to_pylist()
    sets = []
    for start, stop in common.slices(texts):
        values, bounds = shingles(texts[start:stop])
        sets += [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(s) for s in sets])
    tokens, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Only tokens of two sets or more add to what is common.
    shared = count > 1
    number = np.cumsum(shared) - 1
    of_shared = shared[column]
    column, owner = number[column[of_shared]], owner[of_shared]
    by_column = np.argsort(column, kind="stable")
    column, owner = column[by_column], owner[by_column]
    common_count = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common_count += part @ part.T
    both = sizes[:, None] + sizes[None, :] - common_count
    linked = THRESHOLD[1] * common_count >= THRESHOLD[0] * both
    np.fill_diagonal(linked, False)
    if own.min() != own.max():
        # Pairs inside a block belong to the task of that block alone.
        linked &= own[:, None] != own[None, :]
    root = local_roots(linked)
    return [sids, sids[root], (linked * copies[None, :]).sum(axis=1).astype(np.int64)]


def members(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, root (a number of the class, null for a text without words), class_id and n_links."""
    docs = docs.select("doc_id", "text")
    signed = common.written(signatures(docs))
    by_set = signed.where("set_hash IS NOT NULL").groupBy("set_hash")
    merged = by_set.agg(
        F.count("*").alias("copies"),
        F.min("doc_id").alias("least_id"),
        F.min(F.struct("text_hash", "doc_id")).alias("one"),
        F.first("sketch").alias("sketch"),
        F.first("buckets").alias("buckets"),
    )
    sets = common.written(merged.withColumn("sid", F.monotonically_increasing_id()))
    near = components(candidates(sets))
    sizes = common.written(near.groupBy("root").agg(F.count("*").alias("size")))
    members = near.join(sizes, "root").withColumnRenamed("node", "sid")
    active = members.join(sets.select("sid", "copies", "one"), "sid")
    texts = docs.select("text", F.md5("text").alias("text_hash"), F.col("doc_id").alias("text_id"))
    with_text = active.join(
        texts,
        (F.col("one.text_hash") == F.col("text_hash")) & F.col("one.doc_id").eqNullSafe(F.col("text_id")),
    ).select("root", "size", "sid", "copies", "text")
    blocks = in_blocks(with_text, "size", BLOCK).select("root", "low", "high", "own", "sid", "copies", "text")
    exact = by_group(blocks, ["root", "low", "high"], compare_exactly, "sid long, tied long, links long")
    exact = common.written(exact)
    links = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = components(exact.select(F.col("sid").alias("a"), F.col("tied").alias("b")))
    ids = sets.select("sid", "set_hash", "copies", "least_id")
    placed = ids.join(roots.withColumnRenamed("node", "sid"), "sid", "left").join(links, "sid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "sid"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("class_id"))
    known = placed.join(least, "root").select(
        "set_hash", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    like = signed.where("set_hash IS NOT NULL").select("doc_id", "text_hash", "set_hash").join(known, "set_hash")
    none = [F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")]
    alone = signed.where("set_hash IS NULL").select("doc_id", "text_hash", *none)
    return like.select("doc_id", "text_hash", "root", "class_id", "n_links").union(alone)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    return members(docs).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, every column as it was: one of each class, and all without words.

    Of a class the row with the smallest id stays (rows without an id come last, by text hash);
    of equal rows with that id and text, one.
    """
    own = "text_hash"
    found = common.written(members(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("first")
    kept = found.where("root IS NOT NULL").groupBy("root").agg(first, F.count("*").alias("size"))
    kept = kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    hashed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"), F.md5("text").alias(own))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(own) == F.col("kept_hash"))
    with_words = hashed.join(kept, same, "left_semi")
    if not found.where("root IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        with_words = with_words.dropDuplicates(["doc_id", own])
    without = hashed.where(~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return with_words.union(without).select("row.*")
