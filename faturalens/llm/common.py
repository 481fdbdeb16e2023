"""What the operators of this folder share: session set-up, Arrow batches, words and hashes of whole texts.

Words are runs of bytes other than space and \\x09-\\x0D, which in UTF-8 is the same as runs of
such characters. Texts reach Python as bytes, in slices of bounded size; a null text is an empty one.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faturalens.plans.shared import shared_folder
from faturalens.plans.shared import written as written

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SLICE_BYTES = 2_000_000
BATCH_ROWS = 2_000
HELD_OUT_MODULUS = 5


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, keep their batches small, and see that there is a shared folder."""
    # A batch of whole texts is held several times over in a worker: arrays, bytes, results.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    known = context.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    shared_folder(spark)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the documents that no model learns from; a document without an id is one of them."""
    text = F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % HELD_OUT_MODULUS == 0, F.lit(True))


def hash_sample(df: DataFrame, share: Column | float, seed: int = 17) -> DataFrame:
    """Rows whose hashed doc_id falls below the share; the same rows on every evaluation."""
    position = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.where(position < share)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """One Arrow batch in, the columns of one batch out."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield pa.RecordBatch.from_arrays([as_array(out[name]) for name in names], names)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, mask: Callable[[pa.RecordBatch], object]) -> DataFrame:
    """The rows whose mask is true, with every column as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(np.asarray(mask(batch), dtype=bool)))

    return df.mapInArrow(run, df.schema)


def as_array(values: object) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        return values.combine_chunks()
    return values if isinstance(values, pa.Array) else pa.array(values)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Each text in UTF-8; null is empty."""
    values = column(batch, name)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return [value or b"" for value in values.cast(kind).to_pylist()]


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` bytes together; a longer text is a run of its own."""
    start = size = 0
    for index, text in enumerate(texts):
        if index > start and size + len(text) > limit:
            yield start, index
            start, size = index, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between slices."""
    if "up" not in _powers or len(_powers["up"]) < count:
        size = max(count, SLICE_BYTES + 4096)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            values = np.full(size, base, dtype=np.uint64)
            values[0] = 1
            _powers[name] = np.cumprod(values, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Words:
    """The words of a slice of texts: their places in the joined bytes and, per text, their range."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(sizes)])
        inside = ~SPACE[self.bytes]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of powers taken piece by piece."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        first = 0
        while first < len(self.starts):
            origin = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, origin + SLICE_BYTES, side="right")))
            stop = self.ends[last - 1]
            up, down = powers(int(stop - origin) + 1)
            piece = self.bytes[origin:stop].astype(np.uint64)
            piece += np.uint64(1)
            piece *= up[: stop - origin]
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(piece, dtype=np.uint64)])
            begin, end = self.starts[first:last] - origin, self.ends[first:last] - origin
            out[first:last] = (sums[end] - sums[begin]) * down[begin]
            first = last
        return mix(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, by its first word."""
    total = words[: len(words) - width + 1].copy() if len(words) >= width else np.empty(0, dtype=np.uint64)
    for offset in range(1, width):
        total *= BASE
        total += words[offset : offset + len(total)]
    return mix(total)
