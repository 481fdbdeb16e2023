"""Exact search against sorting all products."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from faturalens.llm import common, tiles, topk


def plain(rows, k):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in usable:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in usable if j != i and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_search_equals_sorting(spark):
    common.prepare(spark)
    source = np.random.default_rng(1)
    rows = [(i, [float(x) for x in source.integers(-3, 4, 6) / 4]) for i in range(0, 900, 3)]
    rows += [(1200, [0.5] * 6), (1300, [0.25, 0.5]), (7, [1.0, 2.0]), (8, [0.0]), (None, [1.0] * 6), (9, None), (11, [None] * 6), (13, [math.nan] * 6), (15, [math.inf] * 6)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score")
    for sizes in ({}, {"block_rows": 3, "shard_rows": 20}):
        got = sorted(tuple(r) for r in topk.top_k(data, **sizes).collect())
        assert got == plain(rows, 10)


def test_repeated_rows_and_nothing(spark):
    rows = [(100, [3e5, 1.0])] * 2 + [(1, [3e5, 0.0])] * 2 + [(2, [-3e5, 5.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["rank"], r["score"]) for r in topk.top_k(data, k=3).orderBy("rank").collect()]
    big = (3 * 10**5 * 1024) ** 2
    assert got == [(1, 1, big), (1, 2, big), (2, 3, 5 * 1024**2 - big)]
    assert topk.top_k(data.limit(0)).collect() == []


def test_components_of_any_size(spark):
    """Finite rows stay; sums beyond a long are right where they are not returned, and raise where they are."""
    rows = [(100, [2.0**43, 0.0, 1.0]), (1, [5e12, 0.0, 0.0]), (2, [-5e12, 0.0, 0.0]), (3, [0.0, 1e300, 0.5]), (4, [1e-9, 0.0, 0.0]), (5, [0.0, 0.0, 3.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(data, k=2).collect()
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(data.where("vec_id <> 1"), k=3).orderBy("rank").collect()]
    assert got == [(5, 3 * 1024**2), (3, 1024**2 // 2), (4, 0)]


def test_tiles_of_one_block_lie_in_many_partitions(spark):
    common.prepare(spark)
    source = np.random.default_rng(2)
    data = spark.createDataFrame([(i, source.random(4).tolist()) for i in range(2000)], "vec_id long, embedding array<float>")
    rows = tiles.usable(data)
    blocks = tiles.blocks(rows.where("vec_id % 100 = 0"), 1024)
    assert blocks.count() == 1
    joined = tiles.joined(blocks, tiles.shards(rows, 50), 8)
    assert joined.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    assert joined.count() == tiles.shards(rows, 50).count()


def test_best_lists_equal_sorting():
    source = np.random.default_rng(3)
    for kind in (np.int64, object):
        scores, ids = source.integers(-3, 4, (20, 60)).astype(kind), source.permutation(60)
        allowed = source.random((20, 60)) < 0.3
        best = tiles.Best(20, 4)
        for low in range(0, 60, 7):
            best.add(scores[:, low : low + 7], ids[low : low + 7], allowed[:, low : low + 7])
        for row in range(20):
            want = sorted((-scores[row, j], ids[j]) for j in range(60) if allowed[row, j])[:4]
            assert [(-s, i) for s, i, ok in zip(best.scores[row], best.ids[row], best.filled[row], strict=True) if ok] == want


def test_integers_round_down_at_any_size():
    values = np.array([[-0.3, 2.0**60 + 512, 1e308, -1e-300, 0.999]])
    assert tiles.integers(values, 1024).ravel().tolist() == [math.floor(Fraction(x) * 1024) for x in values.ravel().tolist()]
