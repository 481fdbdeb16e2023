"""Mining against sorting all products, and Strassen's products against plain ones."""

import math

import numpy as np
import pytest

from faturalens.llm import common, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, anchors=50, positives=5, negatives=3):
    usable = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, kind, v in {(i, k, tuple(v)) for i, k, v in usable if i % anchors == 0}:
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, k) for i, k, w in usable if i != a and len(w) == len(v)]
        best = sorted((-s, i) for s, i, k in scored if k == kind)[:positives]
        for minus, p in best:
            found = sorted((-s, i) for s, i, k in scored if k != kind and -50 * minus <= 100 * s <= -95 * minus)[:negatives]
            out += [(a, p, rank, i, -minus, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(7, 9, 5), (101, 77, 203), (1, 64, 3), (60, 130, 0), (0, 8, 8)])
def test_strassen_equals_the_plain_product(shape):
    source = np.random.default_rng(1)
    m, k, n = shape
    left, right = source.integers(-(2**28), 2**28, (m, k)), source.integers(-(2**28), 2**28, (k, n))
    assert (hard_negatives.strassen(left, right, 4) == left @ right).all()
    whole = hard_negatives.strassen(left.astype(object) * 2**70, right.astype(object), 4)
    assert (whole == (left.astype(object) * 2**70) @ right.astype(object)).all()


def test_strassen_is_right_though_sums_on_the_way_wrap():
    source = np.random.default_rng(2)
    left = source.integers(-(2**30), 2**30, (16, 16)) << 16
    right = source.integers(-(2**11), 2**11, (16, 16))
    want = left.astype(object) @ right.astype(object)
    assert max(abs(x) for x in want.ravel()) < 2**63
    assert (hard_negatives.strassen(left, right, 1) == want.astype(np.int64)).all()


def test_mining_equals_sorting(spark):
    common.prepare(spark)
    source = np.random.default_rng(3)
    rows = [(i, [float(x) for x in source.integers(-3, 5, 6) / 4], int(source.integers(0, 3))) for i in range(0, 800, 2)]
    # A hot label, repeated rows, ties, other lengths, and rows that take no part.
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.125], 1) for i in range(801, 1000, 2)] + rows[:30]
    rows += [(1050, [1.0, 0.5], 4), (1001, [0.5, 0.5], 4), (1003, [0.9, 0.0], 5), (1100, [], 4), (1005, [], 4)]
    rows += [(None, [1.0] * 6, 1), (1007, None, 1), (1009, [None] * 6, 1), (1011, [math.nan] * 6, 1), (1013, [math.inf] * 6, 1), (1015, [1.0] * 6, None)]
    data = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "'x' AS v")
    for sizes in ({}, {"block_rows": 3, "shard_rows": 20}):
        got = sorted(tuple(r) for r in hard_negatives.mine(data, **sizes).collect())
        assert got == plain(rows) and len(got) > 100
    assert hard_negatives.mine(data.limit(0)).collect() == []


def test_windows_of_large_and_negative_scores(spark):
    common.prepare(spark)
    rows = [(50, [2.0**34, 1.0], 1), (1, [2.0**12, 0.0], 1), (2, [0.9 * 2**12, 7.0], 2), (3, [-(2.0**12), 0.0], 1), (4, [0.0, 0.0], 2)]
    rows += [(5, [0.96 * 2**12, 0.0], 2), (6, [2.0**11, 0.0], 3), (8, [1.0, 1.0], 4)]
    data = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives.mine(data).collect())
    assert got == plain(rows) and got


def test_very_long_vectors(spark):
    common.prepare(spark)
    source = np.random.default_rng(4)
    rows = [(i, source.normal(size=20_000).tolist(), i % 2) for i in (0, 50, 3, 5, 8, 11)]
    got = sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain([(i, np.float32(v).tolist(), k) for i, v, k in rows])
