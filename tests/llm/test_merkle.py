"""The manifest against a plain tree, and folding by hand."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from faturalens.llm import common, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(level, place):
    """Siblings of a node up to the root, as (left, right) texts, and the root."""
    path = []
    while len(level) > 1:
        low = place - place % 3
        run = level[low : low + 3]
        path.append(("".join(run[: place % 3]), "".join(run[place % 3 + 1 :])))
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
        place //= 3
    return path, level[0] if level else None


def plain(rows):
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4], text)))
    tampered = lambda r: r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    trees = {}
    for r in rows:
        own = leaf(r, r[1])
        trees.setdefault(r[3], []).append((r[0] is not None, r[0], own, leaf(r, r[1].replace("\n", "")) if tampered(r) else own))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in trees.values():
        leaves.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    subroots = [climb([x[2] for x in trees[s]], 0)[1] for s in order]
    out = []
    for number, source in enumerate(order):
        above, root = climb(subroots, number)
        level = [x[2] for x in trees[source]]
        for place, (_, doc_id, own, changed) in enumerate(trees[source]):
            path = climb(level, place)[0] + above
            folded = changed
            for left, right in path:
                folded = H(left, folded, right)
            out.append((doc_id, own, subroots[number], root, H(*[a + b for a, b in path]), folded, folded == root))
    return sorted(map(repr, out))


def got(spark, rows):
    common.prepare(spark)
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(repr(tuple(r)) for r in found)


def rows_of(seed, count, sources):
    source = random.Random(seed)
    return [
        (i, "\n".join(source.choices(["a", "é b", "", "c c"], k=source.randint(1, 4))), source.choice(["en", None]), source.choice(sources), source.choice([3, None]), "x", 1)
        for i in source.sample(range(10**6), count)
    ]


@pytest.mark.parametrize(("count", "sources"), [(300, ["a", "hot", "hot", "hot", "É", None, ""]), (27, ["s"]), (4, list("abcd")), (1, ["a"])])
def test_manifest_equals_a_plain_tree(spark, count, sources):
    rows = rows_of(count, count, sources)
    assert got(spark, rows) == plain(rows)


def test_trees_higher_than_a_block(spark):
    rows = rows_of(9, 2200, ["hot"] * 9 + ["a", None])
    rows += [(10**7 + i, "lone\n", None, f"s{i}", i, "x", 1) for i in range(30)]
    assert got(spark, rows) == plain(rows)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None, "x", 1), (None, "a\nb", "en", None, 1, "x", 1), (2, "", "en", "a", 0, "x", 1), (2, None, "en", "a", 0, "x", 1)]
    rows += [(5, "same\n", "en", "a", 5, "x", 1)] * 5 + [(-3, "x" * 2_000_000 + "\n", "en", "a", 2, "x", 1)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:1]) == plain(rows[:1])


def test_an_empty_table_has_no_rows(spark):
    common.prepare(spark)
    nothing = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert nothing.collect() == [] and nothing.columns[0] == "doc_id"


def test_no_node_serves_more_than_a_lane(spark):
    """Keys of the climb's join have at most 3^6 leaves, though one source has nearly all rows."""
    common.prepare(spark)
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1).cast("long").alias("n_chars")
    )
    rows = merkle.numbered(merkle.written(merkle.leaves(docs)), ["key"], ["doc_id", "leaf"])
    lanes = rows.groupBy(F.floor(F.col("_place") / merkle.BLOCK)).count().agg(F.max("count")).first()[0]
    assert lanes == merkle.BLOCK and rows.agg(F.max("_place")).first()[0] == 2999
