"""Mixing against a plain water-filling, and its promises."""

import random
import re

import pytest

from faturalens.llm import common, mixing

SCHEMA = "doc_id long, text string, source string, mix_size string"


def plain_targets(sizes):
    keys = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(keys)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in keys if s not in fixed]
        total = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / total for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**share, **fixed}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


def rows_of(seed, count=400):
    source = random.Random(seed)
    names = ["a", "B", "é", None, "hot", "hot", "hot", ""]
    return [(i, " ".join("w" * source.randint(0, 60)), source.choice(names), "clash") for i in range(count)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_totals(spark, seed):
    common.prepare(spark)
    rows = rows_of(seed)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in got:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["mix_size"]
        taken[s] = taken.get(s, 0) + r["mix_size"] * r["mix_copies"]
        target[s] = r["mix_target"]
        largest[s] = max(largest.get(s, 0), r["mix_size"])
        assert 0 <= r["mix_copies"] <= 2
    for s, value in plain_targets(sizes).items():
        assert target[s] == pytest.approx(value)
        assert abs(taken[s] - value) <= 2 * largest[s]


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = spark.createDataFrame(rows_of(3), SCHEMA)
    one = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(docs).collect()}
    two = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(docs.repartition(7, "text")).collect()}
    assert one == two


def test_many_salts_give_whole_numbering(spark):
    docs = spark.createDataFrame(rows_of(4), SCHEMA)
    got = mixing.mix(docs, rows_per_salt=5).collect()
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        rate = own[0]["mix_target"] / own[0]["mix_source_size"]
        assert abs(sum(r["mix_copies"] for r in own) - rate * len(own)) <= 1


def test_the_contract_on_documents(spark):
    """Targets and sizes by plain counting; what is taken of a source is within its two largest documents of its target."""
    common.prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: (r["source"], len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))) for r in docs.collect()}
    sizes, largest = {}, {}
    for source, size in texts.values():
        sizes[source] = sizes.get(source, 0) + size
        largest[source] = max(largest.get(source, 0), size)
    taken, want = dict.fromkeys(sizes, 0), plain_targets(sizes)
    got = mixing.mix(docs).collect()
    assert {r["doc_id"]: (r["source"], r["mix_size"]) for r in got} == texts and len(got) == len(texts)
    for r in got:
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
        assert r["mix_source_size"] == sizes[r["source"]] and r["mix_target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["mix_copies"] <= 2
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)


def test_columns_of_any_type_stay(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'a b' AS text, 's' AS source, map('k', 1) AS `m.x`, array(map('a', 'b')) AS l, struct(map(1, 2)) AS t")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r["m.x"]["k"] for r in mixed.collect()} <= {1}
    assert mixing.mix(docs).columns[:6] == docs.columns


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = mixing.mix(spark.createDataFrame([(1, None, "a", ""), (None, " \n", None, "")], SCHEMA)).collect()
    assert [(r["mix_size"], r["mix_target"], r["mix_copies"]) for r in nothing] == [(0, 0.0, 0)] * 2
    same = mixing.mix(spark.createDataFrame([(None, "a b", "s", "")] * 9, SCHEMA)).collect()
    assert sum(r["mix_copies"] for r in same) in (13, 14)


def test_mixed_documents_keep_columns_and_repeat_rows(spark):
    docs = spark.createDataFrame(rows_of(5), SCHEMA)
    copies = sum(r["mix_copies"] for r in mixing.mix(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert [r["mix_size"] for r in mixed.collect()] == ["clash"] * copies
