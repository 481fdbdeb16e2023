"""The join against all pairs, components against a union-find."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from faturalens.llm import common, jaccard_join
from faturalens.llm.components import components


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_classes(rows):
    sets = [plain_set(text) for _, text in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], least[find(i)], links[i]) for i in range(len(rows))), key=str)


def corpus(seed):
    source = random.Random(seed)

    def words(n):
        return [f"w{source.randint(0, 5000)}" for _ in range(n)]

    passage, rows = words(60), []
    for _ in range(6):
        base = words(source.choice([30, 120, 300]))
        for _ in range(source.randint(1, 12)):
            copy = list(base)
            for _ in range(source.randint(0, 8)):
                copy[source.randrange(len(copy))] = f"x{source.randint(0, 99)}"
            rows.append(" ".join(copy))
    rows += [" ".join(passage + words(source.randint(10, 200))) for _ in range(25)]
    rows += ["one two three four five six"] * 5 + ["a b", "a  b", "a", "", None, " \n ", None, "z " * 400, "z " * 300]
    ids = list(range(len(rows)))
    source.shuffle(ids)
    return [*zip(ids, rows, strict=True), (None, rows[0]), (None, "only without id"), (ids[0], rows[0])]


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 8, "BLOCK": 6}])
def test_classes_equal_all_pairs(spark, monkeypatch, limits):
    common.prepare(spark)
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.classes(docs).collect()), key=str)
    assert got == plain_classes(rows)


def test_one_of_each(spark):
    near = " ".join(f"v{i}" for i in range(100))
    rows = [(5, near, "a"), (2, near + " tail", "b"), (2, near + " tail", "b"), (None, near, "c"), (9, "other", "d"), (7, None, "e"), (None, "lone", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text_hash"] for r in kept.collect()) == ["b", "d", "e", "f"]
    assert jaccard_join.one_of_each(docs.limit(0)).collect() == []


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.9995, 0.8) >= jaccard_join.runs_for(0.9, 0.8) >= 1


def test_components(spark):
    source = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in source.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for pair in edges for x in pair if pair[0] != pair[1]}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_very_long_text_and_its_near_copy(spark):
    """A megabyte of words twice with one changed, a megabyte without a blank twice, and one that shares a tenth."""
    common.prepare(spark)
    source = random.Random(6)
    long = [f"w{source.randint(0, 50_000)}" for _ in range(150_000)]
    near = long[:70_000] + ["other"] + long[70_001:]
    rows = [(3, " ".join(long)), (1, " ".join(near)), (4, "x" * 1_000_000), (2, "x" * 1_000_000), (5, " ".join(long[:15_000]))]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.classes(data).select("doc_id", "class_id", "n_links").collect()) == [
        (1, 1, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1), (5, 5, 0),
    ]
