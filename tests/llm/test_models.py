"""Learned operators: held-out accuracy, brute-force versions of their searches, and odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faturalens.llm import common, language, line_quality, site_quality, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def odd(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "12 34 -- !!", "x"), (3, "Word " * 5000, "x"), (3, "Word " * 5000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_language_on_held_out_documents(spark, docs):
    model = language.learn(docs, 150)
    found = language.predict(docs.withColumn("score", F.lit("clash")), model).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = language.predict(odd(spark), model).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3
    assert got[3]["lang_pred"] == got[4]["lang_pred"] != "und"
    assert language.predict(docs.limit(0), model).collect() == []
    nothing = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(odd(spark), nothing).collect()} == {"und"}
    assert language.accepted(odd(spark), model).columns == ["doc_id", "text", "score"]


def test_votes_and_scores_by_hand(spark, docs):
    """Each machine's margin from the features, each vote and each probability one by one."""
    model = language.learn(docs, 60)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ["the der le", "x1", "zzz zzz qqq"]
    rows = language.features(texts).astype(np.float64)
    names, scores = language.predict_texts(model, texts)
    family = lambda i: language.FAMILY_OF.get(model.languages[i], model.languages[i])
    for text, row, name, score in zip(texts, rows, names, scores, strict=True):
        margins = [float(row @ model.weights[: language.BUCKETS, m] + model.bias[m]) for m in range(len(model.machines))]
        votes, sums = Counter(), Counter()
        for margin, (first, second) in zip(margins, model.machines, strict=True):
            level = len(model.languages) if family(first[0]) != family(second[0]) else 1
            for member in first if margin >= 0 else second:
                votes[member] += level
            for member in first + second:
                sums[member] += level * (margin if member in first else -margin)
        most = max(votes.values())
        best = max((i for i in votes if votes[i] == most), key=lambda i: sums[i])
        assert name == model.languages[best]
        right = 1.0
        for margin, (first, second) in zip(margins, model.machines, strict=True):
            if best in first + second:
                sure = 1 / (1 + np.exp(-language.SHARPNESS * abs(margin)))
                right *= sure if (margin >= 0) == (best in first) else 1 - sure
        assert score == pytest.approx(right, abs=2e-3)


def test_documents_leave_by_language_and_by_score(spark, docs):
    model = language.learn(docs, 150)
    planted = docs.where("doc_id % 7 = 0").unionByName(
        spark.createDataFrame([(-1, "Xq zj 9 kx", "en", "s", 9), (-2, "123 !!", "en", "s", 6), (-3, None, "en", "s", 0)], docs.schema)
    )
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(planted, model).collect()}
    for wanted, least in ((None, 0.5), (["en", "fr"], 0.0), (None, 0.97), ([], 0.0)):
        kept = {r["doc_id"] for r in language.accepted(planted, model, wanted, least).collect()}
        assert kept == {i for i, (name, score) in said.items() if name in (wanted if wanted is not None else model.languages) and score >= least}
    assert 0 < len(language.accepted(planted, model, None, 0.97).collect()) < len(said) - 2
    known = {r["doc_id"] for r in planted.where("doc_id >= 0").collect()}
    default = {r["doc_id"] for r in language.accepted(planted, model).collect()}
    assert len(default & known) >= 0.99 * len(known) and not default & {-2, -3}


def test_one_language_and_pieces_of_long_texts():
    model = language.fit_rows(language.features(["the cat", "a dog"]), ["en", "en"])
    assert language.predict_texts(model, ["what", "1"]) == (["en", "und"], [1.0, 0.0])
    two = language.fit_rows(language.features(["the cat sat", "der hund und", "le chat est"]), ["en", "de", "fr"])
    long = "the cat sat on it " * 100_000
    whole, parts = language.margins_of(two, [long])[0], language.margins_of(two, [long[:1800]])[0]
    assert np.allclose(whole, parts, atol=1e-3)


def plain_segments(values):
    """Maximal segments by their definition: take the best, then go on left and right of it."""
    best = None
    for low in range(len(values)):
        total = 0.0
        for high in range(low, len(values)):
            total += values[high]
            if total > 1e-9 and (best is None or total > best[0] + 1e-9):
                best = (total, low, high)
    if best is None:
        return []
    _, low, high = best
    left = plain_segments(values[:low])
    right = [(s, a + high + 1, b + high + 1) for s, a, b in plain_segments(values[high + 1 :])]
    return [*left, best, *right]


def test_segments_equal_the_definition():
    source = random.Random(7)
    for _ in range(300):
        n, step = source.randint(1, 25), -source.choice([0.3, 0.7, 1.9])
        values = [source.choice([1.17, 2.31, 0.53]) + source.random() / 1000 if source.random() < 0.35 else step for _ in range(n)]
        at = [i for i, v in enumerate(values) if v > 0]
        got = toxicity.segments(at, [values[i] for i in at], step)
        want = plain_segments(values)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def test_moment_root():
    root = toxicity.moment_root([2.0], [0.1], -1.0, 0.9)
    assert 0.9 * np.exp(-root) + 0.1 * np.exp(2 * root) == pytest.approx(1, abs=1e-6)


def test_log_odds_by_hand(docs, labels):
    """Counts, priors, deviations, and counts of different surroundings, unit by unit in plain Python."""
    model = toxicity.learn(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    marks = {r["doc_id"]: bool(r["toxic"]) for r in labels.where("toxic IS NOT NULL").collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    counts, words = {False: Counter(), True: Counter()}, Counter()
    around = {False: set(), True: set()}
    for doc, toxic in marks.items():
        tokens = toxicity.tokens_of(texts[doc])
        words[toxic] += len(tokens)
        padded = ["", *tokens, ""]
        for i, token in enumerate(tokens, 1):
            for unit in toxicity.units_of(token):
                counts[toxic][unit] += 1
                around[toxic].add((unit, " ".join(padded[i - 1 : i + 2])))

    def outstanding(clean, toxic):
        whole, found = toxicity.PRIOR_SHARE * (words[False] + words[True]), {}
        for unit in set(clean) | set(toxic):
            prior = toxicity.PRIOR_SHARE * (clean[unit] + toxic[unit])
            odds = [np.log((n[unit] + prior) / (words[which] + whole - n[unit] - prior)) for which, n in ((True, toxic), (False, clean))]
            score, deviation = odds[0] - odds[1], np.sqrt(1 / (toxic[unit] + prior) + 1 / (clean[unit] + prior))
            if score >= toxicity.LEAST_SCORE and score / deviation >= toxicity.LEAST_Z:
                found[unit] = (score, score / deviation)
        return found

    first = outstanding(counts[False], counts[True])
    once = {toxic: Counter(unit for unit, _ in around[toxic] if unit in first) for toxic in (False, True)}
    want = outstanding(once[False], once[True])
    assert set(model.units) == set(want) and want
    assert all(model.units[unit] == pytest.approx(want[unit]) for unit in want)
    share = sum(once[False][unit] for unit in want) / words[False]
    assert model.step == pytest.approx(np.log((1 - toxicity.PASSAGE_RATE) / (1 - min(share, toxicity.PASSAGE_RATE / 2))))


def test_toxicity_on_held_out_documents(spark, docs, labels):
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    got = toxicity.score(odd(spark), model).collect()
    assert [r["predicted"] for r in got] == [0] * 5 and got[3]["score"] == got[4]["score"]
    assert toxicity.clean(odd(spark), model).count() == 5
    found = toxicity.passages(docs, model)
    assert found.where("first_token > last_token OR sum <= 0").isEmpty() and not found.isEmpty()
    assert toxicity.score(docs.limit(0), model).collect() == []
    without = toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd(spark), without).collect()} == {0.0}


def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered, seen, repeated = Counter(windows), set(), set(), 0
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered |= set(range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def test_base_figures_equal_plain_ones(spark, docs):
    source = random.Random(4)
    texts = [r["text"] for r in docs.limit(150).collect()]
    texts += ["", None, "\n", "a\n\na\n a\na", "é\x0bb\x1cc|<>", "x " * 9, "a b c d e f g h " * 2, "a\r\na\r\n", "\n".join("ab" * source.randint(0, 1) for _ in range(50))]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in got:
        n, chars, symbols, lines, repeats = plain_figures(texts[r["doc_id"]])
        assert [r[name] for name in names] == [n, chars, symbols, lines, repeats]
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) == (not r["kept"])


def test_viterbi_and_marginals_equal_all_sequences():
    source = np.random.default_rng(3)
    for n in (1, 2, 5):
        scores, moves = source.normal(size=(n, 2)), source.normal(size=(2, 2))

        def total(path):
            return sum(scores[i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))

        paths = list(itertools.product((0, 1), repeat=n))
        assert tuple(line_quality.viterbi(scores, moves)) == max(paths, key=total)
        weights = np.exp([total(path) for path in paths])
        weights /= weights.sum()
        want = np.array([[sum(w for w, path in zip(weights, paths, strict=True) if path[i] == s) for s in (0, 1)] for i in range(n)])
        states, pairs = line_quality.chain_gradient(scores, moves, np.array([0, n]))
        assert np.allclose(states, want) and pairs.sum() == pytest.approx(n - 1)


def test_line_quality_on_held_out_documents(spark, docs, labels):
    model = line_quality.learn(docs, labels)
    rows = line_quality.judge(docs, model).where(common.held_out()).join(labels, "doc_id").where("not base_failed").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.4 * len(bad)
    assert [r["kept"] for r in line_quality.judge(odd(spark), model).collect()[:3]] == [False] * 3
    marks = line_quality.line_marks(spark.createDataFrame([(1, "a line\n\nb"), (2, None)], "doc_id long, text string"), model).collect()
    assert [len(r["is_content"]) for r in marks] == [2, 0]
    assert line_quality.judge(docs.limit(0), model).collect() == []
    assert line_quality.learn(docs, labels.limit(0)) is None


def test_site_quality_on_held_out_documents(spark, docs, labels):
    rows = site_quality.score(docs, labels, F.col("source"), F.col("lang")).where("held_out").join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.3 * len(bad)
    got = site_quality.score(odd(spark), labels.limit(0), F.lit(None), F.lit(None)).collect()
    assert [r["score"] for r in got] == [0.5] * 5
    assert site_quality.score(docs.limit(0), labels, F.col("source"), F.col("lang")).collect() == []


def test_posteriors_by_hand(spark, docs, labels):
    """Prior strengths by moments, host and path posteriors without the row's own label, and the score."""
    got = {r["doc_id"]: r for r in site_quality.score(docs, labels, F.col("source"), F.col("lang")).collect()}
    place = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.where("quality IS NOT NULL").collect() if r["doc_id"] in got and not got[r["doc_id"]]["held_out"]}
    hosts, paths = Counter(), Counter()
    for doc, quality in marks.items():
        for table, key in ((hosts, place[doc][0]), (paths, place[doc])):
            table[key, "n"] += 1
            table[key, "good"] += quality
    base = (sum(marks.values()) + 0.5) / (len(marks) + 1)

    def strength(table, rate):
        keys = [key for key, what in table if what == "n"]
        n, p, r = (np.array(x, dtype=float) for x in zip(*[(table[k, "n"], table[k, "good"] / table[k, "n"], rate(k)) for k in keys], strict=True))
        excess = ((n * (p - r) ** 2).sum() - (r * (1 - r)).sum()) / max((n * r * (1 - r)).sum() - (r * (1 - r)).sum(), 1e-9)
        return min(site_quality.MOST_STRENGTH, max(site_quality.LEAST_STRENGTH, 1 / excess - 1)) if excess > 0 else site_quality.MOST_STRENGTH

    host_strength = strength(hosts, lambda k: base)
    host_rate = lambda h: (hosts[h, "good"] + host_strength * base) / (hosts[h, "n"] + host_strength)
    path_strength = strength(paths, lambda k: host_rate(k[0]))
    for doc, r in got.items():
        key, own, good = place[doc], int(doc in marks), marks.get(doc, 0)
        host = (hosts[key[0], "good"] - good + host_strength * base) / (hosts[key[0], "n"] - own + host_strength)
        path = (paths[key, "good"] - good + path_strength * host) / (paths[key, "n"] - own + path_strength)
        assert (r["host_posterior"], r["path_posterior"]) == (pytest.approx(host), pytest.approx(path))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(r["evidence"] + np.log(path / (1 - path))))))


def test_sparse_sites_shrink(spark):
    base = "Some good words stand in this line of text, and more of them follow here.\n" * 2
    ids = [i for i in range(400)]
    rows = [(i, base + str(i), "big" if i < 300 else f"s{i}", "p") for i in ids]
    marks = [(i, 0, 0) if i < 150 or i % 7 == 0 else (i, 1, 0) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = site_quality.score(docs, labels, F.col("host"), F.col("path")).collect()
    assert all(0 < r["path_posterior"] < 1 for r in got)
    lone = [r["host_posterior"] for r in got if r["doc_id"] >= 300]
    assert max(lone) - min(lone) < 0.5
