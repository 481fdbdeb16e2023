"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

Learning. Tokens (lower-case runs of letters) of labelled documents and their beginnings of some
lengths, which inflected forms share, are counted by label; with an informative Dirichlet prior,
proportional to the share of all tokens, each such unit gets a log-odds and its deviation. A token
counts by the unit of it that stands out most. Units whose log-odds stand out by `LEAST_Z` deviations, also when equal
surroundings (as copies have) count once, score that much; any other token scores the log-odds of no such token in a toxic passage, a little below zero.

Search. One linear scan over a text finds all maximal segments (each positive run joins earlier
ones while that raises its sum). A segment of sum s in a text of n tokens has the chance
1 - exp(-K n exp(-lambda s)) in clean text; lambda solves the moment equation of token scores in
clean documents, K matches the number of segments that clean documents show. Passages whose
chance is below `LEVEL` are significant. Their surprises (-log chance) are summed, and a logistic
curve in that sum, fitted to the labels, is the document's score.

Learning uses at most about `MOST_LABELLED` labelled documents that are not held out, drawn by
hash. A null or empty text has no passage and the score of one without passages. Without labels
every score is 0. Labels that contradict each other for one id all count; rows without an id are
never learned from. Texts of any length are scanned whole, in time linear in it. Repeated rows are scored
alike; an empty table gives an empty one; of the
documents only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faturalens.llm import common

MOST_LABELLED = 12_000
LEAST_Z = 4.0
LEAST_SCORE = 1.0
BEGINNINGS = (4, 5, 6, 7)
KEPT_TOKENS = 150_000
PRIOR_SHARE = 0.05
PASSAGE_RATE = 0.05
LEVEL = 0.05
# ASCII letters and all bytes of longer characters stay, the rest are blanks.
BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class Model:
    """Score and distinction of outstanding units, the step of any other token, and the calibration."""

    units: dict[str, tuple[float, float]] = field(default_factory=dict)
    step: float = -0.05
    rate: float = 1.0
    scale: float = 1e-3
    intercept: float | None = None
    slope: float = 0.0
    known: dict[str, float] = field(default_factory=dict)

    def score(self, token: str) -> float:
        """The token's score, 0 for one without an outstanding unit."""
        value = self.known.get(token)
        if value is None:
            if len(self.known) >= KEPT_TOKENS:
                self.known.clear()
            found = [self.units[unit] for unit in units_of(token) if unit in self.units]
            value = self.known[token] = max(found, key=lambda pair: pair[1])[0] if found else 0.0
        return value


def tokens_of(text: bytes) -> list[str]:
    lower = text.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    return lower.translate(BLANKED).decode("utf-8", "replace").split()


def units_of(token: str) -> list[str]:
    """The whole token, and its beginnings that are shorter than it, each with a mark of its kind."""
    return [token + "$", *[token[:k] for k in BEGINNINGS if k <= len(token)]]


def segments(positions: list[int], values: list[float], step: float) -> list[tuple[float, int, int]]:
    """(sum, first, last) of all maximal segments; positions hold the positive values, all else is `step`.

    A stack of candidates with the running sums before and behind each. A new run goes back to the
    nearest candidate that began at a lower sum and joins it if it ended at a lower sum than the
    run does; what lay between is swallowed.
    """
    stack: list[tuple[float, float, int, int]] = []
    total, behind = 0.0, 0
    for at, value in zip(positions, values, strict=True):
        before = total + step * (at - behind)
        total, behind = before + value, at + 1
        low, first = before, at
        kept: list[tuple[float, float, int, int]] = []
        while True:
            while stack and stack[-1][0] >= low:
                kept.append(stack.pop())
            if stack and stack[-1][1] < total:
                low, _, first, _ = stack.pop()
                kept = []
                continue
            break
        stack.extend(reversed(kept))
        stack.append((low, total, first, at))
    return [(end - low, first, last) for low, end, first, last in stack]


def passages_of(model: Model, text: bytes) -> tuple[list[tuple[float, int, int]], int]:
    tokens, known, score = tokens_of(text), model.known, model.score
    values = [known[token] if token in known else score(token) for token in tokens]
    at = [i for i, value in enumerate(values) if value]
    return (segments(at, [values[i] for i in at], model.step) if at else []), len(tokens)


def surprise(model: Model, total: float, length: int) -> float:
    """-log of the chance of a segment of this sum in clean text of this length."""
    expected = model.scale * max(1, length) * math.exp(-model.rate * total)
    return -math.log(-math.expm1(-expected)) if expected > 1e-12 else -math.log(model.scale * max(1, length)) + model.rate * total


def significant(model: Model, text: bytes, level: float = LEVEL) -> list[tuple[int, int, float, float]]:
    """(first token, last token, sum, surprise) of every significant passage, in order."""
    found, length = passages_of(model, text)
    rated = [(first, last, total, surprise(model, total, length)) for total, first, last in found]
    return [row for row in rated if row[3] >= -math.log(level)]


def evidence(model: Model, text: bytes) -> float:
    return sum(row[3] for row in significant(model, text))


def chance(model: Model, x: float) -> float:
    if model.intercept is None:
        return 0.0
    z = model.intercept + model.slope * math.log1p(x)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def moment_root(scores: list[float], shares: list[float], step: float, rest: float) -> float:
    """The positive lambda with sum of share * exp(lambda * score) = 1, by bisection."""

    def moment(x: float) -> float:
        return rest * math.exp(x * step) + sum(p * math.exp(min(700.0, x * s)) for p, s in zip(shares, scores, strict=True))

    low, high = 1e-6, 1.0
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    return low


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (never below zero) of a lightly ridged one-variable logistic curve, by Newton steps."""
    design, theta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        theta = theta + move
        if np.abs(move).max() < 1e-9:
            break
    if theta[1] < 0:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return math.log(share / (1 - share)), 0.0
    return float(theta[0]), float(theta[1])


def outstanding(counts: DataFrame, n_clean: float, n_toxic: float) -> list:
    """Units (token, clean, score, distinct) whose log-odds is high enough, and by enough deviations."""
    all_prior = PRIOR_SHARE * (n_clean + n_toxic)
    prior = F.lit(PRIOR_SHARE) * (F.col("clean") + F.col("toxic"))

    def odds(count: str, total: float):
        mass = F.col(count) + prior
        return F.log(mass / (F.lit(total + all_prior) - mass))

    score = odds("toxic", n_toxic) - odds("clean", n_clean)
    deviation = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    stands_out = (score >= LEAST_SCORE) & (score / deviation >= LEAST_Z)
    return counts.select("token", "clean", score.alias("score"), (score / deviation).alias("distinct")).where(stands_out).collect()


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model from labelled documents that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out())
    size = usable.count()
    if not size:
        return Model()
    drawn = common.written(common.hash_sample(usable, min(1.0, most / size)).select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    sample = docs.select("doc_id", "text").join(drawn, "doc_id")

    def count(batch: pa.RecordBatch) -> dict:
        by_label = (Counter(), Counter())
        for text, toxic in zip(common.texts_of(batch), common.column(batch, "toxic").to_pylist(), strict=True):
            by_label[1 if toxic else 0].update(tokens_of(text))
        found: dict[str, list[int]] = {}
        for label, counter in enumerate(by_label):
            for token, times in counter.items():
                for unit in units_of(token):
                    found.setdefault(unit, [0, 0])[label] += times
        return {
            "token": pa.array(list(found), pa.string()),
            "clean": pa.array([c for c, _ in found.values()], pa.int64()),
            "toxic": pa.array([t for _, t in found.values()], pa.int64()),
        }

    counted = common.map_batches(sample, count, "token string, clean long, toxic long")
    counts = common.written(counted.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    # Whole tokens alone add up to the length of the texts.
    totals = counts.where(F.col("token").endswith("$")).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n_clean, n_toxic = float(totals["clean"] or 0), float(totals["toxic"] or 0)
    if not n_clean or not n_toxic:
        return Model(intercept=math.log((0.5 if not n_toxic else 1) / 1000))
    # A bounded sample has a bounded vocabulary, and only its outstanding tokens reach the driver.
    first = outstanding(counts, n_clean, n_toxic)
    # A text that was copied repeats its tokens in the same surroundings: those count once.
    chosen = {row["token"] for row in first}

    def surroundings(batch: pa.RecordBatch) -> dict:
        found = set()
        for text, toxic in zip(common.texts_of(batch), common.column(batch, "toxic").to_pylist(), strict=True):
            tokens = ["", *tokens_of(text), ""]
            for i in range(1, len(tokens) - 1):
                for unit in units_of(tokens[i]):
                    if unit in chosen:
                        found.add((unit, bool(toxic), " ".join(tokens[i - 1 : i + 2])))
        own = list(found)
        return {
            "token": pa.array([token for token, _, _ in own], pa.string()),
            "is_toxic": pa.array([toxic for _, toxic, _ in own], pa.bool_()),
            "around": pa.array([around for _, _, around in own], pa.string()),
        }

    placed = common.map_batches(sample, surroundings, "token string, is_toxic boolean, around string").distinct()
    once = placed.groupBy("token").agg(F.count_if(~F.col("is_toxic")).alias("clean"), F.count_if("is_toxic").alias("toxic"))
    rows = sorted(outstanding(once, n_clean, n_toxic), key=lambda row: row["token"]) if first else []
    share = sum(row["clean"] for row in rows) / n_clean
    step = math.log((1 - PASSAGE_RATE) / (1 - min(share, PASSAGE_RATE / 2)))
    model = Model({row["token"]: (float(row["score"]), float(row["distinct"])) for row in rows}, step)
    if rows:
        seen = [max(row["clean"], 0.5) / n_clean for row in rows]
        model.rate = moment_root([row["score"] for row in rows], seen, step, 1 - min(0.5, sum(seen)))

    def scan(batch: pa.RecordBatch) -> dict:
        found = [passages_of(model, text) for text in common.texts_of(batch)]
        return {
            "toxic": common.column(batch, "toxic"),
            "length": pa.array([length for _, length in found], pa.int64()),
            "sums": pa.array([[s for s, _, _ in some] for some, _ in found], pa.list_(pa.float64())),
        }

    seen = common.map_batches(sample, scan, "toxic int, length long, sums array<double>").collect()
    clean = [row for row in seen if not row["toxic"]]
    above = sum(1 for row in clean for total in row["sums"] if model.rate * total >= 1)
    model.scale = (above + 1) * math.e / (sum(row["length"] for row in clean) + 1)
    limit = -math.log(LEVEL)
    each = [[surprise(model, total, row["length"]) for total in row["sums"]] for row in seen]
    x = np.array([math.log1p(sum(v for v in values if v >= limit)) for values in each])
    y = np.array([1.0 if row["toxic"] else 0.0 for row in seen])
    order = np.lexsort((y, x))
    model.intercept, model.slope = logistic(x[order], y[order])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        scores = [chance(model, evidence(model, text)) for text in common.texts_of(batch)]
        return {
            "doc_id": common.column(batch, "doc_id"),
            "held_out": common.column(batch, "held_out"),
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
        }

    rows = docs.select("doc_id", "text", common.held_out().alias("held_out"))
    return common.map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first and last token, sum and surprise of every significant passage."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = common.column(batch, "doc_id").to_pylist()
        rows = [(i, *row) for i, text in zip(ids, common.texts_of(batch), strict=True) for row in significant(model, text)]
        names = ["doc_id", "first_token", "last_token", "sum", "surprise"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return {name: pa.array([row[at] for row in rows], kind) for at, (name, kind) in enumerate(zip(names, kinds, strict=True))}

    schema = "doc_id long, first_token long, last_token long, sum double, surprise double"
    return common.map_batches(docs.select("doc_id", "text"), run, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't predicted toxic, every column as it was."""
    return common.filter_batches(docs, lambda batch: [chance(model, evidence(model, t)) < 0.5 for t in common.texts_of(batch)])
