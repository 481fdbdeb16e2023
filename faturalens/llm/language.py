"""Language ID by hierarchical discrimination: the family first, then close relatives one against one.

Features are hashed character n-grams (one to three bytes of the lower-case text, anything but
letters being a blank), as shares of the text's n-grams. Linear support vector machines, one for
each pair of families and one for each pair of languages inside a family, vote; a text's score
is the product of the two levels' logistic margins. Every whole text is scored in one pass.

Machines are fitted on at most about `PER_LANGUAGE` texts of each language, drawn by hash from
the learnable rows; their feature rows alone reach the driver, a bounded number of bounded size.

A null text or one without a letter is `und` with score 0. Without learnable rows every text
is `und`. Ties of votes and margins go to the first name in order. Repeated rows are scored
alike; an empty table gives an empty one; only doc_id, text and, for learning, lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faturalens.llm import common

UNKNOWN = "und"
PER_LANGUAGE = 300
BUCKETS = 4096
# Filters reject documents whose language's machines agree with less than this probability.
LEAST_SCORE = 0.5
ROUNDS = 150
PENALTY = 1e-4
SHARPNESS = 3.0
# Families of common languages by ISO code; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es pt it ca ro gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr sl bs".split(),
    "baltic": "lt lv".split(),
    "finnic": "fi et".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "indic": "hi ur bn mr ne gu pa".split(),
    "dravidian": "ta te kn ml".split(),
    "semitic": "ar he mt am".split(),
    "malayic": "id ms jv su tl".split(),
    "sinitic": "zh yue wuu".split(),
    "celtic": "ga cy gd br".split(),
}
FAMILY_OF = {language: family for family, members in FAMILIES.items() for language in members}
LETTER = regex.compile(r"\p{L}")
# ASCII letters and all bytes of longer characters stay, the rest are blanks.
BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
DUMMY = BUCKETS


@dataclass
class Model:
    """Languages in order, machines as (first members, second members), weights of shape (BUCKETS + 1, machines)."""

    languages: list[str]
    machines: list[tuple[list[int], list[int]]]
    weights: np.ndarray
    bias: np.ndarray


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of a slice of texts, one array per length, and where each text starts."""
    encoded = [(" " + text.lower() + " ").encode("utf-8", "replace").translate(BLANKED) for text in texts]
    b = np.frombuffer(b"".join(encoded) + b"  ", dtype=np.uint8).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(e) for e in encoded])])
    one, two, three = b[:-2], b[1:-1], b[2:]
    blank = one == 32
    # An n-gram starts in a word or at the blank before it, and ends at the first blank behind it.
    single = np.where(blank, DUMMY, one * np.uint32(16) % np.uint32(BUCKETS))
    double = (one * np.uint32(0x9E3779B1) + two * np.uint32(0x85EBCA77) + np.uint32(1)) >> np.uint32(20)
    double = np.where(blank & (two == 32), DUMMY, double)
    triple = (one * np.uint32(0xC2B2AE3D) + two * np.uint32(0x27D4EB2F) + three * np.uint32(0x165667B1)) >> np.uint32(20)
    triple = np.where(two == 32, DUMMY, triple)
    return [single, double, triple], starts


def features(texts: list[str]) -> np.ndarray:
    """Shares of n-grams per text, scaled so that a text's row has about unit length."""
    grams, starts = ngrams(texts)
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for index in range(len(texts)):
        low, high = starts[index], starts[index + 1]
        counts = sum(np.bincount(g[low:high], minlength=BUCKETS + 1) for g in grams)[:BUCKETS]
        out[index] = counts / max(1, counts.sum())
    return out


def fit_machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps; classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    design = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    step = 1.0 / (2 * float(np.einsum("ij,ij,i->", design, design, weight)) + PENALTY)
    w = np.zeros(design.shape[1], dtype=np.float32)
    ahead, t = w.copy(), 1.0
    for _ in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (design @ ahead))
        gradient = -2 * design.T @ (weight * y * slack) + PENALTY * ahead
        following = ahead - np.float32(step) * gradient
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = following + np.float32((t - 1) / t_next) * (following - w)
        w, t = following, t_next
    return w[:-1], float(w[-1])


def fit_rows(rows: np.ndarray, labels: list[str]) -> Model:
    """Machines from feature rows and their languages."""
    languages = sorted(set(labels))
    number = np.array([languages.index(label) for label in labels])
    families: dict[str, list[int]] = {}
    for index, language in enumerate(languages):
        families.setdefault(FAMILY_OF.get(language, language), []).append(index)
    groups = [families[name] for name in sorted(families)]
    machines = [*combinations(groups, 2)]
    machines += [([a], [b]) for group in groups for a, b in combinations(group, 2)]
    weights = np.zeros((BUCKETS + 1, len(machines)), dtype=np.float32)
    bias = np.zeros(len(machines), dtype=np.float32)
    scale = np.float32(1 / max(1e-9, np.sqrt((rows**2).sum(axis=1)).mean())) if len(rows) else np.float32(1)
    for index, (first, second) in enumerate(machines):
        chosen = np.isin(number, first + second)
        y = np.where(np.isin(number[chosen], first), 1, -1).astype(np.float32)
        w, bias[index] = fit_machine(rows[chosen] * scale, y)
        weights[:BUCKETS, index] = w * scale
    return Model(languages, machines, weights, bias)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the rows that are not held out and have a language."""
    known = docs.where(~common.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for language, size in sorted(sizes.items()):
        share = F.when(F.col("lang") == language, F.lit(min(1.0, per_language / size))).otherwise(share)
    sample = common.hash_sample(known, share).select("text", "lang")

    def run(batch: pa.RecordBatch) -> dict:
        texts = [text.decode("utf-8", "replace") for text in common.texts_of(batch)]
        rows = [features(texts[a:b]) for a, b in common.slices(texts)]
        return {
            "lang": common.column(batch, "lang"),
            "row": pa.array([row.astype(np.float16).tobytes() for part in rows for row in part * 64], pa.binary()),
        }

    rows = common.map_batches(sample, run, "lang string, row binary").toArrow()
    labels = rows.column("lang").to_pylist()
    # The order in which rows arrive must not matter for the last digits of the sums.
    pairs = sorted(zip(labels, rows.column("row").to_pylist(), strict=True))
    del rows
    x = np.empty((len(pairs), BUCKETS), dtype=np.float32)
    for place, (_, row) in enumerate(pairs):
        x[place] = np.frombuffer(row, dtype=np.float16)
    x /= 64
    return fit_rows(x, [label for label, _ in pairs])


def predict_texts(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """The language and the score of each whole text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return names, scores
    for start, stop in common.slices(texts, 500_000):
        part = texts[start:stop]
        margins = margins_of(model, part)
        votes = np.zeros((len(part), len(model.languages)))
        sums = np.zeros((len(part), len(model.languages)))
        sure = 1 / (1 + np.exp(-SHARPNESS * np.abs(margins.astype(np.float64))))
        for index, (first, second) in enumerate(model.machines):
            m = margins[:, index]
            # A family's win counts for more than any number of wins inside a family.
            level = len(model.languages) if len(first) > 1 or len(second) > 1 or across(first, second, model) else 1
            votes[:, first] += level * (m >= 0)[:, None]
            votes[:, second] += level * (m < 0)[:, None]
            sums[:, first] += level * m[:, None]
            sums[:, second] -= level * m[:, None]
        bound = np.abs(sums).max(axis=1, keepdims=True) + 1
        winner = np.argmax(votes + sums / (4 * bound), axis=1)
        for at, text in enumerate(part):
            if LETTER.search(text):
                best = int(winner[at])
                names[start + at] = model.languages[best]
                mine = [i for i, (a, b) in enumerate(model.machines) if best in a or best in b]
                right = [sure[at, i] if (margins[at, i] >= 0) == (best in model.machines[i][0]) else 1 - sure[at, i] for i in mine]
                scores[start + at] = float(np.prod(right)) if right else 1.0
    return names, scores


def across(first: list[int], second: list[int], model: Model) -> bool:
    a, b = model.languages[first[0]], model.languages[second[0]]
    return FAMILY_OF.get(a, a) != FAMILY_OF.get(b, b)


def margins_of(model: Model, texts: list[str]) -> np.ndarray:
    """Every machine's margin of every text; long texts are summed in pieces."""
    grams, starts = ngrams(texts)
    total = np.zeros((len(texts), len(model.machines)), dtype=np.float64)
    count = np.zeros(len(texts))
    piece = 1 << 20
    columns = [np.ascontiguousarray(model.weights[:, i]) for i in range(len(model.machines))]
    for low in range(0, int(starts[-1]), piece):
        high = min(low + piece, int(starts[-1]))
        first = int(np.searchsorted(starts, low, side="right")) - 1
        last = int(np.searchsorted(starts, high, side="left"))
        cuts = np.maximum(starts[first:last] - low, 0)
        used = np.zeros(high - low, dtype=np.float32)
        for gram in grams:
            used += gram[low:high] != DUMMY
        count[first:last] += np.add.reduceat(used, cuts, dtype=np.float64)
        for index, w in enumerate(columns):
            value = w[grams[0][low:high]] + w[grams[1][low:high]] + w[grams[2][low:high]]
            total[first:last, index] += np.add.reduceat(value, cuts, dtype=np.float64)
    return total / np.maximum(count, 1)[:, None] + model.bias


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        names, scores = predict_texts(model, [text.decode("utf-8", "replace") for text in common.texts_of(batch)])
        return {
            "doc_id": common.column(batch, "doc_id"),
            "held_out": common.column(batch, "held_out"),
            "lang_pred": pa.array(names, pa.string()),
            "score": pa.array(scores, pa.float64()),
        }

    rows = docs.select("doc_id", "text", common.held_out().alias("held_out"))
    return common.map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, languages: list[str] | None = None, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents, every column as it was, whose predicted language is wanted and whose score isn't below the least.

    `languages` are those wanted, all learned ones by default; a text without a letter has none.
    """
    wanted = set(model.languages if languages is None else languages)

    def mask(batch: pa.RecordBatch) -> list[bool]:
        names, scores = predict_texts(model, [text.decode("utf-8", "replace") for text in common.texts_of(batch)])
        return [name in wanted and score >= least_score for name, score in zip(names, scores, strict=True)]

    return common.filter_batches(docs, mask)
