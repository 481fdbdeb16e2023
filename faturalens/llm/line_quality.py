"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Base figures of every whole text (words, code points, symbols, repeated lines, repeated 8-word
windows) come from arrays over a slice of texts. Lines get binned features; Viterbi decoding of
a two-state chain gives the best sequence of marks, and the share of word characters in content
lines decides whether a document that passed the base rules is kept.

Learning. No line is labelled, only documents are. Lines of good documents count as content, those
of bad ones as boilerplate to begin with; a chain is fitted by gradient ascent on the conditional
likelihood, the lines of bad documents are marked anew by it (each keeps at least its likeliest
boilerplate line), and so on for a few rounds. The share that decides is then the largest that
keeps `KEEP_RECALL` of the good documents, `MOST_SHARE` at most. At most about `MOST_LABELLED` labelled documents that
are not held out are used, drawn by hash.

A null or empty text has no words and fails the base rules; a text without labels to learn from
is kept if it passes them. Lines without a word are left out of the sequence. Repeated rows are
judged alike; an empty table gives an empty one; of the documents only doc_id and text are read.
Texts of any length are one sequence of all their lines; one without a line break is one line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faturalens.llm import common

LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
MOST_LABELLED = 3_000
ROUNDS = 4
STEPS = 60
RIDGE = 1e-3
KEEP_RECALL = 0.99
MOST_SHARE = 0.75
CONTENT, BOILERPLATE = 0, 1
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[192:] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
MARK = np.zeros(256, dtype=bool)
MARK[list(b"!?")] = True
# A continuation byte of UTF-8 is no code point of its own.
POINT = np.ones(256, dtype=bool)
POINT[128:192] = False
RATE_EDGES = np.array([0.004, 0.02, 0.06, 0.15, 0.35, 0.7])
WORD_EDGES = np.array([2, 4, 8, 16, 40, 120])
REPEAT_EDGES = np.array([0.05, 0.3, 0.7])
RATES = 5
PLACES = 3
COLUMNS = RATES + 6
WIDTH = RATES * 7 + 7 + 4 + 7 + 2 + PLACES + 1


@dataclass
class Model:
    """Feature weights of the two states, transitions between them, and the content share that keeps a document."""

    weights: np.ndarray
    moves: np.ndarray
    least_share: float


class Figures:
    """Base figures of each text of a slice, and its lines with their feature numbers."""

    def __init__(self, texts: list[bytes]):
        words = common.Words(texts)
        b, starts, ends, bounds = words.bytes, words.starts, words.ends, words.bounds
        self.n_words = words.counts
        owner = np.repeat(np.arange(len(texts)), words.counts)
        points = np.concatenate([[0], np.cumsum(POINT[b], dtype=np.int64)])
        word_points = points[ends] - points[starts]
        self.word_chars = self.per_text(word_points, bounds)
        symbols = np.concatenate([[0], np.cumsum(SYMBOLS[b], dtype=np.int64)])
        self.n_symbols = symbols[words.text_starts[1:]] - symbols[words.text_starts[:-1]]
        hashes = words.hashes()
        repeated = self.repeats(hashes, bounds, owner)
        self.n_repeat_words = self.per_text(repeated.astype(np.int64), bounds)
        # Lines with a word: every text ends in a line feed here.
        breaks = np.flatnonzero(b == 10)
        line_of_word = np.searchsorted(breaks, starts)
        lines, first_word = np.unique(line_of_word, return_index=True)
        line_start = np.concatenate([[0], breaks[:-1] + 1])[lines] if len(breaks) else np.empty(0, dtype=np.int64)
        line_end = breaks[lines]
        # A text's own first line begins where the text does.
        self.line_owner = owner[first_word]
        self.line_bounds = np.searchsorted(self.line_owner, np.arange(len(texts) + 1))
        last_word = np.append(first_word[1:], len(starts))
        self.line_chars = np.add.reduceat(word_points, first_word) if len(first_word) else np.empty(0, dtype=np.int64)
        duplicate = np.zeros(len(lines), dtype=bool)
        data = b.tobytes()
        self.n_dup_lines = np.zeros(len(texts), dtype=np.int64)
        for text in range(len(texts)):
            low, high = self.line_bounds[text], self.line_bounds[text + 1]
            if high - low > 1:
                seen: set[bytes] = set()
                for line in range(low, high):
                    own = data[line_start[line] : line_end[line]]
                    if own in seen:
                        duplicate[line] = True
                    else:
                        seen.add(own)
                self.n_dup_lines[text] = int(duplicate[low:high].sum())
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = hashes[1:] == hashes[:-1]
        n_line = last_word - first_word
        self.features = self.line_features(b, line_start, line_end, n_line, first_word, repeated, same, duplicate)

    @staticmethod
    def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    @staticmethod
    def repeats(hashes: np.ndarray, bounds: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which words lie in a window of `WINDOW` words that stands twice or more in their text."""
        windows = common.window_hashes(hashes, WINDOW)
        cover = np.zeros(len(hashes) + 1, dtype=np.int64)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = windows[low : high - WINDOW + 1] if high - low > WINDOW else windows[:0]
            if len(own) > 1:
                order = np.argsort(own, kind="stable")
                ranked = own[order]
                same = ranked[1:] == ranked[:-1]
                if same.any():
                    twice = np.zeros(len(own), dtype=bool)
                    twice[order[1:][same]] = True
                    twice[order[:-1][same]] = True
                    at = np.flatnonzero(twice) + low
                    cover[at] += 1
                    cover[at + WINDOW] -= 1
        return np.cumsum(cover[:-1]) > 0

    def line_features(self, b, start, end, n_words, first_word, repeated, same, duplicate) -> np.ndarray:
        """(lines, features) numbers of the features that hold for each line."""
        if not len(start):
            return np.zeros((0, COLUMNS), dtype=np.int64)
        size = np.maximum(end - start, 1)
        columns, base = [], 0
        for kind, per in ((SYMBOLS, size), (DIGIT, size), (MARK, n_words), (UPPER, None), (LETTER, size)):
            sums = np.concatenate([[0], np.cumsum(kind[b], dtype=np.int64)])
            count = sums[end] - sums[start]
            if per is None:
                letters = np.concatenate([[0], np.cumsum(LETTER[b], dtype=np.int64)])
                per = np.maximum(letters[end] - letters[start], 1)
            columns.append(base + np.searchsorted(RATE_EDGES, count / per))
            base += 7
        columns.append(base + np.searchsorted(WORD_EDGES, n_words))
        base += 7
        covered = np.add.reduceat(repeated.astype(np.int64), first_word) / n_words
        columns.append(base + np.searchsorted(REPEAT_EDGES, covered))
        base += 4
        again = np.add.reduceat(same.astype(np.int64), first_word) / n_words
        columns.append(base + np.searchsorted(RATE_EDGES, again))
        base += 7
        columns.append(base + duplicate)
        base += 2
        place = np.arange(len(start)) - self.line_bounds[self.line_owner]
        columns.append(base + np.minimum(place, PLACES - 1))
        base += PLACES
        columns.append(np.full(len(start), base))
        return np.stack(columns, axis=1)


def line_scores(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    return weights[:, features].sum(axis=2).T if len(features) else np.zeros((0, 2))


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best sequence of states; content wins ties."""
    back = np.zeros((len(scores), 2), dtype=np.int8)
    a, b = float(scores[0, 0]), float(scores[0, 1])
    m = moves.tolist()
    for at in range(1, len(scores)):
        s0, s1 = scores[at].tolist()
        from0, from1 = a + m[0][0], b + m[1][0]
        to0, to1 = a + m[0][1], b + m[1][1]
        back[at] = (from1 > from0, to1 > to0)
        a, b = max(from0, from1) + s0, max(to0, to1) + s1
    state = int(b > a)
    out = np.empty(len(scores), dtype=np.int8)
    for at in range(len(scores) - 1, -1, -1):
        out[at] = state
        state = int(back[at, state])
    return out


def chain_gradient(scores: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and move marginals of all sequences at once, by forward-backward over equal places."""
    lengths = np.diff(bounds)
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    starts = bounds[:-1]
    live = np.flatnonzero(lengths > 0)
    forward[starts[live]] = scores[starts[live]]
    for step in range(1, int(lengths.max(initial=0))):
        at = starts[lengths > step] + step
        forward[at] = scores[at] + np.logaddexp(forward[at - 1, :1] + moves[0], forward[at - 1, 1:] + moves[1])
    for step in range(int(lengths.max(initial=0)) - 2, -1, -1):
        at = starts[lengths > step + 1] + step
        ahead = scores[at + 1] + backward[at + 1]
        backward[at] = np.stack([np.logaddexp(moves[s, 0] + ahead[:, 0], moves[s, 1] + ahead[:, 1]) for s in (0, 1)], axis=1)
    total = np.zeros(len(scores))
    ends = bounds[1:][live] - 1
    whole = np.logaddexp(forward[ends, 0], forward[ends, 1])
    total = np.repeat(whole, lengths[live])
    states = np.exp(forward + backward - total[:, None])
    inner = np.setdiff1d(np.arange(len(scores)), starts[live])
    pairs = np.zeros((2, 2))
    for s in (0, 1):
        for t in (0, 1):
            value = forward[inner - 1, s] + moves[s, t] + scores[inner, t] + backward[inner, t] - total[inner]
            pairs[s, t] = np.exp(value).sum()
    return states, pairs


def fit_chain(features: np.ndarray, bounds: np.ndarray, marks: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple:
    """Gradient ascent with per-weight steps on the conditional likelihood of the marks."""
    n = max(1, len(features))
    seen_w, seen_m = np.full(weights.shape, 1e-8), np.full(moves.shape, 1e-8)
    wanted = np.zeros((2, WIDTH))
    for state in (0, 1):
        wanted[state] = np.bincount(features[marks == state].ravel(), minlength=WIDTH)
    inner = np.setdiff1d(np.arange(len(features)), bounds[:-1])
    wanted_moves = np.bincount(marks[inner - 1] * 2 + marks[inner], minlength=4).reshape(2, 2)
    for _ in range(STEPS):
        states, pairs = chain_gradient(line_scores(weights, features), moves, bounds)
        expected = np.stack([np.bincount(features.ravel(), np.repeat(states[:, s], features.shape[1]), WIDTH) for s in (0, 1)])
        gradient = (wanted - expected) / n - RIDGE * weights
        gradient_m = (wanted_moves - pairs) / n - RIDGE * moves
        seen_w += gradient**2
        seen_m += gradient_m**2
        weights = weights + 0.5 * gradient / np.sqrt(seen_w)
        moves = moves + 0.5 * gradient_m / np.sqrt(seen_m)
    return weights, moves


def content_share(figures: Figures, text: int, model: Model) -> float:
    low, high = figures.line_bounds[text], figures.line_bounds[text + 1]
    if high == low:
        return 0.0
    marks = viterbi(line_scores(model.weights, figures.features[low:high]), model.moves)
    chars = figures.line_chars[low:high]
    return float(chars[marks == CONTENT].sum() / max(1, chars.sum()))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """A model from labelled documents that are not held out; None without good and bad ones."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out())
    size = usable.count()
    if not size:
        return None
    drawn = common.written(common.hash_sample(usable, min(1.0, most / size)).select("doc_id", F.col("quality").cast("int").alias("quality")))
    sample = docs.select("doc_id", "text").join(drawn, "doc_id")

    def run(batch: pa.RecordBatch) -> dict:
        lines, chars, texts = [], [], common.texts_of(batch)
        for start, stop in common.slices(texts):
            own = Figures(texts[start:stop])
            for text in range(stop - start):
                low, high = own.line_bounds[text], own.line_bounds[text + 1]
                lines.append(own.features[low:high].astype(np.uint8).tobytes())
                chars.append(own.line_chars[low:high].astype("<i8").tobytes())
        return {
            "quality": common.column(batch, "quality"),
            "lines": pa.array(lines, pa.binary()),
            "chars": pa.array(chars, pa.binary()),
        }

    rows = common.map_batches(sample, run, "quality int, lines binary, chars binary").collect()
    rows = sorted(((row["quality"], bytes(row["lines"]), bytes(row["chars"])) for row in rows if row["lines"]), key=lambda row: row[:2])
    return fit(rows)


def fit(rows: list[tuple[int, bytes, bytes]]) -> Model | None:
    """A model from (quality, feature numbers of its lines, their word characters) of each document."""
    quality = np.array([row[0] for row in rows])
    if not len(rows) or not (quality == 1).any() or not (quality == 0).any():
        return None
    features = np.frombuffer(b"".join(row[1] for row in rows), dtype=np.uint8).astype(np.int64).reshape(-1, COLUMNS)
    bounds = np.concatenate([[0], np.cumsum([len(row[1]) // (COLUMNS) for row in rows])])
    bad = np.repeat(quality == 0, np.diff(bounds))
    marks = bad.astype(np.int64)
    weights, moves = np.zeros((2, WIDTH)), np.zeros((2, 2))
    for _ in range(ROUNDS):
        weights, moves = fit_chain(features, bounds, marks, weights, moves)
        scores = line_scores(weights, features)
        for low, high in zip(bounds[:-1][quality == 0], bounds[1:][quality == 0], strict=True):
            own = viterbi(scores[low:high], moves)
            if not own.any():
                own[int(np.argmax(scores[low:high, 1] - scores[low:high, 0]))] = BOILERPLATE
            marks[low:high] = own
    scores = line_scores(weights, features)
    shares = []
    for index, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if quality[index] == 1:
            chars = np.frombuffer(rows[index][2], dtype="<i8")
            shares.append(chars[viterbi(scores[low:high], moves) == CONTENT].sum() / max(1, chars.sum()))
    shares.sort()
    return Model(weights, moves, min(MOST_SHARE, float(shares[int((1 - KEEP_RECALL) * len(shares))])))


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, base figures, base_failed, kept and content_share of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = common.texts_of(batch)
        out: dict[str, list] = {name: [] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        failed, kept, shares = [], [], []
        for start, stop in common.slices(texts):
            own = Figures(texts[start:stop])
            for name, values in out.items():
                values.append(getattr(own, name))
            bad = (own.n_words < LEAST_WORDS) | (100 * own.n_repeat_words > MOST_REPEATED * own.n_words)
            for text in range(stop - start):
                share = 1.0 if model is None else content_share(own, text, model)
                shares.append(share)
                kept.append(not bad[text] and (model is None or share >= model.least_share))
            failed += bad.tolist()
        columns = {name: pa.array(np.concatenate(values), pa.int64()) for name, values in out.items()}
        return {
            "doc_id": common.column(batch, "doc_id"),
            **columns,
            "base_failed": pa.array(failed, pa.bool_()),
            "kept": pa.array([bool(k) for k in kept], pa.bool_()),
            "content_share": pa.array(shares, pa.float64()),
        }

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, content_share double"
    )
    return common.map_batches(docs.select("doc_id", "text"), run, schema)


def line_marks(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and, line by line with a word, whether Viterbi marks it as content."""

    def run(batch: pa.RecordBatch) -> dict:
        marks, texts = [], common.texts_of(batch)
        for start, stop in common.slices(texts):
            own = Figures(texts[start:stop])
            for text in range(stop - start):
                low, high = own.line_bounds[text], own.line_bounds[text + 1]
                scores = line_scores(model.weights, own.features[low:high])
                marks.append((viterbi(scores, model.moves) == CONTENT).tolist() if high > low else [])
        return {"doc_id": common.column(batch, "doc_id"), "is_content": pa.array(marks, pa.list_(pa.bool_()))}

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, is_content array<boolean>")
