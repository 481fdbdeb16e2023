"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie side by side in one ragged array of symbol ids. In each round every
sequence finds the lowest rank among its neighbouring pairs, and all sequences merge their own
lowest-ranked pair at once, at each place where it stands; symbols that survive until no pair has
a rank are the tokens. Counts of short parts are kept, so that a batch merges only new ones; what is
kept is bounded in bytes.

A text is cut at the file's special strings, which are a token each, and then at each space between
two characters that aren't white space: such a space always starts the pre-token behind it. Other
white space stays inside its part, which the splitter takes apart.

Null and empty texts have 0 bytes and 0 tokens; repeated rows count alike; an empty table gives
an empty one; only doc_id and text are read. Texts of any length are counted whole; a part without
such a space is merged in one array, of the part's length, and isn't kept if it is long.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from faturalens.llm import common

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
# Most bytes of kept parts in a worker, what one takes beside its characters, and the longest part kept.
KEPT_BYTES = 48_000_000
PART_BYTES = 120
LONGEST_KEPT = 64
# White space beside a space, where not every space is a border.
UNEVEN = re.compile(r"\s\s|^\s|\s$")
BORDER = re.compile(r"(?<=\S) (?=\S)")
NONE = np.int64(1 << 40)


class Counter:
    """Token counts of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        # A symbol is its number in the vocabulary, a character of the byte alphabet to begin with.
        self.symbol = np.full(0x400, -1, dtype=np.int64)
        for token, number in vocabulary.items():
            if len(token) == 1:
                self.symbol[ord(token)] = number
        self.width = max(vocabulary.values()) + 1
        pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault(vocabulary[left] * self.width + vocabulary[right], (rank, vocabulary[left + right]))
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[key][0] for key in self.keys.tolist()], dtype=np.int64)
        self.results = np.empty(len(pairs), dtype=np.int64)
        for rank, result in pairs.values():
            self.results[rank] = result
        special = sorted((token["content"] for token in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.parts: dict[str, int] = {}
        self.held = 0

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], NONE)

    def merge_counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token, given in the byte alphabet."""
        sizes = np.array([len(piece) for piece in pieces], dtype=np.int64)
        counts = sizes.copy()
        ids = self.symbol[np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4")]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        joined = np.zeros(len(ids), dtype=bool)
        joined[:-1] = owner[1:] == owner[:-1]
        rank = np.full(len(ids), NONE)
        at = np.flatnonzero(joined)
        rank[at] = self.rank_of(ids[at], ids[at + 1])
        while len(ids):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(ids)))
            counts[owner[starts]] = lengths
            going = lowest < NONE
            if not going.all():
                # Sequences without a pair are done.
                keep = np.repeat(going, lengths)
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                lowest, lengths = lowest[going], lengths[going]
                if not len(ids):
                    break
            hit = rank == np.repeat(lowest, lengths)
            # In a run such as aaa the pairs overlap: every second one is merged, from the left.
            places = np.flatnonzero(hit)
            fresh = np.diff(places, prepend=-2) != 1
            index = np.arange(len(places))
            since = index - np.maximum.accumulate(np.where(fresh, index, 0))
            places = places[since % 2 == 0]
            ids[places] = self.results[rank[places]]
            keep = np.ones(len(ids), dtype=bool)
            keep[places + 1] = False
            new_place = np.cumsum(keep) - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            # Only pairs beside a merged symbol have another rank now.
            touched = new_place[places]
            touched = np.unique(np.concatenate([touched, touched[touched > 0] - 1]))
            last = touched + 1 >= len(ids)
            after = np.where(last, touched, touched + 1)
            same = ~last & (owner[after] == owner[touched])
            rank[touched] = np.where(same, self.rank_of(ids[touched], ids[after]), NONE)
        return counts

    def count_new(self, parts: list[str]) -> dict[str, int]:
        """Tokens of parts of texts, each split and merged anew."""
        split = [[piece for piece, _ in self.splitter.pre_tokenize_str(part)] for part in parts]
        pieces = list({piece for some in split for piece in some})
        tokens = dict(zip(pieces, self.merge_counts(pieces).tolist(), strict=True))
        return {part: sum(tokens[piece] for piece in some) for part, some in zip(parts, split, strict=True)}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        parts: list[list[str]] = []
        special = np.zeros(len(texts), dtype=np.int64)
        for index, text in enumerate(texts):
            pieces = [text]
            if "<|" in text:
                pieces = self.special.split(text)
                special[index] = len(pieces) - 1
            own: list[str] = []
            for piece in pieces:
                if not piece:
                    continue
                first, *rest = BORDER.split(piece) if UNEVEN.search(piece) else piece.split(" ")
                own.append(first)
                own += [" " + word for word in rest]
            parts.append(own)
        if self.held > KEPT_BYTES:
            self.parts.clear()
            self.held = 0
        known = self.parts
        found = self.count_new(list({part for own in parts for part in own if part not in known}))
        for part, tokens in found.items():
            if len(part) <= LONGEST_KEPT and self.held <= KEPT_BYTES:
                known[part] = tokens
                self.held += PART_BYTES + 4 * len(part)
        return [sum(known[part] if part in known else found[part] for part in own) + int(extra) for own, extra in zip(parts, special, strict=True)]


@lru_cache(maxsize=4)
def counter(path: str | None = None) -> Counter:
    """The counter of a file, built once per Python worker."""
    return Counter(path or public_tokenizers.path(TOKENIZER))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""

    def run(batch: pa.RecordBatch) -> dict:
        texts, counts = common.texts_of(batch), []
        for start, stop in common.slices(texts):
            counts += counter(path).count([text.decode("utf-8", "replace") for text in texts[start:stop]])
        return {
            "doc_id": common.column(batch, "doc_id"),
            "n_bytes": pa.array([len(text) for text in texts], pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "over_limit": pa.array([count > limit for count in counts], pa.bool_()),
        }

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return common.map_batches(docs.select("doc_id", "text"), run, schema)
