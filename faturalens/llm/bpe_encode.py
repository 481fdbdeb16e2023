"""BPE encoding and decoding: a backtracking encoder over Aho-Corasick matches, and an offset table.

Encoding. One Aho-Corasick pass over a word gives the longest token that starts at each place.
The encoder goes from left to right with those; a token may follow another only if the pair is
compatible, that is, if merging the two texts together would leave this border alone. If no
prefix of the longest token fits, it goes back one token and never tries that place again, so a
word is encoded in linear time. The result is exactly that of applying the merges by rank.
Words are prepared by the tokenizer file's own normalizer and splitter. White space ends
every piece, so a text is encoded in runs without white space, and the ids of a run are kept.

Decoding. All token texts lie in one byte array; a table of offsets gives each token's range, and
the ranges of a document's ids are gathered at once. The file has no decoder: tokens are joined
by a space, as its library does.

Null and empty texts give no ids, zero tokens and an empty decoded text. Repeated rows and
ties are encoded alike, an empty table gives an empty one, and only doc_id and text are read.
Texts of any length are encoded whole; runs that are kept are bounded in bytes, long ones aren't kept.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from faturalens.llm import common

TOKENIZER = "word_bpe_49k.json"
# Most bytes of kept runs in a worker, what one takes beside its characters and ids, and the longest run kept.
KEPT_BYTES = 48_000_000
RUN_BYTES = 160
LONGEST_KEPT = 96
KEPT_PAIRS = 1_000_000
DECODE_IDS = 200_000
# Up to U+024F every Unicode version agrees on letters, numbers, case and composed forms.
LATIN = regex.compile(r"[\x21-\x7e\xa1-\u024f]+")
# Fixed value: the splitter's pattern, as the tokenizer file has it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
# These characters are blanks to Python but not to the splitter.
BLANKS = re.compile("[\\t-\\r \x85\xa0  -     　]+")


class Runs(dict):
    """Ids of runs without white space, as bytes; forgets all when full, and keeps no long run."""

    def __init__(self, encode, limit: int = KEPT_BYTES):
        super().__init__()
        self.encode, self.limit, self.held = encode, limit, 0

    def __missing__(self, run: str) -> bytes:
        value = self.encode(run)
        if len(run) <= LONGEST_KEPT:
            size = RUN_BYTES + 4 * len(run) + len(value)
            if self.held + size > self.limit:
                self.clear()
                self.held = 0
            self[run] = value
            self.held += size
        return value


class Encoder:
    """Exact BPE of one tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        # A last character and its suffix are one symbol, written as one private character.
        self.ends: dict[str, str] = {}
        units = {token: self.units(token) for token in vocabulary}
        self.rank = dict.fromkeys(vocabulary.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, token = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            if pair not in self.merged:
                self.merged[pair] = token
                if self.rank[token] < 0:
                    self.rank[token], self.parts[token] = rank, pair
        # A text that its own merges do not rebuild is never an outcome.
        by_unit = {text: vocabulary[token] for token, text in units.items() if len(text) == 1}
        self.length: dict[int, int] = {}
        self.texts: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        texts = self.texts
        for token, text in units.items():
            number = vocabulary[token]
            if len(text) == 1 or (self.rank[number] >= 0 and self.reachable(text, number, by_unit)):
                self.length[number] = len(text)
                texts[text] = number
                self.automaton.add_word(text, number)
        self.automaton.make_automaton()
        self.shorter = {
            number: next((texts[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in texts), -1)
            for text, number in texts.items()
        }
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        names = [b""] * size
        for content, number in {**vocabulary, **self.special}.items():
            names[number] = b" " + content.encode()
        self.lengths = np.array([len(name) for name in names], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.pool = np.frombuffer(b"".join(names), dtype=np.uint8)
        self.runs = Runs(self.encode_run)
        self.pairs: dict[int, bool] = {}
        # The byte alphabet of the vocabulary's first 256 single characters is found by asking the file's own splitter.
        pattern = library.pre_tokenizer.pre_tokenize_str
        self.alphabet = {0: chr(0)}
        for code in range(0x21, 0x250):
            for byte, shown in zip(chr(code).encode(), "".join(x for x, _ in pattern(chr(code))), strict=False):
                self.alphabet[byte] = shown
        pieces = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        # The short way holds for files with this splitter and these normalizers only.
        self.latin = LATIN.fullmatch if pieces == PIECES and steps == ["NFC", "Replace", "Lowercase"] else lambda _: None
        self.split = regex.compile(PIECES).findall

    def units(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            last = token[-len(self.suffix) - 1]
            return token[: -len(self.suffix) - 1] + self.end_of(last)
        return token

    def end_of(self, character: str) -> str:
        return self.ends.setdefault(character, chr(0xF0000 + ord(character))) if self.suffix else character

    def reachable(self, text: str, number: int, by_unit: dict[str, int]) -> bool:
        """Whether merging the text by rank ends in this one token."""
        symbols = [by_unit.get(c, -1) for c in text]
        while len(symbols) > 1:
            ranks = [self.rank.get(self.merged.get(pair, -1), -1) for pair in zip(symbols, symbols[1:], strict=False)]
            usable = [rank for rank in ranks if rank >= 0]
            if not usable:
                return False
            at = ranks.index(min(usable))
            symbols[at : at + 2] = [self.merged[symbols[at], symbols[at + 1]]]
        return symbols == [number]

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge, at the time its rank comes, joins what stands at the border of the two."""
        merged, rank, parts = self.merged, self.rank, self.parts
        limit = 1 << 60
        while True:
            joint = merged.get((left, right))
            if joint is not None and rank[joint] < limit:
                return False
            # Undo the later of the two merges: the border once stood between its inner parts.
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                limit = rank[left]
                left = parts[left][1]
            else:
                limit = rank[right] + 1
                right = parts[right][0]

    def fits(self, left: int, right: int) -> bool:
        """`compatible`, remembered."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.compatible(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of the splitter, in the byte alphabet."""
        last = word[-1]
        text = word[:-1] + (self.ends.get(last) or self.end_of(last))
        whole = self.texts.get(text)
        if whole is not None:
            return [whole]
        # Leftmost-longest matches: while each fits the one before, nothing has to be taken back.
        pairs, out, token, place = self.pairs, [], -1, 0
        for end, following in self.automaton.iter_long(text):
            if token >= 0 and not (pairs.get(token << 20 | following) or self.fits(token, following)):
                return self.backtrack(text, out, place, following)
            out.append(following)
            token, place = following, end + 1
        return out

    def backtrack(self, text: str, out: list[int], place: int, token: int) -> list[int]:
        """Go on at a place where the longest token doesn't fit, with shorter ones and steps back."""
        size, length, shorter, fits, longest = len(text), self.length, self.shorter, self.fits, self.automaton.iter_long
        closed = set()
        while place < size:
            last = out[-1] if out else -1
            while True:
                end = place + length[token]
                if end not in closed and (last < 0 or fits(last, token)):
                    out.append(token)
                    place = end
                    if place < size:
                        token = next(longest(text, place))[1]
                    break
                token = shorter[token]
                if token < 0:
                    closed.add(place)
                    token = out.pop()
                    place -= length[token]
                    break
        return out

    def pieces_of(self, run: str) -> list[str]:
        """The pieces of a run without white space, in the byte alphabet."""
        if self.latin(run):
            if run.isascii():
                return self.split(run.lower())
            # Latin letters without a combining mark are composed already, except those that have another form.
            if is_normalized("NFC", run) and "\u0130" not in run:
                alphabet = self.alphabet
                return ["".join([alphabet[byte] for byte in piece.encode()]) for piece in self.split(run.lower())]
        return [piece for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(run)) if piece]

    def encode_run(self, run: str) -> bytes:
        ids = [number for piece in self.pieces_of(run) for number in self.encode_word(piece)]
        return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if "<|" not in text or not self.special_pattern.search(text):
            return self.encode_plain(text)
        out, place = [], 0
        for match in self.special_pattern.finditer(text):
            out.append(self.encode_plain(text[place : match.start()]))
            out.append(np.array([self.special[match.group()]], dtype="<u4").tobytes())
            place = match.end()
        return b"".join([*out, self.encode_plain(text[place:])])

    def encode_plain(self, text: str) -> bytes:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        runs = [run for run in BLANKS.split(text) if run] if odd else text.split()
        return b"".join(map(self.runs.__getitem__, runs))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts in UTF-8, joined by a space."""
        numbers = np.frombuffer(ids, dtype="<u4")
        parts = []
        for start in range(0, len(numbers), DECODE_IDS):
            some = numbers[start : start + DECODE_IDS]
            lengths = self.lengths[some]
            before = np.cumsum(lengths) - lengths
            index = np.repeat(self.offsets[some] - before, lengths) + np.arange(int(lengths.sum()))
            parts.append(self.pool[index].tobytes())
        return b"".join(parts)[1:]


@lru_cache(maxsize=4)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of a file, built once per Python worker."""
    return Encoder(path or public_tokenizers.path(TOKENIZER))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids: the whole text's ids as little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = [encoder(path).encode(text.decode("utf-8", "replace")) for text in common.texts_of(batch)]
        return {
            "doc_id": common.column(batch, "doc_id"),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids": pa.array(ids, pa.binary()),
        }

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and n_decoded: the code points of the text that the ids decode to."""

    def run(batch: pa.RecordBatch) -> dict:
        own = encoder(path)
        ids = [own.encode(text.decode("utf-8", "replace")) for text in common.texts_of(batch)]
        return {
            "doc_id": common.column(batch, "doc_id"),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "n_decoded": pa.array([len(own.decode(x).decode()) for x in ids], pa.int64()),
            "ids": pa.array(ids, pa.binary()),
        }

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, n_decoded long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of each row's ids."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [encoder(path).decode(ids or b"").decode() for ids in common.column(batch, "ids").to_pylist()]
        return {"doc_id": common.column(batch, "doc_id"), "text": pa.array(texts, pa.string())}

    return common.map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode, and carry hashes of both in place of them: one pass without a shuffle."""

    def run(batch: pa.RecordBatch) -> dict:
        own, counts, ids_hash, text_hash = encoder(path), [], [], []
        for text in common.texts_of(batch):
            ids = own.encode(text.decode("utf-8", "replace"))
            counts.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return {
            "doc_id": common.column(batch, "doc_id"),
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(ids_hash, pa.string()),
            "decoded_sha256": pa.array(text_hash, pa.string()),
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.map_batches(docs.select("doc_id", "text"), run, schema)
