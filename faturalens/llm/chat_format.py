"""Chat formatting by token-level assembly.

A turn is written `<s>[INST]role[/INST]text</s>`. Roles and texts are encoded apart from each other
and from the marks by a byte-level tokenizer file, whose special strings are ordinary text here;
the marks are reserved ids behind its vocabulary. Segments are spliced into one array of ids
per conversation at places that prefix sums of the lengths give; the loss mask is the prefix sum
of +1 where the text of an assistant begins and -1 where it ends.

Marks inside roles and texts are escaped before they are encoded, so that the rendered text is
as clear as the ids: a backslash goes behind the first character of each mark, and of each mark
that has such backslashes already. To read it back, one backslash is taken out. No mark can
come about where two segments meet, since each begins with its only `<` or `[`.

Rows are encoded where they are read, each for itself. What is shuffled is ids. A conversation is one
row of the result, so its turns do meet in a task, as ids only.

Turns go by `turn`, null first; rows of the same turn go by role and then by their ids; repeated
rows are turns each. Null texts and null roles are empty ones. Rows without a conv_id are one
conversation. Texts of any length are encoded whole. Empty texts have no token under the mask. An
empty table gives an empty one. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faturalens.llm import common

TOKENIZER = "byte_bpe_50k.json"
LOSS_ROLE = "assistant"
# The marks, in the order of their reserved ids.
TURN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
MARKS = (TURN, OPEN, CLOSE, END)
MARK = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
ESCAPED = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])")


def escape(text: str) -> str:
    return MARK.sub(lambda m: f"{m[1] or m[4]}\\{m[2] if m[1] else m[5]}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: f"{m[1] or m[4]}{m[2] if m[1] else m[5]}{m[3] or m[6]}", text)


def byte_of_symbol() -> dict[str, int]:
    """The byte alphabet of such files: visible Latin-1 characters are their own byte, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + place): byte for place, byte in enumerate(others)}


class Codec:
    """Encoding of segments, and decoding of ids and marks through a table of offsets."""

    def __init__(self, path: str):
        # Spark deals out the work; threads of the library's own would only take other tasks' cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Added tokens never come out of a segment, but have their numbers.
        tokens = {number: token for token, number in spec["model"]["vocab"].items()}
        tokens.update({token["id"]: token["content"] for token in spec["added_tokens"]})
        self.base = max(tokens) + 1
        alphabet = byte_of_symbol()
        added = {token["id"] for token in spec["added_tokens"]}
        pieces = [
            tokens.get(number, "").encode() if number in added else bytes(alphabet[c] for c in tokens.get(number, ""))
            for number in range(self.base)
        ] + [mark.encode() for mark in MARKS]
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(piece) for piece in pieces])])
        self.kind = "<u2" if len(pieces) <= 1 << 16 else "<u4"

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each segment, two or four bytes each."""
        found = self.library.encode_batch_fast([escape(text) for text in texts], add_special_tokens=False)
        return [np.array(one.ids, dtype=self.kind).tobytes() for one in found]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin (and the last one's end)."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        places = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(places[-1]) + np.repeat(starts - places[:-1], sizes)
        return self.bytes[at].tobytes(), places


@lru_cache(maxsize=4)
def codec(path: str | None = None) -> Codec:
    """The codec of a file, built once per Python worker."""
    return Codec(path or public_tokenizers.path(TOKENIZER))


def segments(conversations: DataFrame, path: str | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, turn, role, role_ids, text_ids and loss of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path)
        roles = [role or "" for role in common.column(batch, "role").cast(pa.string()).to_pylist()]
        texts, encoded = common.texts_of(batch), []
        for start, stop in common.slices(texts):
            encoded += own.encode([text.decode("utf-8", "replace") for text in texts[start:stop]])
        known = {role: ids for role, ids in zip(set(roles), own.encode(list(set(roles))), strict=True)}
        return {
            "conv_id": common.column(batch, "conv_id"),
            "turn": common.column(batch, "turn"),
            "role": pa.array(roles, pa.string()),
            "role_ids": pa.array([known[role] for role in roles], pa.binary()),
            "text_ids": pa.array(encoded, pa.binary()),
            "loss": pa.array([role == loss_role for role in roles], pa.bool_()),
        }

    kind = dict(conversations.dtypes)
    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, role_ids binary, text_ids binary, loss boolean"
    return common.map_batches(conversations.select("conv_id", "turn", "role", "text"), run, schema)


def spliced(own: Codec, roles: list[bytes], texts: list[bytes], loss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and mask of turns one after the other, and where each turn begins (and the last one ends)."""
    width = np.dtype(own.kind).itemsize
    count = len(roles)
    sizes = np.ones((count, 6), dtype=np.int64)
    sizes[:, 2] = [len(ids) // width for ids in roles]
    sizes[:, 4] = [len(ids) // width for ids in texts]
    ends = np.cumsum(sizes.ravel()).reshape(count, 6)
    starts = ends - sizes
    total = int(ends[-1, -1]) if count else 0
    ids = np.empty(total, dtype=np.int32)
    for segment, mark in ((0, TURN), (1, OPEN), (3, CLOSE), (5, END)):
        ids[starts[:, segment]] = own.base + MARKS.index(mark)
    for segment, parts in ((2, roles), (4, texts)):
        lengths = sizes[:, segment]
        before = np.cumsum(lengths) - lengths
        ids[np.arange(lengths.sum()) + np.repeat(starts[:, segment] - before, lengths)] = np.frombuffer(b"".join(parts), own.kind)
    steps = np.zeros(total + 1, dtype=np.int8)
    steps[starts[loss, 4]] += 1
    steps[ends[loss, 4]] -= 1
    # An empty text begins and ends at one place, where both steps cancel.
    return ids, np.cumsum(steps[:-1], dtype=np.int8), np.append(starts[:, 0], total)


FORMATTED = "ids array<int>, loss_mask array<tinyint>, text string"


def formatted(conversations: DataFrame, path: str | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, ids, loss_mask and the rendered text of every conversation."""
    turns = segments(conversations, path, loss_role)
    row = F.struct("turn", "role", "text_ids", "role_ids", "loss")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def run(batch: pa.RecordBatch) -> dict:
        own, turns = codec(path), common.column(batch, "turns")
        rows = turns.flatten()
        loss = rows.field("loss").to_numpy(zero_copy_only=False).astype(bool)
        ids, mask, starts = spliced(own, rows.field("role_ids").to_pylist(), rows.field("text_ids").to_pylist(), loss)
        borders = turns.offsets.to_numpy() - turns.offsets[0].as_py()
        offsets = starts[borders]
        text, places = own.decode(ids)
        cuts = places[offsets]
        lists = pa.array(offsets, pa.int32())
        return {
            "conv_id": common.column(batch, "conv_id"),
            "ids": pa.ListArray.from_arrays(lists, pa.array(ids, pa.int32())),
            "loss_mask": pa.ListArray.from_arrays(lists, pa.array(mask, pa.int8())),
            "text": pa.array([text[low:high].decode() for low, high in zip(cuts, cuts[1:], strict=False)], pa.string()),
        }

    return common.map_batches(grouped, run, f"conv_id {dict(turns.dtypes)['conv_id']}, {FORMATTED}")


def turns_of(own: Codec, ids: np.ndarray) -> list[tuple[str, str]]:
    """Role and text of each turn, out of the ids alone."""
    text, places = own.decode(ids)
    at = {mark: np.flatnonzero(ids == own.base + number) for number, mark in enumerate(MARKS)}
    cut = lambda low, high: unescape(text[places[low + 1] : places[high]].decode())
    return [(cut(o, c), cut(c, e)) for o, c, e in zip(at[OPEN], at[CLOSE], at[END], strict=True)]


def loss_text(own: Codec, ids: np.ndarray, mask: np.ndarray) -> str:
    """What stands under the mask, span by span."""
    text, places = own.decode(ids)
    edges = np.flatnonzero(np.diff(mask, prepend=0, append=0))
    return "".join(unescape(text[places[low] : places[high]].decode()) for low, high in zip(edges[::2], edges[1::2], strict=True))


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(chats: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, counts and digests of what ids, mask and text of `formatted` say."""

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path)
        out: dict[str, list] = {part.split()[0]: [] for part in READ.split(", ")}
        columns = [common.column(batch, name) for name in ("ids", "loss_mask", "text")]
        for ids, mask, text in zip(*columns, strict=True):
            ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
            turns, loss = turns_of(own, ids), loss_text(own, ids, mask)
            out["n_turns"].append(int((ids == own.base + MARKS.index(TURN)).sum()))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(text.as_py()))
        return {"conv_id": common.column(batch, "conv_id"), **out}

    return common.map_batches(chats, run, f"conv_id {dict(chats.dtypes)['conv_id']}, {READ}")
