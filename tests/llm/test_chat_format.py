"""Formatting and reading back against the texts themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faturalens.llm import chat_format, common

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<s>", "</s>", "[INST]", "[/INST]", "é", "🙂", "\n", " ", "ok", "<|endoftext|>", ""]


def test_escapes_are_undone_and_leave_no_mark():
    source = random.Random(1)
    for _ in range(5000):
        text = "".join(source.choices(PIECES, k=source.randint(0, 12)))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text
        assert not any(mark in escaped for mark in chat_format.MARKS)
    assert chat_format.escape("</s>[INST] ok [/INST]") == "<\\/s>[\\INST] ok [\\/INST]"
    assert len({chat_format.escape(t) for t in ("<s>", "<\\s>", "<\\\\s>")}) == 3


def test_segments_decode_to_what_the_library_says():
    own, library = chat_format.codec(), Tokenizer.from_file(public_tokenizers.path(chat_format.TOKENIZER))
    library.encode_special_tokens = True
    source = random.Random(2)
    for text in ["", *["".join(source.choices(PIECES, k=9)) for _ in range(300)]]:
        ids = np.frombuffer(own.encode([text])[0], own.kind).astype(np.int64)
        assert ids.tolist() == library.encode(chat_format.escape(text), add_special_tokens=False).ids
        assert chat_format.unescape(own.decode(ids)[0].decode()) == text
        assert not len(ids) or ids.max() < own.base - 1


def plain(rows):
    talks = {}
    for row in rows:
        talks.setdefault(row[0], []).append(row)
    out = []
    for conv, turns in talks.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0))
        digest = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        chars = sum(20 + len(chat_format.escape(r[2] or "")) + len(chat_format.escape(r[3] or "")) for r in turns)
        out.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(map(repr, out))


def read(spark, rows):
    common.prepare(spark)
    data = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS ids", "'x' AS loss", "2 AS turns")
    return sorted(repr(tuple(r)) for r in chat_format.read_back(chat_format.formatted(data)).collect())


def test_reading_back_gives_the_turns(spark):
    source = random.Random(3)
    text = lambda: "".join(source.choices(PIECES, k=source.randint(0, 20)))
    rows = [(c, t, source.choice(["user", "assistant", "system", None, "<s>[INST]", "as\nsistant"]), source.choice([text(), text(), None])) for c in range(60) for t in range(source.randint(1, 9))]
    # Null conversations and turns, a lone turn, a repeated row, a very long text, and a hot conversation.
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (70, None, "user", "first"), (70, 0, "assistant", ""), (71, 0, "assistant", None)]
    rows += [(72, 0, "assistant", "twice")] * 2 + [(73, 0, "assistant", "x" * 1_000_000 + "<s>" * 1000)] + [(74, t, "assistant", "[INST]") for t in range(3000)]
    source.shuffle(rows)
    assert read(spark, rows) == plain(rows)


def test_rows_of_one_turn_have_an_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "user", "a")]
    assert read(spark, rows) == read(spark, rows[::-1])


def test_ids_and_mask_of_one_conversation(spark):
    common.prepare(spark)
    rows = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello there"), (1, 2, "assistant", ""), (1, 3, "user", "")]
    (row,) = chat_format.formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    own = chat_format.codec()
    assert row["text"] == "<s>[INST]user[/INST]Hi</s><s>[INST]assistant[/INST]Hello there</s><s>[INST]assistant[/INST]</s><s>[INST]user[/INST]</s>"
    ids, mask = np.array(row["ids"]), np.array(row["loss_mask"])
    assert own.decode(ids)[0].decode() == row["text"] and own.decode(ids[mask == 1])[0] == b"Hello there"
    assert (ids >= own.base).sum() == 16 and not mask[ids >= own.base].any()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_nothing_and_nulls(spark, rows):
    assert read(spark, rows) == plain(rows)
