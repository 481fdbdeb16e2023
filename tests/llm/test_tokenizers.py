"""BPE encoding and counts against the tokenizers library, on whole and odd texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faturalens.llm import bpe_encode, common, token_count

ODD = [
    "", " ", "\n\n", "a", "a b", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n a\n\nb c\n", "a\x1cb", "a\x85b c　d",
    "'s 'S don't", "ΑΣ ΟΔΟΣ", "İstanbul ﬁ ﬂ", "é é", "12 1²3 Ⅷ ١٢", "🙂🙂 x", "a" * 3000, "ab" * 2000, "the " * 500,
    "<|endoftext|>", "x<|endoftext|>y <|startoftext|> z", "<|endof", "tab\tq", "Ünïcödé WÖRDS, näïve", "﻿x­",
]


def random_texts(count):
    source = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    mixed = "abcdeABC   '’.,\n\t\x1c\x85éÉßΣςİ漢字١²Ⅷ🙂́"
    return ["".join(source.choices(source.choice([letters, mixed]), k=source.randint(0, 50))) for _ in range(count)]


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(200)
    return ODD + random_texts(1500) + [row["text"] for row in docs.collect()]


def test_encoder_equals_the_library(texts):
    library, own = Tokenizer.from_file(public_tokenizers.path(bpe_encode.TOKENIZER)), bpe_encode.encoder()
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        mine = own.encode(text)
        assert np.frombuffer(mine, "<u4").tolist() == ids, text[:80]
        assert own.decode(mine).decode() == library.decode(ids, skip_special_tokens=False)


def test_runs_are_forgotten_when_full():
    runs = bpe_encode.Runs(lambda run: run.encode(), 2 * (bpe_encode.RUN_BYTES + 5))
    assert [runs[x] for x in "abcab"] == [x.encode() for x in "abcab"]
    assert len(runs) <= 2
    assert runs["x" * 200] == b"x" * 200 and "x" * 200 not in runs


BLANKS = ["\n\n", "  ", " \n", "\t", "\u3000", "\x85 ", "\x1c", " "]


def test_texts_full_of_blanks_keep_little_and_count_right(monkeypatch):
    """5,000 texts with blank lines throughout; what is kept stays under its bound, and is never a text."""
    source = random.Random(8)
    texts = ["".join(source.choices(["ab", "word", "é", "12", "don't", *BLANKS], k=60)) + str(i) + "\n\n" for i in range(5000)]
    library, own = Tokenizer.from_file(public_tokenizers.path(token_count.TOKENIZER)), token_count.Counter(public_tokenizers.path(token_count.TOKENIZER))
    monkeypatch.setattr(token_count, "KEPT_BYTES", 200_000)
    want = [len(one.ids) for one in library.encode_batch(texts, add_special_tokens=False)]
    got = []
    for low in range(0, 5000, 500):
        got += own.count(texts[low : low + 500])
        assert sum(token_count.PART_BYTES + 4 * len(part) for part in own.parts) <= 201_000
        assert max(map(len, own.parts)) <= token_count.LONGEST_KEPT
    assert got == want


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ab1 " * 250_000, "\n\n" * 500_000, "word\n\n" * 160_000, "漢字" * 100_000])
def test_a_megabyte_of_one_kind(text):
    library, own = Tokenizer.from_file(public_tokenizers.path(token_count.TOKENIZER)), token_count.counter()
    assert own.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    library, encoder = Tokenizer.from_file(public_tokenizers.path(bpe_encode.TOKENIZER)), bpe_encode.encoder()
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids


def test_counts_equal_the_library(texts):
    library, own = Tokenizer.from_file(public_tokenizers.path(token_count.TOKENIZER)), token_count.counter()
    assert own.count(texts) == [len(library.encode(text, add_special_tokens=False).ids) for text in texts]


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def test_digests_of_nulls_repeats_and_clashing_columns(spark):
    common.prepare(spark)
    rows = [(1, None, 9), (2, "", 9), (None, "Hello world", 9), (3, "Hello world", 9), (3, "Hello world", 9)]
    got = bpe_encode.digests(docs_of(spark, rows, ", n_tokens int")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["doc_id"], r["n_tokens"], r["ids_sha256"] == empty) for r in got] == [
        (1, 0, True), (2, 0, True), (None, 2, False), (3, 2, False), (3, 2, False),
    ]
    assert bpe_encode.digests(docs_of(spark, [])).collect() == []


def test_encode_then_decode(spark):
    docs = docs_of(spark, [(1, "Hello, World"), (2, None)])
    got = {r["doc_id"]: r["text"] for r in bpe_encode.decode(bpe_encode.encode(docs)).collect()}
    assert got == {1: "hello</w> ,</w> world</w>", 2: ""}
    assert [r["n_decoded"] for r in bpe_encode.round_trip(docs).collect()] == [len(got[1]), 0]


def test_token_counts_of_repeats_and_clashing_columns(spark):
    common.prepare(spark)
    rows = [(1, "same text", 9, True), (1, "same text", 9, True), (None, "same text", 9, None)]
    got = token_count.token_counts(docs_of(spark, rows, ", n_tokens int, over_limit boolean")).collect()
    assert [(r["doc_id"], r["n_tokens"], r["over_limit"]) for r in got] == [(1, 2, False), (1, 2, False), (None, 2, False)]


def test_token_counts_of_nulls_and_the_limit(spark):
    got = token_count.token_counts(docs_of(spark, [(1, None), (2, "é"), (3, "word " * 600)])).collect()
    assert [(r["n_bytes"], r["over_limit"]) for r in got] == [(0, False), (2, False), (3000, True)]
    assert got[0]["n_tokens"] == 0
    assert token_count.token_counts(docs_of(spark, [])).collect() == []
