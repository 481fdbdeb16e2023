"""The pipeline: what each stage leaves, and the whole run."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from faturalens.llm import bpe_encode, common, jaccard_join, mixing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and what each stage of one whole run wrote."""
    folder = str(tmp_path_factory.mktemp("pipeline") / "run")
    corpus_pipeline.run(spark, FOLDER, folder)
    paths = [f"{FOLDER}/documents.parquet", *[f"{folder}/{i}-{name}" for i, (name, _) in enumerate(corpus_pipeline.STAGES)]]
    return [spark.read.parquet(path) for path in paths]


def test_columns_stay_until_the_last(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_filters_only_remove(stages):
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        assert after.exceptAll(before).isEmpty()
    assert stages[1].count() >= 0.98 * stages[0].count()


def test_no_near_copies_are_left(stages):
    left = jaccard_join.classes(stages[3]).collect()
    assert all(r["n_links"] == 0 and r["class_id"] == r["doc_id"] for r in left)


def test_the_mix_and_its_tokens(stages):
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(stages[3]).collect() if r["mix_copies"]}
    got = {r["doc_id"]: r["n"] for r in stages[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == copies
    own, texts = bpe_encode.encoder(), {r["doc_id"]: r["text"] for r in stages[0].collect()}
    for r in stages[5].collect():
        assert bytes(r["ids"]) == own.encode(texts[r["doc_id"]]) and r["n_tokens"] * 4 == len(r["ids"])


def test_odd_and_empty_tables(spark):
    clashing = "ids string, mix_size string, mix_row string, class_id string, score string, n_tokens string, held_out string, words string"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {clashing}"
    odd = spark.createDataFrame([(1, None, None, None, None, *"abcdefgh"), (None, "Hello there you", "en", None, 3, *"abcdefgh")], schema)
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, FOLDER))
    assert docs.count() <= 2
    nothing = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).isEmpty()
