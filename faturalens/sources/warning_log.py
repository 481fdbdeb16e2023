"""Reading and appending the warning log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faturalens.functions.jsontext import kind, parse_strict
from faturalens.functions.once import with_once
from faturalens.sources.json_split import records

RECORD = (
    "timestamp string, assistente string, quantidade_avisos int, quantidade_erros int, "
    "avisos array<string>, erros array<string>, tamanho_resposta int, primeiras_100_chars string"
)


def records_in(documents: DataFrame, text: str = "value") -> DataFrame:
    """Log records out of JSON documents, one document per row.

    A document is a list of records or an object with the list under `items`; anything
    else, unreadable JSON included, holds no records.
    """
    whole = F.col("_document")
    listed = F.try_variant_get(whole, "$.items", "variant")
    items = F.when(kind(whole) == "array", whole).when(kind(listed) == "array", listed)
    rows = with_once(documents, _document=parse_strict(F.col(text))).select(
        F.explode(F.try_variant_get(items, "$", "array<variant>")).alias("_item")
    )
    fields = [part.split() for part in RECORD.split(", ")]
    return rows.where(kind(F.col("_item")) == "object").select(
        *[F.try_variant_get("_item", f"$.{name}", data_type).alias(name) for name, data_type in fields]
    )


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of every log file under the path; each file is one document of any size, read by many tasks.

    A document is a list of records or an object with the list under `items`; anything else,
    unreadable JSON included, holds no records. A field of another type than the log's is null.
    """
    parsed = F.from_json("text", RECORD)
    return records(spark, path).select(F.inline(F.array(parsed)))


def append_log(records: DataFrame, path: str) -> None:
    """Append records in one folder per day; earlier records are not rewritten.

    Days are gathered before they are written, so that a day gets few files; a very full one is split.
    """
    (
        records.withColumn("log_date", F.to_date("timestamp"))
        .hint("rebalance", "log_date")
        .write.mode("append")
        .partitionBy("log_date")
        .parquet(path)
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
