"""Writers for payloads and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faturalens.functions import fixed
from faturalens.functions.text import first_filled


def payload_documents(payloads: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Payload rows with the document version and time stamp in front, one row per area."""
    stamp = F.current_timestamp() if stamp is None else stamp
    others = [c for c in payloads.columns if c not in ("schema_version", "area")]
    return payloads.select(
        F.lit(fixed.PAYLOAD_SCHEMA_VERSION).alias("document_version"),
        stamp.alias("generated_at"),
        "area",
        F.struct("schema_version", "area", *others).alias("payload"),
    )


def write_payloads(payloads: DataFrame, path: str, stamp: Column | None = None) -> None:
    """JSON documents in one folder per area; absent fields are written as null."""
    (
        payload_documents(payloads, stamp)
        .write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .partitionBy("area")
        .json(path)
    )


def markdown_or_notice(reports: DataFrame, text: str = "markdown") -> DataFrame:
    """An empty or missing report becomes the fixed notice."""
    return reports.withColumn(text, first_filled(F.col(text), F.lit(fixed.EMPTY_MARKDOWN)))


def write_markdown(reports: DataFrame, path: str, text: str = "markdown") -> None:
    markdown_or_notice(reports, text).select(text).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, order: list[str], text: str = "line") -> None:
    """A document held as ordered lines: part files in name order are the document."""
    lines.orderBy(*order).select(text).write.mode("overwrite").text(path)
