"""Which columns the files of a folder have, read where the files lie: first lines and footers only."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.errors.exceptions.base import PySparkException as SparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

READ_ERRORS = (AnalysisException, SparkRuntimeException, Py4JJavaError, SparkException)
# A split as large as any file, and a cost of opening one that keeps a second file out of it.
ONE_FILE = str(1 << 60)
LINES_AT_ONCE = 256
# Batches read behind the first line: a file that ends within them leaves its worker fit for the next one.
BATCHES_BEHIND = 4


def decoded(path: Column) -> Column:
    """A path as it is listed, out of the encoded form that scans report."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def glob_free(path: str) -> str:
    """A path whose name is taken as it is, not as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for what runs inside; keys with `__` for dots."""
    named = {key.replace("__", "."): value for key, value in values.items()}
    kept = {key: spark.conf.get(key) for key in named}
    try:
        for key, value in named.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line that isn't blank, of one file; of what is behind it, no more than a few batches are asked for."""
    for batch in batches:
        for place, line in enumerate(batch.column(0).to_pylist()):
            if line.strip("﻿ \t\r"):
                yield batch.slice(place, 1)
                for _ in islice(batches, BATCHES_BEHIND):
                    pass
                return


def header_lines(spark: SparkSession, folder: str | list[str], pattern: str) -> DataFrame:
    """(header, files, paths): every different first line of the folder's files, with the files that begin with it.

    Each file is a partition, which ends at its first line; a task opens a group of files one after
    the other. So of each file some thousand lines are read at most, however large it is.
    """
    wide = {"spark__sql__files__maxPartitionBytes": ONE_FILE, "spark__sql__files__openCostInBytes": ONE_FILE}
    with settings(spark, **wide, spark__sql__execution__arrow__maxRecordsPerBatch=str(LINES_AT_ONCE)):
        where = folder if isinstance(folder, str) else [glob_free(path) for path in folder]
        lines = spark.read.option("pathGlobFilter", pattern).text(where)
        first = lines.select("value", F.col("_metadata.file_path").alias("path")).mapInArrow(first_line, "value string, path string")
        grouped = first.coalesce(4 * spark.sparkContext.defaultParallelism).groupBy(F.ltrim("value", F.lit("﻿")).alias("header"))
        found = grouped.agg(F.count(F.lit(1)).alias("files"), F.sort_array(F.collect_list(decoded(F.col("path")))).alias("paths"))
        # One row per different header; the paths are what a reader is given anyway.
        rows = found.orderBy("header").collect()
    return spark.createDataFrame(rows, found.schema)


def schema_groups(spark: SparkSession, paths: list[str], fmt: str, skip_unreadable: bool, **options: str) -> list[tuple[T.StructType, list[str]]]:
    """Groups of files whose schemas go together, with the merged schema of each.

    Footers are read and merged by the reader's own job, in parallel over the files. Files that don't go
    together are halved, in the order of their paths, and halves with equal schemas are joined
    again; so the jobs grow with the number of places where the schema changes, not with the files.
    """
    groups: list[tuple[T.StructType, list[str]]] = []

    def add(schema: T.StructType, own: list[str]) -> None:
        for known, members in groups:
            if known == schema:
                members += own
                return
        groups.append((schema, list(own)))

    def look(own: list[str]) -> None:
        reader = spark.read.format(fmt).options(**options).option("mergeSchema", "true")
        try:
            add(reader.load([glob_free(path) for path in own]).schema, own)
        except READ_ERRORS:
            if len(own) > 1:
                look(own[: len(own) // 2])
                look(own[len(own) // 2 :])
            elif not skip_unreadable:
                raise

    if paths:
        look(sorted(paths))
    return groups
