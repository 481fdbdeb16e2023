"""The data profile kept up to date: partial sums of each batch of files, put together when asked.

A store has one folder per batch under each of three tables. `parts` holds the measures per year, month and collaborator
and those per client, which all sections of the profile are rolled up from (batches of before have them per all four
keys, and are read as well), `amounts` how often each amount stands in the batch, for the exact median, and `files` what
was read. All of it can be merged by sums, counts, least and largest values; so new files are
read alone, and rows that were read before never again. A batch that is added twice
under one name replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from faturalens.plans.profile import _fine, _levels, _sections, part_sums, row_sums
from faturalens.plans.running import counted_median
from faturalens.sources import billing

KEYS = ["_set", "year", "month", "collaborator", "client"]
TABLES = ["parts", "amounts", "files"]


def _folder(path: str, table: str) -> str:
    return f"{path.rstrip('/')}/{table}"


def read_parts(spark: SparkSession, path: str, table: str, kind: str) -> DataFrame:
    """One table of the store; a store without a batch has none of it."""
    try:
        return spark.read.schema(kind).parquet(_folder(path, table)).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], kind)


def add_batch(facts: DataFrame, path: str, batch: str) -> None:
    """Sum the billing rows of one batch up and keep that under its name."""
    parts = _fine(facts, row_sums())
    counted = facts.where("amount IS NOT NULL").groupBy("amount").agg(F.count(F.lit(1)).alias("n"))
    parts.write.mode("overwrite").parquet(f"{_folder(path, 'parts')}/batch={batch}")
    counted.write.mode("overwrite").parquet(f"{_folder(path, 'amounts')}/batch={batch}")


def new_files(spark: SparkSession, folder: str, path: str, fmt: str = "parquet") -> list[str]:
    """The folder's files that no batch of the store has read; names are compared where they are listed."""
    listed = billing.list_files(spark, folder, billing.EXTENSIONS[fmt])
    known = read_parts(spark, path, "files", "plain string")
    # The paths of a batch are what a reader is given anyway.
    return [row["path"] for row in listed.join(known, "plain", "left_anti").select("path").orderBy("path").collect()]


def add_new_files(spark: SparkSession, folder: str, path: str, batch: str, fmt: str = "parquet", **options) -> int:
    """Add the files that are new in a billing folder as one batch; returns how many there were. Only these are read."""
    fresh = new_files(spark, folder, path, fmt)
    if fresh:
        add_batch(billing.read_billing(spark, fresh, fmt, **options), path, batch)
        names = spark.createDataFrame([(name,) for name in fresh], "path string").select(billing.plain_path(F.col("path")).alias("plain"))
        # Last, so that a batch that breaks off is new again.
        names.write.mode("overwrite").parquet(f"{_folder(path, 'files')}/batch={batch}")
    return len(fresh)


PART_KIND = "_set int, year int, month int, collaborator string, client string, records long, revenue decimal(28,4), amounts long, lowest decimal(18,4), highest decimal(18,4)"


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profile of everything that was added, out of the partial sums alone."""
    parts = read_parts(spark, path, "parts", PART_KIND)
    # Rows without a set are of all four keys.
    sums = parts.where("_set IS NOT NULL").unionByName(_fine(parts.where("_set IS NULL").drop("_set"), part_sums()))
    fine = sums.groupBy(*KEYS).agg(*[value.alias(name) for name, value in part_sums().items()])
    amounts = read_parts(spark, path, "amounts", "amount decimal(18,4), n long")
    return _sections(_levels(fine), counted_median(amounts, "amount", "n"))
