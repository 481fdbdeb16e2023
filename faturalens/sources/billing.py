"""Billing table: folder ingest, header names, union by name, tolerant reading with rejects."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.orc
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from faturalens.functions import fixed
from faturalens.sources.headers import READ_ERRORS, decoded, glob_free, header_lines, schema_groups

EXTENSIONS = {"parquet": "*.parquet", "csv": "*.csv", "json": "*.json", "orc": "*.orc"}
DEFAULT_OPTIONS = {
    "parquet": {"mergeSchema": "true"},
    "csv": {"header": "true", "inferSchema": "true", "mode": "PERMISSIVE"},
    "json": {"mode": "PERMISSIVE"},
    "orc": {"mergeSchema": "true"},
}
FACT_TYPES = {**dict.fromkeys(fixed.FACT_COLUMNS, "string"), "year": "int", "month": "int", "amount": "decimal(18,4)"}
CORRUPT = "_corrupt_record"
MALFORMED = "malformed row"
REJECT = "array<struct<column:string,value:string,reason:string>>"


def canonical(name: str, aliases: dict[str, str] | None = None) -> str:
    """Stripped, lower case, and the canonical name where there is one."""
    aliases = fixed.COLUMN_ALIASES if aliases is None else aliases
    plain = name.strip().lower()
    return aliases.get(plain, plain)


def places_of(names: list[str], aliases: dict[str, str] | None = None) -> dict[str, list[int]]:
    """Canonical names in order of appearance, each with the places of its spellings."""
    places: dict[str, list[int]] = {}
    for place, name in enumerate(names):
        places.setdefault(canonical(name, aliases), []).append(place)
    return places


def refuse_collisions(names: list[str], aliases: dict[str, str] | None = None, where: str = "") -> None:
    """Two columns of one table that become one name can't both be kept."""
    clashes = {name: [names[i] for i in own] for name, own in places_of(names, aliases).items() if len(own) > 1}
    if clashes:
        raise ValueError(f"columns collide after normalisation{where}: {clashes}")


def normalize_headers(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Strip and lower-case column names, then apply the canonical names."""
    refuse_collisions(df.columns, aliases)
    return df.toDF(*[canonical(name, aliases) for name in df.columns])


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; a column a table lacks is null there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tables)


def read_folder(
    spark: SparkSession,
    folder: str | list[str],
    fmt: str = "parquet",
    pattern: str | None = None,
    schema: str | T.StructType | None = None,
    skip_unreadable: bool = True,
    **options: str,
) -> DataFrame:
    """Every matching file of a folder as one table, as it is stored.

    Unreadable files are skipped while the scan runs; `file_report` names them.
    """
    reader = spark.read.format(fmt).option("pathGlobFilter", pattern or EXTENSIONS[fmt])
    reader = reader.options(**{**DEFAULT_OPTIONS.get(fmt, {}), **options})
    # A scan option, so it holds for this read only. For Parquet the footer of a broken file
    # can also stop schema merging, which a given schema avoids.
    reader = reader.option("ignoreCorruptFiles", str(skip_unreadable).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(folder if isinstance(folder, str) else list(folder))


# --- tolerant reading ---------------------------------------------------------------------
def scan_billing(spark: SparkSession, folder: str | list[str], fmt: str = "parquet", **options) -> DataFrame:
    """Every row of a folder, or of a list of files, under canonical names and types, with `_file`, `_row` and `_rejects`.

    A cell that isn't of its column's type is null and named in `_rejects` with its value; a
    row with too few or too many fields, or that isn't JSON, is one reject without a column.
    `_row` is the row's text where something was rejected. Nothing in a file ends the read; two columns
    of one file under one name do, since one of them would be lost. Write the scan once (`plans.shared.written`) to take
    `good_rows`, `reject_rows` and `billing_report` out of a single reading of the files.
    """
    if fmt == "csv":
        tables = csv_tables(spark, folder, **options)
    else:
        try:
            own = folder if isinstance(folder, str) else [glob_free(path) for path in folder]
            tables = [read_folder(spark, own, fmt, **options)]
        except READ_ERRORS:
            if fmt not in ("parquet", "orc"):
                raise
            tables = schema_tables(spark, folder, fmt, **options)
    scans = [checked(raw) for raw in tables]
    return union_by_name(*scans) if scans else checked(spark.createDataFrame([], T.StructType([])))


def good_rows(scan: DataFrame) -> DataFrame:
    """The billing table of a scan: all rows but malformed ones, bad cells null."""
    malformed = F.exists("_rejects", lambda reject: reject["column"].isNull())
    return scan.where(~malformed).drop("_file", "_row", "_rejects")


def reject_rows(scan: DataFrame) -> DataFrame:
    """(file, row, column, value, reason) of every rejected cell and row."""
    return scan.where(F.size("_rejects") > 0).select(
        F.col("_file").alias("file"), F.col("_row").alias("row"), F.inline("_rejects")
    )


def read_billing(spark: SparkSession, folder: str | list[str], fmt: str = "parquet", **options) -> DataFrame:
    """The billing table of a folder, or of a list of files, whatever the order, spelling, case and types of each file's columns.

    CSV files are grouped by header, since Spark matches their columns by place. Other files are
    read at once; only where their schemas don't go together are they grouped by schema. The
    plan grows with the number of different headers or schemas, not with that of the files.
    """
    return good_rows(scan_billing(spark, folder, fmt, **options))


def csv_tables(spark: SparkSession, folder: str | list[str], pattern: str | None = None, schema: str | None = None, **options) -> list[DataFrame]:
    """One table of text columns per different header line of the CSV files."""
    separator = options.get("sep", options.get("delimiter", ","))
    quote = options.get("quote", '"')
    set_to = {**DEFAULT_OPTIONS["csv"], "inferSchema": "false", **options, "columnNameOfCorruptRecord": CORRUPT}
    # A row is held against the whole header, whichever columns are asked for.
    set_to["columnPruning"] = "false"
    tables = []
    for group in header_lines(spark, folder, pattern or EXTENSIONS["csv"]).collect():
        names = next(csv.reader([group["header"]], delimiter=separator, quotechar=quote))
        refuse_collisions(names, where=f" in {group['paths'][0]}")
        kind = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))] + [T.StructField(CORRUPT, T.StringType())])
        reader = spark.read.schema(kind).options(**set_to)
        reader = reader.option("basePath", folder) if isinstance(folder, str) else reader
        rows = reader.csv([glob_free(path) for path in group["paths"]])
        file = F.col("_metadata.file_path").alias("_file")
        # Columns behind the last one are those of the folders' names.
        folders = rows.columns[len(names) + 1 :]
        tables.append(rows.select("*", file).toDF(*names, CORRUPT, *folders, "_file"))
    return tables


def schema_tables(
    spark: SparkSession, folder: str | list[str], fmt: str, pattern: str | None = None, skip_unreadable: bool = True, schema: str | None = None, **options
) -> list[DataFrame]:
    """One table per group of files whose schemas go together."""
    paths, base = folder, {}
    if isinstance(folder, str):
        paths, base = [row["path"] for row in list_files(spark, folder, pattern or EXTENSIONS[fmt]).select("path").collect()], {"basePath": folder}
    groups = schema_groups(spark, paths, fmt, skip_unreadable, **options)
    return [
        read_folder(spark, [glob_free(path) for path in own], fmt, pattern, kind, skip_unreadable, **base, **options)
        for kind, own in groups
    ]


def merged_spellings(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Canonical names; columns that different files spell differently become one.

    A row that fills two spellings comes from one file that has both, which is refused.
    """
    numbered = df.toDF(*[f"_{place}" for place in range(len(df.columns))])
    columns = []
    for name, own in places_of(df.columns, aliases).items():
        same = len({df.dtypes[i][1] for i in own}) == 1
        values = [F.col(f"_{i}") if same else F.col(f"_{i}").cast("string") for i in own]
        value = F.coalesce(*values)
        if len(own) > 1:
            filled = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
            both = f"columns collide after normalisation in one file: {[df.columns[i] for i in own]}"
            value = F.when(filled > 1, F.raise_error(F.lit(both))).otherwise(value)
        columns.append(value.alias(name))
    return numbered.select(*columns)


def cell(value: Column, given: str, wanted: str) -> tuple[Column, Column]:
    """The value as `wanted`, null where it can't be, and whether there is a value at all."""
    if given == wanted != "string":
        return value, value.isNotNull()
    text = value.cast("string")
    there = value.isNotNull() & (F.trim(text) != "")
    if wanted == "string":
        return text, there
    if given in ("double", "float"):
        # Spreadsheets store a missing number as not-a-number.
        there = there & ~F.isnan(value)
    number = F.trim(text).try_cast("decimal(38,10)")
    if wanted == "int":
        return F.when(there & (number == F.floor(number)), number.try_cast("int")), there
    return F.when(there, number.try_cast(wanted)), there


def checked(raw: DataFrame) -> DataFrame:
    """A raw table under canonical names and types, with `_file`, `_row` and `_rejects`."""
    if "_file" not in raw.columns:
        path = F.col("_metadata.file_path") if raw.columns else F.lit(None).cast("string")
        raw = raw.select("*", path.alias("_file"))
    given = raw.drop("_file", CORRUPT)
    row_text = F.to_json(F.struct(*[F.col(f"`{name}`") for name in given.columns])) if given.columns else F.lit(None)
    corrupt = F.col(CORRUPT) if CORRUPT in raw.columns else F.lit(None).cast("string")
    own = raw.select(*[F.col(f"`{name}`") for name in given.columns], "_file", corrupt.alias("_text"), row_text.alias("_json"))
    named = merged_spellings(own)
    kinds = dict(named.dtypes)
    known, rejects = [], []
    for name, wanted in FACT_TYPES.items():
        if name not in kinds:
            known.append(F.lit(None).cast(wanted).alias(name))
            continue
        value, there = cell(F.col(name), kinds[name], wanted)
        known.append(value.alias(name))
        # A column of the wanted type has no cell to reject.
        if wanted not in ("string", kinds[name]):
            reject = F.struct(F.lit(name).alias("column"), F.col(name).cast("string").alias("value"), F.lit(f"not of type {wanted}").alias("reason"))
            rejects.append(F.when(there & value.isNull(), reject))
    whole_row = F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"), F.lit(MALFORMED).alias("reason"))
    cells = F.array_compact(F.array(*rejects)) if rejects else F.array()
    bad = F.when(F.col("_text").isNotNull(), F.array(whole_row)).otherwise(cells).cast(REJECT)
    others = [name for name in named.columns if name not in FACT_TYPES and not name.startswith("_")]
    shown = F.when(F.size(bad) > 0, F.coalesce("_text", "_json"))
    return named.select(*known, *others, decoded(F.col("_file")).alias("_file"), shown.alias("_row"), bad.alias("_rejects"))


def conform(df: DataFrame) -> DataFrame:
    """The five known columns in their types, a cell that doesn't fit null, and every other one; a missing one is null."""
    kinds = dict(df.dtypes)
    known = [
        (cell(F.col(name), kinds[name], kind)[0] if name in kinds else F.lit(None).cast(kind)).alias(name)
        for name, kind in FACT_TYPES.items()
    ]
    return df.select(*known, *[c for c in df.columns if c not in FACT_TYPES])


# --- reports ------------------------------------------------------------------------------
def plain_path(path: Column) -> Column:
    """One spelling of a local path, with or without an empty authority."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def qualified(spark: SparkSession, folder: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths, names inside the folder and sizes of the matching files; the contents are not read."""
    base = F.regexp_replace(F.lit(qualified(spark, folder).rstrip("/") + "/"), "^file:/+", "file:/")
    path = plain_path(F.col("path"))
    inside = F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(F.element_at(F.split(path, "/"), -1))
    return listed(spark, folder, pattern).select("path", path.alias("plain"), inside.alias("file_name"), F.col("length").alias("bytes"))


def file_report(spark: SparkSession, folder: str, fmt: str = "parquet", pattern: str | None = None, **options) -> DataFrame:
    """One row per matching file: its name inside the folder, rows read from it, and its status.

    `status` is `read`, `empty` for a file that can be read but holds no row, or `unreadable`.
    Files are told apart by their full path, so equal names in different folders stay apart. CSV rows with
    another number of fields than the header are not counted as read.
    """
    if fmt == "csv":
        tables = csv_tables(spark, folder, pattern, **options)
        # The reader needs a column of the file beside the mark of malformed rows.
        whole = [raw.where(F.col(CORRUPT).isNull() & (F.length(F.concat_ws("", raw[0])) >= 0)).select("_file") for raw in tables]
        rows = union_by_name(*whole) if whole else spark.createDataFrame([], "_file string")
    else:
        rows = read_folder(spark, folder, fmt, pattern, **options).select(F.col("_metadata.file_path").alias("_file"))
    counts = rows.groupBy(plain_path(decoded(F.col("_file"))).alias("plain")).agg(F.count(F.lit(1)).alias("rows_read"))
    files = list_files(spark, folder, pattern or EXTENSIONS[fmt])
    counted = files.join(counts, "plain", "left").withColumn("rows_read", F.coalesce("rows_read", F.lit(0)))
    status = F.when(F.col("rows_read") > 0, "read").when(F.col("opens"), "empty").otherwise("unreadable")
    return with_opens(spark, counted, "rows_read", folder, fmt, pattern).select(
        "file_name", "rows_read", (status != "unreadable").alias("readable"), status.alias("status")
    )


def billing_report(spark: SparkSession, scan: DataFrame, folder: str, fmt: str = "parquet", pattern: str | None = None) -> DataFrame:
    """One row per matching file: good rows, rejected rows, rejected cells, and its status.

    `status` is `read`, `rejected` where no row is good, `empty` or `unreadable`.
    """
    malformed = F.exists("_rejects", lambda reject: reject["column"].isNull())
    counts = scan.groupBy(plain_path(F.col("_file")).alias("plain")).agg(
        F.count_if(~malformed).alias("good_rows"),
        F.count_if(malformed).alias("rejected_rows"),
        F.sum(F.when(malformed, 0).otherwise(F.size("_rejects"))).alias("rejected_cells"),
    )
    files = list_files(spark, folder, pattern or EXTENSIONS[fmt])
    numbers = ["good_rows", "rejected_rows", "rejected_cells"]
    counted = files.join(counts, "plain", "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in numbers})
    counted = counted.withColumn("rows", F.col("good_rows") + F.col("rejected_rows"))
    status = F.when(F.col("good_rows") > 0, "read").when(F.col("rows") > 0, "rejected").when(F.col("opens"), "empty").otherwise("unreadable")
    return with_opens(spark, counted, "rows", folder, fmt, pattern).select("file_name", *numbers, status.alias("status"))


# A file without rows holds its schema and nothing else; a larger one without rows is broken.
LARGEST_WITHOUT_ROWS = 8 << 20


def with_opens(spark: SparkSession, counted: DataFrame, rows: str, folder: str, fmt: str, pattern: str | None) -> DataFrame:
    """`counted` with `opens`: whether a file without rows can be read. All such files are tried in one job, on the executors."""
    if fmt not in ("parquet", "orc"):
        # Lines of text can always be read.
        return counted.withColumn("opens", F.lit(True))
    small = listed(spark, folder, pattern or EXTENSIONS[fmt]).where(F.col("length") <= LARGEST_WITHOUT_ROWS)
    rowless = counted.where(F.col(rows) == 0).select("plain")
    contents = small.select(plain_path(F.col("path")).alias("plain"), "content").join(rowless, "plain", "left_semi")

    def try_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"plain": frame["plain"], "opens": [opens(fmt, content) for content in frame["content"]]})

    tried = contents.mapInPandas(try_out, "plain string, opens boolean")
    return counted.join(tried, "plain", "left").withColumn("opens", F.coalesce("opens", F.lit(False)))


def opens(fmt: str, content: bytes) -> bool:
    """Whether the bytes are a file of the format."""
    try:
        (pyarrow.parquet.ParquetFile if fmt == "parquet" else pyarrow.orc.ORCFile)(io.BytesIO(content))
    except (pa.ArrowException, OSError):
        return False
    return True


def has_rows(df: DataFrame) -> bool:
    """Guard at the edge of a job: no rows means there is nothing to analyse."""
    return not df.isEmpty()
