"""Log answers as they arrive.

Each micro-batch goes through the same operators as a batch run and becomes one folder of
the log, named after the batch. A batch that is repeated after a failure overwrites its own
folder, so no record is lost or doubled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from faturalens.functions import fixed
from faturalens.operators.selection import domain
from faturalens.operators.validation import text_checks, verdicts
from faturalens.operators.warninglog import log_records, with_text_figures


def checkpoint_of(shared: str, path: str) -> str:
    """A log's own checkpoint folder under the shared one."""
    own = hashlib.md5(path.rstrip("/").encode()).hexdigest()
    return f"{shared.rstrip('/')}/faturalens-log-answers-{own}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whichever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def log_answers(
    responses: DataFrame,
    years: DataFrame,
    clients: DataFrame,
    path: str,
    checkpoint: str | None = None,
    year_pattern: str = fixed.YEAR_PATTERN,
    stamp: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Validate a stream of `(response_id, area, text)` and write its log records.

    `years` and `clients` hold the known values (columns `year` and `client`); saved domain
    lists keep a batch from reading the whole billing table. `stamp` names a time column of
    the stream, else the clock is used. The checkpoint folder defaults to one of the log's
    own under `spark.checkpoint.dir`, which every machine of the cluster can reach. A log
    that has batches already needs the checkpoint that they were written with: without it
    the batch numbers would start again and replace them, so that is refused. `trigger`
    holds the arguments of the stream's trigger; by default what is there is taken once.
    """
    spark = responses.sparkSession
    if checkpoint is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            raise ValueError("give a checkpoint folder or set spark.checkpoint.dir")
        checkpoint = checkpoint_of(shared, path)
    if exists(spark, f"{path.rstrip('/')}/batch_id=0") and not exists(spark, f"{checkpoint}/commits"):
        raise ValueError(f"the log at {path} has batches, but {checkpoint} isn't their checkpoint")
    # Bounded by the calendar, and read once for all batches.
    known = F.array(*[F.lit(row["year"]) for row in domain(years, "year").collect()]).cast("array<int>")
    kept = ["response_id", "area", "text"] + ([stamp] if stamp else [])

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = text_checks(batch.select(*kept), known, year_pattern)
        verdict = verdicts(with_text_figures(checked), clients)
        time = F.col(stamp) if stamp else None
        log_records(verdict, time).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return (
        responses.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
