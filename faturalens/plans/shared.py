"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only a session on one machine gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            master = context.master
            if master.startswith("local-cluster") or not master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder: lineage ends there, and sizes are known.

    Results that are read later may still need the table, so it stays until `clear_written`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Remove every table that `written` left in the session's shared folder; call it when all results are stored."""
    places = spark._jvm.org.apache.hadoop.fs
    folder = places.Path(shared_folder(spark))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(places.Path(folder, "written-*")) or []:
        system.delete(status.getPath(), True)
