"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Needed for right results, whatever session the caller brings.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated key keeps its last value, as most JSON readers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# Hot names and amounts are split at run time: joins rely on it, whatever session runs them.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Good defaults for a session of our own; a cluster session keeps what it has.
SPEED_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in {**RESULT_SETTINGS, **SKEW_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", memory: str = "20g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faturalens")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RESULT_SETTINGS, **SKEW_SETTINGS, **SPEED_SETTINGS}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
