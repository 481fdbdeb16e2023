"""Sums, counts, rankings and pivots of the billing table.

Group keys that are null are left out, an all-null group sums to zero, and equal rankings
are ordered by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from faturalens.plans.running import median

def revenue_sum() -> Column:
    return F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,4)")


def known(df: DataFrame, *keys: str) -> DataFrame:
    return reduce(lambda left, key: left.where(F.col(key).isNotNull()), keys, df)


def revenue_by(facts: DataFrame, *keys: str) -> DataFrame:
    return known(facts, *keys).groupBy(*keys).agg(revenue_sum().alias("revenue"))


def records_by(facts: DataFrame, *keys: str) -> DataFrame:
    return known(facts, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))


def monthly_revenue(facts: DataFrame) -> DataFrame:
    return revenue_by(facts, "year", "month")


def yearly_revenue(facts: DataFrame) -> DataFrame:
    return revenue_by(facts, "year").orderBy("year")


def ranking(facts: DataFrame, key: str = "client") -> DataFrame:
    """Every name by revenue, largest first."""
    return revenue_by(facts, key).orderBy(F.desc("revenue"), key)


def top(facts: DataFrame, key: str, measure: str = "revenue", n: int = 15) -> DataFrame:
    """The first names by revenue or by record count."""
    grouped = revenue_by(facts, key) if measure == "revenue" else records_by(facts, key)
    return grouped.orderBy(F.desc(measure), key).limit(n)


def total_revenue(facts: DataFrame) -> DataFrame:
    return facts.agg(revenue_sum().alias("total"))


def mean_monthly_revenue(facts: DataFrame) -> DataFrame:
    """Mean over months of the monthly sums, not over rows."""
    return monthly_revenue(facts).agg(
        (F.sum("revenue").cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("mean_month")
    )


def top_client(facts: DataFrame) -> DataFrame:
    """Name of the first client, or a dash when nothing is selected."""
    first = ranking(facts).limit(1)
    return first.agg(F.coalesce(F.max("client"), F.lit("-")).alias("client"))


def indicators(facts: DataFrame) -> DataFrame:
    """Total, mean month and first client in one row, as the panel shows them.

    Both parts start from the same grouped rows and carry no filter on its keys, so the
    shuffle of those rows is shared.
    """
    grouped = facts.groupBy("year", "month", "client").agg(revenue_sum().alias("revenue"))
    dated = F.col("year").isNotNull() & F.col("month").isNotNull()
    monthly = grouped.groupBy("year", "month").agg(F.sum("revenue").alias("revenue"))
    totals = monthly.agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("total"),
        F.sum(F.when(dated, F.col("revenue"))).alias("dated"),
        F.count(F.when(dated, 1)).alias("months"),
    )
    by_client = grouped.groupBy("client").agg(F.sum("revenue").alias("revenue"))
    best = by_client.orderBy(F.col("client").isNull(), F.desc("revenue"), "client").limit(1)
    return totals.select(
        F.col("total").cast("double").alias("total"),
        (F.col("dated").cast("double") / F.nullif(F.col("months"), F.lit(0))).alias("mean_month"),
        F.coalesce(best.agg(F.max("client")).scalar(), F.lit("-")).alias("top_client"),
    )


def amount_profile(facts: DataFrame, exact: bool = True) -> DataFrame:
    """Minimum, maximum, sum, mean and median of the amount.

    The exact median comes from a running count over the distinct amounts, which spreads
    over tasks; `exact=False` uses a sketch instead.
    """
    total = F.sum("amount")
    middle = [] if exact else [F.percentile_approx("amount", 0.5, 10000).cast("double").alias("median_amount")]
    profile = facts.agg(
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        revenue_sum().alias("total"),
        (total.cast("double") / F.nullif(F.count("amount"), F.lit(0))).alias("mean_amount"),
        *middle,
    )
    return profile.withColumn("median_amount", median(facts, "amount").scalar()) if exact else profile


def year_columns(years) -> list[str]:
    return [f"y{year}" for year in years]


def month_year_pivot(facts: DataFrame, years: list[int]) -> DataFrame:
    """One row per month, one column per year; a month without rows stays null.

    The years are given, so that finding them does not run the aggregation twice.
    """
    monthly = monthly_revenue(facts)
    wide = monthly.groupBy("month").pivot("year", years).agg(F.sum("revenue"))
    return wide.toDF("month", *year_columns(years)).orderBy("month")


def active_collaborators(facts: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct collaborators per month; the sketch is for very wide data."""
    distinct = F.approx_count_distinct("collaborator") if approximate else F.count_distinct("collaborator")
    return known(facts, "year", "month").groupBy("year", "month").agg(distinct.alias("collaborators"))


def distinct_counts(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count_distinct("client").alias("clients"),
        F.count_distinct("collaborator").alias("collaborators"),
    )


def record_count(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("records"))


def share(part: Column, whole: Column) -> Column:
    """Percent of the whole, null when the whole is zero."""
    return F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
