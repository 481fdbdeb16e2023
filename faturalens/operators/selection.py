"""Filters and domain lists of the billing table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def select_facts(facts: DataFrame, years=None, clients=None, months=None) -> DataFrame:
    """Rows inside every given list; a list that is not given adds no condition.

    Each argument is a Python list, or, for lists too long to write into a plan, a DataFrame
    with a column of the same name, which becomes a semi-join.
    """

    def keep(df: DataFrame, column: str, wanted) -> DataFrame:
        if wanted is None:
            return df
        if isinstance(wanted, DataFrame):
            return df.join(wanted.select(column), column, "left_semi")
        return df.where(F.col(column).isin(list(wanted)))

    wanted = {"year": years, "client": clients, "month": months}
    return reduce(lambda df, item: keep(df, *item), wanted.items(), facts)


def drill_down(facts: DataFrame, client: str) -> DataFrame:
    """Every column of one client, out of the table before any selection."""
    return facts.where(F.col("client") == client)


def domain(facts: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column, nulls left out."""
    return facts.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def known_years(facts: DataFrame) -> DataFrame:
    """One row with the sorted array of years, bounded by the calendar."""
    return facts.agg(F.sort_array(F.collect_set("year")).alias("years"))


def facts_info(facts: DataFrame) -> DataFrame:
    """One row: years, months, amount range and mean.

    The arrays are bounded by the calendar. Names are not part of it, their number grows
    with the data.
    """
    total = F.coalesce(F.sum("amount"), F.lit(0))
    return facts.agg(
        F.sort_array(F.collect_set("year")).alias("years"),
        F.sort_array(F.collect_set("month")).alias("months"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        (total.cast("double") / F.nullif(F.count("amount"), F.lit(0))).alias("mean_amount"),
    )
