"""Least-squares trend of monthly revenue and its continuation.

Every function takes `keys`: none for one overall line, or e.g. `["client"]` for one line
per client. The monthly table has at most one row per calendar month and key, so a window
over it stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faturalens.operators.aggregates import known, revenue_sum

STEPS = 6


def monthly_series(facts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Monthly revenue with the time index t = 0, 1, ...; missing months leave no gap."""
    columns = [*keys, "year", "month"]
    order = Window.partitionBy(*keys).orderBy("year", "month")
    return known(facts, *columns).groupBy(*columns).agg(revenue_sum().alias("revenue")).withColumn("t", F.row_number().over(order) - 1)


def _line(y: Column, t: Column) -> tuple[Column, Column]:
    """Slope and intercept; a single point gives a flat line through it."""
    slope = F.coalesce(F.regr_slope(y, t), F.lit(0.0))
    intercept = F.coalesce(F.regr_intercept(y, t), F.avg(y))
    return slope, intercept


def trend_model(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Number of points, slope and intercept."""
    slope, intercept = _line(F.col("revenue").cast("double"), F.col("t"))
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), slope.alias("slope"), intercept.alias("intercept")
    )


def fitted(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The observed months with the value of the line; the model needs no join."""
    whole = Window.partitionBy(*keys)
    y, t = F.col("revenue").cast("double"), F.col("t")
    slope = F.coalesce(F.regr_slope(y, t).over(whole), F.lit(0.0))
    intercept = F.coalesce(F.regr_intercept(y, t).over(whole), F.avg(y).over(whole))
    return series.withColumn("forecast", intercept + slope * t)


def forecast(series: DataFrame, keys: list[str] = (), steps: int = STEPS) -> DataFrame:
    """The next steps of the line, neither clipped nor given calendar labels."""
    model = trend_model(series, keys).where("n > 0")
    ahead = F.explode(F.sequence(F.col("n"), F.col("n") + (steps - 1))).alias("t")
    rows = model.select(*keys, "slope", "intercept", ahead)
    return rows.select(*keys, "t", (F.col("intercept") + F.col("slope") * F.col("t")).alias("forecast"))


def year_projection(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Latest year: months seen plus the line for the months still missing after them.

    The conservative and aggressive readings take off or add one standard deviation of the
    residuals for each month projected.
    """
    rows = fitted(series, keys)
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("_latest", F.max("year").over(whole))
    current = F.col("year") == F.col("_latest")
    residual = F.col("revenue").cast("double") - F.col("forecast")
    slope, intercept = _line(F.col("revenue").cast("double"), F.col("t"))
    model = rows.groupBy(*keys).agg(
        F.max("year").alias("year"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(current, F.col("month"))).alias("last_month"),
        F.sum(F.when(current, F.col("revenue"))).cast("double").alias("observed"),
        F.coalesce(F.stddev_samp(residual), F.lit(0.0)).alias("deviation"),
        slope.alias("slope"),
        intercept.alias("intercept"),
    )
    left = F.lit(12) - F.col("last_month")
    # Sum of the line over t = n .. n + left - 1.
    ahead = left * F.col("intercept") + F.col("slope") * (left * F.col("n") + left * (left - 1) / 2)
    realistic = F.col("observed") + ahead
    return model.where("n > 0").select(
        *keys,
        "year",
        left.alias("months_projected"),
        "observed",
        (realistic - left * F.col("deviation")).alias("conservative"),
        realistic.alias("realistic"),
        (realistic + left * F.col("deviation")).alias("aggressive"),
    )
