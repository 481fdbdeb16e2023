"""Comparisons, concentration, load and stability derived from the billing table.

The reports ask for these figures in words; where the wording leaves a definition open the
docstring states the one used here. Months, years and their combinations are bounded by the
calendar, so windows over monthly rows stay small. Rankings over names never sort a whole
group in one task: row numbers are always cut to the first few, and running sums use
`plans.running`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faturalens.functions import fixed
from faturalens.operators.aggregates import known, monthly_revenue, revenue_sum, share
from faturalens.plans.running import running_totals


def change(value: Column, before: Column) -> Column:
    """Percent change, null without a previous value or when it is zero."""
    return F.lit(100.0) * (value.cast("double") / F.nullif(before.cast("double"), F.lit(0.0)) - F.lit(1.0))


def year_on_year(facts: DataFrame) -> DataFrame:
    """Each month against the same month of the year before."""
    return with_previous_year(monthly_revenue(facts)).select(
        "year", "month", "revenue", "previous", change(F.col("revenue"), F.col("previous")).alias("yoy_pct")
    )


def with_previous_year(monthly: DataFrame, value: str = "revenue") -> DataFrame:
    months = Window.partitionBy("month").orderBy("year")
    one_before = F.lag("year").over(months) == F.col("year") - 1
    return monthly.withColumn("previous", F.when(one_before, F.lag(value).over(months)))


def annual_change(facts: DataFrame) -> DataFrame:
    """Year totals against the year before, whole and over the months both years have."""
    years = Window.orderBy("year")
    shared = F.col("previous").isNotNull()
    yearly = (
        with_previous_year(monthly_revenue(facts))
        .groupBy("year")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum(F.when(shared, F.col("revenue"))).alias("shared_revenue"),
            F.sum("previous").alias("shared_previous"),
            F.count("previous").alias("shared_months"),
        )
    )
    follows = F.lag("year").over(years) == F.col("year") - 1
    return yearly.withColumn("_before", F.when(follows, F.lag("revenue").over(years))).select(
        "year",
        "revenue",
        change(F.col("revenue"), F.col("_before")).alias("total_pct"),
        "shared_months",
        change(F.col("shared_revenue"), F.col("shared_previous")).alias("shared_pct"),
    )


def month_on_month(facts: DataFrame) -> DataFrame:
    """Each month against the one before it in the same year."""
    inside = Window.partitionBy("year").orderBy("month")
    follows = F.lag("month").over(inside) == F.col("month") - 1
    return (
        monthly_revenue(facts)
        .withColumn("previous", F.when(follows, F.lag("revenue").over(inside)))
        .withColumn("mom_pct", change(F.col("revenue"), F.col("previous")))
    )


def _monthly_both(facts: DataFrame) -> DataFrame:
    return (
        known(facts, "year", "month")
        .groupBy("year", "month")
        .agg(revenue_sum().alias("revenue"), F.count(F.lit(1)).alias("records"))
    )


def extreme_months(facts: DataFrame) -> DataFrame:
    """Best and worst month by revenue and by records, per year and overall (year null).

    The earliest month wins among equals.
    """
    monthly = _monthly_both(facts)
    scopes = monthly.select("*", F.explode(F.array(F.col("year"), F.lit(None).cast("int"))).alias("scope"))
    early = F.struct(-F.col("year"), -F.col("month"))
    late = F.struct("year", "month")
    when = F.col("year") * 100 + F.col("month")
    return scopes.groupBy("scope").agg(
        F.max_by(when, F.struct("revenue", early)).alias("best_revenue_month"),
        F.min_by(when, F.struct("revenue", late)).alias("worst_revenue_month"),
        F.max_by(when, F.struct("records", early)).alias("best_records_month"),
        F.min_by(when, F.struct("records", late)).alias("worst_records_month"),
    )


def seasonality(facts: DataFrame) -> DataFrame:
    """Mean revenue of the calendar month over the mean of all months."""
    whole = Window.partitionBy()
    by_month = (
        monthly_revenue(facts)
        .groupBy("month")
        .agg(F.sum("revenue").cast("double").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    )
    overall = F.sum("_sum").over(whole) / F.sum("_n").over(whole)
    mean = F.col("_sum") / F.col("_n")
    return by_month.select(
        "month", mean.alias("mean_revenue"), (mean / F.nullif(overall, F.lit(0.0))).alias("season_index")
    )


def _head_sums(ranked: DataFrame, keys: list[str]) -> DataFrame:
    heads = [F.sum(F.when(F.col("_rank") <= n, F.col("revenue"))).alias(f"_top{n}") for n in (1, 3, 5)]
    return ranked.groupBy(*keys).agg(*heads)


def concentration(facts: DataFrame) -> DataFrame:
    """Percent of all revenue that the first 1, 3 and 5 clients bring."""
    by_client = facts.groupBy("client").agg(revenue_sum().alias("revenue"))
    first = by_client.orderBy(F.col("client").isNull(), F.desc("revenue"), "client").limit(5)
    first = first.where("client is not null")
    ranked = first.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("revenue"), "client")))
    # All rows count in the total, those without a client too.
    total = by_client.agg(F.sum("revenue")).scalar()
    return (
        _head_sums(ranked, [])
        .withColumn("total", total)
        .select(
            F.col("total").cast("double").alias("total"),
            *[share(F.col(f"_top{n}"), F.col("total")).alias(f"top{n}_pct") for n in (1, 3, 5)],
        )
    )


def concentration_by_year(facts: DataFrame) -> DataFrame:
    """The same per year, with the change of the first share in points."""
    grouped = known(facts, "year").groupBy("year", "client").agg(revenue_sum().alias("revenue"))
    inside = Window.partitionBy("year").orderBy(F.col("client").isNull(), F.desc("revenue"), "client")
    # Rank filter first: each task keeps five rows per year before anything moves.
    ranked = grouped.withColumn("_rank", F.row_number().over(inside)).where("_rank <= 5")
    ranked = ranked.where("client is not null")
    totals = grouped.groupBy("year").agg(F.sum("revenue").alias("total"))
    joined = totals.join(_head_sums(ranked, ["year"]), "year", "left")
    shares = joined.select(
        "year", *[share(F.col(f"_top{n}"), F.col("total")).alias(f"top{n}_pct") for n in (1, 3, 5)]
    )
    before = F.lag("top1_pct").over(Window.orderBy("year"))
    return shares.withColumn("top1_change", F.col("top1_pct") - before)


def amplitude(facts: DataFrame) -> DataFrame:
    """Distance from the best to the worst month in percent of the best."""
    return monthly_revenue(facts).agg(
        F.max("revenue").alias("best"),
        F.min("revenue").alias("worst"),
        share(F.max("revenue") - F.min("revenue"), F.max("revenue")).alias("amplitude_pct"),
    )


def risk_level(facts: DataFrame) -> DataFrame:
    """Risk label out of the first client's share and the monthly amplitude."""
    grouped = facts.groupBy("year", "month", "client").agg(revenue_sum().alias("revenue"))
    dated = F.col("year").isNotNull() & F.col("month").isNotNull()
    monthly = grouped.groupBy("year", "month").agg(F.sum("revenue").alias("revenue"))
    spread = monthly.agg(
        F.sum("revenue").alias("total"),
        F.max(F.when(dated, F.col("revenue"))).alias("best"),
        F.min(F.when(dated, F.col("revenue"))).alias("worst"),
    )
    by_client = grouped.groupBy("client").agg(F.sum("revenue").alias("revenue"))
    largest = by_client.agg(F.max(F.when(F.col("client").isNotNull(), F.col("revenue"))))
    figures = spread.withColumn("first", largest.scalar()).select(
        share(F.col("first"), F.col("total")).alias("top1_pct"),
        share(F.col("best") - F.col("worst"), F.col("best")).alias("amplitude_pct"),
    )

    def above(limits):
        return (F.col("top1_pct") > limits[0]) | (F.col("amplitude_pct") > limits[1])

    high, moderate, low = fixed.RISK_ORDER
    label = F.when(above(fixed.RISK_HIGH), high).when(above(fixed.RISK_MODERATE), moderate).otherwise(low)
    return figures.withColumn("risk", label)


def confidence(facts: DataFrame) -> DataFrame:
    """How far year-on-year figures cover the latest year.

    High when every month of the latest year has one, moderate when some month of any year
    has one, low otherwise.
    """
    rows = year_on_year(facts)
    latest = F.max("year").over(Window.partitionBy())
    has = F.col("yoy_pct").isNotNull()
    seen = rows.withColumn("_latest", F.col("year") == latest).agg(
        F.count_distinct("year").alias("years"),
        F.count(F.when(F.col("_latest"), 1)).alias("latest_months"),
        F.count(F.when(F.col("_latest") & has, 1)).alias("latest_with_yoy"),
        F.count(F.when(has, 1)).alias("with_yoy"),
    )
    high, moderate, low = fixed.CONFIDENCE_ORDER
    full = (F.col("years") >= 2) & (F.col("latest_with_yoy") == F.col("latest_months"))
    return seen.withColumn(
        "confidence", F.when(full, high).when(F.col("with_yoy") > 0, moderate).otherwise(low)
    )


def _per_collaborator(facts: DataFrame) -> DataFrame:
    """Revenue and records per collaborator, the rows without one included.

    `named` is zero for those. Filtering on it, and not on the key, leaves the grouped rows
    the same for the list and for its total, so both use one shuffle.
    """
    return facts.groupBy("collaborator").agg(
        revenue_sum().alias("revenue"), F.count(F.lit(1)).alias("records"), F.count("collaborator").alias("named")
    )


def _collaborator_totals(per_name: DataFrame) -> Column:
    named = F.col("named") > 0
    return per_name.agg(
        F.struct(
            F.count("collaborator").alias("people"),
            F.sum("revenue").alias("revenue"),
            F.sum(F.when(named, F.col("revenue"))).cast("double").alias("named_revenue"),
            F.sum(F.when(named, F.col("records"))).alias("named_records"),
        )
    ).scalar()


def mean_per_collaborator(facts: DataFrame) -> DataFrame:
    """All revenue over the number of distinct collaborators."""
    people = F.count("collaborator")
    return _per_collaborator(facts).agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("total"),
        people.alias("collaborators"),
        (F.sum("revenue").cast("double") / F.nullif(people, F.lit(0))).alias("mean_revenue"),
    )


def collaborator_load(facts: DataFrame) -> DataFrame:
    """Records and revenue of each collaborator against the mean, with a load flag."""
    per_name = _per_collaborator(facts)
    people = F.col("_all.people")
    flag = (
        F.when(F.col("records_ratio") > fixed.LOAD_OVER, "over")
        .when(F.col("records_ratio") < fixed.LOAD_UNDER, "under")
        .otherwise("normal")
    )
    mean_records = F.nullif(F.col("_all.named_records") / people, F.lit(0.0))
    mean_revenue = F.nullif(F.col("_all.named_revenue") / people, F.lit(0.0))
    return (
        per_name.withColumn("_all", _collaborator_totals(per_name))
        .where("named > 0")
        .select(
            "collaborator",
            "records",
            "revenue",
            (F.col("records") / mean_records).alias("records_ratio"),
            (F.col("revenue").cast("double") / mean_revenue).alias("revenue_ratio"),
        )
        .withColumn("load", flag)
    )


def exit_impact(facts: DataFrame) -> DataFrame:
    """Percent of all revenue that leaves with each collaborator."""
    per_name = _per_collaborator(facts)
    impact = share(F.col("revenue"), F.col("_all.revenue")).alias("impact_pct")
    return (
        per_name.withColumn("_all", _collaborator_totals(per_name))
        .where("named > 0")
        .select("collaborator", "records", "revenue", impact)
    )


def _revenue_steps(facts: DataFrame) -> DataFrame:
    """Distinct revenues of collaborators with running head-count and running revenue."""
    per_name = known(facts, "collaborator").groupBy("collaborator").agg(revenue_sum().alias("revenue"))
    steps = per_name.groupBy("revenue").agg(F.count(F.lit(1)).alias("people"))
    steps = steps.withColumn("part", (F.col("revenue") * F.col("people")).cast("decimal(38,4)"))
    return running_totals(steps, "revenue", ["people", "part"], descending=True)


def cumulative_share(facts: DataFrame) -> DataFrame:
    """Percent of revenue held by the collaborators earning at least as much as each one.

    Equal revenues share one value, so ties need no order.
    """
    per_name = known(facts, "collaborator").groupBy("collaborator").agg(revenue_sum().alias("revenue"))
    total = per_name.agg(F.sum("revenue")).scalar()
    steps = _revenue_steps(facts).select("revenue", "cum_people", "cum_part")
    return per_name.join(steps, "revenue").select(
        "collaborator",
        "revenue",
        F.col("cum_people").alias("position"),
        share(F.col("cum_part"), total).alias("cumulative_pct"),
    )


def people_for_share(facts: DataFrame, target: float = fixed.COVERAGE_TARGET) -> DataFrame:
    """Fewest collaborators that together reach the target part of the revenue."""
    steps = _revenue_steps(facts)
    total = steps.agg(F.sum("part").alias("total")).scalar()
    goal = total * F.lit(str(target)).cast("decimal(4,3)")
    before = F.col("cum_part") - F.col("part")
    missing = goal - before
    # Whole people needed out of the equal earners at the crossing.
    whole = F.expr("missing div revenue")
    needed = F.col("cum_people") - F.col("people") + whole + F.when(F.col("missing") > whole * F.col("revenue"), 1).otherwise(0)
    crossing = (F.col("cum_part") >= goal) & (before < goal)
    return (
        steps.withColumn("missing", missing)
        .withColumn("needed", F.when(crossing, needed))
        .agg(F.sum("people").alias("collaborators"), F.max("needed").alias("people"))
    )


def peak_headcount(facts: DataFrame) -> DataFrame:
    """The best month by revenue and the collaborators active in it."""
    monthly = (
        known(facts, "year", "month")
        .groupBy("year", "month", "collaborator")
        .agg(revenue_sum().alias("revenue"))
        .groupBy("year", "month")
        .agg(F.sum("revenue").alias("revenue"), F.count("collaborator").alias("collaborators"))
    )
    return monthly.orderBy(F.desc("revenue"), "year", "month").limit(1)


def client_stability(facts: DataFrame) -> DataFrame:
    """Months active and relative deviation of the monthly revenue of each client."""
    monthly = (
        known(facts, "client", "year", "month").groupBy("client", "year", "month").agg(revenue_sum().alias("revenue"))
    )
    value = F.col("revenue").cast("double")
    mean = F.sum("revenue").cast("double") / F.count(F.lit(1))
    return monthly.groupBy("client").agg(
        F.count(F.lit(1)).alias("months_active"),
        mean.alias("mean_revenue"),
        (F.stddev_samp(value) / F.nullif(mean, F.lit(0.0))).alias("variation"),
    )


def trajectory(facts: DataFrame) -> DataFrame:
    """First and second difference of monthly revenue, in the order of the months."""
    order = Window.orderBy("year", "month")
    first = F.col("revenue") - F.lag("revenue").over(order)
    return (
        monthly_revenue(facts)
        .withColumn("step", first)
        .withColumn("acceleration", F.col("step") - F.lag("step").over(order))
    )


def volume_change(facts: DataFrame) -> DataFrame:
    """Records and active collaborators per year with their change."""
    yearly = (
        known(facts, "year")
        .groupBy("year", "collaborator")
        .agg(F.count(F.lit(1)).alias("records"))
        .groupBy("year")
        .agg(F.sum("records").alias("records"), F.count("collaborator").alias("collaborators"))
    )
    years = Window.orderBy("year")
    follows = F.lag("year").over(years) == F.col("year") - 1

    def moved(name):
        return change(F.col(name), F.when(follows, F.lag(name).over(years)))

    return yearly.select(
        "*", moved("records").alias("records_pct"), moved("collaborators").alias("collaborators_pct")
    )
