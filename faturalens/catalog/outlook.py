"""Trend, forecast, comparisons, concentration, load and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from faturalens.catalog.money import MONTHLY_SQL, A, C, M, P, Y, doubled, on_facts
from faturalens.catalog.registry import Query
from faturalens.operators import insight, trend
from faturalens.plans.driver_tables import facts

SERIES_SQL = """series AS (
  SELECT year, month, CAST(revenue AS DOUBLE) AS revenue, row_number() OVER (ORDER BY year, month) - 1 AS t FROM monthly)"""
MODEL_SQL = """model AS (
  SELECT count(*) AS n, CASE WHEN count(*) > 1 THEN regr_slope(revenue, t) ELSE 0 END AS slope,
         CASE WHEN count(*) > 1 THEN regr_intercept(revenue, t) ELSE avg(revenue) END AS intercept FROM series)"""
CLIENT_SERIES_SQL = """series AS (
  SELECT *, row_number() OVER (PARTITION BY client ORDER BY year, month) - 1 AS t FROM (
    SELECT client, year, month, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue FROM facts
    WHERE client IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL GROUP BY client, year, month))"""
CLIENT_MODEL_SQL = """model AS (
  SELECT client, count(*) AS n, CASE WHEN count(*) > 1 THEN regr_slope(revenue, t) ELSE 0 END AS slope,
         CASE WHEN count(*) > 1 THEN regr_intercept(revenue, t) ELSE avg(revenue) END AS intercept FROM series GROUP BY client)"""


def rounded(df, digits, *names):
    return doubled(df).withColumns({n: F.round(n, digits) for n in names})


def series(spark, d, keys=()):
    columns = [Y, M, A, *keys]
    return trend.monthly_series(facts(spark, d, columns), list(keys))


def on_series(body):
    return on_facts(body, MONTHLY_SQL, SERIES_SQL, MODEL_SQL)


def on_client_series(body):
    return on_facts(body, CLIENT_SERIES_SQL, CLIENT_MODEL_SQL)


def flat(operator, columns, digits, *names):
    return lambda s, d: rounded(operator(facts(s, d, columns)), digits, *names)


YOY_SQL = """yoy AS (
  SELECT a.year, a.month, CAST(a.revenue AS DOUBLE) AS revenue, CAST(b.revenue AS DOUBLE) AS previous
  FROM monthly a LEFT JOIN monthly b ON b.year = a.year - 1 AND b.month = a.month)"""
PCT = "100.0 * ({0} / nullif({1}, 0) - 1.0)"
PER_NAME_SQL = """per_name AS (
  SELECT collaborator, count(*) AS records, sum(amount) AS revenue FROM facts
  WHERE collaborator IS NOT NULL GROUP BY collaborator)"""
PROJECTION_SQL = """
  SELECT {key}max(year) AS year, 12 - max(month) FILTER (WHERE current) AS months_projected,
    CAST(sum(CAST(revenue AS DECIMAL(28,4))) FILTER (WHERE current) AS DOUBLE) AS observed,
    round(sum(revenue) FILTER (WHERE current) + (12 - max(month) FILTER (WHERE current)) * max(intercept)
      + max(slope) * ((12 - max(month) FILTER (WHERE current)) * max(n)
        + (12 - max(month) FILTER (WHERE current)) * (11 - max(month) FILTER (WHERE current)) / 2), 2) AS realistic,
    coalesce(stddev_samp(revenue - (intercept + slope * t)), 0) AS deviation
  FROM (SELECT series.*, n, slope, intercept, year = max(year) OVER ({part}) AS current FROM series {join} model {using})
  {group}"""


def projection_sql(key=""):
    inner = PROJECTION_SQL.format(
        key=f"{key}, " if key else "",
        part=f"PARTITION BY {key}" if key else "",
        join="JOIN" if key else "CROSS JOIN",
        using=f"USING ({key})" if key else "",
        group=f"GROUP BY {key}" if key else "",
    )
    first = f"{key}, " if key else ""
    return f"""SELECT {first}year, CAST(months_projected AS INTEGER) AS months_projected, observed, realistic,
        round(deviation * months_projected, 1) AS margin FROM ({inner})"""


def projection(keys=()):
    def build(spark, d):
        out = trend.year_projection(series(spark, d, keys), list(keys))
        margin = F.round(F.col("aggressive") - F.col("realistic"), 1).alias("margin")
        return out.select(
            *keys,
            "year",
            "months_projected",
            "observed",
            F.round("realistic", 2).alias("realistic"),
            margin,
        )

    return build


def extremes_sql():
    return """SELECT scope,
        CAST(arg_max(code, (revenue, -code)) AS INTEGER) AS best_revenue_month,
        CAST(arg_min(code, (revenue, code)) AS INTEGER) AS worst_revenue_month,
        CAST(arg_max(code, (records, -code)) AS INTEGER) AS best_records_month,
        CAST(arg_min(code, (records, code)) AS INTEGER) AS worst_records_month
      FROM (SELECT year * 100 + month AS code, sum(amount) AS revenue, count(*) AS records,
                   unnest([year, NULL]) AS scope FROM facts
            WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month)
      GROUP BY scope"""


QUERIES = {
    "time_index": Query(
        lambda s, d: doubled(series(s, d)),
        on_series("SELECT year, month, revenue, CAST(t AS INTEGER) AS t FROM series"),
    ),
    "trend_line": Query(
        lambda s, d: rounded(trend.trend_model(series(s, d)), 2, "slope", "intercept"),
        on_series("SELECT n, round(slope, 2) AS slope, round(intercept, 2) AS intercept FROM model"),
    ),
    "trend_fitted": Query(
        lambda s, d: rounded(trend.fitted(series(s, d)), 2, "forecast"),
        on_series(
            """SELECT year, month, revenue, CAST(t AS INTEGER) AS t, round(intercept + slope * t, 2) AS forecast
               FROM series CROSS JOIN model"""
        ),
    ),
    "trend_forecast": Query(
        lambda s, d: trend.forecast(series(s, d)).withColumn("forecast", F.round("forecast", 2)),
        on_series(
            """SELECT CAST(n + k AS BIGINT) AS t, round(intercept + slope * (n + k), 2) AS forecast
               FROM model CROSS JOIN range(0, 6) r(k)"""
        ),
    ),
    "trend_line_per_client": Query(
        lambda s, d: rounded(trend.trend_model(series(s, d, (C,)), [C]), 2, "slope", "intercept"),
        on_client_series("SELECT client, n, round(slope, 2) AS slope, round(intercept, 2) AS intercept FROM model"),
    ),
    "trend_fitted_per_client": Query(
        lambda s, d: rounded(trend.fitted(series(s, d, (C,)), [C]), 2, "forecast"),
        on_client_series(
            """SELECT client, year, month, revenue, CAST(t AS INTEGER) AS t, round(intercept + slope * t, 2) AS forecast
               FROM series JOIN model USING (client)"""
        ),
    ),
    "trend_forecast_per_client": Query(
        lambda s, d: trend.forecast(series(s, d, (C,)), [C]).withColumn("forecast", F.round("forecast", 2)),
        on_client_series(
            """SELECT client, CAST(n + k AS BIGINT) AS t, round(intercept + slope * (n + k), 2) AS forecast
               FROM model CROSS JOIN range(0, 6) r(k)"""
        ),
    ),
    "year_on_year": Query(
        flat(insight.year_on_year, [Y, M, A], 6, "yoy_pct"),
        on_facts(
            f"SELECT *, round({PCT.format('revenue', 'previous')}, 6) AS yoy_pct FROM yoy", MONTHLY_SQL, YOY_SQL
        ),
    ),
    "annual_change": Query(
        flat(insight.annual_change, [Y, M, A], 6, "total_pct", "shared_pct"),
        on_facts(
            f"""SELECT a.year, a.revenue, round({PCT.format('a.revenue', 'b.revenue')}, 6) AS total_pct, a.shared_months,
                  round({PCT.format('a.shared', 'a.before')}, 6) AS shared_pct
                FROM yearly a LEFT JOIN yearly b ON b.year = a.year - 1""",
            MONTHLY_SQL,
            """yearly AS (SELECT a.year, CAST(sum(a.revenue) AS DOUBLE) AS revenue, count(b.revenue) AS shared_months,
                 CAST(sum(CASE WHEN b.year IS NOT NULL THEN a.revenue END) AS DOUBLE) AS shared,
                 CAST(sum(b.revenue) AS DOUBLE) AS before
               FROM monthly a LEFT JOIN monthly b ON b.year = a.year - 1 AND b.month = a.month GROUP BY a.year)""",
        ),
    ),
    "month_on_month": Query(
        flat(insight.month_on_month, [Y, M, A], 6, "mom_pct"),
        on_facts(
            f"""SELECT a.year, a.month, CAST(a.revenue AS DOUBLE) AS revenue, CAST(b.revenue AS DOUBLE) AS previous,
                  round({PCT.format('CAST(a.revenue AS DOUBLE)', 'CAST(b.revenue AS DOUBLE)')}, 6) AS mom_pct
                FROM monthly a LEFT JOIN monthly b ON b.year = a.year AND b.month = a.month - 1""",
            MONTHLY_SQL,
        ),
    ),
    "extreme_months": Query(flat(insight.extreme_months, [Y, M, A], 0), on_facts(extremes_sql())),
    "seasonality": Query(
        flat(insight.seasonality, [Y, M, A], 6, "mean_revenue", "season_index"),
        on_facts(
            """SELECT month, round(CAST(sum(revenue) AS DOUBLE) / count(*), 6) AS mean_revenue,
                 round(CAST(sum(revenue) AS DOUBLE) / count(*) /
                   (SELECT CAST(sum(revenue) AS DOUBLE) / count(*) FROM monthly), 6) AS season_index
               FROM monthly GROUP BY month""",
            MONTHLY_SQL,
        ),
    ),
    "concentration": Query(
        flat(insight.concentration, [C, A], 6, "top1_pct", "top3_pct", "top5_pct"),
        on_facts(
            """SELECT CAST(total AS DOUBLE) AS total,
                 round(100.0 * CAST(sum(v) FILTER (WHERE rn <= 1) AS DOUBLE) / CAST(total AS DOUBLE), 6) AS top1_pct,
                 round(100.0 * CAST(sum(v) FILTER (WHERE rn <= 3) AS DOUBLE) / CAST(total AS DOUBLE), 6) AS top3_pct,
                 round(100.0 * CAST(sum(v) FILTER (WHERE rn <= 5) AS DOUBLE) / CAST(total AS DOUBLE), 6) AS top5_pct
               FROM (SELECT client, sum(amount) AS v, row_number() OVER (ORDER BY sum(amount) DESC, client) AS rn
                     FROM facts WHERE client IS NOT NULL GROUP BY client)
               CROSS JOIN (SELECT sum(amount) AS total FROM facts) GROUP BY total"""
        ),
    ),
    "concentration_by_year": Query(
        flat(insight.concentration_by_year, [Y, C, A], 6, "top1_pct", "top3_pct", "top5_pct", "top1_change"),
        on_facts(
            """SELECT year, round(t1, 6) AS top1_pct, round(t3, 6) AS top3_pct, round(t5, 6) AS top5_pct,
                 round(t1 - lag(t1) OVER (ORDER BY year), 6) AS top1_change
               FROM (SELECT year,
                   100.0 * CAST(sum(v) FILTER (WHERE rn <= 1) AS DOUBLE) / CAST(total AS DOUBLE) AS t1,
                   100.0 * CAST(sum(v) FILTER (WHERE rn <= 3) AS DOUBLE) / CAST(total AS DOUBLE) AS t3,
                   100.0 * CAST(sum(v) FILTER (WHERE rn <= 5) AS DOUBLE) / CAST(total AS DOUBLE) AS t5
                 FROM (SELECT year, client, sum(amount) AS v,
                         row_number() OVER (PARTITION BY year ORDER BY sum(amount) DESC, client) AS rn
                       FROM facts WHERE client IS NOT NULL AND year IS NOT NULL GROUP BY year, client)
                 JOIN (SELECT year, sum(amount) AS total FROM facts GROUP BY year) USING (year) GROUP BY year, total)"""
        ),
    ),
    "amplitude": Query(
        flat(insight.amplitude, [Y, M, A], 6, "amplitude_pct"),
        on_facts(
            """SELECT CAST(max(revenue) AS DOUBLE) AS best, CAST(min(revenue) AS DOUBLE) AS worst,
                 round(100.0 * CAST(max(revenue) - min(revenue) AS DOUBLE) / CAST(max(revenue) AS DOUBLE), 6) AS amplitude_pct
               FROM monthly""",
            MONTHLY_SQL,
        ),
    ),
    "risk_level": Query(
        flat(insight.risk_level, [Y, M, C, A], 6, "top1_pct", "amplitude_pct"),
        on_facts(
            """SELECT round(top1, 6) AS top1_pct, round(amp, 6) AS amplitude_pct,
                 CASE WHEN top1 > 30 OR amp > 50 THEN 'Alto' WHEN top1 > 15 OR amp > 25 THEN 'Moderado' ELSE 'Baixo' END AS risk
               FROM (SELECT 100.0 * CAST((SELECT max(v) FROM (SELECT sum(amount) AS v FROM facts WHERE client IS NOT NULL GROUP BY client)) AS DOUBLE)
                        / (SELECT CAST(sum(amount) AS DOUBLE) FROM facts) AS top1,
                      (SELECT 100.0 * CAST(max(revenue) - min(revenue) AS DOUBLE) / CAST(max(revenue) AS DOUBLE) FROM monthly) AS amp)""",
            MONTHLY_SQL,
        ),
    ),
    "confidence": Query(
        flat(insight.confidence, [Y, M, A], 0),
        on_facts(
            """SELECT *, CASE WHEN years >= 2 AND latest_with_yoy = latest_months THEN 'alta'
                 WHEN with_yoy > 0 THEN 'moderada' ELSE 'baixa' END AS confidence
               FROM (SELECT count(DISTINCT year) AS years, count(*) FILTER (WHERE year = y) AS latest_months,
                   count(*) FILTER (WHERE year = y AND nullif(previous, 0) IS NOT NULL) AS latest_with_yoy,
                   count(nullif(previous, 0)) AS with_yoy
                 FROM yoy CROSS JOIN (SELECT max(year) AS y FROM yoy))""",
            MONTHLY_SQL,
            YOY_SQL,
        ),
    ),
    "mean_per_collaborator": Query(
        flat(insight.mean_per_collaborator, [P, A], 0),
        on_facts(
            """SELECT CAST(sum(amount) AS DOUBLE) AS total, count(DISTINCT collaborator) AS collaborators,
                 CAST(sum(amount) AS DOUBLE) / count(DISTINCT collaborator) AS mean_revenue FROM facts"""
        ),
    ),
    "collaborator_load": Query(
        flat(insight.collaborator_load, [P, A], 6, "records_ratio", "revenue_ratio"),
        on_facts(
            """SELECT collaborator, records, CAST(revenue AS DOUBLE) AS revenue, round(r, 6) AS records_ratio,
                 round(CAST(revenue AS DOUBLE) / (SELECT CAST(sum(revenue) AS DOUBLE) / count(*) FROM per_name), 6) AS revenue_ratio,
                 CASE WHEN r > 1.5 THEN 'over' WHEN r < 0.5 THEN 'under' ELSE 'normal' END AS load
               FROM (SELECT *, records / (SELECT CAST(sum(records) AS DOUBLE) / count(*) FROM per_name) AS r FROM per_name)""",
            PER_NAME_SQL,
        ),
    ),
    "collaborator_cumulative_share": Query(
        flat(insight.cumulative_share, [P, A], 6, "cumulative_pct"),
        on_facts(
            """SELECT collaborator, CAST(revenue AS DOUBLE) AS revenue,
                 count(*) OVER (ORDER BY revenue DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position,
                 round(100.0 * CAST(sum(revenue) OVER (ORDER BY revenue DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                   / (SELECT CAST(sum(revenue) AS DOUBLE) FROM per_name), 6) AS cumulative_pct
               FROM per_name""",
            PER_NAME_SQL,
        ),
    ),
    "collaborators_for_80_percent": Query(
        flat(insight.people_for_share, [P, A], 0),
        on_facts(
            """SELECT (SELECT count(*) FROM per_name) AS collaborators, min(rn) AS people FROM (
                 SELECT row_number() OVER w AS rn, sum(CAST(revenue AS DECIMAL(28,4))) OVER w AS cum
                 FROM per_name WINDOW w AS (ORDER BY revenue DESC, collaborator ROWS UNBOUNDED PRECEDING))
               WHERE cum * 10 >= (SELECT sum(CAST(revenue AS DECIMAL(28,4))) * 8 FROM per_name)""",
            PER_NAME_SQL,
        ),
    ),
    "collaborator_exit_impact": Query(
        flat(insight.exit_impact, [P, A], 6, "impact_pct"),
        on_facts(
            """SELECT collaborator, records, CAST(revenue AS DOUBLE) AS revenue,
                 round(100.0 * CAST(revenue AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM facts), 6) AS impact_pct
               FROM per_name""",
            PER_NAME_SQL,
        ),
    ),
    "peak_month_headcount": Query(
        flat(insight.peak_headcount, [Y, M, P, A], 0),
        on_facts(
            """SELECT year, month, CAST(sum(amount) AS DOUBLE) AS revenue, count(DISTINCT collaborator) AS collaborators
               FROM facts WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month
               ORDER BY revenue DESC, year, month LIMIT 1"""
        ),
    ),
    "client_stability": Query(
        flat(insight.client_stability, [Y, M, C, A], 4, "variation"),
        on_client_series(
            """SELECT client, count(*) AS months_active,
                 CAST(sum(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS mean_revenue,
                 round(stddev_samp(revenue) / (CAST(sum(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE) / count(*)), 4) AS variation
               FROM series GROUP BY client"""
        ),
    ),
    "trajectory": Query(
        flat(insight.trajectory, [Y, M, A], 0),
        on_facts(
            """SELECT year, month, CAST(revenue AS DOUBLE) AS revenue, CAST(step AS DOUBLE) AS step,
                 CAST(step - lag(step) OVER (ORDER BY year, month) AS DOUBLE) AS acceleration
               FROM (SELECT *, revenue - lag(revenue) OVER (ORDER BY year, month) AS step FROM monthly)""",
            MONTHLY_SQL,
        ),
    ),
    "yearly_volume_change": Query(
        flat(insight.volume_change, [Y, P], 6, "records_pct", "collaborators_pct"),
        on_facts(
            f"""SELECT a.year, a.records, a.collaborators,
                  round({PCT.format('CAST(a.records AS DOUBLE)', 'b.records')}, 6) AS records_pct,
                  round({PCT.format('CAST(a.collaborators AS DOUBLE)', 'b.collaborators')}, 6) AS collaborators_pct
                FROM volume a LEFT JOIN volume b ON b.year = a.year - 1""",
            """volume AS (SELECT year, count(*) AS records, count(DISTINCT collaborator) AS collaborators
                 FROM facts WHERE year IS NOT NULL GROUP BY year)""",
        ),
    ),
    "year_projection": Query(projection(), on_series(projection_sql())),
    "year_projection_per_client": Query(projection((C,)), on_client_series(projection_sql(C))),
}
