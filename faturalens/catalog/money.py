"""Sources, selection, aggregates and rankings of the billing table."""

from __future__ import annotations

from pyspark.sql import functions as F

from faturalens.catalog.registry import Query, with_ctes
from faturalens.operators import aggregates as agg, selection as sel
from faturalens.plans import profile as prof
from faturalens.plans.driver_tables import FACTS_SQL, facts, order_years, table
from faturalens.sources import billing

Y, M, C, P, A = "year", "month", "client", "collaborator", "amount"

MONTHLY_SQL = """monthly AS (
  SELECT year, month, coalesce(sum(amount), 0) AS revenue FROM facts
  WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month)"""


def on_facts(body: str, *ctes: str) -> str:
    return with_ctes([FACTS_SQL, *ctes], body)


def doubled(df, *names):
    """Decimals as doubles, the form the comparison uses."""
    names = names or [f.name for f in df.schema.fields if f.dataType.simpleString().startswith("decimal")]
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# --- sources ------------------------------------------------------------------------------
def folder_scan(spark, d):
    lines = billing.read_folder(spark, d, pattern="lineitem.parquet")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("records"), F.sum("l_linenumber").cast("bigint").alias("numbers")
    )


def header_names(spark, d):
    raw = table(spark, d, "orders").select(
        F.year("o_orderdate").alias(" Ano "),
        F.month("o_orderdate").alias("MÊS"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("VlrFaturamento "),
        F.col("o_orderpriority").alias(" Categoria"),
    )
    named = billing.conform(billing.normalize_headers(raw))
    return doubled(
        named.groupBy("year", "category").agg(
            F.sum("amount").alias("revenue"), F.count("client").alias("with_client"), F.max("month").alias("last_month")
        )
    )


def union_tables(spark, d):
    orders = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")
    )
    lines = table(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("year"), F.col("l_returnflag").alias("flag")
    )
    both = billing.union_by_name(orders, lines)
    return both.groupBy("status", "flag").agg(
        F.count(F.lit(1)).alias("records"), F.max("year").cast("bigint").alias("highest")
    )


def file_rows(spark, d):
    files = ["orders.parquet", "lineitem.parquet", "customer.parquet"]
    # One read per file: the three tables have different columns.
    parts = [billing.file_report(spark, d, pattern=name) for name in files]
    return billing.union_by_name(*parts)


def first_clients(spark, d):
    """The first client of a year without rows and of one with rows."""
    parts = [
        agg.top_client(sel.select_facts(facts(spark, d), years=[year])).select(F.lit(str(year)).alias("chosen"), "client")
        for year in (1900, 1998)
    ]
    return billing.union_by_name(*parts)


# --- selection ------------------------------------------------------------------------------
def selection(spark, d):
    chosen = sel.select_facts(
        facts(spark, d), years=[1996, 1998, 2000], months=[1, 2, 3, 12], clients=table(spark, d, "customer").where(
            F.col("c_mktsegment") == "BUILDING"
        ).select(F.col("c_name").alias("client")),
    )
    return doubled(
        chosen.groupBy("year", "month").agg(
            F.count(F.lit(1)).alias("records"), F.sum("amount").alias("revenue"), F.min("client").alias("first_client")
        )
    )


def domain(column):
    return lambda spark, d: sel.domain(facts(spark, d, [column]), column)


def info(spark, d):
    row = sel.facts_info(facts(spark, d, [Y, M, A]))
    return doubled(
        row.select(
            F.concat_ws(",", F.transform("years", lambda v: v.cast("string"))).alias("years"),
            F.concat_ws(",", F.transform("months", lambda v: v.cast("string"))).alias("months"),
            "min_amount",
            "max_amount",
            "mean_amount",
        )
    )


# --- profile -----------------------------------------------------------------------------------
PROFILE_SQL = """profile AS (
  SELECT 'anos' AS section, format('{:04d}', year) AS key, CAST(year AS DOUBLE) AS value
    FROM facts WHERE year IS NOT NULL GROUP BY year
  UNION ALL SELECT 'meses', format('{:02d}', month), CAST(month AS DOUBLE) FROM facts WHERE month IS NOT NULL GROUP BY month
  UNION ALL SELECT 'registros' AS section, format('{:04d}-{:02d}', year, month) AS key, CAST(count(*) AS DOUBLE) AS value
    FROM facts WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month
  UNION ALL SELECT 'ativos', format('{:04d}-{:02d}', year, month), CAST(count(DISTINCT collaborator) AS DOUBLE)
    FROM facts WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month
  UNION ALL SELECT 'faturamento_mes', format('{:04d}-{:02d}', year, month), CAST(sum(amount) AS DOUBLE)
    FROM facts WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month
  UNION ALL SELECT 'faturamento_ano', format('{:04d}', year), CAST(sum(amount) AS DOUBLE)
    FROM facts WHERE year IS NOT NULL GROUP BY year
  UNION ALL SELECT 'clientes', client, CAST(sum(amount) AS DOUBLE) FROM facts WHERE client IS NOT NULL GROUP BY client
  UNION ALL SELECT 'colaboradores', collaborator, CAST(sum(amount) AS DOUBLE)
    FROM facts WHERE collaborator IS NOT NULL GROUP BY collaborator
  UNION ALL SELECT 'total', 'registros', CAST(count(*) AS DOUBLE) FROM facts
  UNION ALL SELECT 'total', 'minimo', CAST(min(amount) AS DOUBLE) FROM facts
  UNION ALL SELECT 'total', 'maximo', CAST(max(amount) AS DOUBLE) FROM facts
  UNION ALL SELECT 'total', 'soma', CAST(sum(amount) AS DOUBLE) FROM facts
  UNION ALL SELECT 'total', 'media', CAST(sum(amount) AS DOUBLE) / count(amount) FROM facts
  UNION ALL SELECT 'total', 'mediana', (max(CAST(amount AS DOUBLE)) + min(CAST(amount AS DOUBLE))) / 2 FROM (
    SELECT amount, row_number() OVER (ORDER BY amount) AS rn, count(*) OVER () AS n FROM facts WHERE amount IS NOT NULL)
    WHERE rn IN ((n + 1) // 2, n // 2 + 1)
  UNION ALL SELECT * FROM (SELECT 'top_clientes', client, CAST(sum(amount) AS DOUBLE) FROM facts
    WHERE client IS NOT NULL GROUP BY client ORDER BY sum(amount) DESC, client LIMIT 15)
  UNION ALL SELECT * FROM (SELECT 'top_colaboradores', collaborator, CAST(sum(amount) AS DOUBLE) FROM facts
    WHERE collaborator IS NOT NULL GROUP BY collaborator ORDER BY sum(amount) DESC, collaborator LIMIT 15)
  UNION ALL SELECT * FROM (SELECT 'top_registros', collaborator, CAST(count(*) AS DOUBLE) FROM facts
    WHERE collaborator IS NOT NULL GROUP BY collaborator ORDER BY count(*) DESC, collaborator LIMIT 15)
  UNION ALL SELECT 'identificados', 'clientes', CAST(count(DISTINCT client) AS DOUBLE) FROM facts
  UNION ALL SELECT 'identificados', 'colaboradores', CAST(count(DISTINCT collaborator) AS DOUBLE) FROM facts)"""


def profile(spark, d):
    return prof.data_profile(facts(spark, d), facts(spark, d, [A]))


def profile_lines(spark, d):
    return prof.profile_lines(profile(spark, d)).select("part", "line")


TITLES_SQL = "titles(part, section, heading) AS (VALUES " + ", ".join(
    f"({i}, '{s}', '{h}')" for i, (s, h) in enumerate(prof.HEADINGS)
) + ")"
MONEY_TEXT = "format('{{:,.2f}}', CAST(round(CAST({0} AS DECIMAL(38,4)), 2) AS DOUBLE))"


def sql_top(key, expression, alias):
    return f"""SELECT {key}, {expression} AS {alias} FROM facts WHERE {key} IS NOT NULL
      GROUP BY {key} ORDER BY {alias} DESC, {key} LIMIT 15"""


SUM = "CAST(coalesce(sum(amount), 0) AS DOUBLE)"

QUERIES = {
    "folder_scan": Query(
        folder_scan,
        """SELECT l_returnflag, l_linestatus, count(*) AS records, CAST(sum(l_linenumber) AS BIGINT) AS numbers
           FROM lineitem GROUP BY ALL""",
    ),
    "header_names": Query(
        header_names,
        """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category,
             CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue, CAST(0 AS BIGINT) AS with_client,
             CAST(max(month(o_orderdate)) AS INTEGER) AS last_month
           FROM orders GROUP BY ALL""",
    ),
    "union_by_name": Query(
        union_tables,
        """SELECT status, flag, count(*) AS records, CAST(max(year) AS BIGINT) AS highest FROM (
             SELECT year(o_orderdate) AS year, o_orderstatus AS status, NULL AS flag FROM orders
             UNION ALL SELECT l_linenumber, NULL, l_returnflag FROM lineitem) GROUP BY status, flag""",
    ),
    "file_report": Query(
        file_rows,
        """SELECT 'orders.parquet' AS file_name, count(*) AS rows_read, count(*) > 0 AS readable, 'read' AS status FROM orders
           UNION ALL SELECT 'lineitem.parquet', count(*), count(*) > 0, 'read' FROM lineitem
           UNION ALL SELECT 'customer.parquet', count(*), count(*) > 0, 'read' FROM customer""",
    ),
    "selection_filter": Query(
        selection,
        on_facts(
            """SELECT year, month, count(*) AS records, CAST(sum(amount) AS DOUBLE) AS revenue, min(client) AS first_client
               FROM facts WHERE year IN (1996, 1998, 2000) AND month IN (1, 2, 3, 12)
                 AND client IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')
               GROUP BY year, month"""
        ),
    ),
    "client_drill_down": Query(
        lambda s, d: doubled(sel.drill_down(facts(s, d), "Customer#000000007")),
        on_facts(
            """SELECT year, month, client, collaborator, CAST(amount AS DOUBLE) AS amount FROM facts
               WHERE client = 'Customer#000000007'"""
        ),
    ),
    **{
        f"domain_{name}": Query(
            domain(column),
            on_facts(f"SELECT DISTINCT {column} FROM facts WHERE {column} IS NOT NULL ORDER BY {column}"),
        )
        for name, column in {"years": Y, "months": M, "clients": C, "collaborators": P}.items()
    },
    "facts_info": Query(
        info,
        on_facts(
            """SELECT (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (SELECT DISTINCT year FROM facts WHERE year IS NOT NULL)) AS years,
                 (SELECT string_agg(CAST(month AS VARCHAR), ',' ORDER BY month) FROM (SELECT DISTINCT month FROM facts WHERE month IS NOT NULL)) AS months,
                 CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount,
                 CAST(sum(amount) AS DOUBLE) / count(amount) AS mean_amount FROM facts"""
        ),
    ),
    "monthly_revenue": Query(
        lambda s, d: doubled(agg.monthly_revenue(facts(s, d, [Y, M, A]))),
        on_facts(f"SELECT year, month, {SUM} AS revenue FROM facts WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month"),
    ),
    "client_ranking": Query(
        lambda s, d: doubled(agg.ranking(facts(s, d, [C, A]))),
        on_facts(f"SELECT client, {SUM} AS revenue FROM facts WHERE client IS NOT NULL GROUP BY client ORDER BY revenue DESC, client"),
    ),
    "total_revenue": Query(
        lambda s, d: doubled(agg.total_revenue(facts(s, d, [A]))), on_facts(f"SELECT {SUM} AS total FROM facts")
    ),
    "mean_monthly_revenue": Query(
        lambda s, d: agg.mean_monthly_revenue(facts(s, d, [Y, M, A])),
        on_facts("SELECT CAST(sum(revenue) AS DOUBLE) / count(*) AS mean_month FROM monthly", MONTHLY_SQL),
    ),
    "top_client": Query(
        lambda s, d: agg.top_client(facts(s, d, [C, A])),
        on_facts(
            """SELECT client FROM (SELECT client, sum(amount) AS v FROM facts WHERE client IS NOT NULL
                 GROUP BY client ORDER BY v DESC, client LIMIT 1)"""
        ),
    ),
    "top_client_of_nothing": Query(
        first_clients,
        on_facts(
            """SELECT '1900' AS chosen, '-' AS client UNION ALL SELECT '1998', (SELECT client FROM (
                 SELECT client, sum(amount) AS v FROM facts WHERE year = 1998 AND client IS NOT NULL
                 GROUP BY client ORDER BY v DESC, client LIMIT 1))"""
        ),
    ),
    "panel_indicators": Query(
        lambda s, d: agg.indicators(facts(s, d, [Y, M, C, A])),
        on_facts(
            """SELECT (SELECT CAST(sum(amount) AS DOUBLE) FROM facts) AS total,
                 (SELECT CAST(sum(revenue) AS DOUBLE) / count(*) FROM monthly) AS mean_month,
                 (SELECT client FROM (SELECT client, sum(amount) AS v FROM facts WHERE client IS NOT NULL
                    GROUP BY client ORDER BY v DESC, client LIMIT 1)) AS top_client""",
            MONTHLY_SQL,
        ),
    ),
    "amount_profile": Query(
        lambda s, d: doubled(agg.amount_profile(facts(s, d, [A]))),
        on_facts(
            """SELECT CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount,
                 CAST(sum(amount) AS DOUBLE) AS total, CAST(sum(amount) AS DOUBLE) / count(amount) AS mean_amount,
                 (SELECT (max(CAST(amount AS DOUBLE)) + min(CAST(amount AS DOUBLE))) / 2 FROM (
                    SELECT amount, row_number() OVER (ORDER BY amount) AS rn, count(*) OVER () AS n FROM facts)
                  WHERE rn IN ((n + 1) // 2, n // 2 + 1)) AS median_amount
               FROM facts"""
        ),
    ),
    "yearly_revenue": Query(
        lambda s, d: doubled(agg.yearly_revenue(facts(s, d, [Y, A]))),
        on_facts(f"SELECT year, {SUM} AS revenue FROM facts WHERE year IS NOT NULL GROUP BY year ORDER BY year"),
    ),
    "month_year_pivot": Query(
        lambda s, d: doubled(agg.month_year_pivot(facts(s, d, [Y, M, A]), order_years(s, d))),
        on_facts(
            "SELECT month, "
            + ", ".join(f"CAST(sum(revenue) FILTER (WHERE year = {y}) AS DOUBLE) AS y{y}" for y in range(1995, 2002))
            + " FROM monthly GROUP BY month ORDER BY month",
            MONTHLY_SQL,
        ),
    ),
    "monthly_records": Query(
        lambda s, d: agg.records_by(facts(s, d, [Y, M]), Y, M),
        on_facts("SELECT year, month, count(*) AS records FROM facts WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month"),
    ),
    "monthly_active_collaborators": Query(
        lambda s, d: agg.active_collaborators(facts(s, d, [Y, M, P])),
        on_facts(
            """SELECT year, month, count(DISTINCT collaborator) AS collaborators FROM facts
               WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month"""
        ),
    ),
    "distinct_counts": Query(
        lambda s, d: agg.distinct_counts(facts(s, d, [C, P])),
        on_facts("SELECT count(DISTINCT client) AS clients, count(DISTINCT collaborator) AS collaborators FROM facts"),
    ),
    "record_count": Query(
        lambda s, d: agg.record_count(facts(s, d, [A])), on_facts("SELECT count(*) AS records FROM facts")
    ),
    "top_clients": Query(
        lambda s, d: doubled(agg.top(facts(s, d, [C, A]), C)), on_facts(sql_top(C, SUM, "revenue"))
    ),
    "top_collaborators": Query(
        lambda s, d: doubled(agg.top(facts(s, d, [P, A]), P)), on_facts(sql_top(P, SUM, "revenue"))
    ),
    "top_collaborators_by_records": Query(
        lambda s, d: agg.top(facts(s, d, [P]), P, "records"), on_facts(sql_top(P, "count(*)", "records"))
    ),
    "data_profile": Query(
        profile, on_facts("SELECT section, key, value FROM profile", PROFILE_SQL)
    ),
    "data_profile_lines": Query(
        profile_lines,
        on_facts(
            f"""SELECT part, '- ' || CASE
                  WHEN section IN ('clientes', 'colaboradores') THEN key
                  WHEN section IN ('registros', 'ativos', 'top_registros') OR (section = 'total' AND key = 'registros')
                    THEN key || ' ' || format('{{:,.0f}}', value)
                  ELSE key || ' R$ ' || {MONEY_TEXT.format('value')} END AS line
                FROM profile JOIN titles USING (section)
                UNION ALL
                SELECT 0, '- Anos: [' || string_agg(CAST(CAST(value AS INTEGER) AS VARCHAR), ', ' ORDER BY value) || ']' FROM profile WHERE section = 'anos'
                UNION ALL
                SELECT 0, '- Meses: [' || string_agg(CAST(CAST(value AS INTEGER) AS VARCHAR), ', ' ORDER BY value) || ']' FROM profile WHERE section = 'meses'
                UNION ALL
                SELECT part, heading || coalesce(' (' || n || ' identificados)', '') FROM titles
                LEFT JOIN (SELECT key AS section, format('{{:,.0f}}', value) AS n FROM profile WHERE section = 'identificados') USING (section)""",
            PROFILE_SQL,
            TITLES_SQL,
        ),
    ),
    "prompt_per_client": Query(
        lambda s, d: prof.prompt_by_key(F.lit("Analise apenas:\n{dados}\nFim {x}"), "{dados}", facts(s, d, [Y, M, C, A]), C),
        on_facts(
            f"""SELECT client, 'Analise apenas:' || chr(10) || string_agg(format('{{:04d}}-{{:02d}}', year, month) || ' R$ ' ||
                  {MONEY_TEXT.format('revenue')}, chr(10) ORDER BY year, month) || chr(10) || 'Fim {{x}}' AS prompt
                FROM (SELECT client, year, month, sum(amount) AS revenue FROM facts
                      WHERE client IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL GROUP BY client, year, month)
                GROUP BY client"""
        ),
    ),
    "money_text": Query(
        lambda s, d: facts(s, d, [A]).select(
            F.col("amount").cast("double").alias("amount"),
            prof.money(F.col("amount")).alias("two_decimals"),
            prof.money(F.col("amount"), 0).alias("no_decimals"),
        ),
        on_facts(
            """SELECT CAST(amount AS DOUBLE) AS amount,
                 format('{:,.2f}', CAST(round(amount, 2) AS DOUBLE)) AS two_decimals,
                 format('{:,.0f}', CAST(round(amount, 0) AS DOUBLE)) AS no_decimals FROM facts"""
        ),
    ),
}
