"""Prompt documents and the choice between report texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from faturalens.catalog.money import MONEY_TEXT, PROFILE_SQL, TITLES_SQL, on_facts, profile
from faturalens.catalog.registry import Query, with_ctes
from faturalens.catalog.text import contracts, headings_sql, on_payloads, q
from faturalens.functions import fixed
from faturalens.operators import payload as pl, prompts as pr
from faturalens.plans.driver_tables import reports, reports_sql

MANAGER = "Consolide as áreas.\n{insights}\n### Fim {x}"
AREA_FIELDS = ["response_id", "schema_version", "resumo_executivo", "texto_markdown", "contract_ok"]


def insights_prompts(spark, d):
    """Each run's prompt, and what is read back out of the document inside it."""
    chosen = pl.select_attempt(contracts(spark, d)).select("run_id", "area", *AREA_FIELDS)
    rows = pr.manager_prompts(pr.insights_documents(chosen), F.lit(MANAGER))
    document = F.regexp_extract("prompt", r"(?s)^Consolide as áreas\.\n(.*)\n### Fim \{x\}$", 1)
    kind = "struct<" + ",".join(f"{n}:{'boolean' if n == 'contract_ok' else 'string'}" for n in ["area", *AREA_FIELDS]) + ">"
    read = F.from_json(document, ",".join(f"{area} {kind}" for area in fixed.AREAS))
    rows = rows.select("run_id", F.inline(F.array(read)))
    return rows.select("run_id", *[F.col(f"{area}.{name}").alias(f"{area}_{name}") for area in fixed.AREAS for name in AREA_FIELDS])


def area_prompts(spark, d):
    templates = spark.createDataFrame([(area, f"Area {area}:\n{{dados}}\nFim") for area in fixed.AREAS], "area string, template string")
    return pr.area_prompts(templates, profile(spark, d))


def report_choice(spark, d):
    """A second text with the heading put right for some reports, none for others."""
    mended = F.replace("markdown", F.lit("## KPIs"), F.lit("## 📈 KPIs Prioritários"))
    retry = F.when(F.col("report_id") % 3 == 0, mended).when(F.col("report_id") % 3 == 1, F.col("markdown"))
    rows = reports(spark, d).select("report_id", F.col("markdown").alias("first"), retry.alias("retry"))
    asked = pr.retry_prompt(F.lit("P"), F.col("first"))
    return pr.choose_report(rows.withColumn("asked", asked)).select("report_id", "source", "markdown", "asked")


CHOICE_SQL = f"""texts AS (
  SELECT report_id, 1 AS place, markdown FROM given UNION ALL SELECT report_id, 2, CASE report_id % 3
    WHEN 0 THEN replace(markdown, '## KPIs', '## 📈 KPIs Prioritários') WHEN 1 THEN markdown END FROM given),
reports AS (SELECT report_id * 2 + place AS report_id, markdown FROM texts),
whole AS ({headings_sql()})"""

QUERIES = {
    "insights_prompts": Query(
        insights_prompts,
        on_payloads(
            "SELECT run_id, "
            + ", ".join(f"max({name}) FILTER (area = '{area}') AS {area}_{name}" for area in fixed.AREAS for name in AREA_FIELDS)
            + " FROM chosen GROUP BY run_id"
        ),
    ),
    "area_prompts": Query(
        area_prompts,
        on_facts(
            f"""SELECT area, 'Area ' || area || ':' || chr(10) || text || chr(10) || 'Fim' AS prompt
                FROM (VALUES {", ".join(f"('{area}')" for area in fixed.AREAS)}) a(area), (
                SELECT string_agg(line, chr(10) ORDER BY part, rank NULLS FIRST, place) AS text FROM (
                SELECT part, CASE WHEN section LIKE 'top_%' THEN -value ELSE 0 END AS rank, key AS place, '- ' || CASE
                  WHEN section IN ('registros', 'ativos', 'top_registros') OR (section = 'total' AND key = 'registros')
                    THEN key || ' ' || format('{{:,.0f}}', value)
                  ELSE key || ' R$ ' || {MONEY_TEXT.format('value')} END AS line
                FROM profile JOIN titles USING (section) WHERE section NOT IN ('clientes', 'colaboradores')
                UNION ALL
                SELECT 0, 0, section, '- ' || CASE section WHEN 'anos' THEN 'Anos' ELSE 'Meses' END || ': [' ||
                  string_agg(CAST(CAST(value AS INTEGER) AS VARCHAR), ', ' ORDER BY value) || ']' FROM profile WHERE section IN ('anos', 'meses') GROUP BY section
                UNION ALL
                SELECT part, NULL, NULL, heading || coalesce(' (' || n || ' identificados)', '') FROM titles
                LEFT JOIN (SELECT key AS section, format('{{:,.0f}}', value) AS n FROM profile WHERE section = 'identificados') USING (section)))""",
            PROFILE_SQL,
            TITLES_SQL,
        ),
    ),
    "report_choice": Query(
        report_choice,
        with_ctes(
            [reports_sql().replace("reports AS", "given AS", 1), CHOICE_SQL],
            f"""SELECT report_id, source, CASE source WHEN 'notice' THEN {q(fixed.REPORT_MISSING)} WHEN 'first' THEN first WHEN 'retry' THEN second
                    ELSE {q(fixed.REPORT_BAD_FORMAT.strip())} || chr(10) || chr(10) || first END AS markdown,
                  CASE WHEN coalesce(first, '') <> '' AND NOT first_whole THEN 'P' || {" || chr(10) || ".join(q(line) for line in fixed.REPORT_RETRY.split(chr(10)))} || first END AS asked
                FROM (SELECT *, CASE WHEN coalesce(first, '') = '' THEN 'notice' WHEN first_whole THEN 'first' WHEN second_whole THEN 'retry' ELSE 'note' END AS source
                FROM (SELECT t.report_id, max(t.markdown) FILTER (place = 1) AS first, max(t.markdown) FILTER (place = 2) AS second,
                    bool_or(w.complete) FILTER (place = 1) AS first_whole, bool_or(w.complete) FILTER (place = 2) AS second_whole
                  FROM texts t JOIN whole w ON w.report_id = t.report_id * 2 + place GROUP BY t.report_id))""",
        ),
    ),
}
