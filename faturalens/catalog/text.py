"""Checks of report texts, payloads and report shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from faturalens.catalog.money import A, C, M, PROFILE_SQL, Y, facts
from faturalens.catalog.registry import Query, with_ctes
from faturalens.functions import fixed, text as tx
from faturalens.operators import cited, payload as pl, selection as sel, validation as val
from faturalens.plans import profile as prof
from faturalens.plans.driver_tables import (
    FACTS_SQL,
    YEAR_PATTERN,
    reports,
    reports_sql,
    responses,
    responses_sql,
    table,
)
from faturalens.sources import reports as rep


# --- Spark side -------------------------------------------------------------------------
def joined(column, separator="|"):
    return F.concat_ws(separator, column)


def checked(spark, d):
    """Row-by-row checks with the log figures in place of the text."""
    years = sel.known_years(facts(spark, d, [Y])).scalar()
    rows = val.text_checks(responses(spark, d), years, YEAR_PATTERN)
    return (
        rows.withColumn("text_length", F.length("text"))
        .withColumn("text_head", F.left("text", F.lit(fixed.LOG_HEAD_LENGTH)))
        .select("response_id", "area", "stamp", "text_length", "text_head", "errors", "phrases", "names")
    )


def verdicts(spark, d):
    return val.verdicts(checked(spark, d), facts(spark, d, [C]))


def contracts(spark, d):
    return pl.with_contract(pl.normalize_payload(pl.extract_payload(responses(spark, d))))


def year_mentions(spark, d):
    rows = val.answers(responses(spark, d))
    return rows.select("response_id", F.explode(val.year_mentions(F.col("text"), YEAR_PATTERN)).alias("year"))


def unknown_years(spark, d):
    years = sel.domain(facts(spark, d, [Y]), Y)
    return val.unknown_years(responses(spark, d), years, YEAR_PATTERN)


def unknown_entities(spark, d):
    return val.unknown_entities(responses(spark, d), facts(spark, d, [C]))


def verdict_rows(spark, d):
    return verdicts(spark, d).select(
        "response_id", "area", "valid", joined(F.array_sort("errors")).alias("errors"), joined("all_warnings").alias("warnings")
    )


def false_positives(spark, d):
    return verdicts(spark, d).where(F.size("all_warnings") > 0).select(
        "response_id", F.size("all_warnings").alias("before"), F.size("warnings").alias("after"), joined("warnings").alias("kept")
    )


def feedback(spark, d):
    base = facts(spark, d, [Y, M, A])
    info = sel.facts_info(base).select(F.struct("*")).scalar()
    # The order of errors is free; sorted here to compare.
    rows = verdicts(spark, d).withColumn("errors", F.array_sort("errors"))
    return val.feedback(rows, info).select("response_id", "feedback")


def extracted(spark, d):
    return val.answers(pl.extract_payload(responses(spark, d))).select("response_id", "json_text", "json_error")


CHECKS = fixed.CHECK_FIELDS


def normalized(spark, d):
    return contracts(spark, d).select(
        "response_id",
        "schema_version",
        "area",
        "resumo_executivo",
        "texto_markdown",
        *[F.size(name).alias(f"n_{name}") for name in pl.LIST_FIELDS],
        F.col(f"checagem.{CHECKS[0]}").alias("check_years"),
        F.col(f"checagem.{CHECKS[1]}").alias("check_numbers"),
        "erro_llm",
    )


def contract_rows(spark, d):
    # Contract and text checks share one reading of the texts. The verdict depends on the row's
    # own errors alone, so that nothing but the years is shuffled.
    years = sel.known_years(facts(spark, d, [Y])).scalar()
    rows = val.text_checks(contracts(spark, d), years, YEAR_PATTERN, answers_only=False)
    return pl.valid_by_content(rows.withColumn("valid", val.is_valid(F.col("errors")))).select(
        "response_id", "content_empty", "contract_ok", "erro_conteudo", "valid_by_content"
    )


def attempts(spark, d):
    flags = contracts(spark, d).select("response_id", "run_id", "area", "attempt", "contract_ok", "erro_llm")
    return pl.select_attempt(flags)


def model_errors(spark, d):
    return responses(spark, d).select(
        "response_id", val.model_error(F.col("text")).alias("erro_llm"), F.coalesce("text", F.lit("")).alias("body")
    ).where("erro_llm is not null")


def sections(spark, d):
    return val.report_sections(reports(spark, d)).select("report_id", "complete", joined("missing").alias("missing"))


def documents(spark, d):
    years = sel.known_years(facts(spark, d, [Y])).scalar()
    rows = val.text_checks(contracts(spark, d), years, YEAR_PATTERN, answers_only=False)
    whole = pl.area_payloads(rows, facts(spark, d, [C]))
    docs = rep.payload_documents(whole, F.lit("2024-01-01T00:00:00"))
    payload = F.col("payload")
    return docs.select(
        "document_version",
        "generated_at",
        "area",
        "payload.response_id",
        "payload.schema_version",
        F.col("payload.resumo_executivo").alias("summary"),
        F.size("payload.kpis").alias("n_kpis"),
        *[joined(payload["kpis"][name], ",").alias(f"kpi_{name}") for name in pl.KPI_FIELDS if name != "valor"],
        *[joined(payload["insights"][name], ",").alias(f"insight_{name}") for name in pl.INSIGHT_FIELDS],
        joined(F.flatten(F.array_compact("payload.insights.evidencias")), ",").alias("evidence"),
        joined("payload.pontos_de_atencao", ",").alias("points"),
        F.col(f"payload.checagem.{CHECKS[0]}").alias("check_years"),
        F.col(f"payload.checagem.{CHECKS[1]}").alias("check_numbers"),
        joined("payload.avisos_validador").alias("warnings"),
        joined(F.array_sort("payload.alucinacoes_validador")).alias("errors"),
        "payload.erro_json",
        "payload.erro_conteudo",
        "payload.erro_llm",
        "payload.valido_por_conteudo",
        F.col("payload.texto_markdown").alias("body"),
    )


def previews(spark, d):
    source = tx.first_filled(F.col("resumo_executivo"), F.col("texto_markdown"))
    return (
        contracts(spark, d)
        .where(F.col("area").isin(fixed.AREAS))
        .select("response_id", "area", source.alias("source"))
        .where(~tx.is_blank(F.col("source")))
        .select("response_id", "area", tx.sanitize(tx.preview(F.col("source"))).alias("preview"))
        .where(~tx.is_blank(F.col("preview")))
    )


def report_lines(spark, d):
    lines = F.posexplode(F.split(tx.trim_report(F.col("markdown")), "\n")).alias("position", "line")
    shown = reports(spark, d).select("report_id", lines).select("report_id", "position", tx.sanitize(F.col("line")).alias("line"))
    return shown.where(~tx.is_blank(F.col("line")))


def insights(spark, d):
    rows = pl.insight_rows(contracts(spark, d), "response_id", "area")
    return pl.rank_insights(rows).select(
        "response_id", "area", "position", "id", "confianca", "nivel_risco", "confidence_place", "risk_place",
        joined("evidencias", ";").alias("evidencias"),
    )


def kpis(spark, d):
    rows = pl.kpi_rows(contracts(spark, d), "response_id", "area")
    return rows.withColumn("valor", F.col("valor").cast("double"))


def fill(spark, d):
    return pl.minimum_fill(contracts(spark, d)).select("response_id", "text_lines", "points", "filled")


def self_checks(spark, d):
    return pl.self_checks(contracts(spark, d)).select("response_id", "checks_ok", "checks_failed")


def cited_rows(spark, d):
    profile = prof.data_profile(facts(spark, d), facts(spark, d, [A]))
    return cited.cited_in_profile(val.answers(responses(spark, d)), profile)


# --- SQL side ------------------------------------------------------------------------------
def q(value):
    return "'" + value.replace("'", "''") + "'"


def find_all(pattern):
    return f"regexp_extract_all(text, {q(pattern)}, 1, 'i')"


def matches(pattern, text="text"):
    return f"regexp_matches({text}, {q(pattern)}, 'i')"


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
ERROR = " OR ".join(f"starts_with(text, {q(p)})" for p in fixed.MODEL_ERROR_PREFIXES)
ANSWERS_SQL = f"answers AS (SELECT * FROM responses WHERE text IS NOT NULL AND NOT ({ERROR}))"
YEARS_SQL = f"""years AS (SELECT DISTINCT response_id, unnest(regexp_extract_all(text, {q(YEAR_PATTERN)}, 1)) AS year FROM answers)"""
STOPS = ", ".join(q(w) for w in fixed.ENTITY_STOP_WORDS)
MENTIONS_SQL = f"""mentions AS (
  SELECT response_id, name, CAST(row_number() OVER (PARTITION BY response_id ORDER BY i) - 1 AS INTEGER) AS position FROM (
    SELECT response_id, i, {STRIP.format('raw')} AS name FROM (
      SELECT response_id, unnest(found) AS raw, generate_subscripts(found, 1) AS i FROM (
        SELECT response_id, list_concat(list_concat({find_all(fixed.ENTITY_PATTERNS[0])}, {find_all(fixed.ENTITY_PATTERNS[1])}),
          {find_all(fixed.ENTITY_PATTERNS[2])}) AS found FROM answers)))
  WHERE length(name) > 3 AND name NOT IN ({STOPS}))"""
UNKNOWN_SQL = """unknown AS (
  SELECT * FROM mentions WHERE lower(name) NOT IN (SELECT lower(client) FROM facts WHERE client IS NOT NULL))"""
# RE2 has no look-ahead: the allowed wording is cut out first, then the rule is searched.
RULE_TEXTS = ["text", "text", "text", r"regexp_replace(text, 'com\s+base\s+(?:na\s+)?experiência\s+própria', '|', 'gi')"]
RULE_PATTERNS = [p.replace(r"(?!\s+própria)", "") for p, _ in fixed.PHRASE_RULES]
RULES = [matches(p, t) for p, t in zip(RULE_PATTERNS, RULE_TEXTS)]
VERDICT_SQL = f"""verdict AS (
  SELECT a.response_id, area, stamp, text, coalesce(e.errors, []) AS errors,
    list_concat(coalesce(w.names, []), list_filter([{', '.join(f"CASE WHEN {r} THEN {q('AVISO: ' + d)} END" for r, (_, d) in zip(RULES, fixed.PHRASE_RULES))}],
      lambda x: x IS NOT NULL)) AS warnings
  FROM answers a
  LEFT JOIN (SELECT response_id, list('Menção a ano ' || year || ' que não existe nos dados (anos disponíveis: [' ||
      (SELECT string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FROM (SELECT DISTINCT year FROM facts WHERE year IS NOT NULL)) || '])' ORDER BY year) AS errors
    FROM years WHERE CAST(year AS INTEGER) NOT IN (SELECT year FROM facts WHERE year IS NOT NULL) GROUP BY response_id) e USING (response_id)
  LEFT JOIN (SELECT response_id, list('Cliente/Empresa ''' || name || ''' não encontrado na planilha' ORDER BY position) AS names
    FROM unknown GROUP BY response_id) w USING (response_id))"""
KEPT_SQL = f"""kept AS (SELECT *, list_filter(warnings, lambda x: NOT ({' OR '.join(matches(p, 'x') for p in fixed.FALSE_POSITIVE_PATTERNS)})) AS real FROM verdict)"""
CHECK_CTES = [FACTS_SQL, responses_sql(), ANSWERS_SQL, YEARS_SQL, MENTIONS_SQL, UNKNOWN_SQL, VERDICT_SQL, KEPT_SQL]


def on_checks(body):
    return with_ctes(CHECK_CTES, body)


E = fixed.JSON_ERRORS
EXTRACT_SQL = f"""extracted AS (
  SELECT *, CASE WHEN whole = 'OBJECT' THEN raw WHEN whole IS NULL THEN list_filter(candidates, lambda x: json_valid(x))[1] END AS json_text,
    CASE WHEN coalesce(text, '') = '' THEN {q(E['empty'])}
      WHEN whole <> 'OBJECT' THEN {q(E['not_object'])}
      WHEN whole = 'OBJECT' OR len(list_filter(candidates, lambda x: json_valid(x))) > 0 THEN NULL
      WHEN NOT contains(raw, '}}') THEN {q(E['no_delimiter'])} ELSE {q(E['not_found'])} END AS json_error
  FROM (SELECT *, CASE WHEN json_valid(raw) THEN json_type(raw) END AS whole,
      list_reverse(list_transform(string_split(regexp_extract(raw, '(?s)^(.*\\}})', 1), '{{')[2:], lambda x: '{{' || x)) AS candidates
    FROM (SELECT *, CASE WHEN NOT starts_with(trimmed, '```') THEN trimmed
        WHEN ends_with(opened, '```') THEN {STRIP.format('left(opened, length(opened) - 3)')} ELSE opened END AS raw
      FROM (SELECT *, regexp_replace(trimmed, '^```[a-zA-Z]*\\n', '') AS opened
        FROM (SELECT *, {STRIP.format('text')} AS trimmed FROM responses)))))"""


def truthy(path):
    return f"coalesce(CAST(json_extract(p, '$.{path}') AS VARCHAR) NOT IN ('null', '\"\"', '0', 'false', '[]', '{{}}', '0.0'), false)"


def text_or(path, default):
    return f"CASE WHEN {truthy(path)} THEN json_extract_string(p, '$.{path}') ELSE {default} END"


def list_size(path):
    return f"CASE WHEN json_type(p, '$.{path}') = 'ARRAY' THEN CAST(json_array_length(p, '$.{path}') AS INTEGER) ELSE 0 END"


PAYLOAD_SQL = f"""payload AS (
  SELECT *, {text_or('schema_version', "'1.1'")} AS schema_version, {text_or('resumo_executivo', "''")} AS resumo_executivo,
    CASE WHEN p IS NULL THEN coalesce(text, '') ELSE {text_or('texto_markdown', text_or('texto', "''"))} END AS texto_markdown,
    {list_size('kpis')} AS n_kpis, {list_size('insights')} AS n_insights, {list_size('pontos_de_atencao')} AS n_pontos_de_atencao,
    {truthy('checagem.' + CHECKS[0])} AS check_years, {truthy('checagem.' + CHECKS[1])} AS check_numbers
  FROM (SELECT * EXCLUDE (json_error), CASE WHEN text IS NULL THEN {q(fixed.MODEL_ERROR_NULL)} WHEN {ERROR} THEN {q(fixed.MODEL_ERROR_PREFIX)} END AS erro_llm,
      CASE WHEN erro_llm IS NULL THEN json_error END AS json_error,
      CASE WHEN erro_llm IS NULL AND json_text IS NOT NULL AND json_text <> '{{}}' THEN json_text END AS p FROM extracted))"""
CONTRACT_SQL = f"""contract AS (
  SELECT *, erro_llm IS NULL AND json_error IS NULL AND NOT content_empty AS contract_ok,
    CASE WHEN erro_llm IS NULL AND json_error IS NULL AND content_empty THEN {q(fixed.EMPTY_CONTENT)} END AS erro_conteudo
  FROM (SELECT *, {STRIP.format('texto_markdown')} = '' AND {STRIP.format('resumo_executivo')} = ''
      AND n_kpis + n_insights + n_pontos_de_atencao = 0 AS content_empty FROM payload))"""
CHOSEN_SQL = """chosen AS (
  SELECT * FROM (SELECT *, contract_ok OR erro_llm IS NOT NULL AS stops FROM contract)
  QUALIFY row_number() OVER (PARTITION BY run_id, area ORDER BY stops DESC, CASE WHEN stops THEN attempt ELSE -attempt END) = 1)"""
PAYLOAD_CTES = [responses_sql(), EXTRACT_SQL, PAYLOAD_SQL, CONTRACT_SQL, CHOSEN_SQL]


def on_payloads(body):
    return with_ctes(PAYLOAD_CTES, body)


def items(field, fields):
    columns = ", ".join(f"json_extract_string(item, '$.{name}') AS {name}" for name in fields)
    return f"""SELECT response_id, area, CAST(i - 1 AS INTEGER) AS position, item, {columns} FROM (
      SELECT response_id, area, unnest(list) AS item, generate_subscripts(list, 1) AS i FROM (
        SELECT response_id, area, CASE WHEN json_type(p, '$.{field}') = 'ARRAY' THEN json_extract(p, '$.{field}[*]') END AS list FROM contract))"""


def listed(field, name):
    """The values of one field in a list of objects, joined."""
    values = f"json_extract_string(p, '$.{field}[*].{name}')"
    return f"coalesce(array_to_string(list_filter(CASE WHEN n_{field} > 0 THEN {values} ELSE [] END, lambda x: x IS NOT NULL), ','), '')"


def place(column, labels):
    whens = " ".join(f"WHEN {q(label)} THEN {i}" for i, label in enumerate(labels))
    return f"CAST(CASE {column} {whens} ELSE {len(labels)} END AS INTEGER)"


def headings_sql():
    parts = [
        f"CASE WHEN NOT regexp_matches(coalesce(markdown, ''), {q('(?m)' + val.heading_pattern(*h))}) THEN {q(h[2])} END"
        for h in fixed.REPORT_HEADINGS
    ]
    return f"""SELECT report_id, coalesce({STRIP.format('markdown')}, '') <> '' AND missing = '' AS complete, missing FROM (
      SELECT report_id, markdown, concat_ws('|', {', '.join(parts)}) AS missing FROM reports)"""


def plain_text(column):
    return f"translate(coalesce({column}, ''), {q(fixed.STRIPPED_CHARACTERS)}, '')"


CITED_SQL = f"""SELECT response_id, CAST(len(figures) AS INTEGER) AS cited, CAST(len(near) AS INTEGER) AS verified, len(figures) = len(near) AS all_verified FROM (
  SELECT response_id, figures, list_filter(figures, lambda f: len(list_filter(numbers, lambda v: abs(f - v) <= abs(v) * 0.005)) > 0) AS near FROM (
    SELECT response_id, numbers, list_transform(list_transform(list_concat(regexp_extract_all(text, {q(cited.MONEY_PATTERN)}, 1),
        regexp_extract_all(text, {q(cited.PERCENT_PATTERN)}, 1)), lambda n: regexp_replace(n, '[.,]+$', '')),
      lambda n: CAST(CASE WHEN regexp_matches(n, {q(cited.DOT_GROUPED)}) OR regexp_matches(n, {q(cited.COMMA_DECIMAL)}) AND NOT regexp_matches(n, {q(cited.COMMA_GROUPED)})
             THEN replace(replace(n, '.', ''), ',', '.')
           WHEN regexp_matches(n, {q(cited.COMMA_GROUPED)}) THEN replace(n, ',', '')
           WHEN regexp_matches(n, {q(cited.PLAIN)}) THEN n END AS DOUBLE)) AS figures
    FROM answers CROSS JOIN (SELECT list(DISTINCT value) AS numbers FROM profile
      WHERE value IS NOT NULL AND section NOT IN ('anos', 'meses'))))"""

QUERIES = {
    "year_mentions": Query(
        year_mentions, with_ctes([responses_sql(), ANSWERS_SQL, YEARS_SQL], "SELECT response_id, year FROM years")
    ),
    "unknown_years": Query(
        unknown_years,
        on_checks(
            """SELECT response_id, CAST(year AS INTEGER) AS year FROM years
               WHERE CAST(year AS INTEGER) NOT IN (SELECT year FROM facts WHERE year IS NOT NULL)"""
        ),
    ),
    "entity_mentions": Query(
        lambda s, d: val.entity_mentions(responses(s, d)),
        with_ctes([responses_sql(), ANSWERS_SQL, MENTIONS_SQL], "SELECT response_id, position, name FROM mentions"),
    ),
    "unknown_entities": Query(unknown_entities, on_checks("SELECT response_id, position, name FROM unknown")),
    "phrase_flags": Query(
        lambda s, d: val.phrase_flags(responses(s, d)),
        with_ctes(
            [responses_sql(), ANSWERS_SQL],
            "SELECT response_id, " + ", ".join(f"{r} AS flag_{i}" for i, r in enumerate(RULES, 1)) + " FROM answers",
        ),
    ),
    "verdicts": Query(
        verdict_rows,
        on_checks(
            """SELECT response_id, area, len(errors) = 0 AS valid, array_to_string(errors, '|') AS errors,
                 array_to_string(warnings, '|') AS warnings FROM verdict"""
        ),
    ),
    "false_positive_filter": Query(
        false_positives,
        on_checks(
            """SELECT response_id, CAST(len(warnings) AS INTEGER) AS before, CAST(len(real) AS INTEGER) AS after,
                 array_to_string(real, '|') AS kept FROM kept WHERE len(warnings) > 0"""
        ),
    ),
    "feedback": Query(
        feedback,
        on_checks(
            """SELECT response_id, CASE WHEN len(errors) + len(warnings) > 0 THEN 'DETECÇÃO DE ALUCINAÇÃO:' || chr(10) || chr(10)
                 || CASE WHEN len(errors) > 0 THEN 'ERROS CRÍTICOS:' || chr(10) || array_to_string(list_transform(errors, lambda x: '- ' || x || chr(10)), '') ELSE '' END
                 || CASE WHEN len(warnings) > 0 THEN chr(10) || 'AVISOS:' || chr(10) || array_to_string(list_transform(warnings, lambda x: '- ' || x || chr(10)), '') ELSE '' END
                 || chr(10) || chr(10) || 'INFORMAÇÕES REAIS PARA CORRIGIR:' || chr(10) || '- Anos disponíveis: [' || ys || ']' || chr(10)
                 || '- Meses disponíveis: [' || ms || ']' || chr(10) || '- Clientes na planilha: {clientes}' || chr(10)
                 || '- Range de faturamento: R$ ' || lo || ' a R$ ' || hi || chr(10) || '- Média de faturamento: R$ ' || mean || chr(10) END AS feedback
               FROM verdict CROSS JOIN (
                 SELECT (SELECT string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FROM (SELECT DISTINCT year FROM facts WHERE year IS NOT NULL)) AS ys,
                   (SELECT string_agg(CAST(month AS VARCHAR), ', ' ORDER BY month) FROM (SELECT DISTINCT month FROM facts WHERE month IS NOT NULL)) AS ms,
                   CAST(CAST(round(min(amount), 2) AS DECIMAL(18,2)) AS VARCHAR) AS lo, CAST(CAST(round(max(amount), 2) AS DECIMAL(18,2)) AS VARCHAR) AS hi,
                   CAST(CAST(CAST(sum(amount) AS DOUBLE) / count(amount) AS DECIMAL(18,2)) AS VARCHAR) AS mean FROM facts)"""
        ),
    ),
    "json_extraction": Query(
        extracted,
        with_ctes(
            [responses_sql(), EXTRACT_SQL],
            f"SELECT response_id, json_text, json_error FROM extracted WHERE text IS NOT NULL AND NOT ({ERROR})",
        ),
    ),
    "payload_normalized": Query(
        normalized,
        on_payloads(
            """SELECT response_id, schema_version, area, resumo_executivo, texto_markdown, n_kpis, n_insights,
                 n_pontos_de_atencao, check_years, check_numbers, erro_llm FROM payload"""
        ),
    ),
    "payload_contract": Query(
        contract_rows,
        with_ctes(
            [*CHECK_CTES, *PAYLOAD_CTES[1:]],
            """SELECT response_id, content_empty, contract_ok, erro_conteudo,
                 contract_ok AND coalesce(len(errors) = 0, false) AS valid_by_content
               FROM contract LEFT JOIN (SELECT response_id, errors FROM verdict) USING (response_id)""",
        ),
    ),
    "selected_attempt": Query(
        attempts, on_payloads("SELECT response_id, run_id, area, attempt, contract_ok, erro_llm FROM chosen")
    ),
    "model_errors": Query(
        model_errors,
        on_payloads("SELECT response_id, erro_llm, coalesce(text, '') AS body FROM payload WHERE erro_llm IS NOT NULL"),
    ),
    "report_sections": Query(sections, with_ctes([reports_sql()], headings_sql())),
    "payload_documents": Query(
        documents,
        with_ctes(
            [*CHECK_CTES, *PAYLOAD_CTES[1:]],
            f"""SELECT '1.1' AS document_version, '2024-01-01T00:00:00' AS generated_at, c.area, c.response_id, schema_version,
                  resumo_executivo AS summary, n_kpis,
                  {', '.join(f"{listed('kpis', name)} AS kpi_{name}" for name in pl.KPI_FIELDS if name != 'valor')},
                  {', '.join(f"{listed('insights', name)} AS insight_{name}" for name in pl.INSIGHT_FIELDS)},
                  {listed('insights', 'evidencias[*]')} AS evidence,
                  coalesce(array_to_string(CASE WHEN n_pontos_de_atencao > 0 THEN json_extract_string(p, '$.pontos_de_atencao[*]') ELSE [] END, ','), '') AS points,
                  check_years, check_numbers,
                  coalesce(array_to_string(k.real, '|'), '') AS warnings, coalesce(array_to_string(list_sort(k.errors), '|'), '') AS errors,
                  json_error AS erro_json, erro_conteudo, erro_llm, contract_ok AND coalesce(len(k.errors) = 0, false) AS valido_por_conteudo,
                  texto_markdown AS body
                FROM chosen c LEFT JOIN kept k USING (response_id)""",
        ),
    ),
    "markdown_or_notice": Query(
        lambda s, d: rep.markdown_or_notice(reports(s, d)),
        with_ctes([reports_sql()], f"SELECT report_id, coalesce(nullif(markdown, ''), {q(fixed.EMPTY_MARKDOWN)}) AS markdown FROM reports"),
    ),
    "area_previews": Query(
        previews,
        on_payloads(
            f"""SELECT * FROM (
                  SELECT response_id, area, {plain_text("CASE WHEN length(source) > 500 THEN left(source, 500) || '...' ELSE source END")} AS preview
                  FROM (SELECT *, coalesce(nullif(resumo_executivo, ''), nullif(texto_markdown, '')) AS source FROM payload)
                  WHERE area IN ('financeiro', 'operacional', 'estrategico') AND coalesce({STRIP.format('source')}, '') <> '')
                WHERE {STRIP.format('preview')} <> ''"""
        ),
    ),
    "sanitized_documents": Query(
        lambda s, d: table(s, d, "documents").select("doc_id", tx.sanitize(F.col("text")).alias("text")),
        f"SELECT doc_id, {plain_text('text')} AS text FROM documents",
    ),
    "report_lines": Query(
        report_lines,
        with_ctes(
            [reports_sql()],
            f"""SELECT report_id, CAST(i - 1 AS INTEGER) AS position, {plain_text('raw')} AS line FROM (
                  SELECT report_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS i FROM (
                    SELECT report_id, string_split(CASE WHEN length(plain) > 2000
                        THEN left(plain, 2000) || chr(10) || chr(10) || {q(fixed.REPORT_CUT_NOTE)} ELSE plain END, chr(10)) AS lines
                    FROM (SELECT report_id, replace(replace(markdown, '## ', ''), '# ', '') AS plain FROM reports)))
                WHERE {STRIP.format(plain_text('raw'))} <> ''""",
        ),
    ),
    "insight_ranking": Query(
        insights,
        on_payloads(
            f"""SELECT response_id, area, position, id, confianca, nivel_risco, {place('confianca', fixed.CONFIDENCE_ORDER)} AS confidence_place,
                  {place('nivel_risco', fixed.RISK_ORDER)} AS risk_place,
                  coalesce(array_to_string(CASE WHEN json_type(item, '$.evidencias') = 'ARRAY' THEN json_extract_string(item, '$.evidencias[*]') END, ';'), '') AS evidencias
                FROM ({items('insights', ['id', 'confianca', 'nivel_risco'])}) ORDER BY confidence_place, risk_place, id"""
        ),
    ),
    "kpi_list": Query(
        kpis,
        on_payloads(
            f"""SELECT response_id, area, position, id, nome, CAST(valor AS DOUBLE) AS valor, unidade, periodo, fonte
                FROM ({items('kpis', pl.KPI_FIELDS)})"""
        ),
    ),
    "minimum_fill": Query(
        fill,
        on_payloads(
            """SELECT response_id, text_lines, n_pontos_de_atencao AS points, text_lines >= 5 AND n_pontos_de_atencao >= 1 AS filled
               FROM (SELECT *, CAST(CASE WHEN texto_markdown = '' THEN 0 ELSE len(string_split(texto_markdown, chr(10))) END AS INTEGER) AS text_lines FROM payload)"""
        ),
    ),
    "self_checks": Query(
        self_checks,
        on_payloads(
            r"""SELECT response_id, CAST(len(list_filter(marks, lambda x: x = 'OK')) AS INTEGER) AS checks_ok,
                 CAST(len(list_filter(marks, lambda x: x = 'FALHA')) AS INTEGER) AS checks_failed
               FROM (SELECT response_id, regexp_extract_all(texto_markdown, '(?m)^- \[(OK|FALHA)\]', 1) AS marks FROM payload)"""
        ),
    ),
    "cited_numbers": Query(cited_rows, with_ctes([FACTS_SQL, PROFILE_SQL, responses_sql(), ANSWERS_SQL], CITED_SQL)),
}
