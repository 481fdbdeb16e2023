"""The warning log: records, loading, classes, counts, suggestions, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from faturalens.catalog.registry import Query, with_ctes
from faturalens.catalog.text import CHECK_CTES, joined, q, verdicts
from faturalens.functions import fixed
from faturalens.operators import warninglog as wl
from faturalens.sources.warning_log import records_in

STAMP = "2024-06-30 12:00:00"


def log(spark, d):
    return wl.log_records(verdicts(spark, d), F.col("stamp"))


def records(spark, d):
    return log(spark, d).select(
        "timestamp",
        "assistente",
        "quantidade_avisos",
        "quantidade_erros",
        joined("avisos").alias("avisos"),
        "tamanho_resposta",
        "primeiras_100_chars",
    )


def loaded(spark, d):
    """Every order as a small log document: a list, an envelope, or something else."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    record = F.format_string(
        '{"timestamp":"t%d","assistente":"%s","quantidade_avisos":%d,"avisos":["Cliente/Empresa \'%s\' não encontrado","b"],"erros":[]}',
        "o_orderkey", F.col("o_orderstatus"), F.col("o_orderkey") % 5, F.col("o_orderpriority"),
    )
    kind = F.col("o_orderkey") % 5
    document = (
        F.when(kind == 0, F.concat(F.lit("["), record, F.lit("]")))
        .when(kind == 1, F.concat(F.lit('{"schema_version":"1.0","items":['), record, F.lit(","), record, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit('{"items":'), record, F.lit("}")))
        .when(kind == 3, F.concat(record, F.lit(" resto")))
        .otherwise(F.lit("[]"))
    )
    rows = records_in(orders.select(document.alias("value")))
    return rows.select(
        "timestamp", "assistente", "quantidade_avisos", joined("avisos").alias("avisos"), F.size("erros").alias("erros")
    )


def report(spark, d):
    return wl.log_report(log(spark, d), F.lit(STAMP).cast("timestamp")).select("part", "line")


WARNING_SQL = f"""log AS (
  SELECT strftime(CAST(stamp AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, area AS assistente, CAST(len(real) AS INTEGER) AS quantidade_avisos,
    CAST(len(errors) AS INTEGER) AS quantidade_erros, real AS avisos, CAST(length(text) AS INTEGER) AS tamanho_resposta,
    left(text, 100) AS primeiras_100_chars FROM kept),
warned AS (
  SELECT *, CASE WHEN contains(aviso, 'Cliente/Empresa') AND contains(aviso, 'não encontrado') THEN {q(fixed.CLASS_CLIENT)}
      WHEN contains(aviso, 'referência a') THEN {q(fixed.CLASS_REFERENCE)}
      WHEN contains(aviso, '2024') OR contains(aviso, '2027') THEN {q(fixed.CLASS_YEAR)} ELSE {q(fixed.CLASS_OTHER)} END AS tipo,
    CASE WHEN contains(aviso, 'Cliente/Empresa') THEN 'client' WHEN contains(aviso, 'referência') THEN 'reference' ELSE 'other' END AS short
  FROM (SELECT timestamp, assistente, CAST(i - 1 AS INTEGER) AS position, aviso FROM (
    SELECT timestamp, assistente, unnest(avisos) AS aviso, generate_subscripts(avisos, 1) AS i FROM log)))"""
SUGGESTED_SQL = """suggested AS (
  SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, {q(name)}, {limit}, {q(text)})" for i, (name, limit, text) in enumerate(fixed.SUGGESTIONS, 1)
) + """) s(number, name, threshold, suggestion) WHERE threshold < CASE name
    WHEN 'client' THEN (SELECT count(*) FROM warned WHERE short = 'client')
    WHEN 'reference' THEN (SELECT count(*) FROM warned WHERE short = 'reference') ELSE (SELECT count(*) FROM warned) END)"""


def on_log(body):
    return with_ctes([*CHECK_CTES, WARNING_SQL, SUGGESTED_SQL], body)


RUNS = "SELECT assistente, count(*) AS execucoes, CAST(sum(quantidade_avisos) AS DOUBLE) / count(*) AS media_avisos FROM log GROUP BY assistente"
CLIENT_TOTAL = f"SELECT count(*) AS total FROM warned WHERE tipo = {q(fixed.CLASS_CLIENT)}"
FIRST = f"SELECT timestamp, position, aviso FROM warned WHERE tipo = {q(fixed.CLASS_CLIENT)} ORDER BY timestamp, position, aviso LIMIT 5"

QUERIES = {
    "log_records": Query(
        records,
        on_log(
            """SELECT timestamp, assistente, quantidade_avisos, quantidade_erros, array_to_string(avisos, '|') AS avisos,
                 tamanho_resposta, primeiras_100_chars FROM log"""
        ),
    ),
    "log_documents": Query(
        loaded,
        """SELECT 't' || o_orderkey AS timestamp, o_orderstatus AS assistente, CAST(o_orderkey % 5 AS INTEGER) AS quantidade_avisos,
             'Cliente/Empresa ''' || o_orderpriority || ''' não encontrado|b' AS avisos, CAST(0 AS INTEGER) AS erros
           FROM orders JOIN (VALUES (0), (1), (1)) v(k) ON o_orderkey % 5 = k""",
    ),
    "warning_classes": Query(
        lambda s, d: wl.logged_warnings(log(s, d)),
        on_log("SELECT timestamp, assistente, position, aviso, tipo FROM warned"),
    ),
    "runs_per_assistant": Query(lambda s, d: wl.runs_per_assistant(log(s, d)), on_log(RUNS)),
    "warning_class_counts": Query(
        lambda s, d: wl.class_counts(log(s, d)),
        on_log("SELECT tipo, count(*) AS ocorrencias FROM warned GROUP BY tipo ORDER BY ocorrencias DESC, tipo"),
    ),
    "client_warning_total": Query(lambda s, d: wl.client_warning_total(log(s, d)), on_log(CLIENT_TOTAL)),
    "first_client_warnings": Query(lambda s, d: wl.first_client_warnings(log(s, d)), on_log(FIRST)),
    "suggestions": Query(
        lambda s, d: wl.suggestions(log(s, d)),
        on_log("SELECT CAST(number AS INTEGER) AS number, suggestion FROM suggested"),
    ),
    "log_report": Query(
        report,
        on_log(
            f"""SELECT CAST(part AS INTEGER) AS part, line FROM (
                SELECT 0 AS part, '# RELATÓRIO DE AVISOS E PADRÕES' AS line
                UNION ALL SELECT 0, 'Data: {STAMP.replace(' ', 'T')}'
                UNION ALL SELECT 0, 'Total de execuções analisadas: ' || count(*) FROM log
                UNION ALL SELECT 0, '## Avisos por Assistente'
                UNION ALL SELECT 1, unnest(['### ' || upper(assistente), '- Execuções: ' || execucoes,
                   '- Média de avisos por execução: ' || format('{{:.1f}}', media_avisos)]) FROM ({RUNS})
                UNION ALL SELECT 2, '## Tipos de Aviso Mais Comuns'
                UNION ALL SELECT 3, '- ' || tipo || ': ' || count(*) || ' ocorrências' FROM warned GROUP BY tipo
                UNION ALL SELECT 4, '## Falsos Positivos Detectados (' || total || ')' FROM ({CLIENT_TOTAL}) WHERE total > 0
                UNION ALL SELECT 5, '- ' || aviso FROM ({FIRST})
                UNION ALL SELECT 6, '## SUGESTÕES DE MELHORIA' WHERE (SELECT count(*) FROM suggested) > 0
                UNION ALL SELECT 7, '- ' || suggestion FROM suggested)"""
        ),
    ),
}
