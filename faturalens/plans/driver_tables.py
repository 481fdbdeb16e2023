"""Billing facts and report texts derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faturalens.functions import fixed


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the session's shuffles have; a table of few bytes is read by few tasks, whatever its texts cost."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def facts(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The billing table, one row per order line.

    Only the tables that the wanted columns come from are joined. Joins keep every line: a
    line without a match has nulls, as a billing row with empty cells would. The order side
    is put together before it meets the lines, so the lines move once for it.
    """
    wanted = set(columns or fixed.FACT_COLUMNS)
    rows = table(spark, folder, "lineitem")
    if wanted & {"year", "month", "client"}:
        heads = table(spark, folder, "orders").select(
            "o_orderkey",
            "o_custkey",
            F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"),
        )
        if "client" in wanted:
            clients = table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("client"))
            heads = heads.join(clients, F.col("o_custkey") == F.col("c_custkey"), "left")
        rows = rows.join(heads, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "collaborator" in wanted:
        people = table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("collaborator"))
        rows = rows.join(people, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    rate = F.lit(1) - F.col("l_discount").cast("decimal(4,2)")
    rows = rows.withColumn("amount", (price * rate).cast("decimal(18,4)"))
    return rows.select(*[c for c in fixed.FACT_COLUMNS if c in wanted])


def order_years(spark: SparkSession, folder: str) -> list[int]:
    """The years of the order dates, read from that one column; bounded by the calendar."""
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return sorted(row.year for row in years.where("year is not null").collect())


FACTS_SQL = """facts AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         c_name AS client, s_name AS collaborator,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,4)) AS amount
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey)"""

# Report texts: one per order, in the wordings the checks look for, plus every document and
# every conversation turn as it is. The select is plain enough to run on any SQL engine.
# An order's run, area and attempt come from its key, its wording from key and customer.
RESPONSES_SQL = r"""
SELECT concat('order-', o_orderkey) AS response_id,
       concat('run-', floor_run) AS run_id,
       CASE WHEN area_no = 0 THEN 'financeiro' WHEN area_no = 1 THEN 'operacional' ELSE 'estrategico' END AS area,
       CAST(attempt_no AS INTEGER) AS attempt,
       CAST(stamp AS TIMESTAMP) AS stamp,
       CASE wording
         WHEN 0 THEN concat('Em ', order_year, ' o cliente ', c_name, ', contribuiu com R$ ', price, ' no total.')
         WHEN 1 THEN concat('A receita de ', order_year + 9, ' superou ', order_year, '. Em 2024 TÍNHAMOS mais vendas')
         WHEN 2 THEN concat('A EMPRESA Fantasma ', n_name, '. Houve queda de 12,5% em ', order_year)
         WHEN 3 THEN concat('O cliente ', c_name, ' cresceu muito, com crescimento nos últimos 3 anos')
         WHEN 4 THEN concat('Vendas para Gama Norte aumentou; no passado sempre 2022 com base na experiência do setor')
         WHEN 5 THEN concat('```json', chr(10), '{"schema_version":"1.2","area":"x","resumo_executivo":"Receita de R$ ', price,
              '","texto_markdown":"a\nb\nc\nd\ne\n- [OK] Cada valor\n- [FALHA] Cada ano","kpis":[{"id":"k', o_orderkey,
              '","nome":"Receita","valor":', price, ',"unidade":"R$","periodo":"', order_year,
              '","fonte":"planilha"}],"insights":[{"id":"i', o_orderkey,
              '","titulo":"Alta","descricao":"d","evidencias":["', c_name,
              '"],"confianca":"', CASE WHEN o_orderkey % 3 = 0 THEN 'alta' WHEN o_orderkey % 3 = 1 THEN 'moderada' ELSE 'baixa' END,
              '","nivel_risco":"', CASE WHEN o_custkey % 3 = 0 THEN 'Alto' WHEN o_custkey % 3 = 1 THEN 'Moderado' ELSE 'Baixo' END,
              '"}],"pontos_de_atencao":["p"],"checagem":{"anos_e_periodos_usados_estao_nos_dados":true,"numeros_citados_sao_verificaveis_nos_agregados":0}}',
              chr(10), '```')
         WHEN 6 THEN concat('Segue: {"texto":"cliente ', c_name, '","kpis":{"id":"k"}} fim do texto')
         WHEN 7 THEN concat('Aqui: {"resumo_executivo":"x","checagem":{"anos_e_periodos_usados_estao_nos_dados":true}} e {quebrado')
         WHEN 8 THEN concat('[{"id":', o_orderkey, '}]')
         WHEN 9 THEN concat('❌ Erro ao chamar IA: tempo esgotado em ', order_year)
         WHEN 10 THEN NULL
         WHEN 11 THEN concat('[!] falha ', o_orderkey)
         WHEN 12 THEN '{}'
         WHEN 13 THEN concat('{"texto_markdown":"","kpis":[],"insights":[],"pontos_de_atencao":[]}')
         WHEN 14 THEN concat('{"texto_markdown":"Cliente ', c_name, '. Receita R$ ', price, ' em ', order_year,
              '","insights":[1,"x",{"id":"j', o_orderkey, '","confianca":"alta"}]}')
         ELSE concat('  empresa Delta & Filhos ', o_custkey % 50, ', de ', order_year, ' cliente é parte  ')
       END AS text
FROM (
  SELECT o_orderkey, o_custkey, c_name, n_name, o_orderdate AS stamp,
         CAST(year(o_orderdate) AS INTEGER) AS order_year,
         CAST(o_totalprice AS DECIMAL(12,2)) AS price,
         CAST((o_orderkey - o_orderkey % 9) / 9 AS BIGINT) AS floor_run,
         ((o_orderkey - o_orderkey % 3) / 3) % 3 AS area_no,
         o_orderkey % 3 + 1 AS attempt_no,
         CAST((o_orderkey * 7 + o_custkey) % 16 AS INTEGER) AS wording
  FROM <orders> LEFT JOIN <customer> ON o_custkey = c_custkey LEFT JOIN <nation> ON c_nationkey = n_nationkey
)
UNION ALL
SELECT concat('document-', doc_id), concat('source-', source, '-', doc_id), 'operacional', 1,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP), text
FROM <documents>
UNION ALL
SELECT concat('turn-', conv_id, '-', turn), concat('conversation-', conv_id, '-', turn),
       CASE WHEN role = 'user' THEN 'financeiro' ELSE 'estrategico' END, 1,
       CAST('2024-01-02 00:00:00' AS TIMESTAMP), text
FROM <conversations>
"""
RESPONSE_TABLES = ["orders", "customer", "nation", "documents", "conversations"]


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Report texts `(response_id, run_id, area, attempt, stamp, text)`."""
    # A Spark literal reads a backslash as an escape, and the call below reads braces.
    sql = RESPONSES_SQL.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")
    for name in RESPONSE_TABLES:
        sql = sql.replace(f"<{name}>", "{" + name + "}")
    return spark.sql(sql, **{name: table(spark, folder, name) for name in RESPONSE_TABLES})


def responses_sql() -> str:
    sql = RESPONSES_SQL
    for name in RESPONSE_TABLES:
        sql = sql.replace(f"<{name}>", name)
    return f"responses AS ({sql})"


# Dashboard reports: one per customer, complete, lacking a heading, with a changed heading,
# missing or blank; some are long.
REPORTS_SQL = """
SELECT c_custkey AS report_id,
       CASE c_custkey % 5
         WHEN 1 THEN replace(whole, '## 📈 KPIs Prioritários', '## KPIs')
         WHEN 2 THEN replace(whole, 'Roadmap de Implementação', 'Roadmap de Implementação e mais')
         WHEN 3 THEN NULL
         WHEN 4 THEN CASE WHEN c_custkey % 2 = 0 THEN '   ' ELSE '' END
         ELSE whole END AS markdown
FROM (
  SELECT c_custkey, concat(
    '# 🧭 Plano Executivo de Dashboard', chr(10), chr(10), '## 🎯 Objetivo do Dashboard', chr(10),
    'Receita de ', c_name, ' <', c_mktsegment, '> & *saldo* ', CAST(c_acctbal AS DECIMAL(12,2)), chr(10),
    '## 🧠 Leitura Executiva  ', chr(10), repeat('linha de leitura ', CAST(c_custkey % 7 * 30 AS INTEGER)), chr(10),
    '## 📈 KPIs Prioritários', chr(10), '## 📊 Visualizações Recomendadas', chr(10),
    '## 🧠 Insights Refinados e Priorizados', chr(10), '  ', chr(10), '## ⚠️ Pontos de Atenção', chr(10),
    '## 🛠️ Estrutura Técnica do Dashboard', chr(10), '## 🚀 Roadmap de Implementação', chr(10),
    '##   📌 Recomendações Executivas') AS whole
  FROM <customer>)
"""


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Dashboard reports `(report_id, markdown)`."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return spark.sql(REPORTS_SQL.replace("<customer>", "{customer}"), customer=spread(customers))


def reports_sql() -> str:
    return f"reports AS ({REPORTS_SQL.replace('<customer>', 'customer')})"


# The given tables span 1995 to 2001, so the year pattern covers two centuries here.
YEAR_PATTERN = r"\b((?:19|20)[0-9]{2})\b"
