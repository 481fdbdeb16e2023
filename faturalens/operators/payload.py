"""Payloads inside answers: extraction, normalisation, contract, choice of attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faturalens.functions import fixed
from faturalens.functions.jsontext import kind, parse_strict, truthy, with_json_object
from faturalens.functions.once import let, with_once
from faturalens.functions.text import is_blank
from faturalens.operators.validation import model_error, verdicts

LIST_FIELDS = ["kpis", "insights", "pontos_de_atencao"]
PAYLOAD_FIELDS = [
    "schema_version", "resumo_executivo", "texto_markdown", *LIST_FIELDS, "checagem", "avisos_validador",
    "alucinacoes_validador", "erro_json", "erro_conteudo", "erro_llm", "valido_por_conteudo",
]
KPI_FIELDS = ["id", "nome", "valor", "unidade", "periodo", "fonte"]
INSIGHT_FIELDS = ["id", "tipo", "titulo", "descricao", "confianca", "nivel_risco"]


def extract_payload(responses: DataFrame) -> DataFrame:
    """Add `json_text` and `json_error`."""
    return with_json_object(responses, "text")


def _field(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", "variant")


def _text_or(value: Column, default: Column) -> Column:
    return let(value, lambda v: F.when(truthy(v), F.try_variant_get(v, "$", "string")).otherwise(default))


def _list(payload: Column, name: str) -> Column:
    """The list as it is, element by element; anything but a list becomes empty."""
    # A value that is no list does not cast to one.
    items = F.try_variant_get(payload, f"$.{name}", "array<variant>")
    return F.coalesce(items, F.array().cast("array<variant>"))


def normalize_payload(extracted: DataFrame) -> DataFrame:
    """Bring the extracted object of each answer into the fixed payload form.

    An answer without an object, or with an empty one, becomes the text of its payload.
    Model errors hold only their own text. Unknown fields are left out.
    """
    payload, checks, text = F.col("_payload"), F.col("_checks"), F.col("text")
    body = F.when(
        truthy(payload), _text_or(_field(payload, "texto_markdown"), _text_or(_field(payload, "texto"), F.lit("")))
    ).otherwise(F.coalesce(text, F.lit("")))
    version = F.lit(fixed.PAYLOAD_SCHEMA_VERSION)
    rows = extracted.withColumn("erro_llm", model_error(text))
    rows = rows.withColumn("json_error", F.when(F.col("erro_llm").isNull(), F.col("json_error")))
    rows = with_once(rows, _payload=F.when(F.col("erro_llm").isNull(), parse_strict(F.col("json_text"))))
    found = _field(payload, "checagem")
    rows = with_once(rows, _checks=F.when(kind(found) == "object", found))
    return with_once(
        rows,
        schema_version=_text_or(_field(payload, "schema_version"), version),
        resumo_executivo=_text_or(_field(payload, "resumo_executivo"), F.lit("")),
        texto_markdown=body,
        **{name: _list(payload, name) for name in LIST_FIELDS},
        checagem=F.struct(*[truthy(_field(checks, name)).alias(name) for name in fixed.CHECK_FIELDS]),
    ).drop("_payload", "_checks")


def with_contract(payloads: DataFrame) -> DataFrame:
    """Add whether the content is empty and whether the contract holds."""
    lists_empty = F.lit(True)
    for name in LIST_FIELDS:
        lists_empty = lists_empty & (F.size(name) == 0)
    empty = is_blank(F.col("texto_markdown")) & is_blank(F.col("resumo_executivo")) & lists_empty
    real = F.col("erro_llm").isNull()
    return (
        with_once(payloads, content_empty=empty)
        .withColumn("contract_ok", real & F.col("json_error").isNull() & ~F.col("content_empty"))
        .withColumn(
            "erro_conteudo",
            F.when(real & F.col("content_empty") & F.col("json_error").isNull(), F.lit(fixed.EMPTY_CONTENT)),
        )
    )


def valid_by_content(verdict: DataFrame) -> DataFrame:
    """Verdict and contract together, for verdicts that carry the contract flags."""
    return verdict.withColumn(
        "valid_by_content", F.col("valid") & F.col("contract_ok") & F.col("erro_llm").isNull()
    )


def select_attempt(contracts: DataFrame, keys: tuple[str, ...] = ("run_id", "area")) -> DataFrame:
    """The attempt each run ends with.

    The first that keeps the contract, or that is a model error, ends the run; without one
    the last attempt stands, however many there are. The rank filter is applied in every
    task before rows move.
    """
    stops = F.col("contract_ok") | F.col("erro_llm").isNotNull()
    order = Window.partitionBy(*keys).orderBy(
        F.desc("_stops"), F.when(F.col("_stops"), F.col("attempt")).otherwise(-F.col("attempt"))
    )
    return (
        contracts.withColumn("_stops", stops)
        .withColumn("_place", F.row_number().over(order))
        .where("_place = 1")
        .drop("_stops", "_place")
    )


def area_payloads(checked: DataFrame, clients: DataFrame, keys: tuple[str, ...] = ("run_id", "area")) -> DataFrame:
    """The whole payload each run ends with, its flags included, with typed lists.

    `checked` has the contract and the row-by-row text checks. Only the chosen attempts go
    through the name join, with nothing but their ids and findings.
    """
    chosen = select_attempt(checked, keys)
    found = verdicts(chosen.select("response_id", "errors", "phrases", "names"), clients)
    found = found.select("response_id", F.col("warnings").alias("avisos_validador"), "valid")
    none = F.array().cast("array<string>")
    real = F.col("erro_llm").isNull()
    return (
        typed_payload(chosen.drop("valid"))
        .join(found, "response_id", "left")
        .withColumn("avisos_validador", F.coalesce("avisos_validador", none))
        .withColumn("alucinacoes_validador", F.col("errors"))
        .withColumn("erro_json", F.col("json_error"))
        .withColumn("valido_por_conteudo", real & F.col("contract_ok") & F.coalesce("valid", F.lit(False)))
        .select("response_id", *keys, *PAYLOAD_FIELDS)
    )


# --- typed views ------------------------------------------------------------------------------
def _typed(item: Column, fields: list[str]) -> list[Column]:
    return [F.try_variant_get(item, f"$.{name}", "string").alias(name) for name in fields]


def kpi_rows(payloads: DataFrame, *keys: str) -> DataFrame:
    """One row per KPI present in a payload."""
    rows = payloads.select(*keys, F.posexplode("kpis").alias("position", "_item"))
    return rows.select(*keys, "position", *_typed(F.col("_item"), KPI_FIELDS))


def insight_rows(payloads: DataFrame, *keys: str) -> DataFrame:
    rows = payloads.select(*keys, F.posexplode("insights").alias("position", "_item"))
    evidence = F.try_variant_get(F.col("_item"), "$.evidencias", "array<string>").alias("evidencias")
    return rows.select(*keys, "position", *_typed(F.col("_item"), INSIGHT_FIELDS), evidence)


def _place(value: Column, labels: list[str]) -> Column:
    place = F.lit(len(labels))
    for i, label in reversed(list(enumerate(labels))):
        place = F.when(value == label, i).otherwise(place)
    return place


def rank_insights(insights: DataFrame) -> DataFrame:
    """Most confident first, then the higher risk, then by id.

    A global sort reads its input twice, once to sample it. The rows are slim by now, so they
    are spread out first: the second reading then starts here and not at the texts.
    """
    slim = [name for name, kind_of in insights.dtypes if not kind_of.startswith("array")]
    return (
        insights.repartition(*slim).withColumn("confidence_place", _place(F.col("confianca"), fixed.CONFIDENCE_ORDER))
        .withColumn("risk_place", _place(F.col("nivel_risco"), fixed.RISK_ORDER))
        .orderBy("confidence_place", "risk_place", "id")
    )


def minimum_fill(payloads: DataFrame) -> DataFrame:
    """Five lines of text and one point of attention are the least a payload should have."""
    text = F.col("texto_markdown")
    lines = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")))
    return (
        payloads.withColumn("text_lines", lines)
        .withColumn("points", F.size("pontos_de_atencao"))
        .withColumn("filled", (F.col("text_lines") >= 5) & (F.col("points") >= 1))
    )


def self_checks(payloads: DataFrame) -> DataFrame:
    """Lines of the filled self-check list, counted by outcome."""
    marks = F.regexp_extract_all(F.col("texto_markdown"), F.lit(r"(?m)^- \[(OK|FALHA)\]"), F.lit(1))
    return (
        payloads.withColumn("_marks", marks)
        .withColumn("checks_ok", F.size(F.filter("_marks", lambda m: m == "OK")))
        .withColumn("checks_failed", F.size(F.filter("_marks", lambda m: m == "FALHA")))
        .drop("_marks")
    )


def typed_payload(payloads: DataFrame) -> DataFrame:
    """The payload with typed lists, ready to be written."""
    kpis = F.transform("kpis", lambda k: F.struct(*_typed(k, KPI_FIELDS)))
    insights = F.transform(
        "insights",
        lambda i: F.struct(
            *_typed(i, INSIGHT_FIELDS),
            F.try_variant_get(i, "$.evidencias", "array<string>").alias("evidencias"),
        ),
    )
    points = F.transform("pontos_de_atencao", lambda p: F.try_variant_get(p, "$", "string"))
    return payloads.withColumns({"kpis": kpis, "insights": insights, "pontos_de_atencao": points})
