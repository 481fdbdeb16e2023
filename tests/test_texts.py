import json
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from faturalens.functions import fixed, text as tx
from faturalens.functions import jsontext as jt
from faturalens.functions.jsontext import parse_strict
from faturalens.operators import cited, payload as pl, prompts as pr, selection as sel, validation as val
from faturalens.operators.warninglog import with_text_figures
from faturalens.plans import driver_tables, profile as prof
from faturalens.sources import reports as rep


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, text {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_year_mentions(spark):
    texts = ["Em 2024 e 2025, 2024", "x2026 2030 20251", "2023é"]
    assert column(spark, texts, val.year_mentions(F.col("text"))) == [["2024", "2025"], [], []]


def test_entity_names(spark):
    texts = [
        "O cliente Alfa, e o cliente Beta S.A. cresceu",
        "A EMPRESA alfa.",
        "clientes novos",
        "Vendas para Gama Norte aumentou",
        "cliente XYZ.",
        "cliente qual, cliente seria",
        "",
    ]
    assert column(spark, texts, val.entity_names(F.col("text"))) == [
        ["Alfa", "Beta S"], ["alfa"], [], ["Gama Norte"], [], [], [],
    ]


@pytest.mark.parametrize(
    "text, flags",
    [
        ("Em 2024 TÍNHAMOS", [1]),
        ("crescimento nos últimos 3 anos", [2]),
        ("No passado, em 2022", []),
        ("historicamente vimos isso em 2022", [3]),
        ("com base na experiência", [4]),
        ("com base na experiência própria", []),
    ],
)
def test_phrase_rules(spark, text, flags):
    df = spark.createDataFrame([("r", text)], "response_id string, text string")
    row = val.phrase_flags(df).first()
    assert [i for i in range(1, 5) if row[f"flag_{i}"]] == flags


@pytest.mark.parametrize(
    "name, kept",
    [
        ("Acme cresceu 10%", False),
        ("é o maior", False),
        ("tempo de casa", False),
        ("ACME", True),
        ("Acme\ncresceu", True),
        ("Acme teve alta", True),
    ],
)
def test_false_positives(spark, name, kept):
    df = spark.createDataFrame([([f"Cliente/Empresa '{name}' não encontrado na planilha"],)], "w array<string>")
    assert (df.select(F.size(val.real_warnings(F.col("w")))).first()[0] == 1) is kept


def verdict(spark, facts, texts):
    df = spark.createDataFrame([(str(i), "financeiro", t) for i, t in enumerate(texts)], "response_id string, area string, text string")
    years = sel.known_years(facts).scalar()
    slim = with_text_figures(val.text_checks(df, years))
    return {r.response_id: r for r in val.verdicts(slim, facts).collect()}


def test_verdict(spark, facts):
    got = verdict(spark, facts, [
        "Em 2025 o cliente ALFA, subiu",
        "Em 2024 o cliente Zeta, subiu. Empresa Beta",
        None,
        "❌ Erro",
        "[!] falha",
        "cliente Zeta, cliente Zeta, cliente Zeta cresceu",
    ])
    # The text of a failed call is checked like an answer.
    assert set(got) == {"0", "1", "3", "5"}
    assert (got["0"].valid, got["0"].errors, got["0"].all_warnings) == (True, [], [])
    assert got["1"].errors == ["Menção a ano 2024 que não existe nos dados (anos disponíveis: [2025, 2026])"]
    assert got["1"].all_warnings == ["Cliente/Empresa 'Zeta' não encontrado na planilha"]
    assert not got["1"].valid
    assert len(got["5"].all_warnings) == 3 and len(got["5"].warnings) == 2
    assert got["5"].valid


def test_verdicts_with_one_hot_name(spark, facts):
    texts = ["cliente Quente, subiu"] * 400 + ["nada"] * 400 + ["cliente Alfa, subiu"] * 200
    got = verdict(spark, facts, texts)
    assert len(got) == 1000
    assert sum(len(r.all_warnings) for r in got.values()) == 400


def test_feedback_text(spark, facts):
    df = spark.createDataFrame(
        [("a", ["E1"], ["W1", "W2"]), ("b", [], [])], "response_id string, errors array<string>, all_warnings array<string>"
    )
    info = sel.facts_info(facts).select(F.struct("*")).scalar()
    got = {r.response_id: r.feedback for r in val.feedback(df, info).collect()}
    assert got["b"] is None
    names = ", ".join(r.client for r in sel.domain(facts, "client").collect())
    filled = spark.createDataFrame([(got["a"],)], "t string").select(
        tx.fill_template(F.col("t"), val.CLIENTS_MARKER, F.lit(names))
    ).first()[0]
    assert filled == (
        "DETECÇÃO DE ALUCINAÇÃO:\n\nERROS CRÍTICOS:\n- E1\n\nAVISOS:\n- W1\n- W2\n\n\nINFORMAÇÕES REAIS PARA CORRIGIR:\n"
        "- Anos disponíveis: [2025, 2026]\n- Meses disponíveis: [1, 2, 4]\n- Clientes na planilha: Alfa, Beta, Gama, Nula\n"
        "- Range de faturamento: R$ 3.50 a R$ 150.00\n- Média de faturamento: R$ 81.75\n"
    )


STRICT = ['{"a":1}', '{"a":1} lixo', '{"a":1}}', '{"a":1}]', '{"a":1}] }', '{"a":1},{"b":2}', '{"a":1,"a":2}', "{'a':1}",
          '{"a":"x\ny"}', "[1]", "", "12", "-1.5e3", '{"a":01}', '{"a":1,}', "{a:1}", '// c\n{"a":1}', ' {"a":[1,{"b":null}]} ',
          "nullo", "null", "[", '"a" "b"', '{"a":1}}]', '{"a":"\\u00e9"}']


def test_strict_parse_agrees_with_the_json_module(spark):
    def reads(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    got = column(spark, STRICT, parse_strict(F.col("text")).isNotNull())
    assert got == [reads(t) for t in STRICT]


E = fixed.JSON_ERRORS


@pytest.mark.parametrize(
    "text, found, error",
    [
        ('{"a":1}', '{"a":1}', None),
        ('```json\n{"a":{"b":1}}\n```', '{"a":{"b":1}}', None),
        ("[1]", None, E["not_object"]),
        ('Aqui: {"a":1} fim', '{"a":1}', None),
        ('{"a":1}{ruim}', '{"a":1}', None),
        ('Aqui: {"a":{"b":1}}', None, E["not_found"]),
        ("sem json", None, E["no_delimiter"]),
        ("", None, E["empty"]),
        (None, None, E["empty"]),
        ("} {", None, E["not_found"]),
        ('x {"a":1} y {"b":2} z', '{"b":2}', None),
    ],
)
def test_json_extraction(spark, text, found, error):
    df = spark.createDataFrame([(text,)], "text string")
    assert rows(pl.extract_payload(df).select("json_text", "json_error")) == [(found, error)]


def payloads(spark, items):
    df = spark.createDataFrame(
        [(str(i), "r", "financeiro", a, t) for i, (a, t) in enumerate(items)],
        "response_id string, run_id string, area string, attempt int, text string",
    )
    return pl.with_contract(pl.normalize_payload(pl.extract_payload(df)))


def test_normalisation(spark):
    got = payloads(spark, [
        (1, '{"kpis":{"id":1},"texto":"t","checagem":{"anos_e_periodos_usados_estao_nos_dados":1,"x":2},"outro":3}'),
        (1, "{}"),
        (1, '{"schema_version":"","texto_markdown":"","insights":[1,{"id":"i","evidencias":["a","b"]}],"checagem":[1]}'),
        (1, None),
        (1, "❌ Erro {}"),
        (1, '{"texto_markdown":"  ","kpis":[]}'),
    ]).orderBy("response_id").collect()
    a, b, c, d, e, f = got
    assert (a.texto_markdown, a.kpis, a.schema_version, a.checagem) == ("t", [], "1.1", (True, False))
    assert (b.texto_markdown, b.json_error, b.contract_ok) == ("{}", None, True)
    assert (c.schema_version, len(c.insights), c.checagem) == ("1.1", 2, (False, False))
    assert (d.texto_markdown, d.erro_llm, d.json_error, d.contract_ok) == ("", fixed.MODEL_ERROR_NULL, None, False)
    assert (e.texto_markdown, e.erro_llm) == ("❌ Erro {}", None)
    assert (f.content_empty, f.contract_ok, f.erro_conteudo) == (True, False, fixed.EMPTY_CONTENT)


@pytest.mark.parametrize(
    "attempts, chosen",
    [
        ([(1, "x"), (2, '{"texto":"a"}'), (3, '{"texto":"b"}')], 2),
        ([(1, "x"), (2, "y"), (3, "z")], 3),
        ([(1, "x"), (2, None), (3, '{"texto":"b"}')], 2),
        ([(1, "x"), (4, '{"texto":"b"}')], 4),
        ([(1, "x"), (2, "y"), (7, "z")], 7),
        ([(1, "❌ Erro"), (2, '{"texto":"a"}')], 2),
    ],
)
def test_attempt_choice(spark, attempts, chosen):
    assert [r.attempt for r in pl.select_attempt(payloads(spark, attempts)).collect()] == [chosen]


def test_attempt_rank_is_cut_before_the_shuffle(spark):
    plan = pl.select_attempt(payloads(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_insight_rows_and_ranking(spark):
    text = json.dumps({"insights": [
        {"id": "c", "confianca": "baixa", "nivel_risco": "Alto"},
        {"id": "b", "confianca": "alta", "nivel_risco": "Baixo"},
        {"id": "a", "confianca": "alta", "nivel_risco": "Alto", "evidencias": ["e"]},
        "solto",
    ], "texto_markdown": "1\n2\n3\n4\n5\n- [OK] um\n- [FALHA] dois\n - [OK] fora", "pontos_de_atencao": ["p"]})
    got = payloads(spark, [(1, text)])
    assert [r.id for r in pl.rank_insights(pl.insight_rows(got, "response_id")).collect()] == ["a", "b", "c", None]
    assert pl.minimum_fill(got).first().filled
    checks = pl.self_checks(got).first()
    assert (checks.checks_ok, checks.checks_failed) == (1, 1)
    typed = pl.typed_payload(got).first()
    assert typed.insights[2].evidencias == ["e"] and typed.pontos_de_atencao == ["p"]


def test_report_sections(spark):
    whole = "\n".join(f"{a} {b} {c}" for a, b, c in fixed.REPORT_HEADINGS)
    values = [whole, whole.replace("## 📈 KPIs Prioritários", "x"), whole.replace("Leitura Executiva", "Leitura Executiva e mais"), None, "  "]
    df = spark.createDataFrame(list(enumerate(values)), "report_id int, markdown string")
    got = val.report_sections(df).orderBy("report_id").collect()
    assert [r.complete for r in got] == [True, False, False, False, False]
    assert got[1].missing == ["KPIs Prioritários"] and got[2].missing == ["Leitura Executiva"]
    assert len(got[3].missing) == 10


def test_number_reading(spark):
    written = ["1.234,50", "1,234.50", "12,5", "12.5", "1.234", "1234", "1.2.3", "1.234.567"]
    assert column(spark, written, cited.parse_number(F.col("text"))) == [1234.5, 1234.5, 12.5, 12.5, 1234.0, 1234.0, None, 1234567.0]


def test_cited_numbers_of_a_small_profile(spark):
    profile = spark.createDataFrame([("s", "a", 1004.0), ("s", "b", 12.5)], "section string, key string, value double")
    df = spark.createDataFrame([("a", "R$ 1.000,00 e 12,5%. R$ 77"), ("b", "nada")], "response_id string, text string")
    got = {r.response_id: (r.cited, r.verified, r.all_verified) for r in cited.cited_in_profile(df, profile).collect()}
    assert got == {"a": (3, 2, False), "b": (0, 0, True)}


def test_cited_in_profile_equals_all_pairs(spark):
    source = random.Random(3)
    values = [0.0, -5.0, None] + [round(10 ** source.uniform(-2, 7), 4) for _ in range(300)]
    profile = spark.createDataFrame([("s", str(i), v) for i, v in enumerate(values)], "section string, key string, value double")
    figures = [0.0] + [round(abs(v or 1) * source.choice([1, 1.004, 1.005, 1.0051, 0.996, 0.995, 0.9949, 1.02]), 4) for v in values] + [round(10 ** source.uniform(-2, 7), 4) for _ in range(200)]
    texts = ["R$ " + " R$ ".join(f"{f:.4f}" for f in figures[i : i + 7]) for i in range(0, len(figures), 7)] + ["nada", "R$ 1.2.3"]
    df = spark.createDataFrame(list(enumerate(texts)), "response_id int, text string")
    shown = [[float(f"{f:.4f}") for f in figures[i : i + 7]] for i in range(0, len(figures), 7)]
    near = lambda f: any(abs(f - v) <= abs(v) * fixed.CITED_TOLERANCE for v in values if v is not None)
    want = {i: (len(own), sum(map(near, own))) for i, own in enumerate(shown)} | {len(shown): (0, 0), len(shown) + 1: (1, 0)}
    got = {r.response_id: (r.cited, r.verified) for r in cited.cited_in_profile(df, profile).collect()}
    assert got == want


def test_strip_is_linear_and_knows_every_blank(spark):
    blanks = "".join(c for c in map(chr, range(0x3100)) if c.isspace() and not "\x1c" <= c <= "\x1f")
    assert column(spark, [blanks + "a" + blanks + "b" + blanks, blanks], tx.strip(F.col("text"))) == ["a" + blanks + "b", ""]
    start = time.perf_counter()
    assert column(spark, [" " * 1_000_000], tx.strip(F.col("text"))) == [""]
    assert time.perf_counter() - start < 10


def test_wide_error_prefixes_are_a_choice(spark):
    wide = val.model_error(F.col("text"), fixed.MODEL_ERROR_PREFIXES_WIDE)
    assert column(spark, ["❌ x", "[!] x", "x"], wide) == [fixed.MODEL_ERROR_PREFIX] * 2 + [None]
    assert column(spark, ["❌ x"], val.model_error(F.col("text"))) == [None]


def test_shaping(spark):
    assert column(spark, ["  a b\n", "\u00a0x", " \n", None], tx.strip(F.col("text"))) == ["a b", "x", "", None]
    assert column(spark, ["a<b>&#*", None], tx.sanitize(F.col("text"))) == ["ab", ""]
    assert column(spark, ["x" * 500, "x" * 501], tx.preview(F.col("text"))) == ["x" * 500, "x" * 500 + "..."]
    assert column(spark, ["## a\n# b"], tx.trim_report(F.col("text"))) == ["a\nb"]
    assert column(spark, ["y" * 2001], tx.trim_report(F.col("text")))[0].endswith("\n\n" + fixed.REPORT_CUT_NOTE)
    assert column(spark, ["1234567.895", "0"], tx.money(F.col("text").cast("decimal(18,4)"))) == ["1,234,567.90", "0.00"]


def test_payload_and_markdown_sinks(spark, tmp_path):
    typed = pl.typed_payload(payloads(spark, [(1, '{"texto":"t","kpis":[{"id":"k","valor":1.5}]}')]))
    rep.write_payloads(typed.select("area", "schema_version", "texto_markdown", "kpis", "erro_llm"), str(tmp_path / "p"))
    back = spark.read.json(str(tmp_path / "p")).first()
    assert (back.document_version, back.area, back.payload.kpis[0].valor, back.payload.erro_llm) == ("1.1", "financeiro", "1.5", None)
    empty = spark.createDataFrame([(None,), ("",), ("ok",)], "markdown string")
    rep.write_markdown(empty, str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == [fixed.EMPTY_MARKDOWN] * 2 + ["ok"]


def test_lines_keep_their_order(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"line {i:04d}") for i in range(500)], "part int, line string").repartition(5, "line")
    rep.write_lines(lines, str(tmp_path / "l"), ["part"])
    files = sorted((tmp_path / "l").glob("part-*.txt"))
    assert "".join(f.read_text() for f in files).split() == " ".join(f"line {i:04d}" for i in range(500)).split()


# --- prompts and report choice -----------------------------------------------------------
def test_an_answer_beyond_the_limit_has_its_own_error(spark):
    """140 MB of JSON: neither invalid nor without an object."""
    large = F.concat(F.lit('{"a":['), F.repeat(F.lit('"' + "x" * 100 + '",'), F.lit(1_400_000)), F.lit("1]}"))
    small = F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), F.lit(1_000_000)), F.lit('"}'))
    df = spark.range(2).select("id", F.when(F.col("id") == 0, large).otherwise(small).alias("text"))
    got = {r["id"]: r["json_error"] for r in jt.with_json_object(df).select("id", "json_error").collect()}
    assert got == {0: fixed.JSON_ERRORS["too_large"], 1: None}


def payload_rows(spark):
    rows = [("r1", "estrategico", "c"), ("r1", "financeiro", 'a "q" {insights}'), ("r2", "operacional", None), ("r3", "outra", "x")]
    return spark.createDataFrame(rows, "run_id string, area string, body string")


def test_insights_of_a_run_are_one_document(spark):
    documents = pr.insights_documents(payload_rows(spark))
    prompts = pr.manager_prompts(documents, F.lit("Antes {x}\n{insights}\nDepois"))
    got = {r["run_id"]: r for r in prompts.collect()}
    assert set(got) == {"r1", "r2"}
    whole = json.loads(got["r1"]["insights"])
    assert list(whole) == fixed.AREAS and whole["operacional"] is None
    assert whole["financeiro"] == {"area": "financeiro", "body": 'a "q" {insights}'} and whole["estrategico"]["body"] == "c"
    assert json.loads(got["r2"]["insights"])["operacional"] == {"area": "operacional", "body": None}
    assert got["r1"]["prompt"] == "Antes {x}\n" + got["r1"]["insights"] + "\nDepois"
    with pytest.raises(Exception, match="insights"):
        pr.manager_prompts(documents, F.lit("sem marca")).collect()


def test_area_prompts_hold_the_bounded_sections(spark, facts):
    profile = prof.data_profile(facts)
    templates = spark.createDataFrame([("financeiro", "F:\n{dados}\n."), ("operacional", "{dados}")], "area string, template string")
    got = {r["area"]: r["prompt"] for r in pr.area_prompts(templates, profile).collect()}
    lines = got["operacional"].split("\n")
    assert got["financeiro"] == "F:\n" + got["operacional"] + "\n."
    assert lines[:3] == ["### Período", "- Anos: [2025, 2026]", "- Meses: [1, 2, 4]"]
    assert "### Clientes (4 identificados)" in lines and lines.index("### Colaboradores (4 identificados)") == lines.index("### Clientes (4 identificados)") + 1
    assert lines[lines.index("### Faturamento por Ano (soma)") + 1] == "- 2025 R$ 330.00"
    top = lines.index("### Top clientes por faturamento (até 15)")
    assert lines[top + 1] == "- Alfa R$ 217.00" and lines[top + 4] == "- Nula R$ 0.00"
    with pytest.raises(Exception, match="dados"):
        pr.area_prompts(spark.createDataFrame([("x", "sem marca")], "area string, template string"), profile).collect()


def test_report_choice(spark):
    whole = "\n".join(f"{level} {icon} {title}" for level, icon, title in fixed.REPORT_HEADINGS)
    rows = [(0, whole, None), (1, "x", whole), (2, "x", "y"), (3, "x", None), (4, None, whole), (5, "", whole), (6, " ", whole)]
    df = spark.createDataFrame(rows, "i int, first string, retry string").withColumn("asked", pr.retry_prompt(F.lit("P"), F.col("first")))
    got = {r["i"]: (r["source"], r["markdown"], r["asked"]) for r in pr.choose_report(df).collect()}
    note, asked = fixed.REPORT_BAD_FORMAT, "P" + fixed.REPORT_RETRY
    assert got == {
        0: ("first", whole, None), 1: ("retry", whole, asked + "x"), 2: ("note", note + "x", asked + "x"), 3: ("note", note + "x", asked + "x"),
        4: ("notice", fixed.REPORT_MISSING, None), 5: ("notice", fixed.REPORT_MISSING, None), 6: ("retry", whole, asked + " "),
    }


def test_later_attempts_are_reminded(spark):
    got = spark.range(1, 3).select(pr.attempt_prompt(F.lit("P"), F.col("id")).alias("p")).collect()
    assert [r["p"] for r in got] == ["P", "P" + fixed.CONTRACT_REMINDER]


def test_headings_are_found_in_one_pass_as_one_by_one(spark):
    source, titles = random.Random(5), fixed.REPORT_HEADINGS
    blanks = [" ", "  ", "\n", " \n\n ", " ", "\t", ""]
    pieces = [f"{level}{source.choice(blanks)}{icon}{source.choice(blanks)}{title}{source.choice(blanks)}" for level, icon, title in titles * 6]
    pieces += [f"# {title}" for _, _, title in titles] + ["texto", "# 🧭 Plano Executivo de Dashboard e mais", "\r", "x## 📈 KPIs Prioritários"]
    texts = [None, ""] + [source.choice(["\n", "\n\n", "\r\n", " "]).join(source.choices(pieces, k=source.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, markdown string")
    one_by_one = [
        F.when(~F.rlike(F.coalesce("markdown", F.lit("")), F.lit(fixed.regex(val.heading_pattern(*h), "mUd"))), F.lit(h[2])) for h in titles
    ]
    got = df.select(val.missing_headings(F.col("markdown")).alias("got"), F.array_compact(F.array(*one_by_one)).alias("want")).collect()
    assert all(r.got == r.want for r in got) and len({tuple(r.got) for r in got}) > 20


def test_report_texts_are_spread_and_searched_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"c{i}", 1.5, "S") for i in range(20)], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = driver_tables.reports(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and got.count() == 20
    chosen = pr.choose_report(got.select(F.col("markdown").alias("first"), F.upper("markdown").alias("retry")))
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    # One search of each text, of all headings at once.
    assert plan.count("Objetivo do Dashboard|") == 2


def test_cited_figures_of_repeated_rows_and_without_signs(spark):
    profile = spark.createDataFrame([("s", "a", 10.0)], "section string, key string, value double")
    given = [("a", "R$ 10 e 3%"), ("a", "R$ 10"), (None, "9% R$ 10"), ("b", "1" * 100_000), ("c", None)]
    df = spark.createDataFrame(given, "response_id string, text string")
    got = cited.cited_in_profile(df, profile)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 2, 1, False), ("b", 0, 0, True), ("c", 0, 0, True), (None, 2, 1, False)]
    assert [t for _, t in got.dtypes] == ["string", "int", "int", "boolean"]


def test_the_profile_is_rolled_up_once(spark, make_facts):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    facts = make_facts([(2025, 1, f"c{i}", "p", str(i)) for i in range(10)])
    profile = prof.data_profile(facts.mapInArrow(counted, facts.schema), facts)
    assert profile.where("section = 'clientes'").count() == 10 and profile.where("section = 'top_clientes'").count() == 10
    assert read.value == 10
