import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from faturalens.functions import fixed
from faturalens.operators import validation as val, warninglog as wl
from faturalens.sources import json_split, warning_log as src
from faturalens.sources.headers import settings


def record(area, warnings, errors=(), stamp="2026-03-19T07:48:59.050758"):
    return {
        "timestamp": stamp, "assistente": area, "quantidade_avisos": len(warnings), "quantidade_erros": len(errors),
        "avisos": list(warnings), "erros": list(errors), "tamanho_resposta": 9, "primeiras_100_chars": "texto",
    }


def name(i):
    return f"Cliente/Empresa 'nome {i}' não encontrado na planilha"


def golden():
    """42 records with the counts of the stored log: 19, 5 and 22 warnings over 14 runs each."""
    items = []
    for area, total, errors in (("financeiro", 19, 2), ("operacional", 5, 1), ("estrategico", 22, 1)):
        for run in range(14):
            warnings = [name(k) for k in range(run, total, 14)]
            items.append(record(area, warnings, ["e"] if run < errors else [], f"2026-03-19T{run:02d}:00:00"))
    return items


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2))


def test_load_list_envelope_and_anything_else(spark, tmp_path):
    write(tmp_path / "a.json", [record("financeiro", [name(1)])])
    write(tmp_path / "b.json", {"schema_version": "1.0", "items": [record("operacional", []), record("estrategico", [])]})
    write(tmp_path / "c.json", {"items": {"x": 1}})
    write(tmp_path / "d.json", "[{broken")
    write(tmp_path / "e.json", "[]")
    write(tmp_path / "f.json", record("financeiro", []))
    got = src.load_log(spark, str(tmp_path))
    assert sorted(r.assistente for r in got.collect()) == ["estrategico", "financeiro", "operacional"]
    assert [t for _, t in got.dtypes] == ["string", "string", "int", "int", "array<string>", "array<string>", "int", "string"]


def ranges_of(spark, size):
    """Byte ranges of about this size for what is read inside."""
    return settings(spark, spark__sql__files__maxPartitionBytes=str(size), spark__sql__files__openCostInBytes="1")


def odd_value(rng, depth=0):
    """Strings that look like structure, and structure of any kind."""
    text = "".join(rng.choices(['"', "\\", "{", "}", "[", "]", '"items":[', "é", "\n", ",", "a"], k=rng.randint(0, 9)))
    pick = rng.random()
    if depth > 2 or pick < 0.5:
        return text
    if pick < 0.75:
        return {rng.choice(["items", "k", text]): odd_value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def plain_records(text):
    try:
        whole = json.loads(text)
    except ValueError:
        return []
    listed = whole.get("items") if isinstance(whole, dict) else whole
    return [r for r in listed if isinstance(r, dict)] if isinstance(listed, list) else []


@pytest.mark.parametrize(("size", "count"), [(30, 8), (200, 40), (10**6, 40)])
def test_records_equal_a_parser_however_documents_are_cut(spark, tmp_path, size, count):
    rng = random.Random(4)
    want = []
    for i in range(count):
        items = [odd_value(rng) for _ in range(rng.randint(0, 8))]
        shape = rng.choice(["list", "object", "object", "neither"])
        whole = {
            "list": items, "neither": {"other": items, "x": {"items": items}},
            "object": dict(rng.sample([("items", items), ("meta", [{"a": 1}, {"b": {"c": [{}]}}]), ("more", {"x": {"y": 1}, "items": [{"no": 1}]}), ("n", 1)], 4)),
        }[shape]
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        text = rng.choice([text, text, text + "\n", "\n " + text, text[:-1], text[: len(text) // 2]])
        (tmp_path / f"{i}.json").write_text(text)
        want += plain_records(text)
    with ranges_of(spark, size):
        got = [json.loads(r.text) for r in json_split.records(spark, str(tmp_path)).collect()]
    order = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert order(got) == order(want)


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    """30 MB in one line; ranges of 2 MB, none of them without records."""
    one = json.dumps(record("financeiro", [name(1)] * 20, [], "%07d"), ensure_ascii=False)
    count = 30_000_000 // len(one)
    (tmp_path / "log.json").write_text('{"schema_version":"1.0","items":[' + ",".join(one % i for i in range(count)) + "]}")
    with ranges_of(spark, 2_000_000):
        log = src.load_log(spark, str(tmp_path / "log.json"))
        assert json_split.pieces(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() >= 10
    assert log.agg(F.count("*"), F.countDistinct("timestamp"), F.max("timestamp"), F.sum(F.size("avisos"))).first()[:] == (count, count, f"{count - 1:07d}", 20 * count)


def test_many_ranges_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    (tmp_path / "log.json").write_text(json.dumps([record("financeiro", [name(i)], [], str(i)) for i in range(300)]))
    monkeypatch.setattr(json_split, "MOST_SENT", 0)
    with ranges_of(spark, 700):
        assert sorted(int(r.timestamp) for r in src.load_log(spark, str(tmp_path)).collect()) == list(range(300))


def load_golden(spark, tmp_path):
    write(tmp_path / "log.json", {"schema_version": "1.0", "items": golden()})
    return src.load_log(spark, str(tmp_path / "log.json"))


def test_golden_counts(spark, tmp_path):
    log = load_golden(spark, tmp_path)
    runs = {r.assistente: (r.execucoes, round(r.media_avisos, 1)) for r in wl.runs_per_assistant(log).collect()}
    assert runs == {"financeiro": (14, 1.4), "operacional": (14, 0.4), "estrategico": (14, 1.6)}
    assert rows(wl.class_counts(log)) == [(fixed.CLASS_CLIENT, 46)]
    assert [r.number for r in wl.suggestions(log).orderBy("number").collect()] == [1, 3]
    assert rows(wl.client_warning_total(log)) == [(46,)]
    assert wl.first_client_warnings(log).count() == 5


def test_report_lines(spark, tmp_path):
    lines = wl.log_report(load_golden(spark, tmp_path), F.lit("2026-03-20 10:00:00").cast("timestamp"))
    text = [r.line for r in lines.orderBy("part", "rank", "place").collect()]
    assert text[:3] == ["# RELATÓRIO DE AVISOS E PADRÕES", "Data: 2026-03-20T10:00:00", "Total de execuções analisadas: 42"]
    assert text[4:7] == ["### ESTRATEGICO", "- Execuções: 14", "- Média de avisos por execução: 1.6"]
    assert f"- {fixed.CLASS_CLIENT}: 46 ocorrências" in text
    assert "## Falsos Positivos Detectados (46)" in text
    assert text[-2:] == ["- " + fixed.SUGGESTIONS[0][2], "- " + fixed.SUGGESTIONS[2][2]]


def test_report_of_an_empty_log(spark, tmp_path):
    write(tmp_path / "log.json", "[]")
    lines = wl.log_report(src.load_log(spark, str(tmp_path))).orderBy("part", "rank", "place")
    assert [r.line for r in lines.collect()][-2:] == ["## Avisos por Assistente", "## Tipos de Aviso Mais Comuns"]


def test_classes(spark):
    texts = [name(1), "AVISO: referência a 2024 que não existe", "Menção a 2027", "AVISO: outra", "referência solta"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(wl.warning_class(F.col("t")), wl.warning_class_short(F.col("t"))).collect()
    assert [r[0] for r in got] == [fixed.CLASS_CLIENT, fixed.CLASS_REFERENCE, fixed.CLASS_YEAR, fixed.CLASS_OTHER, fixed.CLASS_OTHER]
    assert [r[1] for r in got] == [fixed.CLASS_CLIENT, fixed.CLASS_REFERENCE, fixed.CLASS_OTHER, fixed.CLASS_OTHER, fixed.CLASS_REFERENCE]


def verdict_rows(spark, stamp):
    df = spark.createDataFrame(
        [("a", "financeiro", ["w"], [], 150, "x" * 100)],
        "response_id string, area string, warnings array<string>, errors array<string>, text_length int, text_head string",
    )
    return wl.log_records(df, F.lit(stamp).cast("timestamp"))


def test_append_keeps_earlier_records(spark, tmp_path):
    path = str(tmp_path / "log")
    src.append_log(verdict_rows(spark, "2026-01-01 10:00:00"), path)
    src.append_log(verdict_rows(spark, "2026-01-02 10:00:00"), path)
    log = src.read_log(spark, path)
    assert sorted(r.timestamp for r in log.collect()) == ["2026-01-01T10:00:00.000000", "2026-01-02T10:00:00.000000"]
    assert rows(wl.runs_per_assistant(log)) == [("financeiro", 2, 1.0)]
    assert rows(log.select("tamanho_resposta", "quantidade_avisos", "quantidade_erros").distinct()) == [(150, 1, 0)]


def test_text_figures(spark):
    df = spark.createDataFrame([("r", "é" * 120)], "response_id string, text string")
    row = wl.with_text_figures(val.answers(df)).first()
    assert (row.text_length, row.text_head) == (120, "é" * 100)


def test_the_report_reads_its_log_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    kind = "timestamp string, assistente string, quantidade_avisos int, avisos array<string>, primeiras_100_chars string"
    given = [(f"t{i}", "ab"[i % 2], 2, [name(i), "AVISO: referência a 2024"], "x") for i in range(20)]
    log = spark.createDataFrame(given, kind).mapInArrow(counted, kind)
    lines = [r.line for r in wl.log_report(log, F.lit("2026-01-01").cast("timestamp")).collect()]
    assert read.value == 20
    assert "Total de execuções analisadas: 20" in lines and "## Falsos Positivos Detectados (20)" in lines
    assert sum(line.startswith("- Cliente/Empresa") for line in lines) == 5
