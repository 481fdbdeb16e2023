import pytest

from faturalens.operators import warninglog as wl
from faturalens.streaming.answers import checkpoint_of, log_answers


def test_stream_of_answers_becomes_the_log(spark, facts, tmp_path):
    schema = "response_id string, area string, text string"
    source, log, mark = (str(tmp_path / n) for n in ("in", "log", "mark"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = log_answers(stream, facts.select("year"), facts.select("client"), log, mark)
        query.awaitTermination(120)
        query.stop()

    arrive(("a", "financeiro", "Em 2024 o cliente Zeta, subiu"), ("b", "financeiro", None))
    arrive(("c", "operacional", "cliente Alfa, subiu"), ("d", "operacional", "❌ erro"))
    got = spark.read.parquet(log)
    assert {(r.assistente, r.quantidade_avisos, r.quantidade_erros) for r in got.collect()} == {
        ("financeiro", 1, 1),
        ("operacional", 0, 0),
    }
    # A failed call's text is an answer and is logged; a null one isn't.
    assert {r.assistente: r.execucoes for r in wl.runs_per_assistant(got).collect()} == {"financeiro": 1, "operacional": 2}
    arrive(("c", "operacional", "cliente Alfa, subiu"))
    assert spark.read.parquet(log).count() == 4
    with pytest.raises(ValueError, match="checkpoint"):
        log_answers(spark.readStream.schema(schema).parquet(source), facts.select("year"), facts.select("client"), log, str(tmp_path / "new"))


def test_two_logs_have_checkpoints_of_their_own():
    assert checkpoint_of("/shared/", "/logs/a/") == checkpoint_of("/shared", "/logs/a")
    assert checkpoint_of("/shared", "/logs/a") != checkpoint_of("/shared", "/logs/b")
