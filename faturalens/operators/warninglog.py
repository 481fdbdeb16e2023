"""The warning log and what can be read out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faturalens.functions import fixed
from faturalens.plans.shared import written


def log_records(verdict: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Log records out of verdicts carrying `area`, `text_length` and `text_head`."""
    stamp = F.current_timestamp() if stamp is None else stamp
    return verdict.select(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("area").alias("assistente"),
        F.size("warnings").alias("quantidade_avisos"),
        F.size("errors").alias("quantidade_erros"),
        F.col("warnings").alias("avisos"),
        F.col("errors").alias("erros"),
        F.col("text_length").alias("tamanho_resposta"),
        F.col("text_head").alias("primeiras_100_chars"),
    )


def with_text_figures(df: DataFrame) -> DataFrame:
    """Length and first characters of the text, for the log, in place of the text."""
    return (
        df.withColumn("text_length", F.length("text"))
        .withColumn("text_head", F.left("text", F.lit(fixed.LOG_HEAD_LENGTH)))
        .drop("text")
    )


# --- classes -------------------------------------------------------------------------------
def warning_class(warning: Column) -> Column:
    """Four classes, the first that fits."""

    def has(*parts: str) -> Column:
        found = F.lit(True)
        for part in parts:
            found = found & F.contains(warning, F.lit(part))
        return found

    year = has(fixed.CLASS_YEARS[0]) | has(fixed.CLASS_YEARS[1])
    return (
        F.when(has("Cliente/Empresa", "não encontrado"), fixed.CLASS_CLIENT)
        .when(has("referência a"), fixed.CLASS_REFERENCE)
        .when(year, fixed.CLASS_YEAR)
        .otherwise(fixed.CLASS_OTHER)
    )


def warning_class_short(warning: Column) -> Column:
    """The three classes the suggestions are counted by."""
    return (
        F.when(F.contains(warning, F.lit("Cliente/Empresa")), fixed.CLASS_CLIENT)
        .when(F.contains(warning, F.lit("referência")), fixed.CLASS_REFERENCE)
        .otherwise(fixed.CLASS_OTHER)
    )


def logged_warnings(log: DataFrame) -> DataFrame:
    """One row per warning with its class."""
    return log.select("timestamp", "assistente", F.posexplode("avisos").alias("position", "aviso")).withColumn(
        "tipo", warning_class(F.col("aviso"))
    )


def runs_per_assistant(log: DataFrame) -> DataFrame:
    return log.groupBy("assistente").agg(
        F.count(F.lit(1)).alias("execucoes"),
        (F.sum("quantidade_avisos").cast("double") / F.count(F.lit(1))).alias("media_avisos"),
    )


def class_counts(log: DataFrame) -> DataFrame:
    counted = logged_warnings(log).groupBy("tipo").agg(F.count(F.lit(1)).alias("ocorrencias"))
    return counted.orderBy(F.desc("ocorrencias"), "tipo")


def client_warning_total(log: DataFrame) -> DataFrame:
    return logged_warnings(log).agg(F.count(F.when(F.col("tipo") == fixed.CLASS_CLIENT, 1)).alias("total"))


def first_client_warnings(log: DataFrame, n: int = 5) -> DataFrame:
    rows = logged_warnings(log).where(F.col("tipo") == fixed.CLASS_CLIENT)
    return rows.orderBy("timestamp", "position", "aviso").limit(n).select("timestamp", "position", "aviso")


def suggestions(log: DataFrame) -> DataFrame:
    """The suggestions whose threshold is exceeded, one row each."""
    short = warning_class_short(F.col("aviso"))
    counts = log.select(F.explode("avisos").alias("aviso")).agg(
        F.count(F.when(short == fixed.CLASS_CLIENT, 1)).alias("client"),
        F.count(F.when(short == fixed.CLASS_REFERENCE, 1)).alias("reference"),
        F.count(F.lit(1)).alias("total"),
    )
    rules = [
        F.when(F.col(name) > limit, F.struct(F.lit(i).alias("number"), F.lit(text).alias("suggestion")))
        for i, (name, limit, text) in enumerate(fixed.SUGGESTIONS, start=1)
    ]
    return counts.select(F.inline(F.array_compact(F.array(*rules))))


def tally(log: DataFrame) -> DataFrame:
    """Everything the report counts, overall, per assistant and per class, in one pass.

    An empty log still has its overall row, with zeros.
    """
    aviso, tipo = F.col("aviso"), F.col("tipo")
    rows = log.select("assistente", "quantidade_avisos", F.posexplode_outer("avisos").alias("position", "aviso"))
    # A run is counted at its first row, also when it has no warning.
    first = (F.coalesce("position", F.lit(0)) == 0).cast("bigint")
    kinds = rows.groupBy(
        "assistente",
        F.when(aviso.isNotNull(), warning_class(aviso)).alias("tipo"),
        F.when(aviso.isNotNull(), warning_class_short(aviso)).alias("short"),
    ).agg(
        F.sum(first).alias("runs"),
        F.sum(first * F.col("quantidade_avisos")).alias("listed"),
        F.count("aviso").alias("warnings"),
    )
    seed = log.sparkSession.range(1).selectExpr(
        "cast(null as string) assistente", "cast(null as string) tipo", "cast(null as string) short",
        "0L runs", "0L listed", "0L warnings",
    )

    def at(level: str, name: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), name.alias("name"))

    levels = F.array(at("all", F.lit("")), at("assistant", F.col("assistente")), at("class", tipo))

    def warnings_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("warnings"))), F.lit(0))

    return (
        kinds.unionByName(seed)
        .withColumn("_at", F.explode(levels))
        .where("_at.name is not null")
        .groupBy("_at")
        .agg(
            F.sum("runs").alias("runs"),
            F.sum("listed").alias("listed"),
            F.sum("warnings").alias("total"),
            warnings_where(tipo == fixed.CLASS_CLIENT).alias("client_class"),
            warnings_where(F.col("short") == fixed.CLASS_CLIENT).alias("client"),
            warnings_where(F.col("short") == fixed.CLASS_REFERENCE).alias("reference"),
        )
        .select("_at.*", "runs", "listed", "total", "client_class", "client", "reference")
    )


def log_report(log: DataFrame, stamp: Column | None = None, n: int = 5) -> DataFrame:
    """The report as lines `(part, rank, place, line)`, to be ordered by the first three.

    What the report needs of the log is written first: counts and examples need different columns of
    it, so that no step of the checks behind a log would be shared between them.
    """
    stamp = F.current_timestamp() if stamp is None else stamp
    log = written(log.select("timestamp", "assistente", "quantidade_avisos", "avisos"))
    name, total = F.col("name"), F.col("total").cast("string")

    def line(part: int, text: Column, rank: Column | int = 0, place: Column | str = "") -> Column:
        rank = F.lit(rank) if isinstance(rank, int) else rank
        place = F.lit(place) if isinstance(place, str) else place
        return F.struct(
            F.lit(part).alias("part"), rank.cast("double").alias("rank"), place.alias("place"), text.alias("line")
        )

    over = [F.col(measure) > limit for measure, limit, _ in fixed.SUGGESTIONS]
    overall = [
        line(0, F.lit("# RELATÓRIO DE AVISOS E PADRÕES"), 0),
        line(0, F.concat(F.lit("Data: "), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")), 1),
        line(0, F.concat(F.lit("Total de execuções analisadas: "), F.col("runs").cast("string")), 2),
        line(0, F.lit("## Avisos por Assistente"), 3),
        line(2, F.lit("## Tipos de Aviso Mais Comuns")),
        F.when(
            F.col("client_class") > 0,
            line(4, F.concat(F.lit("## Falsos Positivos Detectados ("), F.col("client_class").cast("string"), F.lit(")"))),
        ),
        F.when(over[0] | over[1] | over[2], line(6, F.lit("## SUGESTÕES DE MELHORIA"))),
        *[
            F.when(above, line(7, F.lit(f"- {text}"), i))
            for i, (above, (_, _, text)) in enumerate(zip(over, fixed.SUGGESTIONS), start=1)
        ],
    ]
    # Rounded half to even on the binary value: 0.25 shows as 0.2.
    mean = F.call_function("format_number", F.col("listed") / F.greatest("runs", F.lit(1)), F.lit("0.0"))
    per_assistant = [
        line(1, F.concat(F.lit("### "), F.upper(name)), 0, F.concat(name, F.lit("/0"))),
        line(1, F.concat(F.lit("- Execuções: "), F.col("runs").cast("string")), 0, F.concat(name, F.lit("/1"))),
        line(1, F.concat(F.lit("- Média de avisos por execução: "), mean), 0, F.concat(name, F.lit("/2"))),
    ]
    per_class = [
        line(3, F.concat(F.lit("- "), name, F.lit(": "), total, F.lit(" ocorrências")), -F.col("total"), name)
    ]
    at = F.col("level")
    chosen = F.when(at == "all", F.array(*overall)).when(at == "assistant", F.array(*per_assistant))
    counted = tally(log).select(F.inline(F.array_compact(chosen.otherwise(F.array(*per_class)))))
    order = F.concat("timestamp", F.lit("/"), F.format_string("%06d", "position"), F.lit("/"), "aviso")
    examples = first_client_warnings(log, n).select(
        F.inline(F.array(line(5, F.concat(F.lit("- "), "aviso"), 0, order)))
    )
    return counted.unionByName(examples)
