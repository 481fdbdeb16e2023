"""The data profile: every aggregate the reports are allowed to quote.

One pass over the billing table feeds all sums: two grouping sets are aggregated once, and
the finer sections are rolled up from that result. That is written, one row per name and month,
and all sections are read from it. Only the median reads the amounts again.

Rows are `(section, key, value)`; lists of names are rows too, never one long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faturalens.functions.text import fill_template, listing, money
from faturalens.plans.running import median
from faturalens.plans.shared import written

TOP = 15
NAME_SECTIONS = ["clientes", "colaboradores"]
PERIOD_SECTIONS = ["anos", "meses"]


def row_sums() -> dict[str, Column]:
    """What is summed up of billing rows."""
    return {
        "records": F.count(F.lit(1)),
        "revenue": F.sum("amount"),
        "amounts": F.count("amount"),
        "lowest": F.min("amount"),
        "highest": F.max("amount"),
    }


def part_sums() -> dict[str, Column]:
    """How sums of parts of the rows are put together."""
    return {name: (F.min if name == "lowest" else F.max if name == "highest" else F.sum)(name) for name in row_sums()}


CLIENT_SET = 14  # year, month and collaborator folded away


def _fine(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Measures per year, month and collaborator, and per client; `_set` tells them apart."""
    return rows.groupingSets(
        [["year", "month", "collaborator"], ["client"]], "year", "month", "collaborator", "client"
    ).agg(F.grouping_id().cast("int").alias("_set"), *[value.alias(name) for name, value in sums.items()])


def _levels(fine: DataFrame) -> DataFrame:
    """Measures per month, year, client, collaborator and overall, written; `fine` has each of its keys once."""

    def level(name: str, year=None, month=None, key=None) -> Column:
        return F.struct(
            F.lit(name).alias("level"),
            F.lit(year).cast("int").alias("year") if year is None else F.col(year).alias("year"),
            F.lit(month).cast("int").alias("month") if month is None else F.col(month).alias("month"),
            F.lit(key).cast("string").alias("name") if key is None else F.col(key).alias("name"),
        )

    by_client = F.array(level("client", key="client"))
    others = F.array(
        level("month", "year", "month"),
        level("year", "year"),
        level("calendar_month", month="month"),
        level("collaborator", key="collaborator"),
        level("all"),
    )
    placed = fine.withColumn("_at", F.explode(F.when(F.col("_set") == CLIENT_SET, by_client).otherwise(others)))
    complete = (
        F.when(F.col("_at.level") == "month", F.col("_at.year").isNotNull() & F.col("_at.month").isNotNull())
        .when(F.col("_at.level") == "year", F.col("_at.year").isNotNull())
        .when(F.col("_at.level") == "calendar_month", F.col("_at.month").isNotNull())
        .when(F.col("_at.level") == "all", F.lit(True))
        .otherwise(F.col("_at.name").isNotNull())
    )
    # A profile of nothing still has its totals and its counts of names, which are zero.
    zeros = fine.sparkSession.range(1).select(
        F.explode(F.array(*[level(name) for name in ("all", "client", "collaborator")])).alias("_at"),
        *[F.lit(0).cast(kind).alias(name) for name, kind in (("records", "long"), ("amounts", "long"))],
    )
    return written(
        placed.where(complete)
        .unionByName(zeros, allowMissingColumns=True)
        .groupBy("_at")
        .agg(
            F.sum("records").alias("records"),
            F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(38,4)").alias("revenue"),
            F.sum("amounts").alias("amounts"),
            F.min("lowest").alias("lowest"),
            F.max("highest").alias("highest"),
            F.count("collaborator").alias("people"),
        )
        .select("_at.*", "records", "revenue", "amounts", "lowest", "highest", "people")
    )


def _entry(section: str | Column, key: Column, value: Column, when: Column) -> Column:
    section = F.lit(section) if isinstance(section, str) else section
    return F.when(
        when, F.struct(section.alias("section"), key.alias("key"), value.cast("double").alias("value"))
    )


def _entries(rows: DataFrame, *entries: Column) -> DataFrame:
    return rows.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def data_profile(facts: DataFrame, amounts: DataFrame | None = None, exact_median: bool = True) -> DataFrame:
    """Sections, keys and values of the whole profile.

    `amounts` may give the amount column by itself when `facts` is a join, so that the median
    does not repeat the join.
    """
    amounts = facts if amounts is None else amounts
    middle = median(amounts, "amount") if exact_median else amounts.agg(
        F.percentile_approx("amount", 0.5, 10000).cast("double").alias("median")
    )
    return _sections(_levels(_fine(facts, row_sums())), middle)


def _sections(levels: DataFrame, middle: DataFrame) -> DataFrame:
    """The profile from the measures of all levels and the one row of the median."""
    at, name = F.col("level"), F.col("name")
    month_key = F.format_string("%04d-%02d", "year", "month")
    year_key = F.format_string("%04d", "year")

    def one(key: str, value: str | Column) -> Column:
        return _entry("total", F.lit(key), F.col(value) if isinstance(value, str) else value, at == "all")

    mean = F.col("revenue").cast("double") / F.nullif(F.col("amounts"), F.lit(0))
    plain = _entries(
        levels,
        _entry("anos", year_key, F.col("year"), at == "year"),
        _entry("meses", F.format_string("%02d", "month"), F.col("month"), at == "calendar_month"),
        _entry("registros", month_key, F.col("records"), at == "month"),
        _entry("ativos", month_key, F.col("people"), at == "month"),
        _entry("faturamento_mes", month_key, F.col("revenue"), at == "month"),
        _entry("faturamento_ano", year_key, F.col("revenue"), at == "year"),
        _entry("clientes", name, F.col("revenue"), (at == "client") & name.isNotNull()),
        _entry("colaboradores", name, F.col("revenue"), (at == "collaborator") & name.isNotNull()),
        one("registros", "records"),
        one("minimo", "lowest"),
        one("maximo", "highest"),
        one("soma", "revenue"),
        one("media", mean),
    )

    def first(measure: str, wanted: list[str]) -> DataFrame:
        # The rank filter keeps TOP rows per level in every task before they move.
        order = Window.partitionBy("level").orderBy(F.desc(measure), "name")
        return levels.where(at.isin(wanted) & name.isNotNull()).withColumn("_rank", F.row_number().over(order)).where(f"_rank <= {TOP}")

    by_revenue = _entries(
        first("revenue", ["client", "collaborator"]),
        _entry("top_clientes", name, F.col("revenue"), at == "client"),
        _entry("top_colaboradores", name, F.col("revenue"), at == "collaborator"),
    )
    by_records = _entries(first("records", ["collaborator"]), _entry("top_registros", name, F.col("records"), F.lit(True)))
    counts = levels.where(at.isin("client", "collaborator")).groupBy("level").agg(F.count("name").alias("n"))
    counted = _entries(
        counts,
        _entry("identificados", F.lit("clientes"), F.col("n"), at == "client"),
        _entry("identificados", F.lit("colaboradores"), F.col("n"), at == "collaborator"),
    )
    middle = middle.select(
        F.lit("total").alias("section"), F.lit("mediana").alias("key"), F.col("median").alias("value")
    )
    return plain.unionByName(by_revenue).unionByName(by_records).unionByName(counted).unionByName(middle)


# --- fixed values: headings of the text form, in order -------------------------------
HEADINGS = [
    ("periodo", "### Período"),
    ("clientes", "### Clientes"),
    ("colaboradores", "### Colaboradores"),
    ("registros", "### Registros por Ano e Mês (contagem)"),
    ("ativos", "### Colaboradores ativos por Ano e Mês (contagem distinta)"),
    ("total", "### Faturamento (vlrfaturamento)"),
    ("faturamento_ano", "### Faturamento por Ano (soma)"),
    ("faturamento_mes", "### Faturamento por Mês e Ano (soma)"),
    ("top_clientes", "### Top clientes por faturamento (até 15)"),
    ("top_colaboradores", "### Top colaboradores por faturamento (até 15)"),
    ("top_registros", "### Top colaboradores por quantidade de registros (até 15)"),
]
COUNT_SECTIONS = ["registros", "ativos", "top_registros"]


def profile_lines(profile: DataFrame) -> DataFrame:
    """The profile as text lines `(part, place, rank, line)`, to be ordered by the first three.

    The name lists stay one name per line, so that no task holds a whole list.
    """
    spark = profile.sparkSession
    headings = [(i, section, heading) for i, (section, heading) in enumerate(HEADINGS)]
    titles = spark.createDataFrame(headings, "part int, section string, heading string")
    section, value = F.col("section"), F.col("value")
    is_count = section.isin(COUNT_SECTIONS) | ((section == "total") & (F.col("key") == "registros"))
    shown = (
        F.when(section.isin(NAME_SECTIONS), F.col("key"))
        .when(is_count, F.concat_ws(" ", "key", F.format_number(value, 0)))
        .otherwise(F.concat(F.col("key"), F.lit(" R$ "), money(value)))
    )
    rank = F.when(F.startswith(section, F.lit("top_")), -value).otherwise(F.lit(0.0))
    # The heading table is fixed and tiny, whatever the size of the profile.
    body = profile.join(F.broadcast(titles), "section").select(
        "part", rank.alias("rank"), F.col("key").alias("place"), F.concat(F.lit("- "), shown).alias("line")
    )
    # Years and months are bounded by the calendar: one line holds each list.
    listed = F.transform(F.sort_array(F.collect_list("value")), lambda v: v.cast("int"))
    period = profile.where(section.isin(PERIOD_SECTIONS)).groupBy("section").agg(
        F.concat(F.lit("- "), F.initcap(F.first("section")), F.lit(": "), listing(listed)).alias("line")
    )
    period = period.select(F.lit(0).alias("part"), F.lit(0.0).alias("rank"), F.col("section").alias("place"), "line")
    counts = profile.where("section = 'identificados'").select(
        F.col("key").alias("section"), F.format_number("value", 0).alias("n")
    )
    heads = titles.join(counts, "section", "left").select(
        "part",
        F.lit(None).cast("double").alias("rank"),
        F.lit(None).cast("string").alias("place"),
        F.concat("heading", F.coalesce(F.concat(F.lit(" ("), "n", F.lit(" identificados)")), F.lit(""))).alias("line"),
    )
    return heads.unionByName(period).unionByName(body)


def prompt_by_key(template: Column, marker: str, facts: DataFrame, key: str) -> DataFrame:
    """One filled template per key value, holding that key's monthly revenue.

    The text of a key is bounded by the calendar: one line per month.
    """
    line = F.format_string("%04d-%02d R$ %s", "year", "month", money(F.col("revenue")))
    monthly = (
        facts.where(F.col(key).isNotNull() & F.col("year").isNotNull() & F.col("month").isNotNull())
        .groupBy(key, "year", "month")
        .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("revenue"))
    )
    text = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("year", "month", line.alias("line")))), lambda e: e["line"]))
    return monthly.groupBy(key).agg(text.alias("_text")).select(
        key, fill_template(template, marker, F.col("_text")).alias("prompt")
    )
