"""Checks of report texts against the billing facts.

`responses` has `response_id` (unique), `text` and any other columns. Everything that
needs only the text and the calendar is computed row by row; the calendar reaches the rows
as one bounded array. Client names are joined, since their number grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from faturalens.functions import fixed
from faturalens.functions.once import let, with_once
from faturalens.functions.text import is_blank, listing, strip


# --- model errors ------------------------------------------------------------------------
def model_error(text: Column, prefixes: list[str] | None = None) -> Column:
    """Why a row holds no answer; null for a real one.

    A text that the model client marked as failed is an answer by default: it is checked,
    logged and tried again. `fixed.MODEL_ERROR_PREFIXES_WIDE` treats it as an error.
    """
    prefixed = F.lit(False)
    for prefix in fixed.MODEL_ERROR_PREFIXES if prefixes is None else prefixes:
        prefixed = prefixed | F.startswith(text, F.lit(prefix))
    return F.when(text.isNull(), F.lit(fixed.MODEL_ERROR_NULL)).when(prefixed, F.lit(fixed.MODEL_ERROR_PREFIX))


def answers(responses: DataFrame) -> DataFrame:
    """The rows that hold a real answer; only these are checked and logged."""
    return responses.where(model_error(F.col("text")).isNull())


# --- years ---------------------------------------------------------------------------------
def year_mentions(text: Column, pattern: str = fixed.YEAR_PATTERN) -> Column:
    """Distinct years named in the text, as written, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.regex(pattern, "Ud")), F.lit(1)))


def unknown_years(responses: DataFrame, known_years: DataFrame, pattern: str = fixed.YEAR_PATTERN) -> DataFrame:
    """Rows `(response_id, year)` for every named year that the facts do not have."""
    named = answers(responses).select(
        "response_id", F.explode(year_mentions(F.col("text"), pattern)).alias("year")
    )
    named = named.withColumn("year", F.col("year").cast("int"))
    return named.join(known_years.select("year"), "year", "left_anti").select("response_id", "year")


def year_errors(text: Column, known_years: Column, pattern: str = fixed.YEAR_PATTERN) -> Column:
    """The same inside one row, as messages; `known_years` is an array."""
    missing = F.filter(year_mentions(text, pattern), lambda y: ~F.array_contains(known_years, y.cast("int")))
    known = listing(known_years)
    return F.transform(
        missing,
        lambda y: F.concat(
            F.lit("Menção a ano "), y, F.lit(" que não existe nos dados (anos disponíveis: "), known, F.lit(")")
        ),
    )


def holds_any(text: Column, pieces: list[str]) -> Column:
    """A plain search that rules most texts out before a pattern is tried."""

    def found(lowered: Column) -> Column:
        return reduce(lambda left, piece: left | F.contains(lowered, F.lit(piece)), pieces, F.lit(False))

    return let(F.lower(text), found)


# --- clients ---------------------------------------------------------------------------------
def entity_names(text: Column) -> Column:
    """Names the text calls a client or company, in pattern order, repeats kept."""
    first, second, third = [
        F.regexp_extract_all(text, F.lit(fixed.regex(p)), F.lit(1)) for p in fixed.ENTITY_PATTERNS
    ]
    # The third pattern is slow on long texts without punctuation, so a plain search goes first.
    may_match = holds_any(text, fixed.ENTITY_PATTERN_3_PIECES)
    third = F.when(may_match, third).otherwise(F.array().cast("array<string>"))
    trimmed = F.transform(F.concat(first, second, third), strip)
    return F.filter(
        trimmed,
        lambda name: (F.length(name) > fixed.ENTITY_MIN_LENGTH) & ~name.isin(fixed.ENTITY_STOP_WORDS),
    )


def entity_mentions(responses: DataFrame) -> DataFrame:
    """Rows `(response_id, position, name)`."""
    return answers(responses).select(
        "response_id", F.posexplode(entity_names(F.col("text"))).alias("position", "name")
    )


def client_names(clients: DataFrame) -> DataFrame:
    """Distinct lower-case names, the lookup side of the checks."""
    return clients.where("client is not null").select(F.lower("client").alias("known_name")).distinct()


def unknown_entities(responses: DataFrame, clients: DataFrame) -> DataFrame:
    """Mentions whose name, in lower case, is no client.

    No broadcast is asked for: the planner broadcasts the names when their measured size
    allows it, and otherwise splits hot names of the mention side.
    """
    mentions = entity_mentions(responses)
    return mentions.join(
        client_names(clients), F.lower("name") == F.col("known_name"), "left_anti"
    )


def entity_warning(name: Column) -> Column:
    return F.concat(F.lit("Cliente/Empresa '"), name, F.lit("' não encontrado na planilha"))


# --- phrases -----------------------------------------------------------------------------------
def phrase_matches(text: Column) -> list[Column]:
    """One truth value for each phrase rule."""
    rules = zip(fixed.PHRASE_PIECES, fixed.PHRASE_RULES)
    return [
        holds_any(text, [piece]) & F.rlike(text, F.lit(fixed.regex(pattern))) for piece, (pattern, _) in rules
    ]


def phrase_warnings(text: Column) -> Column:
    """One warning for each phrase rule that matches."""
    matched = zip(phrase_matches(text), fixed.PHRASE_RULES)
    return F.array_compact(F.array(*[F.when(m, F.lit(f"AVISO: {description}")) for m, (_, description) in matched]))


def phrase_flags(responses: DataFrame) -> DataFrame:
    flags = [m.alias(f"flag_{i}") for i, m in enumerate(phrase_matches(F.col("text")), start=1)]
    return answers(responses).select("response_id", *flags)


# --- false positives -------------------------------------------------------------------------------
def real_warnings(warnings: Column) -> Column:
    """Warnings that none of the false-positive patterns matches."""

    def plausible(warning: Column) -> Column:
        matched = F.lit(False)
        for pattern in fixed.FALSE_POSITIVE_PATTERNS:
            matched = matched | F.rlike(warning, F.lit(fixed.regex(pattern)))
        return ~matched

    return F.filter(warnings, plausible)


# --- verdict ---------------------------------------------------------------------------------------
def text_checks(
    responses: DataFrame, known_years: Column, year_pattern: str = fixed.YEAR_PATTERN, answers_only: bool = True
) -> DataFrame:
    """Add the row-by-row results: `errors`, `phrases` and `names`.

    Model errors are left out, or, with `answers_only=False`, kept with nothing found.
    """
    real = model_error(F.col("text")).isNull()
    rows = responses.where(real) if answers_only else responses
    # A text that is put together by expressions is so once, not for each pattern.
    rows = with_once(rows, text=F.col("text"))
    text = F.col("text") if answers_only else F.when(real, F.col("text")).otherwise(F.lit(""))
    return with_once(
        rows.withColumn("_known_years", known_years),
        errors=year_errors(text, F.col("_known_years"), year_pattern),
        phrases=phrase_warnings(text),
        names=entity_names(text),
    ).drop("_known_years")


def is_valid(errors: Column) -> Column:
    """A response is valid without errors; warnings don't count."""
    return F.size(errors) == 0


def verdicts(checked: DataFrame, clients: DataFrame) -> DataFrame:
    """Warnings and verdict per response out of `text_checks`.

    Columns besides the checks are carried along, so texts should be dropped before. Rows
    without a name keep their place in the join under a key of their own: a shared null
    would gather them all in one task.
    """
    carried = [c for c in checked.columns if c not in ("response_id", "names", "phrases")]
    rows = checked.select(
        "response_id", "phrases", *carried, F.posexplode_outer("names").alias("position", "name")
    )
    # A text with many names carries its other columns at the first of them only.
    leads = F.coalesce("position", F.lit(0)) == 0
    rows = rows.withColumns({c: F.when(leads, F.col(c)) for c in ("phrases", *carried)})
    rows = rows.withColumn(
        "_key", F.coalesce(F.lower("name"), F.concat(F.lit("\u0001"), F.col("response_id").cast("string")))
    )
    looked_up = rows.join(client_names(clients), F.col("_key") == F.col("known_name"), "left")
    missing = F.when(
        F.col("name").isNotNull() & F.col("known_name").isNull(), F.struct("position", "name")
    )
    # A group is one response; its rows are the names in one text.
    grouped = looked_up.groupBy("response_id").agg(
        F.sort_array(F.collect_list(missing)).alias("missing"),
        F.first("phrases", ignorenulls=True).alias("phrases"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carried],
    )
    entity = F.transform("missing", lambda m: entity_warning(m["name"]))
    return (
        grouped.withColumn("all_warnings", F.concat(entity, "phrases"))
        .withColumn("warnings", real_warnings(F.col("all_warnings")))
        .withColumn("valid", is_valid(F.col("errors")))
        .select("response_id", *carried, "all_warnings", "warnings", "valid")
    )


CLIENTS_MARKER = "{clientes}"


def feedback(verdict: DataFrame, info: Column) -> DataFrame:
    """Correction text per response, null when there is nothing to correct.

    `info` is the struct of `facts_info`. The client list is left as a marker: it grows with
    the data and is the same for every response, so it is filled in by
    `functions.text.fill_template` where a single text is sent out.
    """

    def bullets(items: Column) -> Column:
        return F.concat_ws("", F.transform(items, lambda item: F.concat(F.lit("- "), item, F.lit("\n"))))

    def when_any(items: Column, text: Column) -> Column:
        return F.when(F.size(items) > 0, text).otherwise("")

    def two_decimals(name: str) -> Column:
        return F.round(F.col(f"_info.{name}").cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string")

    errors, warnings = F.col("errors"), F.col("all_warnings")
    text = F.concat(
        F.lit("DETECÇÃO DE ALUCINAÇÃO:\n\n"),
        when_any(errors, F.concat(F.lit("ERROS CRÍTICOS:\n"), bullets(errors))),
        when_any(warnings, F.concat(F.lit("\nAVISOS:\n"), bullets(warnings))),
        F.lit("\n\nINFORMAÇÕES REAIS PARA CORRIGIR:\n- Anos disponíveis: "),
        listing(F.col("_info.years")),
        F.lit("\n- Meses disponíveis: "),
        listing(F.col("_info.months")),
        F.lit(f"\n- Clientes na planilha: {CLIENTS_MARKER}\n- Range de faturamento: R$ "),
        two_decimals("min_amount"),
        F.lit(" a R$ "),
        two_decimals("max_amount"),
        F.lit("\n- Média de faturamento: R$ "),
        two_decimals("mean_amount"),
        F.lit("\n"),
    )
    dirty = (F.size(errors) + F.size(warnings)) > 0
    return verdict.withColumn("_info", info).withColumn("feedback", F.when(dirty, text)).drop("_info")


# --- report sections ----------------------------------------------------------------------------------
def heading_line(level: str, icon: str, title: str) -> str:
    return rf"{level}\s+{icon}\s+{title}"


def heading_pattern(level: str, icon: str, title: str) -> str:
    return rf"^{heading_line(level, icon, title)}\s*$"


def missing_headings(markdown: Column) -> Column:
    """Required headings without a line of their own, in order.

    One pass over the text finds the lines of all headings. None of them can begin inside another,
    since the mark that a line begins with stands nowhere else in it.
    """
    any_heading = "|".join(heading_line(*heading) for heading in fixed.REPORT_HEADINGS)
    found = F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(fixed.regex(rf"^({any_heading})\s*$", "mUd")), F.lit(1))

    def missing(lines: Column) -> Column:
        def absent(title: str) -> Column:
            # No title is the end of another.
            return ~F.exists(lines, lambda line: F.endswith(line, F.lit(title)))

        return F.array_compact(F.array(*[F.when(absent(title), F.lit(title)) for _, _, title in fixed.REPORT_HEADINGS]))

    return let(found, missing)


def report_sections(reports: DataFrame, text: str = "markdown") -> DataFrame:
    """Add the missing headings and whether the report is complete."""
    return with_once(reports, missing=missing_headings(F.col(text))).withColumn(
        "complete", ~is_blank(F.col(text)) & (F.size("missing") == 0)
    )
