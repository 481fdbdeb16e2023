"""Prompt documents out of data and payloads, and the choice between report texts.

Documents are bounded: a run has one payload per area, and the data text of an area holds the profile
sections that the calendar and the length of the top lists bound. A template without its
marker is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faturalens.functions import fixed
from faturalens.functions.once import with_once
from faturalens.functions.text import fill_template, is_blank
from faturalens.operators.validation import missing_headings
from faturalens.plans.profile import NAME_SECTIONS, profile_lines


def insights_documents(payloads: DataFrame, run: str = "run_id", pretty: bool = True) -> DataFrame:
    """`(run, insights)`: one JSON text per run, its areas' payloads in their fixed order.

    `payloads` has at most one row per run and area, such as `payload.area_payloads` gives; every
    other column is part of the payload. Absent areas and fields are null. A run's rows meet after
    they have been cut to those of the chosen attempts: three at most.
    """
    fields = [name for name in payloads.columns if name not in (run, "area")]
    whole = F.struct("area", *fields)
    areas = [F.first(F.when(F.col("area") == area, whole), ignorenulls=True).alias(area) for area in fixed.AREAS]
    grouped = payloads.where(F.col("area").isin(fixed.AREAS)).groupBy(run).agg(*areas)
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return grouped.select(run, F.to_json(F.struct(*fixed.AREAS), options).alias("insights"))


def manager_prompts(documents: DataFrame, template: Column) -> DataFrame:
    """The documents with `prompt`: the template with the run's insights in it."""
    return documents.withColumn("prompt", fill_template(template, fixed.INSIGHTS_MARKER, F.col("insights")))


def data_text(profile: DataFrame) -> DataFrame:
    """One row, one column `dados`: the profile as text, without the lists of all names.

    The headings of those lists stay, with their counts. What is gathered is bounded by the
    calendar and the top lists.
    """
    lines = profile_lines(profile.where(~F.col("section").isin(NAME_SECTIONS)))
    row = F.struct("part", "rank", "place", "line")
    ordered = F.transform(F.sort_array(F.collect_list(row)), lambda entry: entry["line"])
    return lines.agg(F.array_join(ordered, "\n").alias("dados"))


def area_prompts(templates: DataFrame, profile: DataFrame) -> DataFrame:
    """`(area, prompt)` from `(area, template)`: each area's template with the data text in it."""
    filled = fill_template(F.col("template"), fixed.DATA_MARKER, F.col("_data"))
    return templates.withColumn("_data", data_text(profile).scalar()).select("area", filled.alias("prompt"))


def attempt_prompt(prompt: Column, attempt: Column) -> Column:
    """The prompt of an attempt, counted from 1: later ones are reminded of the output's contract."""
    return F.when(attempt > 1, F.concat(prompt, F.lit(fixed.CONTRACT_REMINDER))).otherwise(prompt)


def complete(markdown: Column) -> Column:
    """Whether a report has all of its headings."""
    return ~is_blank(markdown) & (F.size(missing_headings(markdown)) == 0)


def retry_prompt(prompt: Column, answer: Column) -> Column:
    """What is asked after an answer that lacks headings; null where nothing has to be asked."""
    asked = F.concat(prompt, F.lit(fixed.REPORT_RETRY), answer)
    return F.when((F.coalesce(answer, F.lit("")) != "") & ~complete(answer), asked)


def choose_report(reports: DataFrame, first: str = "first", retry: str = "retry") -> DataFrame:
    """The reports with `markdown` and `source`: the first text if it is complete, else the second if that is.

    Otherwise the first stands, behind a note on its format; without a first text there is only a notice.
    `source` is `first`, `retry`, `note` or `notice`.
    """
    given = F.coalesce(F.col(first), F.lit("")) != ""
    source = (
        F.when(~given, "notice").when(complete(F.col(first)), "first").when(complete(F.col(retry)), "retry").otherwise("note")
    )
    text = (
        F.when(F.col("source") == "notice", F.lit(fixed.REPORT_MISSING))
        .when(F.col("source") == "first", F.col(first))
        .when(F.col("source") == "retry", F.col(retry))
        .otherwise(F.concat(F.lit(fixed.REPORT_BAD_FORMAT), F.col(first)))
    )
    # Each text is searched once, whatever asks for the source.
    return with_once(reports, source=source).withColumn("markdown", text)
