"""Text shaping on string columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faturalens.functions import fixed


def strip(text: Column) -> Column:
    """Trim every kind of blank, line breaks included, at both ends."""
    return F.btrim(text, F.lit(fixed.BLANKS))


def is_blank(text: Column) -> Column:
    return ~F.rlike(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S"))


def first_filled(*texts: Column) -> Column:
    """The first argument that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def sanitize(text: Column) -> Column:
    """Drop the characters that break the printed report; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), fixed.STRIPPED_CHARACTERS, "")


def preview(text: Column, length: int = fixed.PREVIEW_LENGTH) -> Column:
    """The first characters followed by dots when the text is longer."""
    cut = F.concat(F.left(text, F.lit(length)), F.lit("..."))
    return F.when(F.length(text) > length, cut).otherwise(text)


def trim_report(markdown: Column, length: int = fixed.REPORT_LENGTH) -> Column:
    """Remove heading markers and cut a long report, saying where the rest is."""
    plain = F.replace(F.replace(markdown, F.lit("## "), F.lit("")), F.lit("# "), F.lit(""))
    note = F.lit("\n\n" + fixed.REPORT_CUT_NOTE)
    return F.when(F.length(plain) > length, F.concat(F.left(plain, F.lit(length)), note)).otherwise(plain)


def money(amount: Column, decimals: int = 2) -> Column:
    """Thousands comma and a fixed number of decimals, rounded on the decimal value."""
    return F.format_number(F.round(amount.cast("decimal(38,4)"), decimals), decimals)


def fill_template(template: Column, marker: str, value: Column) -> Column:
    """Put `value` in place of every `marker`; a template without it is an error."""
    missing = F.raise_error(F.lit(f"marker {marker} not found in template")).cast("string")
    return F.when(F.contains(template, F.lit(marker)), F.replace(template, F.lit(marker), value)).otherwise(missing)


def listing(values: Column) -> Column:
    """Render an array as `[a, b, c]`."""
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(values, lambda v: v.cast("string"))), F.lit("]"))
