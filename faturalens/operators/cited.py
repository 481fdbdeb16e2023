"""Money and percent figures cited in texts, compared with the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faturalens.functions import fixed

# --- fixed values: number forms ----------------------------------------------------------
MONEY_PATTERN = r"R\$\s*([0-9][0-9.,]*)"
PERCENT_PATTERN = r"([0-9][0-9.,]*)\s*%"
COMMA_GROUPED = r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
DOT_GROUPED = r"^[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"
COMMA_DECIMAL = r"^[0-9]+,[0-9]+$"
PLAIN = r"^[0-9]+(\.[0-9]+)?$"


def cited_numbers(text: Column) -> Column:
    """Figures after the currency sign or before a percent sign, as written."""

    def figures(pattern: str, sign: str) -> Column:
        # Digits are tried one by one, so a plain search for the sign goes first.
        none = F.array().cast("array<string>")
        return F.when(~F.contains(text, F.lit(sign)), none).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    found = F.concat(figures(MONEY_PATTERN, "R$"), figures(PERCENT_PATTERN, "%"))
    return F.transform(found, lambda n: F.regexp_replace(n, r"[.,]+$", ""))


def parse_number(written: Column) -> Column:
    """Read a figure in comma or dot style; three digits after a lone mark are a group.

    Anything else, such as a date, is null.
    """
    no_dots = F.replace(written, F.lit("."), F.lit(""))
    no_commas = F.replace(written, F.lit(","), F.lit(""))
    comma_to_dot = F.replace(no_dots, F.lit(","), F.lit("."))
    return (
        F.when(F.rlike(written, F.lit(DOT_GROUPED)), comma_to_dot)
        .when(F.rlike(written, F.lit(COMMA_GROUPED)), no_commas)
        .when(F.rlike(written, F.lit(COMMA_DECIMAL)), comma_to_dot)
        .when(F.rlike(written, F.lit(PLAIN)), written)
        .cast("double")
    )


# Bins of the logarithm, narrower than the span that the tolerance allows.
BIN = 0.004
ZERO_BIN = -(10**9)


def bin_of(value: Column) -> Column:
    return F.when(value > 0, F.floor(F.log(value) / BIN)).when(value == 0, ZERO_BIN)


def value_bins(profile: DataFrame) -> DataFrame:
    """The least and the largest profile value of each bin; bounded by the range of a double, not by the profile."""
    # Years and months are no figures that a text could quote.
    values = profile.where("value >= 0 AND section NOT IN ('anos', 'meses')").withColumn("bin", bin_of(F.col("value")))
    return values.groupBy("bin").agg(F.min("value").alias("least"), F.max("value").alias("largest"))


def cited_in_profile(responses: DataFrame, profile: DataFrame, tolerance: float = fixed.CITED_TOLERANCE) -> DataFrame:
    """`(response_id, cited, verified, all_verified)` against every value of the profile, names included.

    A figure's tolerance spans whole bins and the ends of two more. In a bin that it spans any
    value will do; in the lower one the largest value decides, in the upper one the least. So
    the two ends of each bin stand for all values, however many names there are.
    """
    figure = F.col("figure")
    figures = F.transform(cited_numbers(F.col("text")), parse_number)
    rows = responses.select("response_id", F.posexplode_outer(figures).alias("position", "figure"))
    # One bin more on either side, for the rounding of logarithms.
    low, high = bin_of(figure / (1 + tolerance)) - 1, bin_of(figure / (1 - tolerance)) + 1
    spans = F.when(figure == 0, F.array(F.lit(ZERO_BIN).cast("long"))).otherwise(F.sequence(low, high))
    placed = rows.withColumn("bin", F.explode_outer(spans))
    # At most one row for each bin of a double's range: a bound that no data exceeds.
    found = placed.join(F.broadcast(value_bins(profile)), "bin", "left")

    def near(value: str) -> Column:
        return F.abs(figure - F.col(value)) <= F.abs(value) * tolerance

    hit = F.coalesce(near("least") | near("largest"), F.lit(False))
    # A figure's bins are put together first: plain values, which combine in every task before they move.
    each = found.groupBy("response_id", "position").agg(F.max(hit).alias("hit"))
    counted = each.groupBy("response_id").agg(
        F.count("position").cast("int").alias("cited"),
        F.count(F.when(F.col("hit"), F.col("position"))).cast("int").alias("verified"),
    )
    return counted.withColumn("all_verified", F.col("cited") == F.col("verified"))
