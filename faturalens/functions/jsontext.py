"""Strict JSON reading out of free text, on variants.

Spark's JSON readers accept anything after the first value. Wrapping the text as the first
of two array elements, the second a known mark, makes trailing text visible: the array then
fails to parse, or has another size, or does not end in the mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faturalens.functions import fixed
from faturalens.functions.once import let, with_once
from faturalens.functions.text import strip

_MARK = "§end-of-value§"


# How a JSON value begins and ends. Most prose and most pieces of a cut object fail here,
# which is far cheaper than a failed parse.
_OUTLINE = r'(?s)^\s*(\{.*\}|\[.*\]|".*"|-?[0-9][-+.0-9eE]*|true|false|null)\s*\z'


def parse_strict(text: Column) -> Column:
    """Variant of the text, null unless the whole text is one JSON value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))

    def first_of_two(pair: Column) -> Column:
        mark = F.try_variant_get(F.get(pair, F.lit(1)), "$", "string")
        return F.when((F.size(pair) == 2) & (mark == _MARK), F.get(pair, F.lit(0)))

    value = let(F.try_variant_get(wrapped, "$", "array<variant>"), first_of_two)
    return F.when(F.rlike(text, F.lit(_OUTLINE)), value)


# A variant takes about the bytes of its text. Below this many, no text is beyond the limit of a variant.
SURELY_FITS = 12_000_000


def too_large(text: Column) -> Column:
    """Whether a text that `parse_strict` gave nothing for is JSON, and only beyond the size of a variant."""
    return (F.octet_length(text) > SURELY_FITS) & F.coalesce(F.get_json_object(text, "$").isNotNull(), F.lit(False))


def kind(value: Column) -> Column:
    """`object`, `array` or `scalar`; null for a missing value."""
    first = F.left(F.schema_of_variant(value), F.lit(5))
    return (
        F.when(first == "OBJEC", F.lit("object"))
        .when(first == "ARRAY", F.lit("array"))
        .when(first.isNotNull(), F.lit("scalar"))
    )


def truthy(value: Column) -> Column:
    """False for a missing value, null, false, zero and empty strings, lists and objects."""
    empty = r'^(null|false|""|\[\]|\{\}|-?0(\.0*)?([eE][-+]?[0-9]+)?)$'
    return F.coalesce(~F.rlike(F.to_json(value), F.lit(empty)), F.lit(False))


def unfence(text: Column) -> Column:
    """Trim, then remove a leading code fence line and its closing fence."""
    fence = F.lit("```")

    def without_close(opened: Column) -> Column:
        closed = strip(F.regexp_replace(opened, r"```\z", ""))
        return F.when(F.endswith(opened, fence), closed).otherwise(opened)

    def without_fence(raw: Column) -> Column:
        opened = F.regexp_replace(raw, r"^```[a-zA-Z]*\n", "")
        return F.when(F.startswith(raw, fence), let(opened, without_close)).otherwise(raw)

    return let(strip(text), without_fence)


def object_candidates(raw: Column) -> Column:
    """Pieces to try when the whole text is not JSON, in the order they are tried.

    The text ends at its last closing brace; each piece runs from one opening brace up to
    the next one, the last piece first. A nested object after prose is therefore cut apart.
    """
    upto_last_brace = F.regexp_extract(raw, r"(?s)^(.*\})", 1)
    pieces = F.split(upto_last_brace, r"\{")
    objects = F.transform(pieces, lambda piece, i: F.when(i > 0, F.concat(F.lit("{"), piece)))
    return F.reverse(F.array_compact(objects))


def with_json_object(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `json_text` (the object found) and `json_error` (why there is none)."""
    raw, whole, found = F.col("_raw"), F.col("_whole"), F.col("_found")
    candidate = F.get(
        F.filter(object_candidates(raw), lambda piece: parse_strict(piece).isNotNull()), F.lit(0)
    )
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    errors = fixed.JSON_ERRORS
    rows = with_once(df, _raw=unfence(F.col(text)))
    # What the whole text parses to shows in its first character.
    rows = with_once(rows, _whole=F.when(parse_strict(raw).isNotNull(), F.left(raw, F.lit(1))))
    rows = with_once(rows, _found=F.when(whole.isNull() & F.contains(raw, F.lit("}")), candidate))
    return (
        rows.withColumn(
            "json_text", F.when(empty, F.lit(None)).when(whole == "{", raw).otherwise(found)
        )
        .withColumn(
            "json_error",
            F.when(empty, F.lit(errors["empty"]))
            .when(whole != "{", F.lit(errors["not_object"]))
            .when(whole.isNotNull() | found.isNotNull(), F.lit(None))
            .when(too_large(raw), F.lit(errors["too_large"]))
            .when(~F.contains(raw, F.lit("}")), F.lit(errors["no_delimiter"]))
            .otherwise(F.lit(errors["not_found"])),
        )
        .drop("_raw", "_whole", "_found")
    )
