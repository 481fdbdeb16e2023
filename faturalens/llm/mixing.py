"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target by water-filling: weights share the total, a target stops at a multiple
of its source's size, and what is over goes to the others by weight. A document's expected copies
are target / size of its source. Documents of a source stand in an order; the prefix sum of
expected copies plus one random offset of the source crosses integers, and a document is taken
once per integer that it crosses. With an order by size, the words taken come near the target.

No task sees a whole source: the order is (size class, salt, size, doc_id), rows are numbered
inside (source, class, salt), whose number of salts follows the source's size, and the counts of
these small groups give where each begins. Only one row per source ever meets in one task.

Null texts have size 0. A null source is a source, last in order. Rows without an id and repeated
rows are rows like others; equal rows take what equal places in the order get, whichever of them
is first. Extra columns of any type stay; an empty table gives an empty one; sources without words have
target 0 and are never taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faturalens.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix"
ROWS_PER_SALT = 200
OWN = "mix_size mix_key mix_class mix_salt mix_before mix_rate mix_offset mix_target mix_source_size mix_order".split()


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in docs.columns]


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """Order by code point with null last: UTF-8 bytes sort as code points do."""
    return F.coalesce(F.concat(F.lit("0"), F.hex(F.encode(F.col(source), "UTF-8"))), F.lit("1"))


def offset_of(key: Column, seed: str) -> Column:
    """One number from 0 to 1 for each source, the same in every run."""
    head = F.substring(F.md5(F.concat(F.lit(seed + "/"), key)), 1, 8)
    return F.conv(head, 16, 10).cast("long") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """mix_key, mix_source_size, mix_rows and mix_target from one row per source with mix_key, mix_source_size, mix_rows.

    Sources are sorted by the level at which they fill, most * size / weight. Those that fill
    below the common level are a prefix; the level is what is left over the weights that are left.
    """
    by_key = Window.orderBy("mix_key")
    place = (F.row_number().over(by_key) - 1) % len(weights) + 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place).cast("long"))
    full = F.lit(most) * F.col("mix_source_size")
    by_level = Window.orderBy(full / F.col("w"), "mix_key")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    levelled = weighed.select(
        "*",
        full.alias("full"),
        F.sum("mix_source_size").over(every).alias("total"),
        F.coalesce(F.sum(full).over(before), F.lit(0)).alias("filled"),
        F.sum("w").over(after).alias("left"),
    )
    level = (F.lit(share) * F.col("total") - F.col("filled")) / F.col("left")
    # The first source that doesn't fill at its own level sets the level of all behind it.
    found = F.when(F.col("full") >= level * F.col("w"), F.struct(F.col("full") / F.col("w"), F.col("mix_key"), level.alias("level")))
    chosen = F.min(found).over(every).getField("level")
    target = F.least(F.coalesce(chosen * F.col("w"), F.col("full").cast("double")), F.col("full").cast("double"))
    return levelled.select("mix_key", "mix_source_size", "mix_rows", target.alias("mix_target"))


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: str = SEED,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target and mix_copies (0 to `most`)."""
    docs = docs.drop(*OWN, "mix_copies", "mix_rows")
    # Maps can't be hashed; their JSON texts can.
    own = columns_of(docs)
    plain = [F.to_json(F.struct(column)) if "map<" in kind else column for column, (_, kind) in zip(own, docs.dtypes, strict=True)]
    hashed = F.xxhash64(*plain).alias("mix_order")
    sized = docs.select("*", word_count().alias("mix_size"), source_key().alias("mix_key"), hashed)
    slim = docs.select(word_count().alias("mix_size"), source_key().alias("mix_key"))
    sums = slim.groupBy("mix_key").agg(F.sum("mix_size").alias("mix_source_size"), F.count("*").alias("mix_rows"))
    rates = targets(sums, weights, share, most).select(
        "*",
        F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0).alias("mix_rate"),
        offset_of(F.col("mix_key"), seed).alias("mix_offset"),
        (F.lit(1) + F.floor(F.col("mix_rows") / rows_per_salt)).alias("mix_salts"),
    )
    # Written, so that its true size is known: the planner broadcasts it if it is small, and else shuffles.
    sources = common.written(rates)
    size_class = F.floor(F.log2(F.col("mix_size") + 1)).cast("int")
    salt = F.coalesce(F.pmod(F.col("doc_id"), F.col("mix_salts")), F.lit(0))
    placed = sized.join(sources.drop("mix_rows"), "mix_key").select(
        "*", size_class.alias("mix_class"), salt.alias("mix_salt")
    )
    group = ["mix_key", "mix_class", "mix_salt"]
    counts = (
        docs.select("doc_id", word_count().alias("mix_size"), source_key().alias("mix_key"))
        .join(sources.select("mix_key", "mix_salts"), "mix_key")
        .groupBy("mix_key", size_class.alias("mix_class"), salt.alias("mix_salt"))
        .agg(F.count("*").alias("n"))
    )
    classes = counts.groupBy("mix_key", "mix_class").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("mix_key").orderBy("mix_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("mix_key", "mix_class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("class_before"))
    inside = Window.partitionBy("mix_key", "mix_class").orderBy("mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("salt_before"))
    starts = starts.join(classes, ["mix_key", "mix_class"]).select(
        *group, (F.col("class_before") + F.col("salt_before")).alias("mix_before")
    )
    order = Window.partitionBy(*group).orderBy("mix_size", "doc_id", "mix_order")
    numbered = placed.withColumn("mix_number", F.row_number().over(order)).join(starts, group)
    number = F.col("mix_before") + F.col("mix_number")
    # Whole copies apart from the rest, so that a rate of a whole number is exact at any place.
    whole = F.floor("mix_rate")
    part = F.col("mix_rate") - whole
    crossed = F.floor(number * part + F.col("mix_offset")) - F.floor((number - 1) * part + F.col("mix_offset"))
    copies = F.least(whole + crossed, F.lit(most)).cast("int")
    return numbered.select(*own, "mix_size", "mix_source_size", "mix_target", copies.alias("mix_copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, whatever their columns are called."""
    whole = F.struct(*columns_of(docs)).alias("mix_row")
    mixed = mix(docs.select("doc_id", "text", "source", whole), **options)
    times = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return mixed.where("mix_copies > 0").select("mix_row", times.alias("mix_time")).select("mix_row.*")
