"""Exact places and running totals over an ordered key, without sorting everything in one task.

Rows are dealt to partitions by ranges of the order, as many as the session's shuffles have, and
sorted there. That table is written, so that all later steps see the same ranges. Places and sums
inside a partition need no other partition's rows; the few totals per partition are accumulated and
added. So tasks grow with the cluster and the data, and no range is a fixed share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faturalens.plans.shared import written

# Where monotonically_increasing_id keeps the partition.
PART_BITS = 33


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df sorted as a whole over range partitions and written, with `_at` that rises in that order and `_part`."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", PART_BITS))


def numbered(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """df with `_place`, from 0, of each row inside its group in the given order, and `_count`, the group's rows.

    Group columns must not be null. A group of any size may span partitions. Equal rows take the
    places of equal rows, whichever of them is first.
    """
    table = ranged(df, *group, *order)
    pieces = table.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row for each partition that a group touches.
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("_count"),
    )
    # Written, so that the join knows its size.
    placed = table.join(written(starts), [*group, "_part"])
    return placed.withColumn("_place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def running_totals(df: DataFrame, key: str, measures: list[str], descending: bool = False) -> DataFrame:
    """Key, measures and `cum_<measure>`: the sum over all rows up to and including this key value.

    `key` must be unique in `df` and not null. Measures must be exact (integer or decimal).
    """
    direction = F.desc if descending else F.asc
    table = ranged(df.select(key, *measures), direction(key))
    totals = table.groupBy("_part").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    # One row per partition from here to the join.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = table.join(written(offsets), "_part")
    return joined.select(
        key,
        *measures,
        *[(F.sum(m).over(inside) + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures],
    )


MIDDLE = (0.499, 0.501)
# The sketch's rank error is below one part in this many, far less than the middle's width.
SKETCH_ACCURACY = 10_000


def median(df: DataFrame, column: str) -> DataFrame:
    """One row, one column: the interpolated median, nulls left out.

    A sketch brackets the middle: its rank error is bounded, so that the bracket always holds
    the median. One more scan counts the rows below it and groups those inside by value; only
    these, some thousandths of the rows, move. They are written, so that what follows reads no amount again.
    """
    known = df.select(F.col(column).alias("_value")).where(F.col(column).isNotNull())
    bracket = known.agg(F.percentile_approx("_value", list(MIDDLE), SKETCH_ACCURACY).alias("_ends")).scalar()
    sided = known.withColumn("_ends", bracket)
    inside = F.col("_value").between(F.get("_ends", F.lit(0)), F.get("_ends", F.lit(1)))
    # Of the rows outside only the number on either side is kept: one group each.
    side = F.when(F.col("_value") < F.get("_ends", F.lit(0)), -1).when(inside, 0).otherwise(1)
    counts = written(sided.groupBy(side.alias("_side"), F.when(inside, F.col("_value")).alias("_value")).agg(F.count(F.lit(1)).alias("_n")))
    totals = counts.agg(
        F.struct(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("_side") < 0, F.col("_n"))), F.lit(0)).alias("below"))
    ).scalar()
    return _middle(counts.where("_side = 0").select("_value", "_n"), totals)


def counted_median(counts: DataFrame, column: str, count: str) -> DataFrame:
    """One row, one column: the interpolated median of values that come with their numbers; nulls left out."""
    known = written(counts.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.sum(count).alias("_n")))
    totals = known.agg(F.struct(F.sum("_n").alias("n"), F.lit(0).cast("long").alias("below"))).scalar()
    return _middle(known, totals)


def _middle(counts: DataFrame, totals: Column) -> DataFrame:
    """The median out of (_value, _n) around the middle, given how many values there are and how many are below these."""
    ranked = running_totals(counts, "_value", ["_n"]).withColumn("_totals", totals)
    n, upto = F.col("_totals.n"), F.col("cum__n") + F.col("_totals.below")
    value = F.col("_value").cast("double")

    def covers(position):
        return (upto - F.col("_n") < position) & (position <= upto)

    low = F.when(covers(F.floor((n + 1) / 2)), value)
    high = F.when(covers(F.floor(n / 2) + 1), value)
    return ranked.agg(((F.max(low) + F.max(high)) / 2).alias("median"))
