"""Row numbers 1..n over a total order, without sorting the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxsift.staging import shuffle_partitions, stage

# monotonically_increasing_id keeps the row's position in the low 33 bits, the partition above them
_POSITION_BITS = 33


def with_surrogate_key(
    df: DataFrame, key: str, order_by: Sequence[str | Column], tie_break: Sequence[str] = (), drop: Sequence[str] = ()
) -> DataFrame:
    """``row_number() over (order by order_by, tie_break)`` as column ``key``, computed in parallel.

    The table is range-partitioned and sorted within its partitions, then written once, because the
    counts and the numbers must come from the same division. A row's number is its place in its
    partition plus the rows of all partitions before it; that table of counts has one row per
    shuffle partition. Ties in ``order_by`` are also split over partitions when ``tie_break`` tells
    them apart. ``drop`` names helper columns not to keep.
    """
    parts = shuffle_partitions(df.sparkSession)
    columns = [F.col(c) if isinstance(c, str) else c for c in (*order_by, *tie_break)]
    sorted_parts = (
        df.repartitionByRange(parts, *columns)
        .sortWithinPartitions(*columns)
        .withColumn("_row", F.monotonically_increasing_id())
        .drop(*drop)
    )
    staged = stage(sorted_parts, "surrogate-key")
    part = F.shiftright(F.col("_row"), _POSITION_BITS)
    sizes = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)) + 1
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # at most `parts` rows
        .withColumn(key, place + F.col("_before"))
        .drop("_row", "_part", "_before")
        .select(key, *[c for c in sorted_parts.columns if c != "_row"])
    )
