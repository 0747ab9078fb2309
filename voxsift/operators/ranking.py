"""Top-k without gathering a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxsift.operators.joins import join_small
from voxsift.operators.keys import with_surrogate_key
from voxsift.staging import shuffle_partitions, stage

# Spark itself cuts each task's rows to k before shuffling them: for a plain top-k, and per group.
# Up to these k the tasks x k rows that are left fit one task.
SMALL_K = 1000
SMALL_GROUP_K = 100
# Rows left of all slices of a group, at most, that one task ranks.
ONE_TASK_ROWS = 1_000_000


def top_k(
    df: DataFrame, k: int | None, order: Sequence[Column], spread: Column, by: Sequence[str] = (), rank: str | None = None
) -> DataFrame:
    """The first ``k`` rows in ``order``, all when ``k`` is None, per group of ``by`` when given. ``order`` must be total.

    With a large k a group is ranked in two steps, first within slices of it (``spread`` picks the
    slice, for example the primary key), then over the at most k rows left of each slice. Where these could
    be more than ONE_TASK_ROWS they are numbered over range partitions, so that no task's work grows with k.
    """
    order = list(order)
    by = list(by)
    if k is None:
        return df.orderBy(*order) if rank is None else _numbered(df, order, by, rank)
    if k <= SMALL_K and not by and rank is None:
        return df.orderBy(*order).limit(k)
    if k <= SMALL_GROUP_K and by:
        ranked = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        kept = ranked.where(F.col(rank or "_rank") <= k)
        return kept if rank else kept.drop("_rank")
    slices = shuffle_partitions(df.sparkSession)
    position = rank or "_rank"
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int"))
    within = Window.partitionBy(*by, "_slice").orderBy(*order)
    kept = (
        sliced.withColumn("_within", F.row_number().over(within))
        .where(F.col("_within") <= k)
        .drop("_within", "_slice")
    )
    if slices * k > ONE_TASK_ROWS:
        out = _numbered(kept, order, by, position).where(F.col(position) <= k)
        return out if rank else (out if by else out.orderBy(position)).drop(position)
    if not by and rank is None:
        return kept.orderBy(*order).limit(k)
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    out = kept.withColumn(position, F.row_number().over(over.orderBy(*order))).where(F.col(position) <= k)
    return out if rank else out.drop(position)


def _numbered(df: DataFrame, order: list[Column], by: list[str], rank: str) -> DataFrame:
    """Every row with its place in its group: numbered over range partitions, so that no group is one task's work."""
    numbered = with_surrogate_key(df, "_n", [*by, *order])
    if not by:
        return numbered.withColumnRenamed("_n", rank)
    numbered = stage(numbered, "numbered")
    first = numbered.groupBy(*by).agg(F.min("_n").alias("_first"))
    ranked = join_small(numbered, first, by, spread=F.col("_n"))
    return ranked.withColumn(rank, (F.col("_n") - F.col("_first") + 1).cast("long")).drop("_n", "_first")
