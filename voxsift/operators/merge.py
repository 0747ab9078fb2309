"""The two halves of a merge by key, as joins, for tables whose format has no merge of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxsift.operators.joins import BROADCAST_ROWS, has_at_most


def insert_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` plus the rows of ``source`` whose key it does not hold yet."""
    return target.unionByName(missing_rows(target, source, key).select(*target.columns))


def missing_rows(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return source.join(target.select(key), key, "left_anti")


def missing_from_large(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``missing_rows`` for a small ``source`` that was written before, such as a micro-batch.

    While its size is within bounds its keys are sent to the target, whose keys are then filtered
    without a shuffle. A larger source is joined the usual way.
    """
    keys = target.select(key)
    if has_at_most(source.select(key), BROADCAST_ROWS):
        keys = keys.join(F.broadcast(source.select(key).distinct()), key, "left_semi")
    return missing_rows(keys, source, key)


def update_matched(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` with every column replaced by ``source``'s where the key matches, NULLs included.

    A target row matched by two source rows has no single new value: the job fails on it. The
    grouping that finds such keys is on the join key, so the join adds no shuffle of the source.
    """
    values = [c for c in target.columns if c != key]
    changes = source.groupBy(key).agg(
        F.first(F.struct(*values)).alias("_new"), F.count(F.lit(1)).alias("_copies")
    )
    joined = target.join(changes, key, "left")
    matched = F.col("_copies").isNotNull()
    clash = F.raise_error(F.concat(F.lit(f"more than one update for {key} "), F.col(key).cast("string")))
    new = F.when(F.col("_copies") > 1, clash.cast(changes.schema["_new"].dataType)).otherwise(F.col("_new"))
    resolved = joined.withColumn("_new", new)
    return resolved.select(
        *[
            F.col(c) if c == key else F.when(matched, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            for c in target.columns
        ]
    )
