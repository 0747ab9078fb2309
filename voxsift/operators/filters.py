"""Conditions, select lists and thresholds of the search calls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def matching(df: DataFrame, conditions: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows equal to every given column value. None or an empty mapping keeps all rows.

    Values are literals cast to the column's type, so the filter reaches the parquet scan.
    """
    if not conditions:
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    unknown = [c for c in conditions if c not in types]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    tests = [F.col(c) == F.lit(v).cast(types[c]) for c, v in conditions.items()]
    return df.where(reduce(Column.__and__, tests))


def select_list(
    df: DataFrame, select: Sequence[str] | None, also: Sequence[str] = (), measure: str | None = None
) -> DataFrame:
    """The wanted columns in the given order, then ``also`` and ``measure``, each once. None keeps all."""
    if not select:
        return df
    wanted = dict.fromkeys([*select, *also, *([measure] if measure else [])])
    return df.select(*wanted)


def count_matching(df: DataFrame, conditions: Mapping[str, Any] | None = None) -> DataFrame:
    return matching(df, conditions).agg(F.count(F.lit(1)).alias("total"))


def facet_counts(df: DataFrame, column: str, all_label: str | None = None) -> DataFrame:
    """Distinct values of a column with their counts; ``all_label`` adds one row for the whole table."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("total"))
    if all_label is None:
        return counts
    whole = counts.agg(F.lit(all_label).alias(column), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return whole.unionByName(counts)
