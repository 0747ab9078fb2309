"""Joins with a side whose size is checked before it is broadcast, and joins on keys with hot values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxsift.staging import shuffle_partitions

# Largest number of narrow rows (a key and a few numbers) sent to every executor: some tens of MB.
BROADCAST_ROWS = 200_000
# A key with more than one in this many rows is hot; there are fewer than this many such keys.
HOT_SHARE = 1000


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Size check that stops reading as soon as the bound is passed."""
    return df.limit(rows + 1).count() <= rows


def not_broadcast(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle whatever its files say of its size.

    For tables of numbers that grow with the input: written to files they are a fraction of the hash table that a broadcast
    of them builds in the driver.
    """
    return df.hint("merge")


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Column | None = None,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``big`` with a side that is expected, but not promised, to be small.

    Within ``max_rows`` the small side is broadcast and ``big`` is not shuffled. Beyond it both sides
    are shuffled on the key; ``spread``, needed when keys repeat in ``big``, divides each of them over
    several tasks as in ``join_salted``. All ways return the same rows.
    """
    on = list(on)
    if has_at_most(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how) if spread is None else join_salted(big, small, on, spread, how)


def join_salted(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Column,
    how: str = "inner",
    salts: int | None = None,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Shuffle join in which a key holding a large part of ``big`` is divided over ``salts`` tasks.

    ``spread``, an expression over ``big``, picks a row's salt; the rows of ``small`` are repeated once
    per salt. With ``hot``, hashes made by ``hot_keys``, only those keys are divided and repeated.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting keeps only the rows of the left side whole, not {how}")
    salts = salts or max(2, min(32, shuffle_partitions(big.sparkSession)))
    own, every, none = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"), F.sequence(F.lit(0), F.lit(salts - 1)), F.lit(0)
    if hot is not None:
        divided = F.xxhash64(*on).isin(list(hot))
        own, every = F.when(divided, own).otherwise(none), F.when(divided, every).otherwise(F.array(none))
    left = big.withColumn("_salt", own)
    right = small.withColumn("_salt", F.explode(every))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hot_keys(counts: DataFrame, on: Sequence[str], count: str) -> list[int]:
    """Hashes of the keys with more than 1 / ``HOT_SHARE`` of all rows, from the rows per key."""
    total = counts.agg(F.sum(count).alias("n")).first()["n"] or 0
    rows = counts.where(F.col(count) > total / HOT_SHARE).select(F.xxhash64(*on).alias("h")).collect()
    return [r["h"] for r in rows]
