"""Small helpers shared by the operators for training text."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

Model = TypeVar("Model")

#: A key's place in the order by which a sample is chosen: a millionth, and the part of it.
MILLION, PART = 1_000_000, 1 << 40


def sent(spark: SparkSession, model: Model) -> Callable[[], Model]:
    """Sends a fitted model to the executors and returns how a task gets it.

    What is broadcast are bytes that hold the model's class too, so that a worker needs no installed package; a task reads
    them once.
    """
    held, read = spark.sparkContext.broadcast(cloudpickle.dumps(model)), []

    def received() -> Model:
        if not read:
            read.append(cloudpickle.loads(held.value))
        return read[0]

    return received


def bar_of(rows: int, most: int, least: int) -> int:
    """Places below this are sampled: about ``most`` of so many rows, and the row whose place is ``least`` in any case."""
    return max(min(most * MILLION * PART // rows, MILLION * PART), least + 1)


def bounded_sample(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (all, where there are fewer), chosen by a hash of ``key``.

    Only for fitting a classifier. The share of each value comes from a count over all rows; the number of
    values must be small, as that of languages or of classes is. Rows with a null key count as one key. No value is left
    without rows, however many it has: the key that comes first is always taken.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(MILLION)) * PART + F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(PART))
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()  # a row per value
    wanted = F.lit(False)
    for value, n, least in counts:
        if value is not None:
            wanted = wanted | ((F.col(by) == F.lit(value)) & (place < bar_of(n, most, least)))
    return rows.where(wanted)


def long_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, which is made for short rows: a Python worker holds a batch
    of whole texts and what it makes of them. A session that has set another number keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(rows))
