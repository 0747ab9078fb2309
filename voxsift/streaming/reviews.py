"""Analysis of reviews that keep arriving as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from voxsift.operators.merge import missing_from_large
from voxsift.plans.batches import AnalysisTarget
from voxsift.plans.extraction import Extraction
from voxsift.sources import versions
from voxsift.sources.tables import require_columns, with_empty_result
from voxsift.staging import stage


def read_review_files(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet",
                      files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def analyse_micro_batch(target: AnalysisTarget, extraction: Extraction, batch: DataFrame, batch_id: int) -> None:
    """Add the batch's new reviews and analyse those without an answer. Safe to repeat.

    A repeat after a lost driver finds the rows inserted and the answers that were written, and does
    the rest; a review arriving twice is taken once, its values from one of the copies. A review without
    a key stops the stream with an error, before anything of its batch is stored.
    """
    if not batch.where(F.col(target.key).isNull()).isEmpty():
        raise ValueError(f"micro-batch {batch_id} has reviews without {target.key}")
    rows = stage(batch.dropDuplicates([target.key]), "micro-batch")
    if rows.isEmpty():
        return
    target.append(missing_from_large(target.rows(), rows, target.key))
    fresh = missing_from_large(target.processed_keys(), rows, target.key)
    analysed = extraction.analyse(fresh).select(*target.rows().columns)
    target.record(analysed, "stream", batch_id, "stream")


# Columns of the keys that the target holds: the key, and whether it has a result there.
_KNOWN, _ANSWERED = "_known", "_answered"


def new_reviews(reviews: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The stream's reviews that are to be analysed, once each, with ``_stored`` if the target holds the review already.

    ``known`` is the table of keys the target held when the stream began, with ``answered``; reviews with a result there are
    left out. Which keys came before is the state of ``dropDuplicates``, kept in the JVM: no function is called for a
    key, and no stored reviews are read again. A review without a key is an error.
    """
    missing = F.raise_error(F.lit(f"a review without {key}")).cast(reviews.schema[key].dataType)
    own = reviews.withColumn(key, F.coalesce(F.col(key), missing))
    held = known.select(F.col(key).alias(_KNOWN), F.col("answered").alias(_ANSWERED))
    found = own.join(held, own[key] == held[_KNOWN], "left")
    left = found.where(~F.coalesce(F.col(_ANSWERED), F.lit(False)))
    return left.select(*[own[c] for c in reviews.columns], F.col(_KNOWN).isNotNull().alias("_stored")).dropDuplicates([key])


def commit_micro_batch(target: AnalysisTarget, extraction: Extraction, batch: DataFrame, batch_id: int, stream_id: str) -> None:
    """Add the batch's reviews that are not ``_stored`` and analyse all of them. What is written is named by stream and batch,
    so a batch that is repeated after a lost driver replaces its own writes; no other reviews are read."""
    commit = f"stream-{stream_id}-{batch_id}"
    rows = stage(batch, "micro-batch")  # read several times, and the state is not to be asked again
    if rows.isEmpty():
        return
    target.append(rows.where("not _stored").drop("_stored"), commit)
    analysed = extraction.analyse(with_empty_result(rows.drop("_stored"), target.column))
    target.record(analysed, "stream", batch_id, "stream", commit)


def stream_analysis(
    reviews: DataFrame, target: AnalysisTarget, extraction: Extraction, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start the stream. Without a trigger it takes what is there and stops (``availableNow``).

    A review that has a result when the stream is first started, or that came before in the stream, is left out; one that
    the target holds without a result is analysed and not added again. The keys that came are state in the stream's
    checkpoint (a session with many keys should use the RocksDB state store), those of the target at the start a table beside
    it, so a trigger reads no stored reviews. A checkpoint of the form before, with a Python function's state, is not taken
    up: start such a stream with a new one. The
    stream does not know what others put into the target while it runs; where they do, use ``analyse_micro_batch``, which
    compares with the target each time.
    """
    require_columns(reviews, [target.key, extraction.review, extraction.rating])
    spark = target.spark
    known = f"{checkpoint}/known-keys"
    if not versions.path_exists(spark, f"{known}/_SUCCESS"):
        target.read().select(target.key, F.col(target.column).isNotNull().alias("answered")).write.mode("overwrite").parquet(known)
    fresh = new_reviews(reviews, spark.read.parquet(known), target.key)

    def commit(batch: DataFrame, batch_id: int) -> None:
        stream_id = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        commit_micro_batch(target, extraction, batch, batch_id, stream_id)

    return (
        fresh.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
