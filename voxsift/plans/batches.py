"""Resumable analysis of a review table: batch after batch, each committed on its own.

Layout under ``root``: ``data/commit=/key_range=`` holds reviews, a folder per interval of keys, the result NULL until
analysed. A published version is a manifest that names the folders it consists of, with their first and last key and
numbers of rows, and ``answers/run=/batch=/commit=`` with the keys and results given since. A batch, an interval
of keys, opens only the folders that its interval meets, and appends answers. Folding answers in, or setting failures
back, rewrites the folders that hold such keys and takes over all others as they are.

Every review needs a key of its own: NULL and repeated keys are refused when rows come in, before anything
is published. A key that was answered twice, by two runs at once, has one result: the smaller one.
"""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict, deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxsift.functions.documents import RESULT_COLUMN, error_of
from voxsift.operators.joins import join_small
from voxsift.operators.keys import with_surrogate_key
from voxsift.operators.merge import missing_rows
from voxsift.plans.extraction import Extraction
from voxsift.sources import versions
from voxsift.sources.tables import pending, processed, with_empty_result

# Rows per committed batch, and the first batch of the threaded variant.
BATCH_SIZE = 10
FIRST_BATCH = 100
# Batches under way at once.
BATCHES_AT_ONCE = 8

LOG_SCHEMA = "run_id string, batch int, operation string, rows_in long, rows_errored long, started timestamp, ended timestamp"


# Where a row of the target is stored.
_PLACES = T.StructType([T.StructField("commit", T.StringType()), T.StructField("key_range", T.LongType())])


class AnalysisTarget:
    """Reviews with their analysis documents."""

    def __init__(self, spark: SparkSession, root: str, key: str = "review_id", column: str = RESULT_COLUMN):
        self.spark = spark
        self.root = root.rstrip("/")
        self.key = key
        self.column = column
        self._current: str | None = None
        self._logging = threading.Lock()

    # --- state ---------------------------------------------------------------------------------

    def exists(self) -> bool:
        return self._current is not None or versions.current(self.spark, self.root) is not None

    def _folder(self) -> str:
        """Folder of the version this object works on: the published one when first used."""
        if self._current is None:
            self._current = versions.current(self.spark, self.root)
        if self._current is None:
            raise ValueError(f"nothing published under {self.root}; seed the target first")
        return self._current

    def manifest(self) -> DataFrame:
        """A row per folder of the current version; ``of`` is the number of folders of its commit."""
        return self.spark.read.parquet(f"{self._folder()}/manifest")

    def _entries(self) -> list[T.Row]:
        """The manifest, a row for each shuffle partition's worth of reviews."""
        return self.manifest().collect()

    def _read(self, entries: list[T.Row], places: bool = False) -> DataFrame:
        """Rows of these folders alone, with ``commit`` and ``key_range`` if wanted."""
        schema = self.spark.read.parquet(f"{self._folder()}/columns").schema
        if not entries:
            found = self.spark.createDataFrame([], T.StructType([*schema.fields, *_PLACES.fields]))
        else:
            folders = defaultdict(list)
            for entry in entries:
                folders[entry["commit"]].append(entry)
            paths = []
            for commit, own in folders.items():
                path = f"{self.root}/data/commit={commit}"
                paths += [path] if len(own) == own[0]["of"] else [f"{path}/key_range={e['key_range']}" for e in own]
            reader = self.spark.read.schema(T.StructType([*schema.fields, *_PLACES.fields])).option("basePath", f"{self.root}/data")
            found = reader.parquet(*paths)
        return found if places else found.select(*[F.col(f"`{c}`") for c in schema.names])

    def rows(self) -> DataFrame:
        """Rows of the current version, without the answers given since."""
        return self._read(self._entries())

    def answers(self) -> DataFrame | None:
        """Keys and results as written since the current version; a key may be there twice."""
        path = f"{self._folder()}/answers"
        if not versions.path_exists(self.spark, path):
            return None
        schema = self.spark.read.parquet(f"{self._folder()}/columns").select(self.key, self.column).schema
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def _divided(self, answers: DataFrame) -> tuple[list[T.Row], list[T.Row]]:
        """The folders that hold answered keys, and all others. Only keys are moved for it."""
        entries = self._entries()
        keys = self._read(entries, places=True).select(self.key, *_PLACES.names)
        found = keys.join(answers.select(self.key), self.key, "left_semi").groupBy(*_PLACES.names).count().collect()
        held = {(r["commit"], r["key_range"]) for r in found}
        touched = [e for e in entries if (e["commit"], e["key_range"]) in held]
        return touched, [e for e in entries if (e["commit"], e["key_range"]) not in held]

    def _with_answers(self, rows: DataFrame, answers: DataFrame) -> DataFrame:
        # grouped on the join key: the group and the join share one shuffle of the answers
        given = answers.groupBy(self.key).agg(F.min(self.column).alias("_given"))
        both = rows.join(given, self.key, "left")
        result = F.coalesce(F.col(self.column), F.col("_given")).alias(self.column)
        return both.select(*[result if c == self.column else F.col(f"`{c}`") for c in rows.columns])

    def pending(self, batch_size: int | None = None) -> DataFrame:
        """Rows without a result, answers counted in; the first ``batch_size`` by key when given."""
        if batch_size is not None:
            return self.pending().orderBy(self.key).limit(batch_size)
        rows, answers = pending(self._read([e for e in self._entries() if e["pending"]]), self.column), self.answers()
        if answers is None:
            return rows
        # compare keys alone, then fetch the few rows left, instead of moving every text
        left = rows.select(self.key).join(answers.select(self.key), self.key, "left_anti")
        return join_small(rows, left, [self.key], how="left_semi").select(*rows.columns)

    def read(self) -> DataFrame:
        """Every review with its current result. Folders without answered keys are read as they are; only the others are
        joined with the answers."""
        answers = self.answers()
        if answers is None:
            return self.rows()
        touched, others = self._divided(answers)
        if not touched:
            return self._read(others)
        joined = self._with_answers(self._read(touched), answers)
        return joined.unionByName(self._read(others)) if others else joined

    def processed(self) -> DataFrame:
        return processed(self.read(), self.column)

    def processed_keys(self) -> DataFrame:
        """Keys with a result, without reading the other columns; a key may be there twice."""
        keys, answers = processed(self.rows(), self.column).select(self.key), self.answers()
        return keys if answers is None else keys.unionByName(answers.select(self.key))

    def failures(self) -> DataFrame:
        return self.processed().where(error_of(self.column).isNotNull())

    def history(self) -> DataFrame:
        path = f"{self.root}/log"
        if not versions.path_exists(self.spark, path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).json(path)

    # --- changes -------------------------------------------------------------------------------

    def seed(self, reviews: DataFrame, limit: int | None = None, reset: bool = False) -> bool:
        """Create the target from reviews not analysed yet; False, and no change, when it exists.

        ``reset`` replaces an existing target. ``limit`` seeds a trial of that many rows.
        """
        if self.exists() and not reset:
            return False
        rows = with_empty_result(reviews, self.column)
        self._publish(rows.limit(limit) if limit is not None else rows, "seed")
        return True

    def insert_missing(self, reviews: DataFrame) -> None:
        """Append the reviews whose key is not in the target, unanalysed."""
        self.append(missing_rows(self.rows(), reviews, self.key))

    def append(self, reviews: DataFrame, commit: str | None = None) -> None:
        """Append reviews that are known to be new, unanalysed: written first, checked by what was written, then listed.

        A ``commit`` that is listed already is not appended again; one that was written but not listed is replaced.
        """
        if commit is not None and self.has(commit):
            return
        new = with_empty_result(reviews, self.column).select(*self._read([]).columns)
        written = self._write(new, commit or uuid.uuid4().hex[:12])
        if written is not None:
            self._list(written, f"{self._folder()}/manifest")

    def has(self, commit: str) -> bool:
        return not self.manifest().where(F.col("commit") == commit).isEmpty()

    def appended(self, commit: str) -> DataFrame:
        """Rows of one append that still stand in the folders it wrote."""
        return self._read([e for e in self._entries() if e["commit"] == commit])

    def fold(self) -> None:
        """Publish a version whose rows hold all answers; only folders with answered keys are written anew."""
        answers = self.answers()
        if answers is not None:
            touched, others = self._divided(answers)
            self._publish(self._with_answers(self._read(touched, places=True), answers), "fold", others)

    def reprocess_failures(self) -> None:
        """Set failed results back to NULL, so that the next run takes these rows again; only folders with failures are
        written anew."""
        self.fold()
        entries = self._entries()
        touched, others = [e for e in entries if e["errors"]], [e for e in entries if not e["errors"]]
        self._publish(without_failures(self._read(touched, places=True), self.column), "reprocess", others)

    def record(
        self, analysed: DataFrame, run_id: str, batch: int, operation: str = "analyse", commit: str | None = None
    ) -> dict[str, Any]:
        """Commit one batch of analysed rows and log it. A ``commit`` given again replaces what it wrote before."""
        started = datetime.now(timezone.utc)
        # a folder of its own: a repeated batch, or another stream with the same numbers, is not counted in
        path = f"{self._folder()}/answers/run={run_id}/batch={batch}/commit={commit or uuid.uuid4().hex[:12]}"
        answers = analysed.select(self.key, self.column)
        answers.write.mode("errorifexists" if commit is None else "overwrite").parquet(path)
        # counted from what was written: counting `analysed` would call the model again
        written = self.spark.read.schema(answers.schema).parquet(path)
        counts = written.agg(
            F.count(F.lit(1)).alias("rows_in"), F.count(error_of(self.column)).alias("rows_errored")
        ).first()
        return self._log(run_id, batch, operation, counts["rows_in"], counts["rows_errored"], started)

    def _write(self, rows: DataFrame, commit: str, unique: bool = True) -> DataFrame | None:
        """Write rows to the folders of a commit, a folder per interval of keys (rows that come from folders: one for each of
        those), and return the manifest's rows of them."""
        path = f"{self.root}/data/commit={commit}"
        if "key_range" in rows.columns:
            place = F.concat_ws("-", "commit", F.col("key_range").cast("string")) if "commit" in rows.columns else F.col("key_range")
            placed = rows.withColumn("_from", place).drop(*_PLACES.names).repartition("_from")
            own = placed.withColumn("key_range", F.xxhash64("_from")).drop("_from")
        else:
            own = rows.repartitionByRange(F.col(self.key)).withColumn("key_range", F.spark_partition_id().cast("long"))
        own.sortWithinPartitions("key_range", self.key).write.mode("overwrite").partitionBy("key_range").parquet(path)
        schema = T.StructType([f for f in rows.schema.fields if f.name not in _PLACES.names])
        written = self.spark.read.schema(T.StructType([*schema.fields, _PLACES["key_range"]])).parquet(path)
        if unique:
            require_unique_keys(written, self.key)
        entries = written.groupBy("key_range").agg(
            F.min(self.key).alias("first_key"), F.max(self.key).alias("last_key"), F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(self.column).isNull()).alias("pending"), F.count(error_of(self.column)).alias("errors"),
        ).collect()
        if not entries:
            return None
        kind = T.StructType([
            T.StructField("commit", T.StringType()), T.StructField("of", T.LongType()), T.StructField("key_range", T.LongType()),
            T.StructField("first_key", schema[self.key].dataType), T.StructField("last_key", schema[self.key].dataType),
            *[T.StructField(c, T.LongType()) for c in ("n", "pending", "errors")],
        ])
        return self.spark.createDataFrame([(commit, len(entries), *e) for e in entries], kind)

    def _list(self, entries: DataFrame, path: str) -> None:
        entries.coalesce(1).write.mode("append").parquet(path)

    def _publish(self, rows: DataFrame, operation: str, others: list[T.Row] | None = None) -> None:
        """A version of ``rows`` and of folders taken over from the current one."""
        started = datetime.now(timezone.utc)
        version = versions.new_version(self.root)
        folder = f"{self.root}/{version}"
        kept = [c for c in rows.columns if c not in _PLACES.names] if others is not None else rows.columns
        written = self._write(rows, uuid.uuid4().hex[:12], unique=operation == "seed")
        rows.select(*[F.col(f"`{c}`") for c in kept]).limit(0).coalesce(1).write.parquet(f"{folder}/columns")
        schema = written.schema if written is not None else (self.manifest().schema if others is not None else None)
        if schema is None:  # no reviews at all
            empty = self.spark.read.parquet(f"{folder}/columns").select(
                F.lit("").alias("commit"), F.lit(0).cast("long").alias("of"), F.lit(0).cast("long").alias("key_range"),
                F.col(self.key).alias("first_key"), F.col(self.key).alias("last_key"), *[F.lit(0).cast("long").alias(c) for c in ("n", "pending", "errors")],
            )
            written, schema = empty, empty.schema
        entries = self.spark.createDataFrame(others or [], schema)
        self._list(entries if written is None else entries.unionByName(written), f"{folder}/manifest")
        versions.publish(self.spark, self.root, version)
        self._current = folder
        counts = self.manifest().agg(F.sum("n").alias("n"), F.sum("errors").alias("errors")).first()
        self._log(version, 0, operation, counts["n"] or 0, counts["errors"] or 0, started)

    def _log(self, run_id, batch, operation, rows_in, rows_errored, started) -> dict[str, Any]:
        entry = (run_id, batch, operation, rows_in, rows_errored, started, datetime.now(timezone.utc))
        log = self.spark.createDataFrame([entry], LOG_SCHEMA)
        with self._logging:  # one write into a folder at a time
            log.coalesce(1).write.mode("append").json(f"{self.root}/log")
        return dict(zip(log.columns, entry))


def require_unique_keys(rows: DataFrame, key: str) -> None:
    """Raise when a key is NULL or repeated. Moves keys only, summed up before they are shuffled."""
    copies = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = copies.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("repeated"),
    ).first()
    if found["null_keys"] or found["repeated"]:
        raise ValueError(f"{found['null_keys']} rows without {key}, {found['repeated']} values of {key} on several rows")


def without_failures(df: DataFrame, column: str = RESULT_COLUMN) -> DataFrame:
    """Rows with a failed result set back to NULL."""
    return df.withColumn(column, F.when(error_of(column).isNull(), F.col(column)))


def batch_of(number: Column, batch_size: int, first_batch: int | None = None) -> Column:
    """Batch (from 1) of the row with this number (from 1)."""
    first = first_batch or batch_size
    return F.when(number <= first, F.lit(1)).otherwise(
        F.floor((number - F.lit(first) - 1) / F.lit(batch_size)) + 2
    ).cast("long")


def batch_bounds(keys: DataFrame, key: str, batch_size: int, first_batch: int | None = None) -> DataFrame:
    """Last key, first key and size of every batch of pending rows in key order."""
    numbered = with_surrogate_key(keys.select(key), "_n", [key])
    return (
        numbered.groupBy(batch_of(F.col("_n"), batch_size, first_batch).alias("batch"))
        .agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("rows"))
    )


def run_batches(
    target: AnalysisTarget,
    extraction: Extraction,
    batch_size: int = BATCH_SIZE,
    first_batch: int | None = None,
    max_batches: int | None = None,
    fold: bool = True,
    at_once: int = BATCHES_AT_ONCE,
) -> list[dict[str, Any]]:
    """Analyse all pending rows, ``batch_size`` per commit, and return the log entries.

    The batches are key intervals fixed at the start, and a batch reads the folders that its interval meets. They are begun in
    order, ``at_once`` of them side by side; an extraction whose ``tasks`` bound its calls has one at a time. A run that is
    stopped loses at most the batches it was in: the next run finds the rows still pending. A row whose analysis fails gets
    a document with the error, so the run ends.
    """
    earlier, entries = target.answers(), [e for e in target._entries() if e["pending"]]
    columns = target._read([]).columns
    run_id = uuid.uuid4().hex[:12]
    log = []
    bounds = batch_bounds(target.pending(), target.key, batch_size, first_batch)

    def run(bound: T.Row) -> dict[str, Any]:
        interval = F.col(target.key).between(bound["first_key"], bound["last_key"])
        met = [e for e in entries if e["first_key"] <= bound["last_key"] and e["last_key"] >= bound["first_key"]]
        rows = pending(target._read(met), target.column).where(interval)
        if earlier is not None:
            rows = rows.join(earlier.where(interval).select(target.key), target.key, "left_anti")
        analysed = extraction.analyse(rows).select(*columns)
        return target.record(analysed, run_id, bound["batch"])

    if extraction.tasks:
        at_once = 1
    run = inheritable_thread_target(target.spark)(run)
    with ThreadPoolExecutor(at_once) as pool:
        begun = deque()
        for bound in _in_order(bounds, max_batches):
            begun.append(pool.submit(run, bound))
            if len(begun) >= at_once:
                log.append(begun.popleft().result())
        log += [batch.result() for batch in begun]
    if fold and log:
        target.fold()
    return log


def run_threaded(
    target: AnalysisTarget, extraction: Extraction, batch_size: int = BATCH_SIZE, **options
) -> list[dict[str, Any]]:
    """As ``run_batches`` with a larger first batch; the extraction's own ``threads`` run inside each task."""
    return run_batches(target, extraction, batch_size, first_batch=FIRST_BATCH, **options)


def _in_order(bounds: DataFrame, max_batches: int | None) -> Iterator[T.Row]:
    ordered = bounds.orderBy("batch")
    yield from (ordered if max_batches is None else ordered.limit(max_batches)).toLocalIterator()
