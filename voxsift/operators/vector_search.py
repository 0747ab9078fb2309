"""Nearest rows by cosine distance, exact, for one query vector or many."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from voxsift.functions.vectors import BLOCK_NUMBERS, DECIMALS, batch_matrix, cosine_distance, unit
from voxsift.operators.filters import matching, select_list
from voxsift.operators.ranking import top_k
from voxsift.staging import stage

# Fixed value: rows at this cosine distance or farther are not hits.
THRESHOLD = 0.6
# Candidates a task may hold for all queries of a block together.
_HELD = 2_000_000


def vector_search(
    rows: DataFrame, query: Sequence[float], key: str = "review_id", vector: str = "vector",
    conditions: Mapping[str, Any] | None = None, limit: int | None = None, select: Sequence[str] | None = None,
    threshold: float | None = THRESHOLD,
) -> DataFrame:
    """The ``limit`` nearest rows meeting ``conditions`` (all without a limit), of these the ones nearer than ``threshold``.

    With ``select`` the columns of the conditions are added to it. The distance is column ``distance``. Single
    vectors of another length are no hits; a query whose length no vector has is an error.
    """
    size = F.size(vector)
    if rows.where(size == len(query)).select(vector).isEmpty() and not rows.where(size > 0).select(vector).isEmpty():
        raise ValueError(f"no vector has the query's length, {len(query)}")
    named = matching(rows, conditions)
    if select:
        named = named.select(*dict.fromkeys([key, vector, *select, *(conditions or {})]))
    measured = named.withColumn("distance", cosine_distance(F.col(vector), query)).where("distance is not null")
    if select and vector not in select:
        measured = measured.drop(vector)
    # the nearest come first, so the rows beyond the threshold can go before the limit as well
    kept = measured if threshold is None else measured.where(F.col("distance") < threshold)
    nearest = top_k(kept, limit, [F.asc("distance"), F.asc(key)], F.col(key))
    return select_list(nearest, select, [*(conditions or {})], "distance")


def vector_search_text(rows: DataFrame, text: str, embed: Callable[[str], Sequence[float]], **options) -> DataFrame:
    """``vector_search`` for a text, embedded by the caller's function."""
    return vector_search(rows, embed(text), **options)


def nearest_many(
    rows: DataFrame, queries: DataFrame, k: int, key: str = "review_id", vector: str = "vector",
    query_key: str = "query", query_vector: str = "vector",
) -> DataFrame:
    """query, key, distance, rank: the ``k`` nearest rows of each query.

    Every task compares its rows with a block of queries as one matrix product and keeps the k
    nearest of each, so what is shuffled is tasks x k rows per query. Queries are taken in blocks of
    bounded size; each block reads the rows once.
    """
    dim = queries.agg(F.max(F.size(query_vector)).alias("n")).first()["n"] or 1
    block = max(1, min(BLOCK_NUMBERS // dim, _HELD // max(1, k)))
    found = []
    blocks = _blocks(queries, block, query_key, query_vector)
    held = next(blocks, None)
    while held is not None:
        near, held = _nearest_of_block(rows, held, k, key, vector), next(blocks, None)
        # one of several blocks is written at once, so that the driver lets go of its vectors
        found.append(near if held is None and not found else stage(near, "nearest"))
    if not found:
        found = [rows.limit(0).select(F.lit(0).cast("bigint").alias("query"), key, F.lit(0.0).alias("distance"))]
    merged = reduce(DataFrame.unionByName, found)
    return top_k(merged, k, [F.asc("distance"), F.asc(key)], F.col(key), by=["query"], rank="rank")


def _blocks(queries: DataFrame, block: int, query_key: str, query_vector: str) -> Iterator[list]:
    """Queries in lists of at most ``block``; the driver holds one list at a time."""
    held: list = []
    for row in queries.select(query_key, query_vector).orderBy(query_key).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def _nearest_of_block(rows: DataFrame, block: list, k: int, key: str, vector: str) -> DataFrame:
    ids = [q for q, _ in block]
    matrix = np.stack([unit(v) for _, v in block])
    id_type = pa.int64() if all(isinstance(q, int) for q in ids) else pa.string()
    spark_id = "bigint" if id_type == pa.int64() else "string"
    key_type = rows.schema[key].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table | None] = [None] * len(ids)
        cuts = np.full(len(ids), np.inf)
        for batch in batches:
            at, scaled = batch_matrix(batch.column(1), matrix.shape[1])
            keys = batch.column(0).take(pa.array(at))
            distances = np.round(1 - matrix @ scaled.T, DECIMALS)
            for q in np.flatnonzero((distances <= cuts[:, None]).any(axis=1)):
                near = np.flatnonzero(distances[q] <= cuts[q])
                new = pa.table({"distance": distances[q][near], "key": keys.take(pa.array(near))})
                table = new if held[q] is None else pa.concat_tables([held[q], new])
                order = pc.sort_indices(table, [("distance", "ascending"), ("key", "ascending")])
                held[q] = table.take(order[:k])
                if len(held[q]) == k:
                    cuts[q] = held[q]["distance"][k - 1].as_py()
        for q, table in enumerate(held):
            if table is not None:
                columns = [pa.array([ids[q]] * len(table), id_type), table["key"].combine_chunks(),
                           table["distance"].combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, names=["query", key, "distance"])

    schema = f"query {spark_id}, `{key}` {key_type}, distance double"
    return rows.select(key, vector).mapInArrow(nearest, schema)


def approximate_nearest(
    rows: DataFrame, query: Sequence[float], k: int, key: str = "review_id", vector: str = "vector",
    bucket_length: float = 0.5, tables: int = 8, seed: int = 1,
) -> DataFrame:
    """About the ``k`` nearest rows by random projections, with their exact distance.

    For tables searched often, where the fitted hashes can be kept. Recall depends on ``tables`` and
    ``bucket_length``; ``vector_search`` is exact.
    """
    scaled = unit_vectors(rows, vector).select(key, array_to_vector("_unit").alias("_unit"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="_unit", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    near = lsh.fit(scaled).approxNearestNeighbors(scaled, Vectors.dense(unit(query)), k, distCol="_euclid")
    # on vectors of length one the squared Euclidean distance is twice the cosine distance
    return near.select(key, (F.col("_euclid") * F.col("_euclid") / 2).alias("distance"))


def unit_vectors(rows: DataFrame, vector: str, out: str = "_unit") -> DataFrame:
    """``out``: the vector scaled to length one as array<double>; rows without a direction are dropped."""
    values = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(F.col("_v"), F.lit(0.0), lambda total, x: total + x * x))
    return (
        rows.withColumn("_v", values)
        .withColumn("_length", length)
        .where(F.col("_length") > 0)
        .withColumn(out, F.transform("_v", lambda x: x / F.col("_length")))
        .drop("_v", "_length")
    )


def similarity(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns of the same row."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda t, v: t + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
