"""Cosine similarity of vector columns. Vectors go to numpy one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# Numbers of a constant matrix sent with a task (8 bytes each); larger sets are taken in blocks.
BLOCK_NUMBERS = 1_000_000
# Equal vectors must come out equally far whatever the batch they are in.
DECIMALS = 12


def batch_matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors and those vectors scaled to length one.

    NULL, zero or wrongly sized vectors, and vectors with a NULL inside, have no direction.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    if len(rows) < len(vectors):
        vectors = vectors.take(pa.array(rows))
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes NaN
    matrix = flat.reshape(len(rows), dim)
    lengths = np.linalg.norm(matrix, axis=1)
    usable = np.isfinite(lengths) & (lengths > 0)
    return rows[usable], matrix[usable] / lengths[usable, None]


def unit(vector: Sequence[float]) -> np.ndarray:
    array = np.asarray(vector, dtype=np.float64)
    length = np.linalg.norm(array)
    if not np.isfinite(length) or length == 0:
        raise ValueError("a query vector needs a finite, non-zero length")
    return array / length


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """1 - cosine similarity to a constant vector; NULL for vectors without a direction."""
    target = unit(query)

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        rows, matrix = batch_matrix(vectors, len(target))
        out = np.full(len(vectors), np.nan)
        out[rows] = np.round(1 - matrix @ target, DECIMALS)
        return pa.array(out, from_pandas=True)

    return distance.asNondeterministic()(vector)  # so that a filter on it is not a second evaluation


def best_match(vector: Column, names: Sequence, vectors: Sequence[Sequence[float]]) -> Column:
    """``struct<similarity, place>`` of the constant vector most similar to ``vector``; ``place`` is its
    position, ties go to the first. Large sets are compared block by block."""
    if not len(names):
        raise ValueError("nothing to compare with")
    matrix = np.stack([unit(v) for v in vectors])
    block = max(1, BLOCK_NUMBERS // matrix.shape[1])
    parts = [_best_of_block(vector, matrix[i : i + block], i) for i in range(0, len(matrix), block)]
    if len(parts) == 1:
        return parts[0]
    # on equal similarity the earlier place wins: compare by (similarity, -place)
    keyed = [F.struct(p["similarity"].alias("similarity"), (-p["place"]).alias("place")) for p in parts]
    best = F.greatest(*keyed)
    return F.struct(best["similarity"].alias("similarity"), (-best["place"]).alias("place"))


def _best_of_block(vector: Column, matrix: np.ndarray, first: int) -> Column:
    @F.arrow_udf("similarity double, place int")
    def best(vectors: pa.Array) -> pa.Array:
        rows, scaled = batch_matrix(vectors, matrix.shape[1])
        similar = np.round(scaled @ matrix.T, DECIMALS)
        top = similar.argmax(axis=1)
        similarity = np.full(len(vectors), np.nan)
        similarity[rows] = similar[np.arange(len(rows)), top]
        place = np.zeros(len(vectors), dtype=np.int32)
        place[rows] = top + first
        missing = np.isnan(similarity)
        return pa.StructArray.from_arrays(
            [pa.array(similarity, mask=missing), pa.array(place, mask=missing)], names=["similarity", "place"]
        )

    return best.asNondeterministic()(vector)  # read twice, evaluated once
