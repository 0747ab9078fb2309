"""Full-text search (BM25) over a published index."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxsift.functions.stemming import stem_word
from voxsift.functions.text import tokens
from voxsift.functions.vectors import BLOCK_NUMBERS
from voxsift.operators.filters import matching
from voxsift.operators.joins import BROADCAST_ROWS, has_at_most, join_small
from voxsift.operators.ranking import top_k
from voxsift.sources.search_index import OWN_COLUMNS, SearchIndex, stemmed_if, term_bucket
from voxsift.staging import stage

# BM25 parameters.
K1 = 1.2
B = 0.75
# Up to this many distinct query terms are looked up by name.
PRUNED_TERMS = 1000
# With more postings than this many for each document, counted for every query that meets them, the documents' own terms are read.
POSTINGS_A_DOCUMENT = 4


def idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25(weight: Column, tf: Column, length: Column, avg_length: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def query_terms(queries: DataFrame, index: SearchIndex, query_key: str = "query", text: str = "text") -> DataFrame:
    """query, term, bucket and how often the query names the term."""
    words = queries.select(F.col(query_key).alias("query"), F.explode(tokens(F.col(text))).alias("term"))
    return (
        stemmed_if(words, index.tokenizer)
        .withColumn("bucket", term_bucket(F.col("term"), index.buckets))
        .groupBy("query", "bucket", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def weighted_terms(terms: DataFrame, index: SearchIndex) -> DataFrame:
    """query, bucket, term and weight of the query terms the index knows."""
    stats = _of_terms(index.term_stats, terms)
    known = join_small(stats, terms, ["bucket", "term"])
    weight = F.col("times") * idf(F.lit(index.docs), F.col("df"))
    return known.select("query", "bucket", "term", weight.alias("weight"), "df")


def _of_terms(table: DataFrame, terms: DataFrame) -> DataFrame:
    """With few terms, read only their buckets and the row groups that may hold them."""
    wanted = terms.select("bucket", "term").distinct().limit(PRUNED_TERMS + 1).collect()
    if len(wanted) > PRUNED_TERMS:
        return table
    return table.where(
        F.col("bucket").isin(sorted({w["bucket"] for w in wanted})) & F.col("term").isin([w["term"] for w in wanted])
    )


def scores(weighted: DataFrame, index: SearchIndex, allowed: DataFrame | None = None) -> DataFrame:
    """query, doc, score of every document holding at least one of the query's ``weighted_terms``.

    ``allowed`` (a ``doc`` column) keeps only those documents, before any ranking; it is joined on
    the document, which is also how the scores are then grouped.
    """
    hits = join_small(_of_terms(index.postings, weighted), weighted, ["bucket", "term"], F.col("doc"))
    if allowed is not None:
        hits = hits.join(allowed.select("doc"), "doc", "left_semi")
    part = bm25(F.col("weight"), F.col("tf"), F.col("len"), F.lit(index.avg_len))
    return hits.groupBy("query", "doc").agg(F.sum(part).alias("score"))


def _meets_many(weighted: DataFrame, index: SearchIndex) -> bool:
    """Whether the queries meet so many postings that one pass over all documents is less work, and fit a matrix for it."""
    size = weighted.agg(F.countDistinct("term").alias("t"), F.count_distinct(F.struct("query")).alias("q"), F.sum("df").alias("n")).first()
    return size["t"] * size["q"] <= BLOCK_NUMBERS and (size["n"] or 0) > POSTINGS_A_DOCUMENT * index.docs and index.unique_keys


def best_scores(weighted: DataFrame, index: SearchIndex, limit: int, conditions: Mapping[str, Any] | None = None) -> DataFrame:
    """query, doc, score: of the rows of ``scores`` at least the ``limit`` best of each query, for documents with keys of their own.

    Some documents at a time meet all queries as a matrix product where their terms are stored, so nothing is moved but the best
    of each part. Equal scores (to 9 decimals) go by document key here as in the ranking.
    """
    rows = weighted.select("query", "term", "weight").collect()  # at most BLOCK_NUMBERS
    column = {q: i for i, q in enumerate(dict.fromkeys(r["query"] for r in rows))}
    line = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in rows))}
    weights = np.zeros((len(line), len(column)))
    for r in rows:
        weights[line[r["term"]], column[r["query"]]] = r["weight"]
    types = [weighted.schema["query"].dataType, index.documents.schema[index.doc_key].dataType]
    names, terms = pa.array(list(column), to_arrow_type(types[0])), pa.array(list(line), pa.string())
    step = max(1, 4 * BLOCK_NUMBERS // max(weights.shape))
    stemmed, avg_len, wide = index.tokenizer == "en_stem", index.avg_len, len(line)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, stems = np.full(len(names), -np.inf), {}
        for batch in batches:
            runs, docs = batch.column("_runs"), batch.column("doc")
            found = pc.list_flatten(runs)
            coded = found.field("term").dictionary_encode()
            words = coded.dictionary
            if stemmed:
                stems = stems if len(stems) < BLOCK_NUMBERS else {}
                words = pa.array([stems.get(w) or stems.setdefault(w, stem_word(w)) for w in words.to_pylist()], pa.string())
            place = pc.index_in(words, value_set=terms).take(coded.indices)
            known = pc.is_valid(place).to_numpy(zero_copy_only=False)
            row, place = pc.list_parent_indices(runs).to_numpy()[known], place.drop_null().to_numpy()
            uses = found.field("tf").to_numpy(zero_copy_only=False)[known]
            length = batch.column("len").to_numpy(zero_copy_only=False)
            by_key = np.empty(len(docs), np.int64)
            by_key[pc.sort_indices(docs).to_numpy()] = np.arange(len(docs))
            for low in range(0, len(docs), step):
                high = min(low + step, len(docs))
                a, b = np.searchsorted(row, [low, high])
                at = (row[a:b] - low).astype(np.int64) * wide + place[a:b]
                tf = np.bincount(at, weights=uses[a:b], minlength=(high - low) * wide).reshape(-1, wide)
                tf = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[low:high, None] / avg_len))
                exact = (tf @ weights).T
                score = np.round(exact, 9)
                if high - low >= limit:  # no hit below the last of the best here is one of the best of all
                    floor = np.maximum(floor, np.partition(score, -limit, axis=1)[:, -limit])
                query, doc = np.nonzero((exact > 0) & (score >= floor[:, None]))
                value, doc = score[query, doc], doc + low
                order = np.lexsort((by_key[doc], -value, query))
                query, doc, value = query[order], doc[order], value[order]
                kept = np.arange(len(query)) - np.searchsorted(query, query) < limit
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(query[kept])), docs.take(pa.array(doc[kept])), pa.array(value[kept])], names=["query", "doc", "score"]
                )

    stored = matching(index.with_runs, conditions).select(F.col(index.doc_key).alias("doc"), F.col("_tokens").alias("len"), "_runs")
    fields = [T.StructField("query", types[0]), T.StructField("doc", types[1]), T.StructField("score", T.DoubleType())]
    return stored.mapInArrow(best, T.StructType(fields))


def ranked_hits(
    queries: DataFrame, index: SearchIndex, limit: int | None = None, conditions: Mapping[str, Any] | None = None,
    query_key: str = "query", text: str = "text",
) -> DataFrame:
    """query, doc, score, rank: the ``limit`` best documents of each query, all without one, ties by document key."""
    weighted = stage(weighted_terms(query_terms(queries, index, query_key, text), index), "query-terms")  # measured, listed and joined
    if limit is not None and _meets_many(weighted, index):
        scored = best_scores(weighted, index, limit, conditions)
    else:
        allowed = matching(index.documents, conditions).select(F.col(index.doc_key).alias("doc")) if conditions else None
        scored = scores(weighted, index, allowed)
    # sums of doubles depend on their order: equal up to rounding is equal in rank
    rounded = scored.withColumn("score", F.round("score", 9))
    return top_k(rounded, limit, [F.desc("score"), F.asc("doc")], F.col("doc"), by=["query"], rank="rank")


def text_search_many(
    queries: DataFrame, index: SearchIndex, limit: int | None = None, conditions: Mapping[str, Any] | None = None,
    select: Sequence[str] | None = None, query_key: str = "query", text: str = "text",
) -> DataFrame:
    """Hits of many queries in one job, with the wanted columns of the documents."""
    hits = ranked_hits(queries, index, limit, conditions, query_key, text).withColumnRenamed("doc", index.doc_key)
    hits = hits.withColumn("_doc_bucket", term_bucket(F.col(index.doc_key), index.doc_buckets))
    columns = select or [c for c in index.documents.columns if c not in OWN_COLUMNS]
    wanted = index.documents.select(*dict.fromkeys(["_doc_bucket", index.doc_key, *columns]))
    few = limit is not None and has_at_most(queries.select(query_key), BROADCAST_ROWS // max(1, limit))
    # with the bucket among the keys, only the folders holding a hit are read
    found = wanted.join(F.broadcast(hits) if few else hits, ["_doc_bucket", index.doc_key])
    return found.select("query", "rank", *dict.fromkeys(columns), "score")


def text_search(
    query: str, index: SearchIndex, limit: int | None = None, conditions: Mapping[str, Any] | None = None,
    select: Sequence[str] | None = None,
) -> DataFrame:
    """Documents with any word of ``query``, best first by ``rank``, with their ``score``."""
    # the query number is a column and no literal: ranking per constant would be one task's work
    one = index.spark.range(1).select(F.col("id").alias("query"), F.lit(query).alias("text"))
    return text_search_many(one, index, limit, conditions, select).drop("query")
