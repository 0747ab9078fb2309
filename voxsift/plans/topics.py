"""Topic discovery: embed, assign to named topics, cluster the rest, and describe every topic.

Frames used throughout: ``assigned`` has a document key, a ``topic`` and the text or its tokens;
``weights`` has ``topic, term, tf, idf, weight``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from voxsift.functions.text import WORDS_AT_ONCE, term_counts, term_positions, tokens
from voxsift.functions.vectors import BLOCK_NUMBERS, DECIMALS, batch_matrix, best_match, unit
from voxsift.operators.joins import has_at_most, hot_keys, join_salted, join_small
from voxsift.operators.ranking import top_k
from voxsift.operators.vector_search import similarity, unit_vectors
from voxsift.plans.model import MakeComplete, ModelSettings, model_call
from voxsift.staging import spread_input, stage

# Thresholds and sizes of the topic model.
MIN_SIMILARITY = 0.85
MIN_TOPIC_SIZE = 15
TOP_WORDS = 10
DIVERSITY = 0.4
WINDOW = 4
MIN_WINDOW_SIMILARITY = 0.1
OUTLIERS = -1

CANDIDATE_WORDS = 30
# Passes over the vectors when the centres to begin with are given.
CLUSTER_ROUNDS = 10
NAME_WORDS = 4
REPRESENTATIVES = 3
# Single characters say little about a topic.
WORD_CHARS = 2
# How far apart similarities must be for one topic to be much more probable than another.
TEMPERATURE = 0.1
# Topics are declared by people or found by a clustering with a given k.
MAX_TOPICS = 10_000
# Topics that a text's windows are compared with in one row, about; places times topics worked on at once.
TOPIC_BLOCK = 64
SLICE_ENTRIES = 200_000
# Weights (of a word in a topic) that every task has at hand, at most; four topics leave room for 125,000 words.
WEIGHTS_AT_HAND = 500_000
# Up to this many words are looked for as a list, more by a join.
LISTED_WORDS = 2000
# Words of a projection, numbers of a projected vector, and numbers that one hash gives signs for.
VOCABULARY = 10_000
PROJECTED = 64
HASH_DIGITS = 64


# --- embedding --------------------------------------------------------------------------------------


def fit_hashed_embedding(docs: DataFrame, token_column: str = "tokens", features: int = 256) -> PipelineModel:
    """Default embedding when no vectors are given: hashed TF-IDF of length one."""
    return Pipeline(
        stages=[
            HashingTF(inputCol=token_column, outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_norm"),
        ]
    ).fit(docs)


def embed(docs: DataFrame, model: PipelineModel, vector: str = "vector") -> DataFrame:
    dense = vector_to_array("_norm", "float32")
    return model.transform(docs).withColumn(vector, dense).drop("_tf", "_tfidf", "_norm")


@dataclass(frozen=True)
class TextProjection:
    """Words with their inverse document frequencies, and the seed of their random signs."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    dim: int = PROJECTED
    seed: int = 1

    def signs(self, term: str) -> list[float]:
        """A sign for each number of a vector: a digit of sha256('seed:block:term') from 8 on is plus, below 8 minus."""
        blocks = range(-(-self.dim // HASH_DIGITS))
        digits = "".join(hashlib.sha256(f"{self.seed}:{block}:{term}".encode()).hexdigest() for block in blocks)
        return [1.0 if digit >= "8" else -1.0 for digit in digits[: self.dim]]


def fit_projection(
    docs: DataFrame, token_column: str = "tokens", size: int = VOCABULARY, dim: int = PROJECTED, seed: int = 1
) -> TextProjection:
    """The ``size`` words found in most of all documents (equal counts by word), with ln((documents + 1) / (documents with it + 1)).

    Every word of every document is counted; what comes to the driver is the chosen vocabulary. ``size`` times ``dim`` is
    bounded, as that matrix goes to every task.
    """
    if size * dim > BLOCK_NUMBERS:
        raise ValueError(f"more than {BLOCK_NUMBERS} numbers in a projection")
    every = docs.select(token_column)
    found = every.select(F.explode(F.array_distinct(token_column)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    chosen = found.orderBy(F.desc("df"), "term").limit(size).collect()
    n = every.count()
    return TextProjection(tuple(r["term"] for r in chosen), tuple(math.log((n + 1) / (r["df"] + 1)) for r in chosen), dim, seed)


def project(docs: DataFrame, model: TextProjection, token_column: str = "tokens", vector: str = "vector") -> DataFrame:
    """``docs`` with the TF-IDF of the model's words, added up along their random signs and scaled to length one.

    Cosines of these vectors are near those of the TF-IDF itself. Worked out in the scan, some words at a time, so long
    texts take no more memory. NULL for documents without a word of the model that tells documents apart.
    """
    terms, dim = pa.array(model.terms, pa.string()), model.dim
    weights = np.array([model.signs(t) for t in model.terms]).reshape(-1, dim) * np.array(model.idf)[:, None]
    step = max(1, BLOCK_NUMBERS // dim)

    @F.arrow_udf("array<double>")
    def projected(words: pa.Array) -> pa.Array:
        place = pc.index_in(pc.list_flatten(words), value_set=terms)
        known = pc.is_valid(place).to_numpy(zero_copy_only=False)
        rows = pc.list_parent_indices(words).to_numpy()[known]
        place = place.drop_null().to_numpy()
        out = np.zeros((len(words), dim))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[starts]] += np.add.reduceat(weights[place[at : at + step]], starts, axis=0)
        lengths = np.linalg.norm(out, axis=1)
        usable = lengths > 0
        out[usable] /= lengths[usable, None]
        ends = pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()), mask=pa.array(~usable))

    return docs.withColumn(vector, projected.asNondeterministic()(F.col(token_column)))


def with_tokens(docs: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    return docs.withColumn(out, tokens(F.col(text), WORD_CHARS))


# --- assignment -------------------------------------------------------------------------------------


def topic_means(assigned: DataFrame, vector: str = "vector") -> DataFrame:
    """topic, mean vector, rows; partial sums are made before the shuffle."""
    return assigned.groupBy("topic").agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("mean"),
        F.count(F.lit(1)).alias("rows"),
    )


def _named_vectors(means: DataFrame) -> tuple[list, list]:
    rows = means.select("topic", "mean").orderBy("topic").limit(MAX_TOPICS + 1).collect()
    if len(rows) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    return [r["topic"] for r in rows], [r["mean"] for r in rows]


def nearest_topic(docs: DataFrame, means: DataFrame, vector: str = "vector") -> DataFrame:
    """``docs`` with the topic of the most similar mean and the similarity, computed row by row in
    the scan: no row is multiplied by the topics and nothing is shuffled."""
    names, vectors = _named_vectors(means)
    kind = means.schema["topic"].dataType
    listed = F.array(*[F.lit(n) for n in names]).cast(f"array<{kind.simpleString()}>")
    matched = docs.withColumn("_best", best_match(F.col(vector), names, vectors))
    return (
        matched.withColumn("topic", F.get(listed, F.col("_best.place")))
        .withColumn("similarity", F.col("_best.similarity"))
        .drop("_best")
    )


def zero_shot(
    docs: DataFrame, named: DataFrame, vector: str = "vector", min_similarity: float = MIN_SIMILARITY
) -> DataFrame:
    """``docs`` with the most similar named topic; NULL where none reaches ``min_similarity``.

    ``named`` has ``topic`` and ``mean``, the vector of the topic's name or of its examples.
    """
    near = nearest_topic(docs, named, vector)
    return near.withColumn("topic", F.when(F.col("similarity") >= min_similarity, F.col("topic")))


def cluster_rest(docs: DataFrame, key: str, k: int, vector: str = "vector", min_topic_size: int = MIN_TOPIC_SIZE,
                 seed: int = 1) -> DataFrame:
    """``key, topic`` by k-means on the cosine; clusters below ``min_topic_size`` become topic -1.

    Topics are numbered from 0 by size, largest first. Rows without a usable vector are outliers.
    """
    usable = unit_vectors(docs.select(key, vector), vector).select(key, array_to_vector("_unit").alias("_unit"))
    # the passes of the clustering read a written table, not the source again
    points = stage(usable, "cluster-points")
    model = KMeans(featuresCol="_unit", predictionCol="_cluster", k=k, seed=seed, distanceMeasure="cosine").fit(points)
    clustered = stage(model.transform(points).select(key, "_cluster"), "clusters")
    found = numbered_topics(clustered, min_topic_size).select(key, "topic")
    return (
        docs.select(key)
        .join(found, key, "left")
        .select(key, F.coalesce("topic", F.lit(OUTLIERS)).cast("int").alias("topic"))
    )


def numbered_topics(clustered: DataFrame, min_topic_size: int = MIN_TOPIC_SIZE, cluster: str = "_cluster") -> DataFrame:
    """``clustered`` with ``topic``: its clusters numbered from 0 by size, largest first (equal sizes by cluster).

    Clusters below ``min_topic_size``, and rows without a cluster, are topic -1.
    """
    sizes = clustered.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"))
    by_size = Window.orderBy(F.desc("_size"), cluster)  # a row per cluster from here on
    numbers = sizes.where(F.col("_size") >= min_topic_size).select(cluster, (F.row_number().over(by_size) - 1).alias("topic"))
    rows = clustered.join(F.broadcast(numbers), cluster, "left")
    return rows.withColumn("topic", F.coalesce("topic", F.lit(OUTLIERS)).cast("int"))


def drawn_centres(docs: DataFrame, key: str, k: int, vector: str = "vector") -> DataFrame:
    """``topic, mean, rows`` of ``k`` usable vectors: those with the smallest md5 of the key, so the draw hangs on nothing else."""
    drawn = unit_vectors(docs.select(key, vector), vector).select(F.md5(F.col(key).cast("string")).alias("_draw"), key, "_unit")
    number = F.row_number().over(Window.orderBy("_draw", key)) - 1  # k rows
    return drawn.orderBy("_draw", key).limit(k).select(number.alias("topic"), F.col("_unit").alias("mean"), F.lit(0).cast("long").alias("rows"))


def moved_centres(points: DataFrame, centres: DataFrame, rounds: int, vector: str = "vector") -> DataFrame:
    """``topic, mean, rows`` after ``rounds`` rounds: each vector goes to its nearest centre, each centre to their mean.

    ``points`` have vectors of length one. A round is one pass over them: they are compared in the scan and summed before
    the only shuffle, which moves a row per task and centre. A centre that no vector is nearest to stays where it is.
    """
    for _ in range(rounds):
        near = nearest_topic(points, centres, vector).where(F.col("topic").isNotNull())
        means = topic_means(near, vector).withColumnsRenamed({"mean": "_mean", "rows": "_rows"})
        moved = centres.join(F.broadcast(means), "topic", "left")  # as many rows as centres
        centres = stage(moved.select("topic", F.coalesce("_mean", "mean").alias("mean"), F.coalesce("_rows", F.lit(0).cast("long")).alias("rows")), "centres")
    return centres


def cluster_from(
    docs: DataFrame, key: str, centres: DataFrame, rounds: int = CLUSTER_ROUNDS, vector: str = "vector", min_topic_size: int = MIN_TOPIC_SIZE
) -> DataFrame:
    """``key, topic`` as ``cluster_rest`` gives them, by a fixed number of rounds from given ``centres`` (``topic, mean, rows``).

    Rows with equal keys are clustered each on its own; rows without a usable vector are outliers.
    """
    points = stage(unit_vectors(docs.select(vector), vector).select(F.col("_unit").alias("_point")), "cluster-points")
    found = moved_centres(points, stage(centres, "centres"), rounds, "_point")
    near = nearest_topic(docs.select(key, vector), found, vector)
    return numbered_topics(stage(near.select(key, F.col("topic").alias("_cluster")), "clusters"), min_topic_size).select(key, "topic")


# --- topic words ------------------------------------------------------------------------------------


def topic_term_counts(assigned: DataFrame, key: str, text: str) -> DataFrame:
    """topic, term, tf over all documents of the topic. A task's words are summed up before they are shuffled."""
    words = spread_input(assigned.select(key, "topic", text), key)
    every = words.select("topic", F.explode(tokens(F.col(text), WORD_CHARS)).alias("term"))
    return every.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))


def class_tfidf(counts: DataFrame) -> DataFrame:
    """Weight of each word in each topic: its share of the topic's words times ln(1 + A / f).

    A is the mean number of words per topic, cut to a whole number; f is the word's count over all
    topics. The totals per topic are one row per topic; those per word are a window of at most one
    row per topic.
    """
    counted = stage(counts, "topic-terms")  # read for the totals and for the weights
    totals = counted.groupBy("topic").agg(F.sum("tf").alias("_words"))
    if not has_at_most(totals, MAX_TOPICS):
        raise ValueError(f"more than {MAX_TOPICS} topics")
    mean = F.floor(F.avg("_words").over(Window.partitionBy(F.lit(0))))  # one row per topic
    sized = counted.withColumn("_f", F.sum("tf").over(Window.partitionBy("term"))).join(
        F.broadcast(totals.withColumn("_mean", mean)), "topic"
    )
    idf = F.log(1 + F.col("_mean") / F.col("_f"))
    return sized.select("topic", "term", "tf", idf.alias("idf"), (F.col("tf") / F.col("_words") * idf).alias("weight"))


def top_words(weights: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """topic, term, weight, rank for the n heaviest words of each topic; equal weights by word."""
    rounded = weights.select("topic", "term", F.round("weight", 9).alias("weight"))
    return top_k(rounded, n, [F.desc("weight"), F.asc("term")], F.col("term"), by=["topic"], rank="rank")


def topic_labels(words: DataFrame, separator: str = ", ", first: int | None = None) -> DataFrame:
    """topic, label: the ranked words of a topic joined in order."""
    kept = words if first is None else words.where(F.col("rank") <= first)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return kept.groupBy("topic").agg(F.array_join(F.transform(ordered, lambda w: w["term"]), separator).alias("label"))


def topic_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))


def representative_documents(
    assigned: DataFrame, words: DataFrame, key: str, text: str, n: int = REPRESENTATIVES
) -> DataFrame:
    """topic, key, score, rank of the documents that use the topic's top words most.

    The score is the weighted share of those words in the document; only the ranked words are sent
    to the documents.
    """
    docs = spread_input(assigned.select(key, "topic", text), key)
    sized = docs.select(key, "topic", tokens(F.col(text), WORD_CHARS).alias("_t")).withColumn("_len", F.size("_t"))
    few = listed_words(words)
    if few is not None:  # drop the other words before they are counted
        sized = sized.withColumn("_t", only_words(F.col("_t"), few))
    counted = term_counts(sized, "_t", [key, "topic", "_len"])
    used = join_small(counted, words.select("topic", "term", "weight"), ["topic", "term"], F.col(key))
    scored = used.groupBy("topic", key).agg(
        F.round(F.sum(F.col("tf") * F.col("weight") / F.col("_len")), 9).alias("score")
    )
    return top_k(scored, n, [F.desc("score"), F.asc(key)], F.col(key), by=["topic"], rank="rank")


def topic_info(assigned: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """One row per topic: size, name, top words and representative documents."""
    words = stage(words, "topic-words")  # a few rows per topic, used three times
    representatives = representative_documents(assigned, words, key, text)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("doc"))))
    docs = representatives.groupBy("topic").agg(F.transform(listed, lambda d: d["doc"]).alias("representative_docs"))
    names = topic_labels(words, "_", NAME_WORDS).withColumnRenamed("label", "_name")
    labels = topic_labels(words).withColumnRenamed("label", "representation")
    info = topic_sizes(assigned)
    for part in (names, labels, docs):  # one row per topic each
        info = info.join(part, "topic", "left")
    return info.select(
        "topic", "count", F.concat_ws("_", F.col("topic").cast("string"), "_name").alias("name"), "representation",
        "representative_docs",
    )


def listed_words(words: DataFrame) -> list[str] | None:
    """The different terms of ``words``, None when there are more than ``LISTED_WORDS``."""
    few = [r["term"] for r in words.select("term").where("term IS NOT NULL").distinct().limit(LISTED_WORDS + 1).collect()]
    return few if len(few) <= LISTED_WORDS else None


def only_words(words: Column, few: list[str]) -> Column:
    return F.filter(words, lambda w: w.isin(few))


def word_vectors(docs: DataFrame, words: DataFrame, token_column: str = "tokens", vector: str = "vector") -> DataFrame:
    """term, vector: mean of the vectors of the documents using the term, for the terms in ``words``."""
    few = listed_words(words)
    if few is not None:
        return _listed_vectors(docs, sorted(few), token_column, vector)
    used = docs.select(
        F.explode(F.array_distinct(token_column)).alias("term"),
        array_to_vector(F.col(vector).cast("array<double>")).alias("_v"),
        F.xxhash64(vector).alias("_spread"),
    )
    wanted = join_small(used, words.select("term").distinct(), ["term"], F.col("_spread"), "left_semi")
    return wanted.groupBy("term").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("vector"))


def _listed_vectors(docs: DataFrame, few: list[str], token_column: str, vector: str) -> DataFrame:
    """``word_vectors`` of few words: a task adds up its documents' vectors as matrix products, some documents at a time,
    and passes on a row per word; no vector is repeated for each word of its document."""
    terms = pa.array(few, pa.string())
    step = max(1, BLOCK_NUMBERS // max(1, len(few)))

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, np.zeros(len(few), np.int64)
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(0)), 0))
            words, vectors = batch.column(0), batch.column(1)
            if not len(batch):
                continue
            if vectors.null_count or len(pc.unique(pc.list_value_length(vectors))) > 1:
                raise ValueError("documents without a vector, or with vectors of several lengths")
            matrix = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            if total is None:
                total = np.zeros((len(few), matrix.shape[1]))
            if matrix.shape[1] != total.shape[1]:
                raise ValueError("vectors of several lengths")
            place = pc.index_in(pc.list_flatten(words), value_set=terms).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(words).to_numpy()
            for at in range(0, len(batch), step):
                low, high = np.searchsorted(row, [at, at + step])
                holds = np.zeros((len(few), min(step, len(batch) - at)))
                holds[place[low:high], row[low:high] - at] = 1.0
                total += holds @ matrix[at : at + step]
                rows += holds.sum(axis=1).astype(np.int64)
        if total is not None and rows.any():
            found = np.flatnonzero(rows)
            mean = total[found] / rows[found, None]
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * mean.shape[1])
            columns = [terms.take(pa.array(found)), pa.ListArray.from_arrays(ends, pa.array(mean.ravel())), pa.array(rows[found].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "mean", "n"])

    used = docs.select(only_words(F.col(token_column), few).alias("_words"), F.col(vector).alias("_v"))
    parts = used.mapInArrow(means, "term string, mean array<double>, n double")
    return parts.groupBy("term").agg(vector_to_array(Summarizer.mean(array_to_vector("mean"), F.col("n"))).alias("vector"))


def diverse_words(
    candidates: DataFrame, vectors: DataFrame, means: DataFrame, n: int = TOP_WORDS, diversity: float = DIVERSITY
) -> DataFrame:
    """topic, term, rank by maximal marginal relevance.

    ``candidates`` are the ranked words of each topic, a fixed number of them; ``vectors`` and ``means`` come from
    ``word_vectors`` and ``topic_means``. The first word is the one nearest to the mean; each next one has the most left of
    its nearness, weighed against that to the nearest word chosen already. Equal values (to 9 decimals) go by rank. A topic
    is one row of its candidates and their closeness to each other; the rounds are a fold over it.
    """

    def near(a: Column, b: Column) -> Column:
        return F.coalesce(similarity(a, b), F.lit(0.0))  # a vector without a direction is near to nothing

    joined = candidates.select("topic", "term", "rank").join(vectors, "term").join(means.select("topic", "mean"), "topic")
    word = F.struct("rank", "term", "vector", near(F.col("vector"), F.col("mean")).alias("relevance"))
    listed = joined.groupBy("topic").agg(F.sort_array(F.collect_list(word)).alias("words"))
    listed = listed.withColumn("close", F.transform("words", lambda a: F.transform("words", lambda b: near(a["vector"], b["vector"]))))
    places, last = F.sequence(F.lit(0), F.size("words") - 1), F.least(F.lit(n), F.size("words"))

    def best(places: Column, gain: Callable[[Column], Column]) -> Column:
        return -F.array_max(F.transform(places, lambda i: F.struct(F.round(gain(i), 9), (-i).alias("place"))))["place"]

    def relevance(i: Column) -> Column:
        return F.get(F.col("words"), i)["relevance"]

    def next_to(chosen: Column) -> Column:
        def gain(i: Column) -> Column:
            nearest = F.array_max(F.transform(chosen, lambda j: F.get(F.get(F.col("close"), i), j)))
            return (1 - diversity) * relevance(i) - diversity * nearest

        return best(F.filter(places, lambda i: ~F.array_contains(chosen, i)), gain)

    first = F.array(best(places, relevance))
    rounds = F.aggregate(F.sequence(F.lit(2), last), first, lambda chosen, _: F.concat(chosen, F.array(next_to(chosen))))
    chosen = listed.select("topic", "words", F.posexplode(F.when(last > 1, rounds).otherwise(first)).alias("at", "place"))
    return chosen.select("topic", F.get("words", F.col("place"))["term"].alias("term"), (F.col("at") + 1).alias("rank"))


def centroid_words(candidates: DataFrame, vectors: DataFrame, means: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """topic, term, similarity, rank: candidates nearest to the topic's mean vector."""
    joined = candidates.select("topic", "term").join(vectors, "term").join(means.select("topic", "mean"), "topic")
    near = joined.select("topic", "term", F.round(similarity(F.col("vector"), F.col("mean")), 9).alias("similarity"))
    return top_k(near, n, [F.desc("similarity"), F.asc("term")], F.col("term"), by=["topic"], rank="rank")


def model_labels(
    info: DataFrame, make_complete: MakeComplete, settings: ModelSettings | None = None, threads: int = 1
) -> DataFrame:
    """``info`` with a model-written ``label`` per topic, and ``label_error`` where the call failed."""
    prompt = F.concat(
        F.lit("task: name the topic of a group of reviews in a few words\nwords: "), F.col("representation")
    )
    asked = info.withColumn("_call", model_call(prompt, make_complete, settings or ModelSettings(), threads))
    return asked.withColumn("label", F.col("_call.reply")).withColumn("label_error", F.col("_call.error")).drop("_call")


# --- topics of new text -----------------------------------------------------------------------------


def topic_probabilities(
    docs: DataFrame, means: DataFrame, vector: str = "vector", n: int | None = None, temperature: float = TEMPERATURE
) -> DataFrame:
    """``docs`` with the array ``topics`` of topic, similarity and probability, most probable first; ``n`` of them when given.

    The probability is the topic's part of the sum of exp(similarity / ``temperature``) over all topics, also those
    beyond ``n``. Equal similarities come by topic. NULL for documents without a usable vector. Worked out in the scan, some
    rows at a time, so that rows times topics held at once are bounded.
    """
    names, vectors = _named_vectors(means)
    kind = means.schema["topic"].dataType
    if not names:
        raise ValueError("nothing to compare with")
    matrix, listed = np.stack([unit(v) for v in vectors]), pa.array(names)

    @F.arrow_udf(T.ArrayType(T.StructType([
        T.StructField("topic", kind), T.StructField("similarity", T.DoubleType()), T.StructField("probability", T.DoubleType())
    ])))
    def ranked(vectors: pa.Array) -> pa.Array:
        rows, scaled = batch_matrix(vectors, matrix.shape[1])
        wide, step = min(n or len(names), len(names)), max(1, BLOCK_NUMBERS // len(names))
        place, similar, chance = np.empty((len(rows), wide), np.int64), np.empty((len(rows), wide)), np.empty((len(rows), wide))
        for at in range(0, len(rows), step):
            near = np.round(scaled[at : at + step] @ matrix.T, DECIMALS)
            part = np.exp((near - near.max(axis=1, keepdims=True)) / temperature)
            order = np.argsort(-near, axis=1, kind="stable")[:, :wide]
            place[at : at + step], similar[at : at + step] = order, np.take_along_axis(near, order, axis=1)
            chance[at : at + step] = np.take_along_axis(part / part.sum(axis=1, keepdims=True), order, axis=1)
        values = pa.StructArray.from_arrays(
            [listed.take(pa.array(place.ravel())), pa.array(similar.ravel()), pa.array(chance.ravel())], names=["topic", "similarity", "probability"]
        )
        held = np.zeros(len(vectors), bool)
        held[rows] = True
        ends = np.concatenate([[0], np.cumsum(held * wide)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~held, False)), values)

    return docs.withColumn("topics", ranked.asNondeterministic()(vector))


def assign_new(docs: DataFrame, means: DataFrame, words: DataFrame, vector: str = "vector") -> DataFrame:
    """New documents with topic, similarity, the topic's probability among all, and its words."""
    best = F.get("topics", F.lit(0))
    found = topic_probabilities(docs, means, vector, 1)
    found = found.select(*[F.col(f"`{c}`") for c in docs.columns if c != "topic"], *[best[c].alias(c) for c in ("topic", "similarity", "probability")])
    return found.join(
        F.broadcast(topic_labels(words).withColumnRenamed("label", "topic_words")), "topic", "left"
    )


def topic_distribution(
    docs: DataFrame, weights: DataFrame, key: str, text: str, window: int = WINDOW,
    min_similarity: float = MIN_WINDOW_SIMILARITY,
) -> DataFrame:
    """key, topic, share: how much of a text is about each topic.

    Every run of ``window`` words (the whole text when shorter) is compared with each topic's word
    weights by cosine; similarities of at least ``min_similarity`` are added up per topic and scaled
    to sum 1. Texts without any such window have no rows.

    Up to ``TOPIC_BLOCK`` topics, the words that occur most are known to every task by number, with their weights; only other
    words are looked up by a join, and a text goes to them as the numbers of its words. With more topics every word is
    looked up: topics are taken in blocks of about ``TOPIC_BLOCK``, and a text meets only blocks with topics of its words, so
    what one row holds is bounded by the text and the block, however many topics there are. The sum over a window is a
    difference of running sums over the positions where a topic has weight.
    """
    weights = stage(weights, "topic-weights")
    sizes = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    topics = sizes.count()
    blocks = max(1, -(-topics // TOPIC_BLOCK))
    norms = join_small(weights, sizes, ["topic"], spread=F.col("term"))
    scaled = norms.select(
        "term", "tf", "idf", F.pmod(F.xxhash64("topic"), F.lit(blocks)).alias("block"), "topic", (F.col("weight") / F.col("_norm")).alias("w")
    )
    by_topic = F.collect_list(F.struct("topic", "w")).alias("by_topic")
    spread = spread_input(docs.select(key, text), key)
    words = spread.select(key, tokens(F.col(text), WORD_CHARS).alias("_t")).withColumn("_len", F.size("_t"))
    if blocks == 1:
        packed = stage(scaled.groupBy("term").agg(F.first("idf").alias("idf"), F.sum("tf").alias("tf"), by_topic), "packed-weights")
        return _shares(_sums_by_number(words, packed, key, WEIGHTS_AT_HAND // max(1, topics), window, min_similarity), key)
    packed = scaled.groupBy("term", "block").agg(F.first("idf").alias("idf"), by_topic)
    # the length of a window counts words without weight in a block too
    every = scaled.groupBy("term").agg(F.first("idf").alias("idf")).withColumn("block", F.lit(-1).cast("long"))
    packed = packed.unionByName(every, allowMissingColumns=True)

    # a common word occurs in most texts: its rows are divided over several tasks
    hot = hot_keys(weights.groupBy("term").agg(F.sum("tf").alias("tf")), ["term"], "tf")
    known = join_salted(term_positions(words, "_t", [key, "_len"]), packed, ["term"], F.col(key), hot=hot)
    entry = F.struct("positions", "idf", F.col("by_topic.topic").alias("topic"), F.col("by_topic.w").alias("w"))
    grouped = known.groupBy(key, "_len", "block").agg(F.collect_list(entry).alias("words"))

    @F.arrow_udf("array<double>")
    def lengths(words: pa.Array, sizes: pa.Array) -> pa.Array:
        return _lengths(words, sizes, window)

    @F.arrow_udf(_sums_type(weights.schema["topic"].dataType))
    def summed(words: pa.Array, lengths: pa.Array) -> pa.Array:
        entries = _starts(words)
        cost = np.bincount(np.repeat(np.arange(len(words)), np.diff(entries)), minlength=len(words), weights=_links(words))
        return _in_slices(cost, lambda low, n: _topic_sums(words.slice(low, n), lengths.slice(low, n), window, min_similarity))

    measured = grouped.where("block < 0").select(key, lengths("words", "_len").alias("lengths"))
    whole = grouped.where("block >= 0").join(measured, key)
    return _shares(whole.select(key, F.explode(summed("words", "lengths")).alias("x")).select(key, "x.topic", "x.sum"), key)


def _shares(sums: DataFrame, key: str) -> DataFrame:
    total = F.sum("sum").over(Window.partitionBy(key))  # at most a row per topic
    return sums.select(key, "topic", (F.col("sum") / total).alias("share"))


def _sums_by_number(words: DataFrame, packed: DataFrame, key: str, at_hand: int, window: int, min_similarity: float) -> DataFrame:
    """key, topic, sum of the windows' similarities. ``words`` has the key, the words ``_t`` and their number ``_len``; ``packed``
    the weights by topic of each term and how often it occurs.

    The terms that occur most, ``at_hand`` at most, go to every task, where a text becomes the numbers of its words; its
    other words are joined with their weights, and both meet at the key. So texts and weights of common words are not moved.
    """
    level = F.coalesce(F.floor(4 * F.log2(F.col("tf").cast("double"))), F.lit(-1).cast("long"))
    bar, held = None, 0
    for at, n in sorted(packed.groupBy(level.alias("level")).count().collect(), reverse=True):  # four rows per power of two
        held += n
        if held > at_hand:
            break
        bar = at
    common, others = (packed.where(F.lit(False)), packed) if bar is None else (packed.where(level >= bar), packed.where(level < bar))
    weight = [F.col("by_topic.topic").alias("topic"), F.col("by_topic.w").alias("w")]
    table = common.select("term", "idf", *weight).toArrow()
    shared = words.sparkSession.sparkContext.broadcast([table[c].combine_chunks() for c in table.column_names])

    @F.arrow_udf("line array<int>, rare array<struct<term string, positions array<int>>>")
    def numbered(words: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // WORDS_AT_ONCE)) + 1
        return pa.concat_arrays([_numbered(words.slice(low, high - low), shared.value[0]) for low, high in zip([0, *cuts], [*cuts, len(words)])])

    texts = words.where("_len > 0").select(key, "_len", numbered.asNondeterministic()("_t").alias("_x"))
    texts = stage(texts.select(key, "_len", "_x.*"), "numbered-words")
    rare = texts.select(key, "_len", F.explode("rare").alias("_r")).select(key, "_len", "_r.term", "_r.positions")
    entry = F.struct("positions", "idf", *weight).alias("word")
    looked_up = rare.join(others, "term").select(key, "_len", entry)
    both = looked_up.unionByName(texts.select(key, "_len", "line"), allowMissingColumns=True)
    whole = both.groupBy(key, "_len").agg(F.collect_list("line").alias("lines"), F.collect_list("word").alias("words"))

    @F.arrow_udf(_sums_type(packed.schema["by_topic"].dataType.elementType["topic"].dataType))
    def summed(lines: pa.Array, words: pa.Array, sizes: pa.Array) -> pa.Array:
        _, idf, topic, w = shared.value
        topics = np.append(np.diff(_starts(topic)), 0)  # none for a word without a number
        numbers, entries = pc.list_flatten(lines), _starts(words)
        row = pc.list_parent_indices(lines).to_numpy()[pc.list_parent_indices(numbers).to_numpy()]
        cost = np.bincount(row, minlength=len(lines), weights=topics[pc.list_flatten(numbers).to_numpy()])
        cost += np.bincount(np.repeat(np.arange(len(words)), np.diff(entries)), minlength=len(words), weights=_links(words))

        def part(low: int, n: int) -> pa.Array | None:
            every = _with_numbers(lines.slice(low, n), words.slice(low, n), idf, topic, w)
            return _topic_sums(every, _lengths(every, sizes.slice(low, n), window), window, min_similarity)

        return _in_slices(cost, part)

    found = whole.select(key, F.explode(summed.asNondeterministic()("lines", "words", "_len")).alias("x"))
    return found.select(key, "x.topic", "x.sum")


def _sums_type(topic: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("topic", topic), T.StructField("sum", T.DoubleType())]))


def _in_slices(cost: np.ndarray, part: Callable[[int, int], pa.Array | None]) -> pa.Array:
    """``part`` of some rows at a time, from a row on and so many."""
    cuts = np.flatnonzero(np.diff(np.floor(np.cumsum(cost) / SLICE_ENTRIES))) + 1
    parts = [part(low, high - low) for low, high in zip([0, *cuts], [*cuts, len(cost)])]
    return pa.concat_arrays([p for p in parts if p is not None] or [pa.nulls(0)])


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal numbers together, and where each run of them begins in it."""
    order = np.argsort(group, kind="stable")
    ranked = group[order]
    return order, np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])


def _numbered(words: pa.Array, terms: pa.Array) -> pa.Array:
    """Per text the place of each of its words in ``terms``, -1 for others, and the positions of each of the others."""
    flat, starts = pc.list_flatten(words), _starts(words)
    place = pc.index_in(flat, value_set=terms)
    line = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pc.fill_null(place, -1))
    at = np.flatnonzero(pc.is_null(place).to_numpy(zero_copy_only=False))
    coded, row = flat.take(pa.array(at)).dictionary_encode(), pc.list_parent_indices(words).to_numpy()[at].astype(np.int64)
    wide = max(1, len(coded.dictionary))
    group = row * wide + coded.indices.to_numpy()
    order, begin = _runs(group)
    row, term = np.divmod(group[order][begin], wide)
    positions = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), pa.array((at - starts[group // wide])[order], pa.int32()))
    runs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(term)), positions], names=["term", "positions"])
    rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(words) + 1)), pa.int32()), runs)
    return pa.StructArray.from_arrays([line, rare], names=["line", "rare"])


def _with_numbers(lines: pa.Array, words: pa.Array, idf: pa.Array, topic: pa.Array, w: pa.Array) -> pa.Array:
    """``words`` with the words that ``lines`` tell by number, in one list per row."""
    numbers, found = pc.list_flatten(lines), words.flatten()
    number, text = pc.list_flatten(numbers).to_numpy(), pc.list_parent_indices(numbers).to_numpy().astype(np.int64)
    at = np.arange(len(number)) - _starts(numbers)[text]
    held, wide = number >= 0, max(1, len(idf))
    group = text[held] * wide + number[held]
    order, begin = _runs(group)
    text, number = np.divmod(group[order][begin], wide)
    positions = pa.ListArray.from_arrays(pa.array(np.append(begin, len(group)), pa.int32()), pa.array(at[held][order], pa.int32()))
    number = pa.array(number)
    common = pa.StructArray.from_arrays([positions, idf.take(number), topic.take(number), w.take(number)], names=["positions", "idf", "topic", "w"])
    owner = np.concatenate([pc.list_parent_indices(lines).to_numpy()[text], pc.list_parent_indices(words).to_numpy()])
    order = np.argsort(owner, kind="stable")
    every = pa.concat_arrays([common.cast(found.type), found]).take(pa.array(order))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(len(lines) + 1)), pa.int32()), every)


def _lengths(words: pa.Array, sizes: pa.Array, window: int) -> pa.Array:
    """The length of each window's vector, per text of so many words."""
    found, out = words.flatten(), []
    idf = found.field("idf").to_numpy(zero_copy_only=False)
    place, first_place = found.field("positions").flatten().to_numpy(), _starts(found.field("positions"))
    first_word = _starts(words)
    for i, size in enumerate(sizes.to_numpy(zero_copy_only=False)):
        a, b = first_word[i], first_word[i + 1]
        line = np.full(size, -1)  # which of the text's words stands at each position
        line[place[first_place[a] : first_place[b]]] = np.repeat(np.arange(a, b), np.diff(first_place[a : b + 1]))
        out.append(window_lengths(line, idf, window))
    return pa.array(out, pa.list_(pa.float64()))


def _starts(lists: pa.Array) -> np.ndarray:
    """Where each list begins in the flattened values, and their number at the end."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])


def _links(words: pa.Array) -> np.ndarray:
    """Positions times topics of each word."""
    found = words.flatten()
    return np.diff(_starts(found.field("positions"))) * np.diff(_starts(found.field("topic")))


def window_lengths(line: np.ndarray, idf: np.ndarray, window: int) -> np.ndarray:
    """The length of each window's vector, equal words counted together; ``line`` has the word at each position, -1 for none.

    Two places at distance d stand in the windows that begin from where the later one is the last to where the earlier one
    is the first: window - d of them in a row, so running sums of the products at each distance give all windows.
    """
    width = min(window, len(line))
    value = np.where(line >= 0, idf[line], 0.0) if len(idf) else np.zeros(len(line))
    squared = np.zeros(len(line) - width + 1)
    for apart in range(width):
        same = value[: len(line) - apart] * value[apart:] * (line[: len(line) - apart] == line[apart:])
        running = np.concatenate([[0.0], np.cumsum(same)])
        reach = width - apart
        squared += (1 if apart == 0 else 2) * (running[reach : reach + len(squared)] - running[: len(squared)])
    return np.sqrt(np.maximum(squared, 0.0))


def _topic_sums(words: pa.Array, lengths: pa.Array, window: int, min_similarity: float) -> pa.Array | None:
    """Per text the topics with a similar window, and the sum of these similarities.

    Texts are laid end to end with room between them, so that no window reaches from one into another; a topic's places are
    sorted there, and each window that holds one of them is a difference of running sums.
    """
    found = words.flatten()
    text_of = np.repeat(np.arange(len(words)), np.diff(_starts(words)))
    spans = pc.list_value_length(lengths).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(spans + 2 * window)])
    places, topics = found.field("positions"), found.field("topic")
    n_places, n_topics = np.diff(_starts(places)), np.diff(_starts(topics))
    names = topics.flatten().dictionary_encode()
    at, weight = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.field("w").flatten().to_numpy(zero_copy_only=False)
    place = places.flatten().to_numpy() + np.repeat(begin[text_of], n_places) + window
    # every place of a word with every topic of it
    many = n_places * n_topics
    nth, wide = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many), np.repeat(n_topics, many)
    left = np.repeat(_starts(places)[:-1], many) + nth // wide
    right = np.repeat(_starts(topics)[:-1], many) + nth % wide
    line = int(begin[-1]) + window
    where = at[right] * line + place[left]
    value = weight[right] * np.repeat(found.field("idf").to_numpy(zero_copy_only=False), many)
    order = np.argsort(where, kind="stable")
    where, running = where[order], np.concatenate([[0.0], np.cumsum(value[order])])
    starts = np.unique(np.concatenate([where - k for k in range(window)])) if len(where) else where
    own = np.searchsorted(begin, starts % line - window, side="right") - 1
    first = starts % line - window - begin[own]
    inside = (first >= 0) & (first < spans[own])
    starts, own, first = starts[inside], own[inside], first[inside]
    dot = running[np.searchsorted(where, starts + window)] - running[np.searchsorted(where, starts)]
    length = lengths.flatten().to_numpy(zero_copy_only=False)[(_starts(lengths)[:-1][own] + first)]
    similar = np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)
    kept = np.round(similar, 9) >= min_similarity
    topic, own, similar = starts[kept] // line, own[kept], similar[kept]
    group = own * max(1, len(names.dictionary)) + topic
    keys, inverse = np.unique(group, return_inverse=True)
    total = np.bincount(inverse, weights=similar, minlength=len(keys))
    some = total > 0
    keys, total = keys[some], total[some]
    row, topic = np.divmod(keys, max(1, len(names.dictionary)))
    values = pa.StructArray.from_arrays([names.dictionary.take(pa.array(topic)), pa.array(total, pa.float64())], names=["topic", "sum"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(words) + 1)), pa.int32()), values)
