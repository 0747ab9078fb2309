"""A published search index: ordinary parquet tables under one version folder.

documents   the indexed rows, all columns, with their terms and counts, partitioned by bucket of the document key
postings    bucket, term, doc, tf, len   one row per term and document, partitioned by bucket of term
term_stats  bucket, term, df             partitioned likewise
corpus      docs, avg_len                one row
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxsift.functions.stemming import stem
from voxsift.functions.text import term_counts, tokens, with_term_runs
from voxsift.sources import versions
from voxsift.staging import fresh_path, shuffle_partitions

TOKENIZERS = ("en_stem", "plain")
# Folders of terms; a query reads only those of its own terms.
TERM_BUCKETS = 64
# Terms that the sketch names and keeps counters for; it misses none with more than a few of its counters' shares of all rows.
SKETCH_TERMS = 10_000
SKETCH_COUNTERS = 100_000


# Columns the index adds to its documents: token count and bucket of the key.
OWN_COLUMNS = ("_tokens", "_doc_bucket")


def term_bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def stemmed_if(frame: DataFrame, tokenizer: str) -> DataFrame:
    """Terms as the index stores them: equal stems of one row merged by the caller."""
    return frame.withColumn("term", stem(F.col("term"))) if tokenizer == "en_stem" else frame


def document_terms(rows: DataFrame, doc_key: str, text_column: str, tokenizer: str = "en_stem") -> DataFrame:
    """doc, term, tf, len of every document; equal stems are not merged yet."""
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"tokenizer {tokenizer} is none of {', '.join(TOKENIZERS)}")
    words = rows.select(F.col(doc_key).alias("doc"), tokens(F.col(text_column)).alias("_tokens"))
    sized = words.select("doc", F.size("_tokens").alias("len"), "_tokens")
    return stemmed_if(term_counts(sized, "_tokens", ["doc", "len"]), tokenizer)


def indexed_terms(documents: DataFrame, doc_key: str) -> DataFrame:
    """doc, term, tf, len from the terms stored with the documents: texts are not read."""
    runs = documents.select(F.col(doc_key).alias("doc"), F.col("_tokens").alias("len"), F.explode("_runs").alias("_run"))
    return runs.select("doc", "len", "_run.term", "_run.tf")


def hot_terms(terms: DataFrame, tasks: int, tokenizer: str = "plain") -> DataFrame:
    """term, slices, first: terms with more rows than a task's share, over how many tasks their rows are to be divided, and the
    first of these. Hot terms begin where the one before ends, so that their slices do not pile up.

    A sketch of frequent items, filled where the rows are, counts the terms; at most ``SKETCH_TERMS`` come out of it. They
    are stemmed after that, so no row passes through Python for it. The counts are estimates, which only move rows.
    """
    sketch = F.expr(f"approx_top_k(term, {SKETCH_TERMS}, {SKETCH_COUNTERS})")
    counted = terms.agg(sketch.alias("top"), F.count(F.lit(1)).alias("rows"))
    named = stemmed_if(counted.select("rows", F.explode("top").alias("t")).select("rows", F.col("t.item").alias("term"), "t.count"), tokenizer)
    slices = F.least(F.lit(tasks), F.ceil(F.sum("count") * tasks / F.max("rows"))).cast("int")
    found = named.groupBy("term").agg(slices.alias("slices")).where("slices > 1")
    before = Window.orderBy(F.desc("slices"), "term").rowsBetween(Window.unboundedPreceding, -1)  # at most SKETCH_TERMS rows
    return found.withColumn("first", F.pmod(F.coalesce(F.sum("slices").over(before), F.lit(0)), F.lit(tasks)).cast("int"))


def merged_postings(terms: DataFrame, buckets: int, hot: DataFrame, merge: bool = True) -> DataFrame:
    """Postings, in the layout they are stored in. ``merge`` is needed where a document may have a term on several rows.

    One shuffle, in which a row names its task. A bucket has some tasks, among which its terms are divided; the rows of a
    hot term are divided by document over the tasks that ``hot`` gives it. Tasks are as many as shuffle
    partitions, and the merge of equal stems needs no other shuffle.
    """
    tasks = shuffle_partitions(terms.sparkSession)
    own = max(1, tasks // buckets)
    home = F.col("bucket") * own + F.pmod(F.xxhash64("term", F.lit("slice")), F.lit(own)).cast("int")
    slice_of_doc = F.pmod(F.xxhash64("doc"), F.col("slices")).cast("int")
    placed = (
        terms.withColumn("bucket", term_bucket(F.col("term"), buckets))
        .join(F.broadcast(hot), "term", "left")  # at most SKETCH_TERMS rows
        .withColumn("_task", F.pmod(F.coalesce(F.col("first") + slice_of_doc, home), F.lit(tasks)))
    )
    dealt = placed.repartitionById(tasks, "_task")
    if merge:
        dealt = dealt.groupBy("_task", "bucket", "term", "doc", "len").agg(F.sum("tf").cast("int").alias("tf"))
    return dealt.select("bucket", "term", "doc", "tf", "len")


def have_own_keys(documents: DataFrame, doc_key: str) -> bool:
    """Whether every document has a key of its own. Moves keys only, summed up before they are shuffled."""
    copies = documents.groupBy(doc_key).agg(F.count(F.lit(1)).alias("n"))
    return copies.where(F.col(doc_key).isNull() | (F.col("n") > 1)).isEmpty()


def document_frequencies(postings: DataFrame, buckets: int) -> DataFrame:
    """bucket, term, df in the layout they are stored in.

    Counted first, next to the postings; only one row per term is then moved to its bucket's files.
    """
    slices = max(1, shuffle_partitions(postings.sparkSession) // buckets)
    counted = postings.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    slice_of_term = F.pmod(F.xxhash64("term", F.lit("slice")), F.lit(slices))
    return counted.repartition(buckets * slices, "bucket", slice_of_term)


@dataclass(frozen=True)
class SearchIndex:
    """An opened version. Its tables do not change, so frames are made once."""

    spark: SparkSession
    path: str
    doc_key: str
    tokenizer: str
    buckets: int
    doc_buckets: int

    @cached_property
    def with_runs(self) -> DataFrame:
        """The documents and ``_runs``, their words (not stemmed) with their counts."""
        return self.spark.read.parquet(f"{self.path}/documents")

    @cached_property
    def documents(self) -> DataFrame:
        return self.with_runs.drop("_runs")

    @cached_property
    def unique_keys(self) -> bool:
        return have_own_keys(self.documents, self.doc_key)

    @cached_property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @cached_property
    def term_stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/term_stats")

    @cached_property
    def corpus(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/corpus")

    @cached_property
    def _corpus_row(self):
        return self.corpus.first()

    @property
    def docs(self) -> int:
        return self._corpus_row["docs"]

    @property
    def avg_len(self) -> float:
        return self._corpus_row["avg_len"] or 0.0

    @property
    def doc_stats(self) -> DataFrame:
        """Token count of every document, those without tokens included."""
        return self.documents.select(F.col(self.doc_key).alias("doc"), F.col("_tokens").alias("len"))


def publish_index(
    rows: DataFrame, root: str, doc_key: str = "review_id", text_column: str = "review", tokenizer: str = "en_stem",
    buckets: int = TERM_BUCKETS, doc_buckets: int | None = None,
) -> SearchIndex:
    """Build an index from ``rows`` and make it the current one under ``root``. Earlier versions stay
    readable until ``versions.drop_old_versions``.

    ``doc_buckets``, by default the number of shuffle partitions, divides the documents so that the
    few rows of a search are fetched from the folders that hold them.
    """
    spark = rows.sparkSession
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"tokenizer {tokenizer} is none of {', '.join(TOKENIZERS)}")
    version = versions.new_version(root)
    path = f"{root}/{version}"
    doc_buckets = doc_buckets or shuffle_partitions(spark)
    bucketed = rows.withColumn("_doc_bucket", term_bucket(F.col(doc_key), doc_buckets))
    # texts are moved once and cut into words once, where they are written; the postings are made from what is stored
    ordered = bucketed.repartition(doc_buckets, "_doc_bucket").sortWithinPartitions("_doc_bucket", doc_key)
    worded = ordered.withColumn("_words", F.coalesce(tokens(F.col(text_column)), F.array().cast("array<string>")))
    counted = with_term_runs(worded, "_words").withColumn("_tokens", F.size("_words")).drop("_words")
    counted.write.partitionBy("_doc_bucket").parquet(f"{path}/documents")

    stored = spark.read.parquet(f"{path}/documents")
    terms = indexed_terms(stored, doc_key)
    hot = hot_terms(terms, shuffle_partitions(spark), tokenizer)
    # plain terms come from each document once: only rows of one key are to be merged
    merge = tokenizer != "plain" or not have_own_keys(stored, doc_key)
    postings = merged_postings(stemmed_if(terms, tokenizer), buckets, hot, merge)
    # sorted by term: a reader skips the row groups of other terms of the bucket
    postings.sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{path}/postings")
    document_frequencies(spark.read.parquet(f"{path}/postings"), buckets).sortWithinPartitions("bucket", "term").write.partitionBy(
        "bucket"
    ).parquet(f"{path}/term_stats")
    corpus_stats(spark.read.parquet(f"{path}/documents").select(F.col("_tokens").alias("len"))).write.parquet(
        f"{path}/corpus"
    )
    settings = json.dumps(
        {"doc_key": doc_key, "tokenizer": tokenizer, "buckets": buckets, "doc_buckets": doc_buckets}
    )
    spark.range(1).select(F.lit(settings).alias("value")).write.text(f"{path}/settings")
    versions.publish(spark, root, version)
    return open_index(spark, root)


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))


def open_index(spark: SparkSession, root: str) -> SearchIndex:
    """The current version, read in place."""
    path = versions.current(spark, root)
    if path is None:
        raise ValueError(f"no index is published under {root}")
    settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
    return SearchIndex(spark, path, **settings)


def scratch_index(rows: DataFrame, **options) -> SearchIndex:
    """An index in the session's shared folder, for one application."""
    return publish_index(rows, fresh_path(rows.sparkSession, "index"), **options)
