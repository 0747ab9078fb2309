"""Search index, text search, vector search, query cleaning and highlighting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxsift.checks.common import Query, counted_embedding, counted_vector, once, reviews, search_index, sql_counted_vector, sql_tokens, table
from voxsift.functions.text import clean_query, highlight, sentences, tokens
from voxsift.functions.vectors import cosine_distance
from voxsift.operators.joins import join_small
from voxsift.operators.search import query_terms, text_search, text_search_many
from voxsift.operators.vector_search import approximate_nearest, nearest_many, vector_search
from voxsift.plans.review_search import search_reviews
from voxsift.plans.topics import topic_means
from voxsift.sources.search_index import document_terms, open_index, publish_index, scratch_index
from voxsift.sources.vector_index import publish_vector_index
from voxsift.staging import fresh_path

TOP = 10
QUERY_TEXT = "the, that? (reason) of"
HIGHLIGHT_QUERY = "the of That"


def f15_clean_query(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", clean_query(F.col("text")).alias("query"))


def f16_highlight(spark, sf) -> DataFrame:
    marked = highlight(F.col("text"), HIGHLIGHT_QUERY)
    return table(spark, sf, "documents").select(
        "doc_id", F.length(marked).cast("long").alias("chars"), F.md5(marked).alias("marked_md5")
    )


def f17_tokens(spark, sf) -> DataFrame:
    words = tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(words).cast("long").alias("tokens"), F.md5(F.array_join(words, " ")).alias("tokens_md5")
    )


def f17_stemmed_terms(spark, sf) -> DataFrame:
    """Stems of the whole collection with their counts."""
    terms = document_terms(reviews(spark, sf), "review_id", "review")
    return terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.countDistinct("doc").alias("df"))


def f18_sentences(spark, sf) -> DataFrame:
    split = sentences(table(spark, sf, "documents"), "text", ["doc_id"])
    return split.select("doc_id", F.col("position").cast("long").alias("position"), F.md5("sentence").alias("sentence_md5"))


def s13_publish_index(spark, sf) -> DataFrame:
    """The postings of a newly published index."""
    index = publish_index(reviews(spark, sf), fresh_path(spark, "index"), tokenizer="plain")
    return index.postings.select("term", "doc", F.col("tf").cast("long").alias("tf"), F.col("len").cast("long").alias("len"))


def s14_open_index(spark, sf) -> DataFrame:
    """What the current version says after an index was published twice."""
    root = fresh_path(spark, "index")
    rows = reviews(spark, sf)
    publish_index(rows.where("lang = 'de'"), root, tokenizer="plain")
    publish_index(rows, root, tokenizer="plain")
    index = open_index(spark, root)
    return index.doc_stats.agg(
        F.count(F.lit(1)).alias("docs"), F.sum("len").alias("words"), F.round(F.avg("len"), 6).alias("avg_len")
    )


def a5_corpus_statistics(spark, sf) -> DataFrame:
    return search_index(spark, sf).term_stats.select("term", "df")


def j4_text_match(spark, sf) -> DataFrame:
    index = search_index(spark, sf)
    terms = query_terms(table(spark, sf, "benchmark"), index, "item_id")
    matched = join_small(index.postings, terms, ["bucket", "term"], F.col("doc"))
    return matched.groupBy("query", "term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("uses"))


def _benchmark_hits(spark, sf, tokenizer: str) -> DataFrame:
    index = search_index(spark, sf, tokenizer)
    return text_search_many(table(spark, sf, "benchmark"), index, limit=TOP, select=["review_id"], query_key="item_id")


def t2_text_search(spark, sf) -> DataFrame:
    """The ten best documents for every passage of the benchmark table, in one job."""
    hits = _benchmark_hits(spark, sf, "plain")
    return hits.select("query", F.col("rank").cast("long").alias("rank"), "review_id", F.round("score", 6).alias("score"))


def t2_text_search_stemmed(spark, sf) -> DataFrame:
    return _benchmark_hits(spark, sf, "en_stem")


def t2_text_search_one(spark, sf) -> DataFrame:
    """One cleaned query with a condition and a select list, default limit."""
    query = spark.range(1).select(clean_query(F.lit(QUERY_TEXT)).alias("q")).first()["q"]
    hits = text_search(query, search_index(spark, sf), conditions={"lang": "en"}, select=["review_id", "brand"])
    return hits.select("review_id", "brand", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def t4_display_cap(spark, sf) -> DataFrame:
    hits = text_search("the of", search_index(spark, sf), select=["review_id", "brand"])
    return hits.orderBy("rank").limit(TOP).select("review_id", "brand")


def t4_search_page(spark, sf) -> DataFrame:
    """The shown hits of a typed sentence, highlighted, for one brand."""
    page = search_reviews(search_index(spark, sf), QUERY_TEXT, brand="src3", shown=20)
    return page.text.select("review_id", F.md5("marked").alias("marked_md5"))


def a4_page_counts(spark, sf) -> DataFrame:
    return search_reviews(search_index(spark, sf), QUERY_TEXT, brand="src3").counts


def _whole_page(spark, sf):
    """The page with its semantic half, over documents that all have a vector."""
    def make():
        rows = reviews(spark, sf).withColumn("vector", counted_vector(tokens(F.col("review"))))
        return search_reviews(scratch_index(rows), QUERY_TEXT, embed=counted_embedding, brand="src3", shown=20)

    return once(spark, sf, "whole-page", make)


def t4_search_page_near(spark, sf) -> DataFrame:
    """The nearest reviews of the page, highlighted."""
    return _whole_page(spark, sf).near.select("review_id", F.md5("marked").alias("marked_md5"))


def a4_page_counts_whole(spark, sf) -> DataFrame:
    return _whole_page(spark, sf).counts


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def _first_vector(spark, sf) -> list[float]:
    return _vectors(spark, sf).where("vec_id = 0").first()["embedding"]


_VECTOR = {"key": "vec_id", "vector": "embedding"}


def t3_vector_search(spark, sf) -> DataFrame:
    hits = vector_search(_vectors(spark, sf), _first_vector(spark, sf), limit=TOP, select=["vec_id", "label"], threshold=None, **_VECTOR)
    return hits.withColumn("distance", F.round("distance", 6))


def t3_vector_search_filtered(spark, sf) -> DataFrame:
    """With a condition; the column of the condition joins the select list."""
    hits = vector_search(
        _vectors(spark, sf), _first_vector(spark, sf), conditions={"label": "3"}, select=["vec_id"], threshold=None, **_VECTOR
    )
    return hits.withColumn("distance", F.round("distance", 6))


def p8_distance_threshold(spark, sf) -> DataFrame:
    hits = vector_search(_vectors(spark, sf), _first_vector(spark, sf), threshold=0.95, **_VECTOR)
    return hits.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def _label_queries(spark, sf) -> DataFrame:
    means = topic_means(_vectors(spark, sf).withColumnRenamed("label", "topic"), "embedding")
    return means.select(F.col("topic").cast("bigint").alias("query"), F.col("mean").alias("vector"))


def j5_vector_match(spark, sf) -> DataFrame:
    """The ten vectors nearest to the mean of each label."""
    near = nearest_many(_vectors(spark, sf), _label_queries(spark, sf), TOP, **_VECTOR)
    return near.select("query", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def j5_approximate(spark, sf) -> DataFrame:
    return approximate_nearest(_vectors(spark, sf), _first_vector(spark, sf), TOP, **_VECTOR)


def j5_inverted_file(spark, sf) -> DataFrame:
    """The ten nearest among the rows of the three nearest centres, for every 50th vector; centres are the means of the
    labels."""
    rows = _vectors(spark, sf)
    centres = _label_queries(spark, sf).select(F.col("query").cast("int").alias("centre"), "vector")
    index = publish_vector_index(rows, centres, fresh_path(spark, "vectors"), **_VECTOR)
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    near = index.search(queries, TOP, 3)
    return near.select("query", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def a4_result_counts(spark, sf) -> DataFrame:
    """Number of text hits and of near vectors for one search."""
    text = text_search("that with", search_index(spark, sf), select=["review_id"]).agg(F.count(F.lit(1)).alias("rows"))
    near = _vectors(spark, sf).where(cosine_distance(F.col("embedding"), _first_vector(spark, sf)) < 0.9)
    return text.select(F.lit("text").alias("search"), "rows").unionByName(
        near.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("semantic").alias("search"), "rows")
    )


QUERIES: dict[str, Query] = {
    "f15_clean_query": f15_clean_query,
    "f16_highlight": f16_highlight,
    "f17_tokens": f17_tokens,
    "f17_stemmed_terms": f17_stemmed_terms,
    "f18_sentences": f18_sentences,
    "s13_publish_index": s13_publish_index,
    "s14_open_index": s14_open_index,
    "a5_corpus_statistics": a5_corpus_statistics,
    "j4_text_match": j4_text_match,
    "t2_text_search": t2_text_search,
    "t2_text_search_stemmed": t2_text_search_stemmed,
    "t2_text_search_one": t2_text_search_one,
    "t4_display_cap": t4_display_cap,
    "t4_search_page": t4_search_page,
    "a4_page_counts": a4_page_counts,
    "t4_search_page_near": t4_search_page_near,
    "a4_page_counts_whole": a4_page_counts_whole,
    "t3_vector_search": t3_vector_search,
    "t3_vector_search_filtered": t3_vector_search_filtered,
    "p8_distance_threshold": p8_distance_threshold,
    "j5_vector_match": j5_vector_match,
    "j5_approximate": j5_approximate,
    "j5_inverted_file": j5_inverted_file,
    "a4_result_counts": a4_result_counts,
}

_TOKENS = f"tok AS (SELECT doc_id, lang, source, {sql_tokens('text')} AS toks FROM documents)"
_POSTINGS = f"""{_TOKENS},
  words AS (SELECT doc_id AS doc, len(toks) AS len, unnest(toks) AS term FROM tok),
  post AS (SELECT term, doc, len, count(*) AS tf FROM words GROUP BY term, doc, len)"""


def _bm25(queries: str, allowed: str = "true") -> str:
    """query, doc, score, rank; ``queries`` selects (query, text)."""
    return f"""{_POSTINGS},
  stats AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  corpus AS (SELECT count(*) AS docs, avg(len(toks)) AS avg_len FROM tok),
  q AS (SELECT query, term, count(*) AS times FROM
      (SELECT query, unnest({sql_tokens('text')}) AS term FROM ({queries})) GROUP BY query, term),
  scored AS (SELECT q.query, p.doc, round(sum(q.times * ln(1 + (c.docs - s.df + 0.5) / (s.df + 0.5)) * p.tf * 2.2
        / (p.tf + 1.2 * (0.25 + 0.75 * p.len / c.avg_len))), 9) AS score
      FROM q JOIN post p ON q.term = p.term JOIN stats s ON s.term = q.term, corpus c
      WHERE p.doc IN (SELECT doc_id FROM documents WHERE {allowed}) GROUP BY q.query, p.doc),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored)"""


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_DISTANCE = f"1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})"
_NEAR = f"""near AS (SELECT doc_id AS doc, 1 - list_cosine_similarity({sql_counted_vector('toks')},
    {counted_embedding('the that reason of')}::DOUBLE[]) AS distance FROM tok WHERE source = 'src3')"""
_MEANS = """means AS (SELECT label, list(x ORDER BY pos) AS mean FROM (SELECT label, pos, avg(x) AS x FROM
      (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label)"""

ORACLE: dict[str, str] = {
    "f15_clean_query": """SELECT conv_id, turn, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g') AS query
        FROM conversations""",
    "f16_highlight": r"""WITH h AS (SELECT doc_id, regexp_replace(text, '(?i)(that|the|of)',
          '<div style="background-color: yellow; display: inline;">\1</div>', 'g') AS marked FROM documents)
        SELECT doc_id, length(marked) AS chars, md5(marked) AS marked_md5 FROM h""",
    "f17_tokens": f"""SELECT doc_id, len(toks) AS tokens, md5(array_to_string(toks, ' ')) AS tokens_md5
        FROM (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents)""",
    "f18_sentences": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '([^.!?]+[.!?]*)'),
          lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents)
        SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS position, md5(unnest(parts)) AS sentence_md5
        FROM s WHERE len(parts) > 0""",
    "s13_publish_index": f"WITH {_POSTINGS} SELECT term, doc, tf, len FROM post",
    "s14_open_index": f"""WITH {_TOKENS} SELECT count(*) AS docs, CAST(sum(len(toks)) AS BIGINT) AS words,
        round(avg(len(toks)), 6) AS avg_len FROM tok""",
    "a5_corpus_statistics": f"WITH {_POSTINGS} SELECT term, count(*) AS df FROM post GROUP BY term",
    "j4_text_match": f"""WITH {_POSTINGS}, q AS (SELECT DISTINCT query, term FROM
          (SELECT item_id AS query, unnest({sql_tokens('text')}) AS term FROM benchmark))
        SELECT q.query, q.term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses
        FROM q JOIN post p ON p.term = q.term GROUP BY q.query, q.term""",
    "t2_text_search": f"""WITH {_bm25('SELECT item_id AS query, text FROM benchmark')}
        SELECT query, rank, doc AS review_id, round(score, 6) AS score FROM ranked WHERE rank <= {TOP}""",
    "t2_text_search_one": f"""WITH {_bm25("SELECT 0 AS query, 'the that reason of' AS text", "lang = 'en'")}
        SELECT doc AS review_id, source AS brand, rank, round(score, 6) AS score
        FROM ranked JOIN documents ON doc = doc_id""",
    "t4_display_cap": f"""WITH {_bm25("SELECT 0 AS query, 'the of' AS text")}
        SELECT doc AS review_id, source AS brand FROM ranked JOIN documents ON doc = doc_id WHERE rank <= {TOP}""",
    "t4_search_page": rf"""WITH {_bm25("SELECT 0 AS query, 'the that reason of' AS text", "source = 'src3'")},
        hits AS (SELECT doc, text FROM ranked JOIN documents ON doc = doc_id WHERE rank <= 20),
        escaped AS (SELECT doc, replace(replace(replace(replace(regexp_replace(text, '(?i)(reason|that|the|of)',
            chr(57344) || '\1' || chr(57345), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM hits)
        SELECT doc AS review_id, md5(replace(replace(t, chr(57344),
            '<div style="background-color: yellow; display: inline;">'), chr(57345), '</div>')) AS marked_md5
        FROM escaped""",
    "a4_page_counts": f"""WITH {_TOKENS} SELECT 'total' AS measure, count(*) AS rows FROM tok WHERE source = 'src3'
        UNION ALL SELECT 'text', count(*) FROM tok WHERE source = 'src3' AND len(list_intersect(toks, ['reason', 'that', 'the', 'of'])) > 0""",
    "t4_search_page_near": rf"""WITH {_TOKENS}, {_NEAR},
        hits AS (SELECT doc, text FROM near JOIN documents ON doc = doc_id WHERE distance < 0.7
          ORDER BY round(distance, 12), doc LIMIT 20),
        escaped AS (SELECT doc, replace(replace(replace(replace(regexp_replace(text, '(?i)(reason|that|the|of)',
            chr(57344) || '\1' || chr(57345), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM hits)
        SELECT doc AS review_id, md5(replace(replace(t, chr(57344),
            '<div style="background-color: yellow; display: inline;">'), chr(57345), '</div>')) AS marked_md5
        FROM escaped""",
    "a4_page_counts_whole": f"""WITH {_TOKENS}, {_NEAR} SELECT 'total' AS measure, count(*) AS rows FROM tok WHERE source = 'src3'
        UNION ALL SELECT 'text', count(*) FROM tok WHERE source = 'src3' AND len(list_intersect(toks, ['reason', 'that', 'the', 'of'])) > 0
        UNION ALL SELECT 'semantic', count(*) FROM near WHERE distance < 0.7""",
    "t3_vector_search": f"""SELECT vec_id, label, round({_DISTANCE}, 6) AS distance FROM embeddings
        ORDER BY round({_DISTANCE}, 12), vec_id LIMIT {TOP}""",
    "t3_vector_search_filtered": f"""SELECT vec_id, label, round({_DISTANCE}, 6) AS distance FROM embeddings
        WHERE label = 3""",
    "p8_distance_threshold": f"""SELECT vec_id, label, round({_DISTANCE}, 6) AS distance FROM embeddings
        WHERE {_DISTANCE} < 0.95""",
    "j5_vector_match": f"""WITH {_MEANS}, d AS (SELECT m.label AS query, vec_id,
          round(1 - list_cosine_similarity(embedding::DOUBLE[], mean), 12) AS distance FROM embeddings, means m),
        k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM d)
        SELECT CAST(query AS BIGINT) AS query, vec_id, rank, round(distance, 6) AS distance FROM k WHERE rank <= {TOP}""",
    "j5_inverted_file": f"""WITH {_MEANS}, c AS (SELECT vec_id, embedding, m.label AS centre, row_number() OVER (PARTITION BY vec_id
          ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], mean), 12), m.label) AS place FROM embeddings, means m),
        d AS (SELECT q.vec_id AS query, r.vec_id, round(1 - list_cosine_similarity(r.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS distance
          FROM c q JOIN c r ON q.centre = r.centre AND q.place <= 3 AND r.place = 1 WHERE q.vec_id % 50 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM d)
        SELECT query, vec_id, rank, round(distance, 6) AS distance FROM k WHERE rank <= {TOP}""",
    "a4_result_counts": f"""WITH {_TOKENS} SELECT 'text' AS search, count(*) AS rows FROM tok
          WHERE list_contains(toks, 'that') OR list_contains(toks, 'with')
        UNION ALL SELECT 'semantic', count(*) FROM embeddings WHERE {_DISTANCE} < 0.9""",
}
