"""Topic discovery over the documents (topic = source or language) and the given vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxsift.checks.common import Query, counted_vector, once, sql_counted_vector, sql_tokens, table
from voxsift.plans import topics as tm
from voxsift.plans.model import ModelSettings
from voxsift.staging import stage

MIN_SIMILARITY = 0.2  # the given vectors are only weakly clustered
CLUSTERS = 12
ROUNDS = 5
PROJECTED_WORDS = 1000


def _assigned(spark, sf, topic: str = "source") -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col(topic).alias("topic"), "text")


def _weights(spark, sf, topic: str = "source") -> DataFrame:
    def make() -> DataFrame:
        counts = tm.topic_term_counts(_assigned(spark, sf, topic), "doc_id", "text")
        return stage(tm.class_tfidf(counts), "weights")

    return once(spark, sf, f"weights-{topic}", make)


def _means(spark, sf) -> DataFrame:
    return tm.topic_means(_vectors(spark, sf).withColumnRenamed("label", "topic"), "embedding")


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def a6_topic_sizes(spark, sf) -> DataFrame:
    return tm.topic_sizes(_assigned(spark, sf))


def a7_class_tfidf(spark, sf) -> DataFrame:
    counts = tm.topic_term_counts(_assigned(spark, sf), "doc_id", "text")
    return tm.class_tfidf(counts).select("topic", "term", "tf", F.round("weight", 9).alias("weight"))


def w3_top_words(spark, sf) -> DataFrame:
    words = tm.top_words(_weights(spark, sf))
    return words.select("topic", "term", F.col("rank").cast("long").alias("rank"), F.round("weight", 8).alias("weight"))


def f19_topic_labels(spark, sf) -> DataFrame:
    return tm.topic_labels(tm.top_words(_weights(spark, sf)))


def tm8_topic_info(spark, sf) -> DataFrame:
    info = tm.topic_info(_assigned(spark, sf), tm.top_words(_weights(spark, sf)), "doc_id", "text")
    return info.withColumn("representative_docs", F.array_join(F.col("representative_docs").cast("array<string>"), ","))


def w2_best_label(spark, sf) -> DataFrame:
    near = tm.nearest_topic(_vectors(spark, sf).drop("label"), _means(spark, sf), "embedding")
    return near.select("vec_id", F.col("topic").alias("best"), F.round("similarity", 6).alias("similarity"))


def j6_zero_shot_pairs(spark, sf) -> DataFrame:
    """Documents similar enough to their best label."""
    near = tm.nearest_topic(_vectors(spark, sf).drop("label"), _means(spark, sf), "embedding")
    return near.where(F.col("similarity") >= MIN_SIMILARITY).select("vec_id", F.col("topic").alias("best"))


def tm1_embed_documents(spark, sf) -> DataFrame:
    return _embedded(spark, sf).select("doc_id", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


def tm1_embed_projected(spark, sf) -> DataFrame:
    """A row per number of each document's projected vector."""
    rows = _projected(spark, sf).select("doc_id", F.posexplode_outer("vector").alias("at", "x"))
    # a tiny negative number must not become -0
    return rows.select("doc_id", F.col("at").cast("long").alias("at"), (F.round("x", 6) + 0.0).alias("x"))


def _projected(spark, sf) -> DataFrame:
    def make() -> DataFrame:
        docs = tm.with_tokens(table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic"), "text"), "text")
        return stage(tm.project(docs, tm.fit_projection(docs, size=PROJECTED_WORDS)), "projected")

    return once(spark, sf, "projected", make)


def _embedded(spark, sf) -> DataFrame:
    def make() -> DataFrame:
        docs = tm.with_tokens(table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic"), "text"), "text")
        docs = stage(docs.drop("text"), "tokens")  # cut into words once, for the fit and for the vectors
        return stage(tm.embed(docs, tm.fit_hashed_embedding(docs)), "embedded")

    return once(spark, sf, "embedded", make)


def tm2_zero_shot(spark, sf) -> DataFrame:
    found = tm.zero_shot(_vectors(spark, sf).drop("label"), _means(spark, sf), "embedding", MIN_SIMILARITY)
    return found.select("vec_id", "topic", F.round("similarity", 6).alias("similarity"))


def tm3_cluster_rest(spark, sf) -> DataFrame:
    """Clusters of the vectors that match no label."""
    found = tm.zero_shot(_vectors(spark, sf).drop("label"), _means(spark, sf), "embedding", MIN_SIMILARITY)
    return tm.cluster_rest(found.where("topic IS NULL").drop("topic"), "vec_id", CLUSTERS, "embedding")


def tm3_cluster_rounds(spark, sf) -> DataFrame:
    """Clusters of the same vectors by five rounds from drawn centres."""
    found = tm.zero_shot(_vectors(spark, sf).drop("label"), _means(spark, sf), "embedding", MIN_SIMILARITY)
    rest = stage(found.where("topic IS NULL").select("vec_id", "embedding"), "rest")
    centres = tm.drawn_centres(rest, "vec_id", CLUSTERS, "embedding")
    return tm.cluster_from(rest, "vec_id", centres, ROUNDS, "embedding")


def tm4_topic_words(spark, sf) -> DataFrame:
    return tm.top_words(_weights(spark, sf, "lang")).select("topic", "term", F.col("rank").cast("long").alias("rank"))


def _candidates(spark, sf) -> DataFrame:
    return once(
        spark, sf, "candidates", lambda: stage(tm.top_words(_weights(spark, sf), tm.CANDIDATE_WORDS), "candidates")
    )


def _word_vectors(spark, sf) -> DataFrame:
    return once(
        spark, sf, "word-vectors", lambda: stage(tm.word_vectors(_embedded(spark, sf), _candidates(spark, sf)), "words")
    )


def tm5_diverse_words(spark, sf) -> DataFrame:
    return tm.diverse_words(_candidates(spark, sf), _word_vectors(spark, sf), tm.topic_means(_embedded(spark, sf)))


def tm5_diverse_words_counted(spark, sf) -> DataFrame:
    """With a vector made of each document's own words, so that all documents count."""
    docs = tm.with_tokens(table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic"), "text"), "text")
    known = docs.withColumn("vector", counted_vector(F.col("tokens")))
    candidates = _candidates(spark, sf)
    words = tm.diverse_words(candidates, tm.word_vectors(known, candidates), tm.topic_means(known))
    return words.select("topic", "term", F.col("rank").cast("long").alias("rank"))


def tm6_centroid_words(spark, sf) -> DataFrame:
    return tm.centroid_words(_candidates(spark, sf), _word_vectors(spark, sf), tm.topic_means(_embedded(spark, sf)))


def tm6_centroid_words_given(spark, sf) -> DataFrame:
    """With the given vectors as those of the documents of the same number."""
    docs = tm.with_tokens(table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic"), "text"), "text")
    vectors = _vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    known = docs.join(vectors, "doc_id")
    candidates = _candidates(spark, sf)
    words = tm.centroid_words(candidates, tm.word_vectors(known, candidates), tm.topic_means(known))
    return words.select("topic", "term", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def tm6_centroid_words_counted(spark, sf) -> DataFrame:
    """With a vector made of each document's own words, so that all documents count."""
    docs = tm.with_tokens(table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic"), "text"), "text")
    known = docs.withColumn("vector", counted_vector(F.col("tokens")))
    candidates = _candidates(spark, sf)
    words = tm.centroid_words(candidates, tm.word_vectors(known, candidates), tm.topic_means(known))
    return words.select("topic", "term", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def tm6_centroid_words_projected(spark, sf) -> DataFrame:
    """With the projected vectors of the documents' words."""
    known, candidates = _projected(spark, sf), _candidates(spark, sf)
    usable = known.where("vector IS NOT NULL")
    words = tm.centroid_words(candidates, tm.word_vectors(usable, candidates), tm.topic_means(usable))
    return words.select("topic", "term", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _first_words(settings):
    """Stand-in for a language model: the first three words of the prompt's word list."""
    return lambda prompts: prompts.map(lambda p: " / ".join(p.rsplit("words: ", 1)[1].split(", ")[:3]))


def tm7_model_labels(spark, sf) -> DataFrame:
    info = tm.topic_labels(tm.top_words(_weights(spark, sf))).withColumnRenamed("label", "representation")
    return tm.model_labels(info, _first_words, ModelSettings("first words")).select("topic", "label", "label_error")


def tm9_topic_distribution(spark, sf) -> DataFrame:
    shares = tm.topic_distribution(
        table(spark, sf, "documents").select("doc_id", "text"), _weights(spark, sf, "lang"), "doc_id", "text"
    )
    return shares.select("doc_id", "topic", F.round("share", 6).alias("share"))


def tm10_assign_new(spark, sf) -> DataFrame:
    """Conversation turns as new documents for the topics of the documents."""
    docs = tm.with_tokens(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"), "text"), "text")
    model = tm.fit_hashed_embedding(docs)
    means = tm.topic_means(tm.embed(docs, model))
    turns = tm.embed(tm.with_tokens(table(spark, sf, "conversations"), "text"), model)
    found = tm.assign_new(turns, means, tm.top_words(_weights(spark, sf, "lang")))
    return found.select("conv_id", "turn", "topic", F.round("similarity", 5).alias("similarity"), "topic_words")


def tm10_topic_probabilities(spark, sf) -> DataFrame:
    """The three most probable labels of every vector, by the labels' means."""
    rows = table(spark, sf, "embeddings")
    means = tm.topic_means(rows.select(F.col("label").alias("topic"), F.col("embedding").alias("vector")))
    found = tm.topic_probabilities(rows.select("vec_id", "embedding"), means, "embedding", 3)
    listed = found.select("vec_id", F.posexplode("topics").alias("at", "t"))
    return listed.select(
        "vec_id", (F.col("at") + 1).cast("long").alias("rank"), "t.topic",
        F.round("t.similarity", 6).alias("similarity"), F.round("t.probability", 6).alias("probability"),
    )


QUERIES: dict[str, Query] = {
    "a6_topic_sizes": a6_topic_sizes,
    "a7_class_tfidf": a7_class_tfidf,
    "w2_best_label": w2_best_label,
    "w3_top_words": w3_top_words,
    "f19_topic_labels": f19_topic_labels,
    "j6_zero_shot_pairs": j6_zero_shot_pairs,
    "tm1_embed_documents": tm1_embed_documents,
    "tm1_embed_projected": tm1_embed_projected,
    "tm2_zero_shot": tm2_zero_shot,
    "tm3_cluster_rest": tm3_cluster_rest,
    "tm3_cluster_rounds": tm3_cluster_rounds,
    "tm4_topic_words": tm4_topic_words,
    "tm5_diverse_words": tm5_diverse_words,
    "tm5_diverse_words_counted": tm5_diverse_words_counted,
    "tm6_centroid_words": tm6_centroid_words,
    "tm6_centroid_words_given": tm6_centroid_words_given,
    "tm6_centroid_words_counted": tm6_centroid_words_counted,
    "tm6_centroid_words_projected": tm6_centroid_words_projected,
    "tm7_model_labels": tm7_model_labels,
    "tm8_topic_info": tm8_topic_info,
    "tm9_topic_distribution": tm9_topic_distribution,
    "tm10_assign_new": tm10_assign_new,
    "tm10_topic_probabilities": tm10_topic_probabilities,
}


def _weights_sql(topic: str) -> str:
    """w: topic, term, tf, idf, weight"""
    return f"""tok AS (SELECT doc_id, {topic} AS topic, {sql_tokens('text', 2)} AS toks FROM documents),
  words AS (SELECT doc_id, topic, len(toks) AS len, unnest(toks) AS term FROM tok),
  counts AS (SELECT topic, term, count(*) AS tf FROM words GROUP BY topic, term),
  totals AS (SELECT topic, sum(tf) AS words FROM counts GROUP BY topic),
  freq AS (SELECT term, sum(tf) AS f FROM counts GROUP BY term),
  w AS (SELECT c.topic, c.term, c.tf, ln(1 + a.a / f.f) AS idf, c.tf / t.words * ln(1 + a.a / f.f) AS weight
    FROM counts c JOIN totals t USING (topic) JOIN freq f USING (term), (SELECT floor(avg(words)) AS a FROM totals) a),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM w)"""


_MEANS = """means AS (SELECT label, list(x ORDER BY pos) AS mean FROM (SELECT label, pos, avg(x) AS x FROM
      (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label),
  pairs AS (SELECT vec_id, m.label, round(list_cosine_similarity(embedding::DOUBLE[], mean), 12) AS similarity
    FROM embeddings, means m),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) AS n
    FROM pairs) WHERE n = 1)"""


def _rounds_sql(rounds: int) -> str:
    """a0, c1, a1, ...: vectors with their nearest centre, and the centres they move to."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, v, c FROM (SELECT u.vec_id, u.v, c.c, row_number() OVER (PARTITION BY u.vec_id
    ORDER BY round(list_cosine_similarity(u.v, c.v), 12) DESC, c.c) AS n FROM u, c{r} c) WHERE n = 1)"""
    moved = """c{n} AS MATERIALIZED (SELECT p.c, coalesce(m.v, p.v) AS v FROM c{r} p LEFT JOIN (SELECT c, list(x ORDER BY pos) AS v
    FROM (SELECT c, pos, avg(x) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY c, pos)
    GROUP BY c) m USING (c))"""
    steps = [f"{near},\n  {moved}".format(r=r, n=r + 1) for r in range(rounds)]
    return ",\n  ".join([*steps, near.format(r=rounds)])


def _projected_sql() -> str:
    """proj: doc_id, pos (from 1), x of every document with a vector; needs tok."""
    return f"""df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok) GROUP BY term),
  voc AS (SELECT term, ln(((SELECT count(*) FROM tok) + 1) / (df + 1)) AS idf, sha256('1:0:' || term) AS h
    FROM df ORDER BY df DESC, term LIMIT {PROJECTED_WORDS}),
  tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY doc_id, term),
  raw AS (SELECT doc_id, pos, sum(tf * idf * CASE WHEN substr(h, pos, 1) >= '8' THEN 1 ELSE -1 END) AS x
    FROM tfs JOIN voc USING (term), generate_series(1, 64) g(pos) GROUP BY doc_id, pos),
  proj AS (SELECT doc_id, pos, x / len AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS len FROM raw) WHERE len > 0)"""


ORACLE: dict[str, str] = {
    "a6_topic_sizes": "SELECT source AS topic, count(*) AS count FROM documents GROUP BY source",
    "a7_class_tfidf": f"""WITH {_weights_sql('source')} SELECT topic, term, tf, round(weight, 9) AS weight FROM w""",
    "w2_best_label": f"WITH {_MEANS} SELECT vec_id, label AS best, round(similarity, 6) AS similarity FROM best",
    "w3_top_words": f"""WITH {_weights_sql('source')} SELECT topic, term, rank, round(weight, 8) AS weight
        FROM ranked WHERE rank <= 10""",
    "f19_topic_labels": f"""WITH {_weights_sql('source')} SELECT topic, string_agg(term, ', ' ORDER BY rank) AS label
        FROM ranked WHERE rank <= 10 GROUP BY topic""",
    "j6_zero_shot_pairs": f"WITH {_MEANS} SELECT vec_id, label AS best FROM best WHERE similarity >= {MIN_SIMILARITY}",
    "tm2_zero_shot": f"""WITH {_MEANS} SELECT vec_id, CASE WHEN similarity >= {MIN_SIMILARITY} THEN label END AS topic,
        round(similarity, 6) AS similarity FROM best""",
    "tm1_embed_projected": f"""WITH tok AS (SELECT doc_id, {sql_tokens('text', 2)} AS toks FROM documents), {_projected_sql()}
        SELECT d.doc_id, pos - 1 AS at, round(x, 6) + 0.0::DOUBLE AS x FROM documents d LEFT JOIN proj p ON p.doc_id = d.doc_id""",
    "tm3_cluster_rounds": f"""WITH {_MEANS},
        u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v
          FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings JOIN best USING (vec_id) WHERE similarity < {MIN_SIMILARITY})),
        c0 AS MATERIALIZED (SELECT n - 1 AS c, v FROM (SELECT v, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS n
          FROM u) WHERE n <= {CLUSTERS}),
        {_rounds_sql(ROUNDS)},
        numbered AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS topic FROM a{ROUNDS} GROUP BY c HAVING count(*) >= 15)
        SELECT vec_id, CAST(coalesce(topic, -1) AS INTEGER) AS topic FROM a{ROUNDS} LEFT JOIN numbered USING (c)""",
    "tm4_topic_words": f"WITH {_weights_sql('lang')} SELECT topic, term, rank FROM ranked WHERE rank <= 10",
    "tm6_centroid_words_given": f"""WITH {_weights_sql('source')},
        cand AS (SELECT topic, term FROM ranked WHERE rank <= 30),
        long AS (SELECT vec_id AS doc_id, unnest(embedding)::DOUBLE AS x,
          unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
        used AS (SELECT DISTINCT doc_id, term FROM words WHERE term IN (SELECT term FROM cand)),
        wv AS (SELECT term, list(x ORDER BY pos) AS v FROM (SELECT term, pos, avg(x) AS x FROM used JOIN long USING (doc_id)
          GROUP BY term, pos) GROUP BY term),
        means AS (SELECT topic, list(x ORDER BY pos) AS mean FROM (SELECT topic, pos, avg(x) AS x FROM tok
          JOIN long USING (doc_id) GROUP BY topic, pos) GROUP BY topic),
        sims AS (SELECT topic, term, round(list_cosine_similarity(v, mean), 9) AS similarity
          FROM cand JOIN wv USING (term) JOIN means USING (topic)),
        best AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, term) AS rank FROM sims)
        SELECT topic, term, rank, round(similarity, 6) AS similarity FROM best WHERE rank <= 10""",
    "tm5_diverse_words_counted": f"""WITH RECURSIVE {_weights_sql('source')},
        cand AS (SELECT topic, term, rank FROM ranked WHERE rank <= 30),
        long AS (SELECT doc_id, unnest(v) AS x, unnest(generate_series(1, len(v))) AS pos
          FROM (SELECT doc_id, {sql_counted_vector('toks')} AS v FROM tok)),
        used AS (SELECT DISTINCT doc_id, term FROM words WHERE term IN (SELECT term FROM cand)),
        wv AS (SELECT term, list(x ORDER BY pos) AS v FROM (SELECT term, pos, avg(x) AS x FROM used JOIN long USING (doc_id)
          GROUP BY term, pos) GROUP BY term),
        means AS (SELECT topic, list(x ORDER BY pos) AS mean FROM (SELECT topic, pos, avg(x) AS x FROM tok
          JOIN long USING (doc_id) GROUP BY topic, pos) GROUP BY topic),
        rel AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY rank) AS i, v, list_cosine_similarity(v, mean) AS relevance
          FROM cand JOIN wv USING (term) JOIN means USING (topic)),
        near AS (SELECT a.topic, a.i, any_value(a.term) AS term, any_value(a.relevance) AS relevance,
          list(list_cosine_similarity(a.v, b.v) ORDER BY b.i) AS close FROM rel a JOIN rel b USING (topic) GROUP BY a.topic, a.i),
        pick AS (SELECT topic, [i] AS chosen FROM (SELECT topic, i, row_number() OVER (PARTITION BY topic ORDER BY round(relevance, 9) DESC, i) AS k
            FROM near) WHERE k = 1
          UNION ALL SELECT topic, list_append(chosen, i) FROM (SELECT p.topic, p.chosen, n.i, row_number() OVER (PARTITION BY p.topic
              ORDER BY round(0.6 * n.relevance - 0.4 * list_max(list_transform(p.chosen, lambda j: n.close[j])), 9) DESC, n.i) AS k
            FROM pick p JOIN near n ON n.topic = p.topic AND NOT list_contains(p.chosen, n.i) WHERE len(p.chosen) < 10) WHERE k = 1),
        done AS (SELECT topic, arg_max(chosen, len(chosen)) AS chosen FROM pick GROUP BY topic)
        SELECT d.topic, n.term, CAST(list_position(d.chosen, n.i) AS BIGINT) AS rank FROM done d JOIN near n
          ON n.topic = d.topic AND list_contains(d.chosen, n.i)""",
    "tm6_centroid_words_counted": f"""WITH {_weights_sql('source')},
        cand AS (SELECT topic, term FROM ranked WHERE rank <= 30),
        long AS (SELECT doc_id, unnest(v) AS x, unnest(generate_series(1, len(v))) AS pos
          FROM (SELECT doc_id, {sql_counted_vector('toks')} AS v FROM tok)),
        used AS (SELECT DISTINCT doc_id, term FROM words WHERE term IN (SELECT term FROM cand)),
        wv AS (SELECT term, list(x ORDER BY pos) AS v FROM (SELECT term, pos, avg(x) AS x FROM used JOIN long USING (doc_id)
          GROUP BY term, pos) GROUP BY term),
        means AS (SELECT topic, list(x ORDER BY pos) AS mean FROM (SELECT topic, pos, avg(x) AS x FROM tok
          JOIN long USING (doc_id) GROUP BY topic, pos) GROUP BY topic),
        sims AS (SELECT topic, term, round(list_cosine_similarity(v, mean), 9) AS similarity
          FROM cand JOIN wv USING (term) JOIN means USING (topic)),
        best AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, term) AS rank FROM sims)
        SELECT topic, term, rank, round(similarity, 6) AS similarity FROM best WHERE rank <= 10""",
    "tm6_centroid_words_projected": f"""WITH {_weights_sql('source')},
        cand AS (SELECT topic, term FROM ranked WHERE rank <= 30),
        {_projected_sql()},
        long AS (SELECT doc_id, x, pos FROM proj),
        used AS (SELECT DISTINCT doc_id, term FROM words WHERE term IN (SELECT term FROM cand)),
        wv AS (SELECT term, list(x ORDER BY pos) AS v FROM (SELECT term, pos, avg(x) AS x FROM used JOIN long USING (doc_id)
          GROUP BY term, pos) GROUP BY term),
        means AS (SELECT topic, list(x ORDER BY pos) AS mean FROM (SELECT topic, pos, avg(x) AS x FROM tok
          JOIN long USING (doc_id) GROUP BY topic, pos) GROUP BY topic),
        sims AS (SELECT topic, term, round(list_cosine_similarity(v, mean), 9) AS similarity
          FROM cand JOIN wv USING (term) JOIN means USING (topic)),
        best AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, term) AS rank FROM sims)
        SELECT topic, term, rank, round(similarity, 6) AS similarity FROM best WHERE rank <= 10""",
    "tm7_model_labels": f"""WITH {_weights_sql('source')} SELECT topic, string_agg(term, ' / ' ORDER BY rank) AS label,
        CAST(NULL AS VARCHAR) AS label_error FROM ranked WHERE rank <= 3 GROUP BY topic""",
    "tm8_topic_info": f"""WITH {_weights_sql('source')},
        top AS (SELECT topic, term, round(weight, 9) AS weight, rank FROM ranked WHERE rank <= 10),
        used AS (SELECT doc_id, topic, term, len, count(*) AS tf FROM words GROUP BY doc_id, topic, term, len),
        scored AS (SELECT u.topic, u.doc_id, round(sum(u.tf * t.weight / u.len), 9) AS score
          FROM used u JOIN top t ON u.topic = t.topic AND u.term = t.term GROUP BY u.topic, u.doc_id),
        reps AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS n FROM scored)
        SELECT s.topic, s.count, s.topic || '_' || n.name AS name, r.representation, d.representative_docs
        FROM (SELECT source AS topic, count(*) AS count FROM documents GROUP BY source) s
        LEFT JOIN (SELECT topic, string_agg(term, '_' ORDER BY rank) AS name FROM top WHERE rank <= 4 GROUP BY topic) n
          ON n.topic = s.topic
        LEFT JOIN (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS representation FROM top GROUP BY topic) r
          ON r.topic = s.topic
        LEFT JOIN (SELECT topic, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n) AS representative_docs
          FROM reps WHERE n <= 3 GROUP BY topic) d ON d.topic = s.topic""",
    "tm10_topic_probabilities": """WITH means AS (SELECT label, list(x ORDER BY pos) AS mean FROM (SELECT label, pos, avg(x) AS x FROM
          (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label),
        s AS (SELECT vec_id, m.label AS topic, round(list_cosine_similarity(embedding::DOUBLE[], mean), 12) AS similarity FROM embeddings, means m),
        p AS (SELECT *, exp(similarity / 0.1) / sum(exp(similarity / 0.1)) OVER (PARTITION BY vec_id) AS probability,
          row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, topic) AS rank FROM s)
        SELECT vec_id, rank, topic, round(similarity, 6) AS similarity, round(probability, 6) AS probability FROM p WHERE rank <= 3""",
    "tm9_topic_distribution": f"""WITH {_weights_sql('lang')},
        norms AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY topic),
        wins AS (SELECT doc_id, s, toks[s : s + least(4, len(toks)) - 1] AS win FROM
          (SELECT doc_id, toks, unnest(generate_series(1, greatest(len(toks) - 3, 1))) AS s FROM tok WHERE len(toks) > 0)),
        cnt AS (SELECT doc_id, s, term, count(*) AS n FROM
          (SELECT doc_id, s, unnest(win) AS term FROM wins) GROUP BY doc_id, s, term),
        idfs AS (SELECT DISTINCT term, idf FROM w),
        lens AS (SELECT doc_id, s, sqrt(sum(n * n * idf * idf)) AS len FROM cnt JOIN idfs USING (term) GROUP BY doc_id, s),
        sims AS (SELECT c.doc_id, c.s, w.topic, sum(c.n * w.idf * w.weight) AS dot
          FROM cnt c JOIN w ON w.term = c.term GROUP BY c.doc_id, c.s, w.topic),
        kept AS (SELECT s.doc_id, s.topic, s.dot / l.len / n.norm AS sim FROM sims s JOIN norms n ON n.topic = s.topic
          JOIN lens l ON l.doc_id = s.doc_id AND l.s = s.s WHERE round(s.dot / l.len / n.norm, 9) >= 0.1),
        sums AS (SELECT doc_id, topic, sum(sim) AS sim FROM kept GROUP BY doc_id, topic)
        SELECT doc_id, topic, round(sim / sum(sim) OVER (PARTITION BY doc_id), 6) AS share FROM sums""",
}
