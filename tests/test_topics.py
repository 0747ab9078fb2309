import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxsift.functions.text import tokens
from voxsift.plans import topics as tm
from voxsift.plans.model import ModelSettings, embedding_call

DOCS = [
    (0, "film", "great film great actors"), (1, "film", "the film was long"), (2, "film", "actors of the film"),
    (3, "game", "the game was fun"), (4, "game", "game game controls"), (5, "game", ""),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, topic string, text string")


@pytest.fixture
def weights(docs):
    return tm.class_tfidf(tm.topic_term_counts(docs, "doc_id", "text"))


def test_class_weights(weights):
    got = {(r.topic, r.term): r.weight for r in weights.collect()}
    mean = (12 + 7) // 2  # words per topic, cut to a whole number
    assert got[("film", "film")] == pytest.approx(3 / 12 * math.log(1 + mean / 3))
    assert got[("game", "the")] == pytest.approx(1 / 7 * math.log(1 + mean / 3))
    assert ("game", "film") not in got


def test_words_and_labels(weights):
    words = tm.top_words(weights, 2)
    ranked = {(r.topic, r["rank"]): r.term for r in words.collect()}
    assert ranked[("game", 1)] == "game" and ranked[("film", 1)] == "film"
    assert {r.topic: r.label for r in tm.topic_labels(words).collect()}["game"].startswith("game, ")


def test_topic_info(docs, weights):
    info = {r.topic: r for r in tm.topic_info(docs, tm.top_words(weights), "doc_id", "text").collect()}
    assert info["game"]["count"] == 3 and info["game"].name.startswith("game_game_")
    assert info["game"].representative_docs[0] == 4 and 5 not in info["game"].representative_docs


def distribution(texts, weights_rows, window=4):
    """Windows, cosine and sums written out word by word."""
    weight = {(r.topic, r.term): r.weight for r in weights_rows}
    idf = {r.term: r.idf for r in weights_rows}
    topics = sorted({r.topic for r in weights_rows})
    norm = {t: math.sqrt(sum(w * w for (a, _), w in weight.items() if a == t)) for t in topics}
    out = {}
    for key, text in texts:
        words = [w for w in text.lower().split() if len(w) > 1]
        if not words:
            continue
        total = dict.fromkeys(topics, 0.0)
        for start in range(max(1, len(words) - window + 1)):
            piece = words[start : start + window]
            vector = {w: piece.count(w) * idf[w] for w in piece if w in idf}
            length = math.sqrt(sum(v * v for v in vector.values()))
            for t in topics:
                dot = sum(v * weight.get((t, w), 0.0) for w, v in vector.items())
                similar = dot / length / norm[t] if length else 0.0
                total[t] += similar if similar >= 0.1 else 0.0
        if sum(total.values()):
            out.update({(key, t): round(v / sum(total.values()), 6) for t, v in total.items() if v})
    return out


def test_distribution_of_new_texts(spark, weights):
    texts = [(1, "great game"), (2, "unknown unheard unseen words"), (3, ""), (4, "the film was great but the game was fun and"),
             (5, "film film film film film zz yy xx ww vv"), (6, "fun")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.topic): round(r.share, 6) for r in tm.topic_distribution(frame, weights, "doc_id", "text").collect()}
    assert got == distribution(texts, weights.collect())
    assert not {2, 3} & {key for key, _ in got}


def blobs(spark, sizes=(60, 40, 4)):
    random = np.random.default_rng(5)
    centers = np.eye(8)
    data, key = [], 0
    for at, size in enumerate(sizes):
        for _ in range(size):
            data.append((key, (centers[at] * 5 + random.normal(scale=0.2, size=8)).tolist(), at))
            key += 1
    data.append((key, [0.0] * 8, None))
    return spark.createDataFrame(data, "doc_id long, vector array<double>, topic int")


def test_small_clusters_are_outliers(spark):
    rows = blobs(spark)
    got = rows.join(tm.cluster_rest(rows.drop("topic"), "doc_id", 3).withColumnRenamed("topic", "found"), "doc_id")
    by_blob = {r.topic: (r.found, r.n) for r in got.groupBy("topic", "found").agg(F.count("*").alias("n")).collect()}
    assert by_blob == {0: (0, 60), 1: (1, 40), 2: (-1, 4), None: (-1, 1)}


def lloyd(points, centres, rounds):
    """Rounds written out point by point: the nearest centre by cosine, the lower number on a tie."""
    points, centres = [p / np.linalg.norm(p) for p in points], [np.array(c, float) for c in centres]

    def nearest():
        return [int(np.argmax([round(p @ c / np.linalg.norm(c), 12) for c in centres])) for p in points]

    for _ in range(rounds):
        near = nearest()
        centres = [np.mean([p for p, c in zip(points, near) if c == k], axis=0) if k in near else old for k, old in enumerate(centres)]
    return nearest()


def test_clusters_from_given_centres(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(90, 5))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    odd = [(90, None), (91, [0.0] * 5), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [1.0, 2.0])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, vector array<double>")
    # the third centre equals the second, so no vector is nearest to it
    begin = [vectors[0], vectors[1], vectors[1], vectors[2]]
    centres = spark.createDataFrame([(k, [float(x) for x in v], 0) for k, v in enumerate(begin)], "topic int, mean array<double>, rows long")
    for rounds in (0, 1, 6):
        want = lloyd(vectors, begin, rounds)
        sizes = sorted(((-want.count(c), c) for c in set(want) if want.count(c) >= 15))
        number = {c: n for n, (_, c) in enumerate(sizes)}
        got = {r.doc_id: r.topic for r in tm.cluster_from(docs, "doc_id", centres, rounds).collect()}
        assert got == {k: number.get(c, -1) for k, c in enumerate(want)} | {k: -1 for k, _ in odd}


def test_rounds_move_no_points(spark):
    """A round shuffles sums of the centres, not vectors."""
    rows = blobs(spark).drop("topic")
    centres = tm.drawn_centres(rows, "doc_id", 3)
    assert centres.count() == 3 and {r.topic for r in centres.collect()} == {0, 1, 2}
    near = tm.nearest_topic(rows, centres)
    plan = tm.topic_means(near)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_" in plan
    assert tm.cluster_from(rows.limit(0), "doc_id", centres).count() == 0


def test_projection_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(tm, "BLOCK_NUMBERS", 70 * 8)  # a few words at a time
    draw = np.random.default_rng(4)
    texts = [[f"w{int(x)}" for x in draw.zipf(1.5, size=int(n)) if x < 60] for n in draw.integers(0, 200, 40)] + [None, [], [None, "w1"], ["unseen"]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, tokens array<string>")
    model = tm.fit_projection(docs.where("doc_id < 41"), size=7, dim=70, seed=5)
    assert len(model.terms) == 7 and len(model.signs("w1")) == 70 and model.signs("w1") != model.signs("w2")
    got = {r.doc_id: r.vector for r in tm.project(docs, model).collect()}
    for k, words in enumerate(texts):
        total = np.zeros(70)
        for w in words or []:
            if w in model.terms:
                total += np.array(model.signs(w)) * model.idf[model.terms.index(w)]
        if not total.any():
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(list(total / np.linalg.norm(total)))
    assert sum(v is not None for v in got.values()) > 30
    with pytest.raises(ValueError, match="numbers in a projection"):
        tm.fit_projection(docs, size=100, dim=64)


def test_projection_keeps_cosines(spark):
    same = ["alpha beta gamma delta", "alpha beta gamma epsilon", "one two three four"]
    docs = spark.createDataFrame([(k, t.split()) for k, t in enumerate(same)], "doc_id long, tokens array<string>")
    vectors = {r.doc_id: np.array(r.vector) for r in tm.project(docs, tm.fit_projection(docs, dim=1000, size=50)).collect()}
    often, rare = math.log(4 / 3) ** 2, math.log(4 / 2) ** 2  # squared weights of words of two documents and of one
    assert vectors[0] @ vectors[1] == pytest.approx(3 * often / (3 * often + rare), abs=0.1)
    assert vectors[0] @ vectors[2] == pytest.approx(0, abs=0.1)


def test_zero_shot_and_new_documents(spark):
    rows = blobs(spark)
    means = tm.topic_means(rows.where("topic IS NOT NULL"))
    assert {r.topic: r.rows for r in means.collect()} == {0: 60, 1: 40, 2: 4}
    found = tm.zero_shot(rows.withColumnRenamed("topic", "truth"), means)
    assert found.where("truth IS NOT NULL AND NOT truth <=> topic").count() == 0
    assert found.where("truth IS NULL AND topic IS NOT NULL").count() == 0
    assert tm.zero_shot(rows.drop("topic"), means, min_similarity=1.01).where("topic IS NOT NULL").count() == 0
    words = spark.createDataFrame([(0, "b", 0.5, 2), (0, "a", 0.9, 1)], "topic int, term string, weight double, rank int")
    new = tm.assign_new(rows.drop("topic").where("doc_id < 2"), means, words)
    assert {r.topic_words for r in new.collect()} == {"a, b"}


def test_diverse_and_central_words(spark):
    candidates = spark.createDataFrame([(0, w, i + 1) for i, w in enumerate("abc")], "topic int, term string, rank int")
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.1, 0.0]), ("b", [1.0, 0.12, 0.0]), ("c", [0.6, -0.8, 0.0])], "term string, vector array<double>"
    )
    means = spark.createDataFrame([(0, [1.0, 0.0, 0.0], 3)], "topic int, mean array<double>, rows int")
    close = tm.diverse_words(candidates, vectors, means, 2, diversity=0.0).orderBy("rank").collect()
    spread = tm.diverse_words(candidates, vectors, means, 2, diversity=0.7).orderBy("rank").collect()
    assert [r.term for r in close] == ["a", "b"] and [r.term for r in spread] == ["a", "c"]
    central = tm.centroid_words(candidates, vectors, means, 2).orderBy("rank").collect()
    assert [r.term for r in central] == ["a", "b"]


@pytest.mark.parametrize("listed", [2000, 0])
def test_word_vectors_are_means_of_their_documents(spark, monkeypatch, listed):
    monkeypatch.setattr(tm, "LISTED_WORDS", listed)
    docs = spark.createDataFrame(
        [(["a", "a", "b"], [1.0, 0.0]), (["a"], [0.0, 1.0]), (["c"], [9.0, 9.0])], "tokens array<string>, vector array<float>"
    )
    words = spark.createDataFrame([("a",), ("b",)], "term string")
    assert {r.term: r.vector for r in tm.word_vectors(docs, words).collect()} == {"a": [0.5, 0.5], "b": [1.0, 0.0]}


def test_no_vector_is_repeated_for_each_word(spark, monkeypatch):
    """Few words: sums per task and word, some documents at a time; words are not exploded with their document's vector."""
    monkeypatch.setattr(tm, "BLOCK_NUMBERS", 6)
    rows = [([f"w{i % 3}", "all", "other"], [float(i), 1.0]) for i in range(50)] + [([], [7.0, 7.0]), (["other"], None)]
    docs = spark.createDataFrame(rows, "tokens array<string>, vector array<float>").repartition(3)
    words = spark.createDataFrame([("w0",), ("w1",), ("all",), ("none",), ("all",)], "term string")
    found = tm.word_vectors(docs, words)
    assert {r.term: r.vector for r in found.collect()} == {"w0": pytest.approx([24.0, 1.0]), "w1": pytest.approx([25.0, 1.0]), "all": pytest.approx([24.5, 1.0])}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_of_topics_are_summed_before_they_move(docs):
    """In the task, over its documents: no row per document and word is made in Python."""
    plan = tm.topic_term_counts(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.index("HashAggregate") < plan.index("Generate")


def test_only_ranked_words_are_counted_in_documents(spark, docs, weights, monkeypatch):
    """The words of a text that no topic has among its ranked ones are dropped before the text is counted."""
    counted = []
    count = tm.term_counts
    monkeypatch.setattr(tm, "term_counts", lambda df, column, keep: counted.append(df) or count(df, column, keep))
    words = tm.top_words(weights, 2)
    found = tm.representative_documents(docs, words, "doc_id", "text")
    ranked = {r.term for r in words.collect()}
    held = counted[0].collect()
    assert {t for r in held for t in r._t} == ranked and {r.doc_id: r._len for r in held}[0] == 4
    monkeypatch.setattr(tm, "LISTED_WORDS", 0)
    assert sorted(found.collect()) == sorted(tm.representative_documents(docs, words, "doc_id", "text").collect())


def test_hashed_embedding_separates_topics(spark, docs):
    ready = tm.with_tokens(docs, "text")
    embedded = tm.embed(ready, tm.fit_hashed_embedding(ready))
    assert embedded.where("doc_id = 5").first().vector == [0.0] * 256
    means = tm.topic_means(embedded.where(F.size("tokens") > 0))
    found = tm.nearest_topic(embedded.withColumnRenamed("topic", "truth"), means)
    assert found.where("doc_id < 5 AND truth <> topic").count() == 0
    assert found.where("doc_id = 5").first().topic is None


def test_labels_by_a_model(spark):
    info = spark.createDataFrame([(0, "a, b"), (1, "c, d")], "topic int, representation string")

    def make(settings):
        def complete(prompts):
            if prompts.str.contains("c, d").any():
                raise ValueError("busy")
            return prompts.str.upper()

        return complete

    got = {r.topic: (r.label, r.label_error) for r in tm.model_labels(info, make).collect()}
    assert got[0][0].endswith("A, B") and got[1] == (None, "busy")


def test_embeddings_are_requested_in_chunks(spark, tmp_path):
    log = tmp_path / "sizes"

    def make(settings):
        def embed(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return [[float(len(t))] for t in texts]

        return embed

    frame = spark.range(250).coalesce(1).select(F.lit("abc").alias("t"))
    assert frame.select(embedding_call(F.col("t"), make, ModelSettings()).alias("v")).where("v[0] = 3").count() == 250
    assert sorted(map(int, log.read_text().split())) == [50, 100, 100]


def test_single_letters_are_no_topic_words(docs):
    assert docs.select(tokens(F.lit("a bc d"), tm.WORD_CHARS).alias("t")).first().t == ["bc"]


@pytest.mark.parametrize("block, entries", [(1, 5), (2, 200_000), (64, 7)])
def test_distribution_in_blocks_of_topics(spark, weights, monkeypatch, block, entries):
    """Many blocks and slices of a few entries give what one block gives."""
    texts = list(enumerate(["great film great actors of the game", "fun", "the film film was fun game game game", "nothing known here", "", "game " * 9, "film game"]))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(tm, "TOPIC_BLOCK", block)
    monkeypatch.setattr(tm, "SLICE_ENTRIES", entries)
    got = {(r.doc_id, r.topic): round(r.share, 6) for r in tm.topic_distribution(frame, weights, "doc_id", "text").collect()}
    assert got == distribution(texts, weights.collect())


@pytest.mark.parametrize("at_hand, entries", [(0, 200_000), (8, 5), (500_000, 7)])
def test_distribution_with_common_words_at_hand(spark, weights, monkeypatch, at_hand, entries):
    """No, some and all words known by number give the same; these are looked up by no join and not repeated per topic."""
    texts = list(enumerate(["great film great actors of the game", "fun", "the film film was fun game game game", "nothing known here", "", "game " * 9, None]))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(tm, "WEIGHTS_AT_HAND", at_hand)
    monkeypatch.setattr(tm, "SLICE_ENTRIES", entries)
    got = {(r.doc_id, r.topic): round(r.share, 6) for r in tm.topic_distribution(frame, weights, "doc_id", "text").collect()}
    assert got == distribution([t for t in texts if t[1] is not None], weights.collect())


def test_distribution_of_a_long_text_over_many_topics(spark):
    """20,000 words and 5,000 topics: a row holds a block of topics, never words times topics."""
    import random

    draw = random.Random(3)
    vocabulary = [f"word{n}" for n in range(2000)]
    rows = [(t, w, 1, 1.0 + (hash_of(w) % 5), 0.1 + (t % 7)) for t in range(5000) for w in draw.sample(vocabulary, 4)]
    weights = spark.createDataFrame(rows, "topic int, term string, tf int, idf double, weight double")
    text = " ".join(draw.choice(vocabulary) for _ in range(20_000))
    frame = spark.createDataFrame([(1, text), (2, "word1 word2")], "doc_id long, text string")
    found = tm.topic_distribution(frame, weights, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("all")).collect()
    got = {r["doc_id"]: (r["n"], round(r["all"], 9)) for r in found}
    assert got[1][0] > 4900 and got[1][1] == 1.0 and got[2][1] == 1.0


def hash_of(word):
    return sum(map(ord, word))


def test_probabilities_of_topics(spark):
    means = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 2.0])], "topic string, mean array<double>")
    rows = [(1, [3.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])]
    docs = spark.createDataFrame(rows, "id int, vector array<double>")
    found = {r["id"]: r["topics"] for r in tm.topic_probabilities(docs, means).collect()}
    assert found[3] is None and found[4] is None and found[5] is None
    assert [t["topic"] for t in found[1]] == ["a", "c", "b"] and [t["topic"] for t in found[2]] == ["c", "a", "b"]
    parts = [math.exp(s / tm.TEMPERATURE) for s in (1.0, math.sqrt(0.5), 0.0)]
    assert [round(t["probability"], 9) for t in found[1]] == [round(p / sum(parts), 9) for p in parts]
    few = {r["id"]: r["topics"] for r in tm.topic_probabilities(docs, means, n=2).collect()}
    assert few[1] == found[1][:2] and few[3] is None
    words = spark.createDataFrame([("a", "x", 1)], "topic string, term string, rank int")
    new = {r["id"]: r for r in tm.assign_new(docs, means, words).collect()}
    assert (new[1]["topic"], new[1]["topic_words"], round(new[1]["probability"], 9)) == ("a", "x", round(found[1][0]["probability"], 9))
    assert new[3]["topic"] is None and new[3]["probability"] is None
