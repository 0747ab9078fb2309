import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxsift.functions import vectors as vec
from voxsift.functions.stemming import stem, stem_word
from voxsift.functions.text import (
    HIGHLIGHT_CLOSE, HIGHLIGHT_OPEN, clean_query, highlight, sentences, term_counts, term_positions, tokens,
)
from voxsift.operators import vector_search as vs
from voxsift.operators.ranking import top_k
from voxsift.operators.search import text_search, text_search_many
from voxsift.sources import versions
from voxsift.sources.search_index import hot_terms, indexed_terms, merged_postings, open_index, publish_index

# word and stem pairs of the published English Snowball vocabulary
STEMS = """consign consign|consigned consign|consignment consign|consistency consist|consolatory consolatori
conspiracy conspiraci|knackeries knackeri|kneaded knead|knightly knight|movies movi|running run|hopping hop|hoped hope
happy happi|cry cri|by by|say say|flies fli|ties tie|gas gas|gaps gap|this this|kiwis kiwi|nationality nation
rational ration|generate generat|generously generous|communication communic|skies sky|dying die|news news
proceed proceed|inning inning|agreed agre|feed feed|luxuriated luxuri|digitizer digit|relational relat
conditional condit|valency valenc|hopefulness hope|goodness good|electricity electr|formative format|formalize formal
analogy analog|revival reviv|allowance allow|adjustable adjust|replacement replac|adoption adopt|controlling control
rolled roll|probate probat|rate rate|cease ceas|youth youth|boy boy|yes yes|bled bled|bed bed|beautifully beauti
quickly quick|sensational sensat|delivery deliveri|delivered deliv|products product|used use|sized size|a a|ion ion"""


def pairs():
    return [tuple(p.split()) for p in re.split(r"[|\n]", STEMS)]


def test_stems(spark):
    assert [(w, stem_word(w)) for w, _ in pairs()] == pairs()
    frame = spark.createDataFrame([*pairs(), (None, None), ("über", "über"), ("2x4", "2x4")], "w string, want string")
    assert frame.select(F.col("want"), stem(F.col("w")).alias("got")).where("NOT want <=> got").count() == 0


def test_tokens_keep_accents_and_long_words(spark):
    frame = spark.createDataFrame([("Größe, naïve-CAFÉ 42!",), ("x" * 40 + " " + "y" * 39,), ("",), (None,)], "t string")
    got = [r.v for r in frame.select(tokens(F.col("t")).alias("v")).collect()]
    assert got == [["größe", "naïve", "café", "42"], ["x" * 40, "y" * 39], [], None]
    short = frame.select(tokens(F.col("t"), below_bytes=40).alias("v")).collect()
    assert [r.v for r in short] == [["größe", "naïve", "café", "42"], ["y" * 39], [], None]


def test_terms_of_a_row(spark):
    frame = spark.createDataFrame([(1, list("babab")), (2, []), (3, None), (4, ["z"])], "id int, t array<string>")
    counts = {(r.id, r.term): r.tf for r in term_counts(frame, "t", ["id"]).collect()}
    assert counts == {(1, "a"): 2, (1, "b"): 3, (4, "z"): 1}
    places = {(r.id, r.term): r.positions for r in term_positions(frame, "t", ["id"]).collect()}
    assert places == {(1, "a"): [1, 3], (1, "b"): [0, 2, 4], (4, "z"): [0]}


def test_words_are_counted_in_parts(spark, monkeypatch):
    """Texts counted some at a time give what each gives on its own; rows are counted in Arrow batches, not by lambdas."""
    monkeypatch.setattr("voxsift.functions.text.WORDS_AT_ONCE", 5)
    texts = [(i, None if i % 7 == 3 else [f"w{(i * j) % 5}é" for j in range(i % 6)]) for i in range(40)]
    counted = term_counts(spark.createDataFrame(texts, "id int, t array<string>").coalesce(1), "t", ["id"])
    assert "lambda" not in counted._jdf.queryExecution().toString()
    assert {(r.id, r.term): r.tf for r in counted.collect()} == {(i, w): n for i, t in texts for w, n in Counter(t or []).items()}


def test_long_rows_stay_linear(spark):
    frame = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("w"), i % 50_000)).alias("t"))
    total = term_counts(frame, "t", ["id"]).agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).first()
    assert (total.n, total.tf) == (50_000, 200_000)


def marked(text):
    return f"{HIGHLIGHT_OPEN}{text}{HIGHLIGHT_CLOSE}"


@pytest.mark.parametrize(
    "text, query, want",
    [
        ("Good day, GOODNESS", "good", f"{marked('Good')} day, {marked('GOOD')}NESS"),
        ("a div is yellow", "div yellow a", f"{marked('a')} {marked('div')} is {marked('yellow')}"),  # words of the markup
        ("goodness good", "good goodness", f"{marked('goodness')} {marked('good')}"),  # the longest wins
        ("1+1 (x) $1 \\E", "+ ( $1 \\E", f"1{marked('+')}1 {marked('(')}x) {marked('$1')} {marked(chr(92) + 'E')}"),
        ("Über über", "über", f"{marked('Über')} {marked('über')}"),
        ("unchanged", "", "unchanged"),
        ("unchanged", "  ", "unchanged"),
    ],
)
def test_highlight(spark, text, query, want):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(highlight(F.col("t"), query).alias("h")).first().h == want


def test_highlight_escapes_the_text_only(spark):
    frame = spark.createDataFrame([('<b> & "amp"',)], "t string")
    got = frame.select(highlight(F.col("t"), "b amp", escape_html=True).alias("h")).first().h
    assert got == f"&lt;{marked('b')}&gt; &amp; &quot;{marked('amp')}&quot;"


def test_clean_query_and_sentences(spark):
    frame = spark.createDataFrame([(1, "No! Really?? (yes) é."), (2, "..."), (3, "no end")], "id int, t string")
    assert [r.q for r in frame.select(clean_query(F.col("t")).alias("q")).collect()] == ["No Really yes ", "", "no end"]
    got = [tuple(r) for r in sentences(frame, "t", ["id"]).orderBy("id", "position").collect()]
    assert got == [(1, 0, "No!"), (1, 1, "Really??"), (1, 2, "(yes) é."), (3, 0, "no end")]


# --- text search ------------------------------------------------------------------------------------

TEXTS = [
    "the movie was great and the sound was great", "the sound of movies", "box arrived late, the box was broken",
    "", None, "great great great", "the the the the", "late movie", "unrelated words only", "moving boxes arrive",
]


def rows(spark):
    data = [(i, t, "even" if i % 2 == 0 else "odd") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(data, "review_id long, review string, brand string")


def brute_force(query, stemmed, allowed=lambda i: True):
    """BM25 written out over plain lists."""
    words = lambda t: [stem_word(w) if stemmed else w for w in re.findall(r"\w+", (t or "").lower())]
    docs = {i: words(t) for i, t in enumerate(TEXTS)}
    average = sum(map(len, docs.values())) / len(docs)
    scores = Counter()
    for term in words(query):
        holding = [i for i, d in docs.items() if term in d]
        idf = math.log(1 + (len(docs) - len(holding) + 0.5) / (len(holding) + 0.5))
        for i in holding:
            tf = docs[i].count(term)
            scores[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / average))
    return sorted(((i, round(s, 6)) for i, s in scores.items() if allowed(i)), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def indexes(spark):
    from voxsift.sources.search_index import scratch_index

    return {t: scratch_index(rows(spark), tokenizer=t, buckets=4) for t in ("plain", "en_stem")}


def found(hits):
    return [(r.review_id, round(r.score, 6)) for r in hits.orderBy("rank").collect()]


@pytest.mark.parametrize("tokenizer", ["plain", "en_stem"])
@pytest.mark.parametrize("query", ["the movies", "great great sound", "box late", "nothing known", "", "?!"])
def test_text_search_equals_brute_force(indexes, tokenizer, query):
    assert found(text_search(query, indexes[tokenizer])) == brute_force(query, tokenizer == "en_stem")


def test_conditions_apply_before_the_limit(indexes):
    hits = text_search("the great", indexes["plain"], limit=2, conditions={"brand": "odd"}, select=["review_id"])
    assert found(hits) == brute_force("the great", False, lambda i: i % 2)[:2]
    assert hits.columns == ["rank", "review_id", "score"]


@pytest.mark.parametrize("bounds", [(1000, 200_000), (0, 0)])
def test_many_queries_either_way(spark, indexes, monkeypatch, bounds):
    """Few terms are pruned and broadcast; with the bounds at nothing all joins shuffle."""
    monkeypatch.setattr("voxsift.operators.search.PRUNED_TERMS", bounds[0])
    monkeypatch.setattr("voxsift.operators.search.BROADCAST_ROWS", bounds[1])
    monkeypatch.setattr(vs, "_HELD", vs._HELD)
    texts = ["the movie", "late box", "zzz", "great"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query long, text string")
    hits = text_search_many(queries, indexes["plain"], limit=3, select=["brand", "review_id"]).collect()
    for q, text in enumerate(texts):
        got = sorted(((r["rank"], r.review_id, round(r.score, 6)) for r in hits if r["query"] == q))
        assert [(i, s) for _, i, s in got] == brute_force(text, False)[:3]


@pytest.mark.parametrize("tokenizer", ["plain", "en_stem"])
@pytest.mark.parametrize("step", [1, 100_000])
def test_many_postings_are_not_moved(spark, indexes, monkeypatch, tokenizer, step):
    """Queries that meet many postings are scored where the documents are: no row per query and posting is made."""
    monkeypatch.setattr("voxsift.operators.search.POSTINGS_A_DOCUMENT", 0)
    monkeypatch.setattr("voxsift.operators.search.BLOCK_NUMBERS", step * 50)
    texts = ["the movies", "late box", "zzz", "great the was", "the the moving sound"]
    queries = spark.createDataFrame([*enumerate(texts), (None, "great")], "query long, text string")
    for limit, allowed in ((3, None), (1, None), (20, None), (2, "odd")):
        hits = text_search_many(queries, indexes[tokenizer], limit, {"brand": allowed} if allowed else None, ["review_id"])
        assert "PythonMapInArrow" in hits._jdf.queryExecution().toString() or "MapInArrow" in hits._jdf.queryExecution().toString()
        rows = hits.collect()
        for q, text in [*enumerate(texts), (None, "great")]:
            got = sorted((r["rank"], r.review_id, round(r.score, 6)) for r in rows if r["query"] == q)
            want = brute_force(text, tokenizer == "en_stem", (lambda i: i % 2) if allowed else lambda i: True)
            assert [(i, s) for _, i, s in got] == want[:limit]


def test_repeated_keys_are_scored_together(spark, monkeypatch):
    """Rows of one key are one document of a search, whatever the way."""
    from voxsift.sources.search_index import scratch_index

    held = spark.createDataFrame([(1, "a a b"), (1, "a c"), (2, "a b"), (None, "b b a")], "review_id long, review string")
    index, ways = scratch_index(held, tokenizer="plain", buckets=2), []
    queries = spark.createDataFrame([(7, "a b"), (8, "b a a")], "query long, text string")
    for bound in (0, 1_000_000):
        monkeypatch.setattr("voxsift.operators.search.POSTINGS_A_DOCUMENT", bound)
        hits = text_search_many(queries, index, 2, select=["review_id"])
        ways.append(sorted((r["query"], r["rank"], r.review_id, round(r.score, 6)) for r in hits.collect()))
    assert ways[0] == ways[1] and not index.unique_keys


def test_index_tables(indexes):
    index = indexes["plain"]
    lengths = {r.doc: r.len for r in index.doc_stats.collect()}
    assert len(lengths) == len(TEXTS) and lengths[3] == 0 and lengths[6] == 4
    assert {r.term: r.df for r in index.term_stats.collect()}["the"] == 4
    assert index.docs == len(TEXTS)
    # stems of one document are merged: "box ... box" and "boxes"
    stems = {(r.term, r.doc): r.tf for r in indexes["en_stem"].postings.collect()}
    assert stems[("box", 2)] == 2 and stems[("box", 9)] == 1


@pytest.mark.parametrize("tasks", [8, 200])
def test_hot_terms_are_divided_over_tasks(spark, tasks):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        word = F.concat(F.lit("w"), F.xxhash64("doc", "at").cast("string"))
        every = F.when(F.col("at") == 0, "every").when((F.col("at") == 1) & (F.col("doc") % 4 == 0), "often").otherwise(word)
        terms = spark.range(20_000).select(F.col("id").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("at"))
        terms = terms.select("doc", every.alias("term"), F.lit(1).alias("tf"), F.lit(3).alias("len"))
        hot = hot_terms(terms, tasks)
        slices = {r.term: r.slices for r in hot.collect()}
        assert slices["every"] == -(-tasks // 3) and slices.get("often", 1) == -(-tasks // 12) and len(slices) <= 2
        postings = merged_postings(terms, 64, hot)
        placed = postings.groupBy(F.spark_partition_id().alias("task"), "term").count().collect()
        assert sum(r["count"] for r in placed) == 60_000 and sum(r.term == "every" for r in placed) == slices["every"]
        load = {}
        for r in placed:
            load[r.task] = load.get(r.task, 0) + r["count"]
        assert max(load.values()) < (2 if tasks == 8 else 2.5) * 60_000 / tasks
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_texts_are_cut_into_words_once(indexes):
    index = indexes["plain"]
    terms = indexed_terms(index.spark.read.parquet(f"{index.path}/documents"), index.doc_key)
    plan = merged_postings(terms, index.buckets, hot_terms(terms, 8))._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "review#" not in plan and "regexp" not in plan
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and "Exchange hashpartitioning(_task" not in plan
    assert "_runs" not in index.documents.columns


def test_postings_of_a_query_are_pruned(indexes):
    plan = text_search("movie", indexes["plain"], limit=100_000)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket[^]]*(=|IN)", plan)
    assert "EqualTo(term,movie)" in plan or "In(term, [movie])" in plan


def test_hits_are_fetched_from_their_buckets(indexes):
    plan = text_search("movie", indexes["plain"], limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(_doc_bucket" in plan


@pytest.mark.parametrize("limit", [3, 100_000])
def test_scores_are_never_ranked_whole_in_one_task(indexes, limit):
    """Every exchange below the scores is by key; a single task sees only rows cut to the limit."""
    plan = text_search("movie", indexes["plain"], limit=limit)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan
    assert ("WindowGroupLimit" if limit == 3 else "_slice") in plan


def test_republishing_replaces_all_rows(spark, folder):
    with pytest.raises(ValueError, match="no index"):
        open_index(spark, folder)
    with pytest.raises(ValueError, match="tokenizer"):
        publish_index(rows(spark), folder, tokenizer="other", buckets=2)
    first = publish_index(rows(spark), folder, buckets=2)
    second = publish_index(rows(spark).where("review_id < 2"), folder, buckets=2)
    assert open_index(spark, folder) == second and second.docs == 2
    assert first.documents.count() == len(TEXTS)  # an open version stays as it was
    assert len(versions.drop_old_versions(spark, folder)) >= 1
    assert open_index(spark, folder).documents.count() == 2


# --- vectors ----------------------------------------------------------------------------------------

ODD = [
    (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0]), (6, [None, 1.0]), (7, [0.0, -3.0]),
    (8, [float("nan"), 1.0]), (9, []),
]


def test_vectors_without_direction_are_no_hits(spark):
    frame = spark.createDataFrame(ODD, "review_id long, vector array<float>")
    hits = vs.vector_search(frame, [3.0, 0.0], threshold=None).orderBy("distance", "review_id").collect()
    assert [(r.review_id, r.distance) for r in hits] == [(1, 0.0), (5, 0.0), (7, 1.0)]
    with pytest.raises(ValueError, match="length"):
        vs.vector_search(frame, [0.0, 0.0])
    with pytest.raises(ValueError, match="length, 3"):
        vs.vector_search(frame, [1.0, 0.0, 0.0])
    assert vs.vector_search(frame.limit(0), [1.0, 0.0, 0.0]).isEmpty()


def test_places_without_a_limit(spark):
    frame = spark.createDataFrame([(q, d, float(d % 3)) for q in "ab" for d in range(50)], "query string, doc int, score double")
    order = [F.desc("score"), F.asc("doc")]
    every = top_k(frame, None, order, F.col("doc"), by=["query"], rank="rank")
    bounded = top_k(frame, 50, order, F.col("doc"), by=["query"], rank="rank")
    assert sorted(every.select("query", "rank", "doc").collect()) == sorted(bounded.select("query", "rank", "doc").collect())


def test_limit_comes_before_the_threshold_and_near_rows_are_kept(spark):
    frame = spark.createDataFrame(ODD, "review_id long, vector array<float>").withColumn("brand", F.lit("b"))
    kept = vs.vector_search(frame, [1.0, 0.0], limit=3, threshold=0.5)
    assert sorted(r.review_id for r in kept.collect()) == [1, 5]
    assert [r.review_id for r in vs.vector_search(frame, [1.0, 0.0], limit=1).collect()] == [1]
    selected = vs.vector_search(frame, [1.0, 0.0], conditions={"brand": "b"}, select=["review_id"])
    assert selected.columns == ["review_id", "brand", "distance"]
    by_text = vs.vector_search_text(frame, "xx", lambda t: [float(len(t)), 0.0], limit=1)
    assert [r.review_id for r in by_text.collect()] == [1]


@pytest.mark.parametrize("held", [2_000_000, 10])
def test_nearest_of_many_queries(spark, monkeypatch, held):
    """Against numpy; with little room the queries are taken in blocks. A third of the rows are copies."""
    monkeypatch.setattr(vs, "_HELD", held)
    random = np.random.default_rng(1)
    data = random.normal(size=(300, 5)).round(3)
    data[::3] = data[0]
    queries = random.normal(size=(4, 5)).round(3)
    queries[1] = data[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "review_id long, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query long, vector array<double>")
    near = vs.nearest_many(frame.repartition(5), asked, 7).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = np.round(1 - unit(queries) @ unit(data).T, 9)
    for q in range(4):
        want = sorted(range(300), key=lambda i: (distance[q, i], i))[:7]
        got = sorted((r["rank"], r.review_id) for r in near if r["query"] == q)
        assert [i for _, i in got] == want
    assert vs.nearest_many(frame, asked.limit(0), 3).count() == 0


def test_best_match_in_blocks(spark, monkeypatch):
    random = np.random.default_rng(2)
    names, labels = list("abcdefg"), random.normal(size=(7, 4))
    labels[5] = labels[2]  # a tie goes to the first
    data = random.normal(size=(50, 4))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(50, None)], "id long, v array<double>")

    def places():
        out = frame.select("id", vec.best_match(F.col("v"), names, labels.tolist()).alias("b")).collect()
        return {r.id: (r.b["place"], round(r.b["similarity"], 9) if r.b["similarity"] is not None else None) for r in out}

    whole = places()
    monkeypatch.setattr(vec, "BLOCK_NUMBERS", 8)
    assert places() == whole and whole[50][0] is None
    similar = (data / np.linalg.norm(data, axis=1, keepdims=True)) @ (labels / np.linalg.norm(labels, axis=1, keepdims=True)).T
    assert [whole[i][0] for i in range(50)] == similar.round(9).argmax(axis=1).tolist()


def test_recall_of_the_approximate_search(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    query = frame.where("vec_id = 3").first()["embedding"]
    exact = vs.vector_search(frame, query, "vec_id", "embedding", limit=10, threshold=None).collect()
    near = vs.approximate_nearest(frame, query, 10, "vec_id", "embedding").collect()
    exact_distance = {r.vec_id: r.distance for r in exact}
    both = [r for r in near if r.vec_id in exact_distance]
    assert len(both) >= 7
    assert all(abs(r.distance - exact_distance[r.vec_id]) < 1e-6 for r in both)


def test_search_page(spark):
    from voxsift.plans.review_search import search_reviews
    from voxsift.sources.search_index import scratch_index

    data = [(i, f"late <b>box</b> {i}", "b1" if i % 2 else "b2", [1.0, float(i)]) for i in range(40)]
    index = scratch_index(spark.createDataFrame(data, "review_id long, review string, brand string, vector array<float>"), buckets=2)
    page = search_reviews(index, "late, B-O-X!", lambda text: [1.0, 0.0], brand="b1", shown=1)
    assert page.cleaned == "late BOX"
    assert {r.measure: r["rows"] for r in page.counts.collect()} == {"total": 20, "text": 20, "semantic": 2}  # 1 - 1/sqrt(1+i*i) < 0.7
    shown = page.text.collect()
    assert [r.review_id for r in shown] == [1, 3, 5, 7, 9]
    assert shown[0].marked == f"{marked('late')} &lt;b&gt;{marked('box')}&lt;/b&gt; 1"
    assert [r.review_id for r in page.near.collect()] == [1, 3]
    assert search_reviews(index, "late").near is None
