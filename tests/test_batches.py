import json

import pytest
from pyspark.sql import functions as F

from voxsift.domains import Domain, DomainSet
from voxsift.plans.batches import AnalysisTarget, run_batches, run_threaded
from voxsift.plans.extraction import LexiconExtraction, ModelExtraction, lexicon_model
from voxsift.streaming.reviews import analyse_micro_batch, read_review_files, stream_analysis

WORDS = {"product": ["phone"]}


def domains():
    return DomainSet([Domain("product", "w", "d")])


def lexicon():
    return LexiconExtraction(domains(), WORDS)


def reviews(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.col("id").alias("review_id"), F.when(F.col("id") % 3 == 0, "a phone").otherwise("a book").alias("review"),
        (F.col("id") % 5 + 1).cast("int").alias("rating"),
    )


def test_a_thousand_pending_at_five_hundred_are_two_commits(spark, folder):
    target = AnalysisTarget(spark, folder)
    assert not target.exists()
    with pytest.raises(ValueError, match="seed"):
        target.read()
    assert target.seed(reviews(spark, 1000))
    assert not target.seed(reviews(spark, 5))
    assert target.pending().count() == 1000
    log = run_batches(target, lexicon(), batch_size=500)
    assert [(e["batch"], e["rows_in"], e["rows_errored"]) for e in log] == [(1, 500, 0), (2, 500, 0)]
    assert target.pending().isEmpty() and target.read().count() == 1000
    expected = {r.review_id: r.analysis for r in lexicon().analyse(reviews(spark, 1000)).collect()}
    assert {r.review_id: r.analysis for r in target.read().collect()} == expected
    # nothing is left, so another run changes nothing
    assert run_batches(target, lexicon(), batch_size=500) == []
    assert [r.operation for r in target.history().orderBy("started").collect()] == ["seed", "analyse", "analyse", "fold"]


def test_a_stopped_run_is_taken_up(spark, folder):
    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 100))
    run_batches(target, lexicon(), batch_size=30, max_batches=2, fold=False)
    again = AnalysisTarget(spark, folder)
    assert again.pending().count() == 40 and again.processed().count() == 60
    log = run_batches(again, lexicon(), batch_size=30, first_batch=5)
    assert [e["rows_in"] for e in log] == [5, 30, 5]
    assert again.read().select("review_id").distinct().count() == again.read().count() == 100


def test_a_half_written_batch_is_completed(spark, folder):
    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 50))
    half = lexicon().analyse(target.rows().where("review_id < 7"))
    half.write.parquet(f"{target._folder()}/answers/run=lost/batch=1")
    # files of a write that was never committed do not count
    half.write.parquet(f"{target._folder()}/answers/run=lost/batch=2/_temporary/0")
    log = run_batches(target, lexicon(), batch_size=20)
    assert [e["rows_in"] for e in log] == [20, 20, 3]
    assert target.read().count() == 50 and target.pending().isEmpty()


def test_late_reviews_join_once(spark, folder):
    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 100), limit=10)
    assert target.read().count() == 10
    target.insert_missing(reviews(spark, 30))
    target.insert_missing(reviews(spark, 30))
    assert target.read().count() == 30
    log = run_threaded(target, lexicon(), batch_size=5)
    assert [e["rows_in"] for e in log] == [30]
    target.insert_missing(reviews(spark, 40))
    assert target.pending().count() == 10 and target.processed().count() == 30
    target.seed(reviews(spark, 3), reset=True)
    assert target.read().count() == 3 and target.processed().isEmpty()


def test_failures_are_set_back_and_run_again(spark, folder):
    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 30))
    words = WORDS

    def flaky(settings):
        complete = lexicon_model(words)(settings)

        def checked(prompts):
            if prompts.str.contains("a phone").any():
                raise TimeoutError("too slow")
            return complete(prompts)

        return checked

    log = run_batches(target, ModelExtraction(domains(), flaky, threads=2), batch_size=15)
    assert [e["rows_errored"] for e in log] == [5, 5]
    assert {r.review_id for r in target.failures().collect()} == set(range(0, 30, 3))
    assert json.loads(target.failures().first().analysis)["category_breakdown"] == {"error": "too slow"}
    target.reprocess_failures()
    assert target.pending().count() == 10 and target.processed().count() == 20
    run_batches(target, lexicon(), batch_size=100)
    assert target.failures().isEmpty() and target.pending().isEmpty()


def test_text_keys(spark, folder):
    target = AnalysisTarget(spark, folder, key="code")
    rows = reviews(spark, 20).withColumn("code", F.concat(F.lit("r"), F.col("review_id").cast("string"))).drop("review_id")
    target.seed(rows)
    assert [e["rows_in"] for e in run_batches(target, lexicon(), batch_size=8)] == [8, 8, 4]
    assert target.pending().isEmpty()


def test_stream_in_several_micro_batches(spark, folder):
    target = AnalysisTarget(spark, folder + "/target")
    target.seed(reviews(spark, 5))
    source = folder + "/arriving"
    for start in (0, 20, 30):  # the second file repeats reviews of the first
        reviews(spark, 25, start).coalesce(1).write.mode("append").parquet(source)
    arriving = read_review_files(spark, source, reviews(spark, 1).schema, files_per_batch=1)
    stream_analysis(arriving, target, lexicon(), folder + "/progress").awaitTermination()
    state = target.read()
    assert state.count() == state.select("review_id").distinct().count() == 55
    assert target.pending().isEmpty()
    assert target.history().where("operation = 'stream'").count() == 3
    # started again with nothing new: no change
    stream_analysis(arriving, target, lexicon(), folder + "/progress").awaitTermination()
    assert target.read().count() == 55


def places(frame):
    return {tuple(f.split("/data/")[1].split("/")[:2]) for f in frame.inputFiles()}


def test_a_batch_reads_the_folders_its_keys_are_in(spark, folder):
    """Four ranges of keys; a batch of ten keys opens one of them, and folding it leaves the files of the others."""
    target = AnalysisTarget(spark, folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        target.seed(reviews(spark, 800))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = places(target.rows())
    entries = target.manifest().orderBy("first_key").collect()
    assert len(entries) == len(before) == 8 and sum(e["n"] for e in entries) == 800
    assert all(a["last_key"] < b["first_key"] for a, b in zip(entries, entries[1:]))
    read = []

    class Watched(LexiconExtraction):
        def analyse(self, rows):
            read.append(places(rows))
            return super().analyse(rows)

    run_batches(target, Watched(domains(), WORDS), batch_size=10, max_batches=2)
    assert [len(r) for r in read] == [1, 1]
    after = places(target.rows())
    assert len(after - before) == 1 and len(after & before) == 7
    target.fold()  # nothing to fold
    assert places(target.rows()) == after
    run_batches(target, lexicon(), batch_size=1000)
    assert target.pending().isEmpty() and target.read().count() == 800


def test_batches_run_side_by_side(spark, folder):
    """Two batches wait for each other; where the extraction bounds its calls by tasks there is one at a time."""
    import threading

    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 40))
    both, inside = threading.Barrier(2, timeout=60), []

    class Meeting(LexiconExtraction):
        def analyse(self, rows):
            both.wait()
            return super().analyse(rows)

    log = run_batches(target, Meeting(domains(), WORDS), batch_size=10, at_once=2)
    assert [e["batch"] for e in log] == [1, 2, 3, 4] and [e["rows_in"] for e in log] == [10] * 4
    assert target.pending().isEmpty() and target.history().where("operation = 'analyse'").count() == 4

    class Alone(ModelExtraction):
        def analyse(self, rows):
            inside.append(target.history().where("operation = 'analyse'").count())
            return super().analyse(rows)

    target.seed(reviews(spark, 30), reset=True)
    run_batches(target, Alone(domains(), lexicon_model(WORDS), tasks=2), batch_size=10)
    assert [n - inside[0] for n in inside] == [0, 1, 2]


def test_a_failing_batch_ends_the_run_and_keeps_the_others(spark, folder):
    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 30))

    class Broken(LexiconExtraction):
        def analyse(self, rows):
            if rows.where("review_id = 15").count():
                raise RuntimeError("no more")
            return super().analyse(rows)

    with pytest.raises(RuntimeError, match="no more"):
        run_batches(target, Broken(domains(), WORDS), batch_size=10, at_once=3)
    assert 10 <= target.pending().count() <= 20
    run_batches(target, lexicon(), batch_size=10)
    assert target.pending().isEmpty() and target.read().count() == 30


def test_failures_rewrite_only_their_folders(spark, folder):
    target = AnalysisTarget(spark, folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        target.seed(reviews(spark, 400))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    run_batches(target, lexicon(), batch_size=1000, fold=False)
    failed = target.rows().where("review_id < 9").withColumn("analysis", F.lit('{"error": "lost"}'))
    only = AnalysisTarget(spark, folder + "/second")
    only.seed(target.rows())
    only.record(failed.unionByName(lexicon().analyse(target.rows().where("review_id >= 9")).select(*failed.columns)), "run", 1)
    only.fold()
    before = places(only.rows())
    only.reprocess_failures()
    assert only.pending().count() == only.manifest().agg(F.sum("pending")).first()[0]
    assert len(places(only.rows()) - before) <= 1 and only.read().count() == 400


def test_appends_are_written_once_and_checked_before_they_are_listed(spark, folder):
    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 10))
    target.append(reviews(spark, 5, 10), commit="late")
    target.append(reviews(spark, 5, 10), commit="late")
    assert target.read().count() == 15 and target.appended("late").count() == 5
    with pytest.raises(ValueError, match="review_id"):
        target.append(reviews(spark, 3, 20).unionByName(reviews(spark, 1, 20)), commit="bad")
    assert target.read().count() == 15 and not target.has("bad")


def test_an_empty_target(spark, folder):
    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 0))
    assert target.read().count() == 0 and run_batches(target, lexicon()) == []
    target.insert_missing(reviews(spark, 3))
    assert [e["rows_in"] for e in run_batches(target, lexicon())] == [3]


def test_later_triggers_read_no_stored_reviews(spark, folder):
    """Keys known from the target and from earlier micro-batches are state: with the stored reviews out of reach, a later
    trigger still leaves out what came before."""
    target = AnalysisTarget(spark, folder + "/target")
    target.seed(reviews(spark, 10))
    source, progress = folder + "/arriving", folder + "/progress"
    arriving = lambda: read_review_files(spark, source, reviews(spark, 1).schema)
    reviews(spark, 10, 5).write.parquet(source)
    stream_analysis(arriving(), target, lexicon(), progress).awaitTermination()
    assert target.read().count() == 15
    opened = []
    rows, read = AnalysisTarget.rows, AnalysisTarget._read
    AnalysisTarget._read = lambda self, entries, places=False: opened.append([e["commit"] for e in entries]) or read(self, entries, places)
    try:
        reviews(spark, 16).write.mode("append").parquet(source)  # all but one were there
        stream_analysis(arriving(), target, lexicon(), progress).awaitTermination()
    finally:
        AnalysisTarget._read = read
    stored = [c for own in opened for c in own if not c.startswith("stream-")]
    assert target.rows().count() == 16 and target.pending().isEmpty()
    assert stored == []


def test_the_stream_keeps_its_keys_without_a_function_for_each(spark, folder):
    """Answered, stored and new keys, each arriving more than once, with the key state kept by Spark alone."""
    from voxsift.streaming.reviews import new_reviews

    target = AnalysisTarget(spark, folder + "/target")
    target.seed(reviews(spark, 6))
    target.record(lexicon().analyse(target.rows().where("review_id < 4")), "before", 0)  # ids 0 to 3
    source, progress = folder + "/arriving", folder + "/progress"
    for start in (0, 2, 4):  # ids 0 to 5, 2 to 7, 4 to 9, the first of each file twice
        reviews(spark, 6, start).union(reviews(spark, 1, start)).coalesce(1).write.mode("append").parquet(source)
    arriving = read_review_files(spark, source, reviews(spark, 1).schema, files_per_batch=1)
    known = target.read().select("review_id", F.col("analysis").isNotNull().alias("answered"))
    plan = new_reviews(arriving, known, "review_id")._jdf.queryExecution().analyzed().toString()
    assert "InPandas" not in plan
    stream_analysis(arriving, target, lexicon(), progress).awaitTermination()
    held = target.read().select("review_id", "analysis").collect()
    assert sorted(r["review_id"] for r in held) == list(range(10)) and all(r["analysis"] for r in held)
    answered = target.answers().groupBy("review_id").count().collect()
    assert sorted(map(tuple, answered)) == [(i, 1) for i in range(10)]  # none analysed again


def test_a_micro_batch_repeated_after_a_lost_driver(spark, folder):
    from voxsift.streaming.reviews import commit_micro_batch

    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 2))
    batch = reviews(spark, 8, 2).withColumn("_stored", F.lit(False))
    target._write(batch.drop("_stored").withColumn("analysis", F.lit(None).cast("string")), "stream-s-0")  # written, not listed
    for _ in range(2):
        commit_micro_batch(target, lexicon(), batch, 0, "s")
    assert target.read().count() == 10 and target.pending().count() == 2
    commit_micro_batch(target, lexicon(), batch.limit(0), 1, "s")
    assert target.read().count() == 10


def test_a_repeated_micro_batch_is_harmless(spark, folder):
    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 2))
    batch = reviews(spark, 20)
    # the first attempt was lost after its rows were inserted and some answers written
    target.insert_missing(batch)
    target.record(lexicon().analyse(target.rows().where("review_id < 4")), "stream", 0)
    analyse_micro_batch(target, lexicon(), batch, 0)
    analyse_micro_batch(target, lexicon(), batch, 0)
    assert target.read().count() == 20 and target.pending().isEmpty()
    target.fold()
    assert target.read().count() == 20


def test_stream_needs_its_columns(spark, folder):
    reviews(spark, 1).write.parquet(folder + "/in")
    arriving = read_review_files(spark, folder + "/in", "review_id long, review string")
    with pytest.raises(ValueError, match="rating"):
        stream_analysis(arriving, AnalysisTarget(spark, folder), lexicon(), folder + "/progress")


def test_missing_and_repeated_keys_are_refused_and_nothing_is_lost(spark, folder):
    rows = reviews(spark, 6)
    without = rows.withColumn("review_id", F.expr("nullif(review_id, 3)"))
    twice = rows.unionByName(reviews(spark, 1))
    for bad, message in ((without, "1 rows without"), (twice, "1 values of")):
        target = AnalysisTarget(spark, folder + "/bad")
        with pytest.raises(ValueError, match=message):
            target.seed(bad)
        assert not AnalysisTarget(spark, folder + "/bad").exists()
    target = AnalysisTarget(spark, folder + "/good")
    target.seed(rows)
    for bad in (without, reviews(spark, 3, 6).unionByName(reviews(spark, 1, 7))):
        with pytest.raises(ValueError, match="review_id"):
            target.append(bad)
    with pytest.raises(ValueError, match="without review_id"):
        analyse_micro_batch(target, lexicon(), without, 1)
    assert target.read().count() == 6 and target.pending().count() == 6


def test_a_key_answered_twice_has_one_result(spark, folder):
    target = AnalysisTarget(spark, folder)
    target.seed(reviews(spark, 20))
    analysed = lexicon().analyse(target.rows())
    target.record(analysed, "one", 1)
    entry = target.record(analysed.where("review_id < 5"), "one", 1)
    assert entry["rows_in"] == 5
    assert target.read().count() == target.processed().count() == 20
    target.fold()
    assert target.read().count() == 20 and target.pending().isEmpty()
