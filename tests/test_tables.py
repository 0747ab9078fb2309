import pytest
from pyspark.sql import functions as F

from voxsift.operators.filters import matching, select_list
from voxsift.operators.joins import join_salted, join_small
from voxsift.operators.keys import with_surrogate_key
from voxsift.operators.merge import insert_missing, missing_from_large, update_matched
from voxsift.operators.ranking import top_k
from voxsift.sources import tables
from voxsift.sources.tables import SourceTable


def declared(schema="checks"):
    return (
        SourceTable(schema, "reviews", "answers", "analysis")
        .with_column("review_id", int, "the reader's key")
        .with_column("review", str, is_extractor_input=True)
        .with_column("score", float)
        .with_column("draft", bool, is_target_column=False)
    )


def test_declared_tables_in_the_catalog(spark):
    tables.ensure_schema(spark, "checks")
    tables.ensure_schema(spark, "checks")
    source = declared()
    assert source.create(spark).count() == 0
    types = dict(spark.table("checks.reviews").dtypes)
    assert types == {"review_id": "int", "review": "string", "score": "double", "draft": "boolean"}
    assert spark.table("checks.reviews").schema["review_id"].metadata["comment"] == "the reader's key"
    # the target takes the extractor's inputs, whatever is marked as target column
    assert source.create_target(spark).columns == ["review", "analysis"]
    listed = {r.tableName for r in tables.list_tables(spark, "checks").collect()}
    assert {"reviews", "answers"} <= listed
    rows = spark.createDataFrame([(1, "a", 2.0, True)], source.source_schema())
    assert source.select_target_columns(rows).columns == ["review_id", "review", "score"]


def test_a_target_needs_an_input_column():
    with pytest.raises(ValueError, match="extractor input"):
        SourceTable("s", "t", "u").with_column("a", str).target_schema()
    with pytest.raises(ValueError, match="str, int, float, bool"):
        SourceTable("s", "t", "u").with_column("a", list).source_schema()


def test_table_by_name_and_by_path(spark, folder):
    tables.ensure_schema(spark, "checks")
    for ref in ("checks.overwritten", folder):
        tables.write_table(spark.range(5), ref)
        tables.write_table(spark.range(3), ref)
        assert tables.read_table(spark, ref).count() == 3


def test_required_columns(spark):
    with pytest.raises(ValueError, match="rating, review"):
        tables.require_columns(spark.range(1).withColumnRenamed("id", "review_id"))


def test_load_numbers_equal_rows_too(spark, folder):
    # a third and more of the rows are copies of one row
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    rows.repartition(6).write.parquet(folder)
    loaded = tables.load_reviews(spark, folder, ["k"]).cache()
    assert loaded.columns == ["review_id", "k", "v"]
    ids = [r.review_id for r in loaded.orderBy("review_id").collect()]
    assert ids == list(range(1, 3001))
    in_order = [r.k for r in loaded.orderBy("review_id").collect()]
    assert in_order == sorted(in_order)


def test_surrogate_key_divides_ties_over_tasks(spark):
    rows = spark.range(8000).select((F.col("id") % 2).alias("k"), "id")
    numbered = with_surrogate_key(rows, "n", ["k"], ["id"])
    expected = sorted((r.k, r.id) for r in rows.collect())
    got = [(r.k, r.id) for r in numbered.orderBy("n").collect()]
    assert got == expected


def test_insert_missing_twice_changes_nothing(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    source = spark.createDataFrame([("z", 2), ("new", 3)], "v string, id int")
    once = insert_missing(target, source, "id")
    twice = insert_missing(once, source, "id")
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (2, None), (3, "new")}


@pytest.mark.parametrize("bound", [0, 100])
def test_missing_from_large_either_way(spark, monkeypatch, bound):
    monkeypatch.setattr("voxsift.operators.merge.BROADCAST_ROWS", bound)
    target = spark.range(1000).withColumnRenamed("id", "k")
    source = spark.range(990, 1010).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert sorted(r.k for r in missing_from_large(target, source, "k").collect()) == list(range(1000, 1010))


def test_update_overwrites_with_null_and_refuses_two_updates(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id int, v string, w int")
    source = spark.createDataFrame([(1, None, 10), (9, "x", 9)], "id int, v string, w int")
    got = {tuple(r) for r in update_matched(target, source, "id").collect()}
    assert got == {(1, None, 10), (2, "b", 2), (3, "c", 3)}
    clash = source.unionByName(source.where("id = 1"))
    with pytest.raises(Exception, match="more than one update for id 1"):
        update_matched(target, clash, "id").collect()
    # two updates for a row that is not there are no clash
    unmatched = source.unionByName(source.where("id = 9"))
    assert update_matched(target, unmatched, "id").count() == 3


def test_matching_casts_to_the_column_and_keeps_quotes(spark):
    rows = spark.createDataFrame([(1, "it's"), (2, "b")], "n int, t string")
    assert [r.n for r in matching(rows, {"n": "1", "t": "it's"}).collect()] == [1]
    assert matching(rows, {}).count() == matching(rows, None).count() == 2
    with pytest.raises(ValueError, match="no such column"):
        matching(rows, {"x": 1})


def test_condition_reaches_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = matching(docs, {"lang": "en"}).select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_select_list_keeps_order_and_drops_repeats(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert select_list(rows, ["c", "a", "c"], also=["a", "b"]).columns == ["c", "a", "b"]
    assert select_list(rows, None).columns == ["a", "b", "c"]


@pytest.mark.parametrize("k", [3, 150, 1200])
def test_top_k_of_a_hot_group(spark, k):
    # one group holds most rows, and scores are tied
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") % 11).alias("score"), "id",
    )
    order = [F.desc("score"), F.asc("id")]
    data = sorted(((r.g, -r.score, r.id) for r in rows.collect()))
    want = {}
    for g, score, i in data:
        want.setdefault(g, []).append(i)
    ranked = top_k(rows, k, order, F.col("id"), by=["g"], rank="rank").collect()
    got = {}
    for r in sorted(ranked, key=lambda r: (r.g, r["rank"])):
        got.setdefault(r.g, []).append(r.id)
    assert got == {g: ids[:k] for g, ids in want.items()}
    overall = [r.id for r in sorted(rows.collect(), key=lambda r: (-r.score, r.id))][:k]
    assert [r.id for r in top_k(rows, k, order, F.col("id")).collect()] == overall


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_small_join_either_way(spark, how):
    big = spark.range(500).select(F.when(F.col("id") < 200, F.lit(0)).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    small = spark.range(0, 40, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    broadcast = join_small(big, small, ["k"], F.col("id"), how)
    shuffled = join_small(big, small, ["k"], F.col("id"), how, max_rows=2)
    assert {tuple(r) for r in broadcast.collect()} == {tuple(r) for r in shuffled.select(*broadcast.columns).collect()}
    assert broadcast.count() == shuffled.count()


def test_salted_join_refuses_kinds_it_would_repeat(spark):
    with pytest.raises(ValueError):
        join_salted(spark.range(1), spark.range(1), ["id"], F.col("id"), "full")


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_only_hot_keys_are_divided(spark, how):
    from voxsift.operators.joins import hot_keys

    big = spark.range(6000).select(F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(0, 6000, 2).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    hot = hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n")
    assert len(hot) == 1
    got = join_salted(big, small, ["k"], F.col("id"), how, salts=5, hot=hot)
    want = big.join(small, "k", how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)


def test_a_large_k_is_no_single_tasks_work(spark):
    """200,000 of 300,000 rows: no step of the plan takes all rows into one partition or cuts them in one task."""
    from voxsift.operators import ranking

    rows = spark.range(300_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0).alias("score"))
    found = top_k(rows, 200_000, [F.desc("score"), F.asc("id")], F.col("id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan
    # the only single partition is that of the partitions' sizes
    assert plan.count("SinglePartition") <= 1
    got = found.collect()
    want = rows.orderBy(F.desc("score"), F.asc("id")).limit(200_000).collect()
    assert got == want
    assert 200_000 * int(spark.conf.get("spark.sql.shuffle.partitions")) > ranking.ONE_TASK_ROWS
