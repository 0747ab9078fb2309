import json

import pytest
from pyspark.sql import functions as F

from voxsift.domains import CATCH_ALL_KEY, Domain, DomainSet
from voxsift.functions.documents import json_path, json_strings
from voxsift.plans.batches import without_failures
from voxsift.plans.views import (
    ViewDefinition, ViewSource, build_analysis_views, catch_all_view, domain_summary, domain_view, error_view, read_view,
)
from voxsift.sources.tables import ensure_schema

DOMAINS = DomainSet(
    [
        Domain("Product", "when", "it's the summary\\of").with_additional_info("can gift", "a 'gift'"),
        Domain("delivery", "when", "d"),
    ]
)
DOCUMENTS = [
    (0, None),
    (1, "not json"),
    (2, "{}"),
    (3, json.dumps({"category_breakdown": {"error": "it's broken"}})),
    (4, json.dumps({"category_breakdown": {
        "productdetails": {"details": "p", "ai_rating": "null", "keywords": ["a", "b"], "can gift": "yes"},
        "deliverydetails": {"keywords": [], "ai_rating": "4", "sentiment": "positive"}}})),
    (5, json.dumps({"category_breakdown": {CATCH_ALL_KEY: {"details": "c", "keywords": '["x", "y"]', "ai_rating": 3}}})),
    (6, json.dumps({"category_breakdown": {CATCH_ALL_KEY: {"keywords": "plain text"}}})),
    (7, json.dumps({"category_breakdown": {CATCH_ALL_KEY: {"details": "no keywords"}}})),
    (8, json.dumps({"category_breakdown": {"Productdetails": {"details": "other case"}}})),
    (9, json.dumps({"category_breakdown": {"productdetails": {}}})),
    (10, json.dumps({"category_breakdown": {"productdetails": None}})),
]


@pytest.fixture
def analysed(spark):
    return spark.createDataFrame(DOCUMENTS, "review_id int, analysis string")


def rows(frame):
    return {r.review_id: r.asDict() for r in frame.collect()}


def test_domain_view(analysed):
    got = rows(read_view(analysed, domain_view, DOMAINS.topics[0]))
    assert set(got) == {4, 9}
    assert got[4] == {"review_id": 4, "details": "p", "sentiment": None, "keywords": ["a", "b"], "ai_rating": "null",
                      "rationale": None, "can gift": "yes"}
    assert got[9]["details"] is None and got[9]["keywords"] is None
    assert rows(read_view(analysed, domain_view, DOMAINS.topics[1]))[4]["keywords"] == []


def test_catch_all_and_error_views(analysed):
    got = rows(read_view(analysed, catch_all_view))
    assert {i: r["keywords"] for i, r in got.items()} == {5: ["x", "y"], 6: None, 7: None}
    assert got[5]["ai_rating"] == "3"
    assert rows(read_view(analysed, error_view)) == {3: {"review_id": 3, "error_details": "it's broken"}}


def test_permanent_views_with_comments(spark, analysed):
    ensure_schema(spark, "viewed")
    analysed.write.mode("overwrite").saveAsTable("viewed.answers")
    names = build_analysis_views(spark, ViewSource("viewed.answers"), DOMAINS, schema="viewed", prefix="seen")
    assert names == ["seen_Product", "seen_delivery", "seen_catchall", "seen_errors"]
    build_analysis_views(spark, ViewSource("viewed.answers"), DOMAINS, schema="viewed", prefix="seen")
    comments = {f.name: f.metadata.get("comment") for f in spark.table("viewed.seen_Product").schema}
    assert comments["details"] == "it's the summary\\of" and comments["can gift"] == "a 'gift'"
    assert {n: spark.table(f"viewed.{n}").count() for n in names} == dict(zip(names, (2, 1, 3, 1)))


def test_replaced_definitions(spark, analysed):
    analysed.createOrReplaceTempView("edge_answers")

    def own_errors(source, prefix):
        return ViewDefinition(f"{prefix}own", {"n": "how many"}, f"SELECT count(*) AS n FROM {source.table}")

    names = build_analysis_views(
        spark, ViewSource("edge_answers"), DOMAINS, temporary=True, errors=own_errors,
        catch_all_fields={"details": "d", "mood": None},
    )
    assert names[-1] == "analysis_own" and spark.table("analysis_own").first().n == len(DOCUMENTS)
    assert spark.table("analysis_catchall").columns == ["review_id", "details", "mood"]


def test_a_document_is_parsed_once(analysed):
    plan = read_view(analysed, domain_view, DOMAINS.topics[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(category_breakdown") == 1


def test_summary_counts_what_the_views_hold(analysed):
    got = {(r.domain, r.sentiment): (r.reviews, r.mean_ai_rating) for r in domain_summary(analysed, DOMAINS).collect()}
    assert got[("deliverydetails", "positive")] == (1, 4.0)
    assert got[("productdetails", None)] == (2, None)
    assert got[(CATCH_ALL_KEY, None)] == (3, 3.0)


def test_failures_set_back(analysed):
    assert [r.review_id for r in without_failures(analysed).where("analysis IS NULL").collect()] == [0, 3]


def test_json_helpers(spark):
    frame = spark.createDataFrame([('["a"]',), ("a, b",), (None,), ('{"k": 1}',)], "t string")
    assert [r.v for r in frame.select(json_strings(F.col("t")).alias("v")).collect()] == [["a"], None, None, None]
    assert [r.v for r in frame.select(json_path("t", "k").alias("v")).collect()] == [None, None, None, "1"]
