import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxsift.domains import AI_RATING_TEXT, CATCH_ALL_KEY, Domain, DomainSet, Extra
from voxsift.functions.domain_columns import condition_map, flat_rows, split_categories, valid_categories
from voxsift.plans.extraction import FILL_TASK, IDENTIFY_TASK, LexiconExtraction, ModelExtraction, lexicon_model
from voxsift.plans.model import ModelSettings
from voxsift.sources.config_table import load_domains, save_domains

AWKWARD = "it's {braced} with \\ and \"quotes\" for {topic}"


def two_domains():
    return DomainSet(
        [
            Domain("Product", "use {topic} for the thing bought", "<summary>").with_additional_info("gift", "is {topic} a gift"),
            Domain("delivery", AWKWARD, "<summary>"),
        ]
    )


WORDS = {"Product": ["phone"], "delivery": ["late", "box"]}


def test_domain_texts():
    d = Domain("Product", "use {topic}", "x", extras=[Extra("sentiment", "mood of {topic}"), Extra("gift", "g")])
    assert d.key == "productdetails" and d.condition == "use productdetails"
    flat = d.to_kwargs()
    assert flat["sentiment"] == "mood of Product" and flat["gift"] == "g"
    assert flat["ai_rating"] == AI_RATING_TEXT.replace("{topic}", "Product")
    assert json.loads(flat["raw"]) == {k: v for k, v in flat.items() if k != "raw"}
    # a rating text of one's own is kept
    assert Domain("a", "b", "c", ai_rating="own").ai_rating == "own"
    assert d.to_row()["serialized"]["extras"][1] == {"item_name": "gift", "item_description": "g"}


def test_keys_are_unique():
    with pytest.raises(ValueError, match="taken"):
        DomainSet([Domain("a", "", ""), Domain("A", "", "")])
    with pytest.raises(ValueError, match="taken"):
        DomainSet([Domain("catchall", "", "")])


def test_domain_columns_equal_the_builder(spark):
    domains = two_domains()
    domains.topics[0].with_additional_info("gift", "later text").with_additional_info("details", "own details")
    frame = domains.to_frame(spark)
    got = {r["topic"]: r["fields"] for r in flat_rows(frame).collect()}
    assert got == {d.topic: d.fields() for d in domains}
    assert condition_map(frame).first()["conditions"] == domains.conditions()


def test_configuration_survives_awkward_texts(spark, folder):
    save_domains(spark, DomainSet([Domain("old", "", "")]), folder)
    save_domains(spark, two_domains(), folder)
    loaded = load_domains(spark, folder)
    assert [d.as_dict() for d in loaded] == [d.as_dict() for d in two_domains()]
    assert spark.read.parquet(folder).columns == ["topic", "raw"]


def test_category_lists(spark):
    rows = spark.createDataFrame(
        [(["b", "x", "b", "A"],), ([],), (None,), ([CATCH_ALL_KEY, "a"],)], "c array<string>"
    ).select(valid_categories(F.col("c"), ["a", "b"]).alias("v"))
    assert [r.v for r in rows.collect()] == [["b"], [CATCH_ALL_KEY], [CATCH_ALL_KEY], [CATCH_ALL_KEY, "a"]]
    text = spark.createDataFrame([(" a, b ,c",)], "t string").select(split_categories(F.col("t")).alias("v"))
    assert text.first().v == ["a", "b", "c"]


def reviews(spark):
    texts = ["the phone is good", "late box, phone broken", "nothing here", None, "", 'quote " brace { back \\ late', "PHONE"]
    return spark.createDataFrame([(i, t, i % 5 + 1) for i, t in enumerate(texts)], "review_id long, review string, rating int")


def documents(frame):
    return {r.review_id: json.loads(r.analysis) for r in frame.collect()}


def test_lexicon_and_model_path_agree(spark):
    by_columns = documents(LexiconExtraction(two_domains(), WORDS).analyse(reviews(spark)))
    by_model = documents(ModelExtraction(two_domains(), lexicon_model(WORDS), threads=3).analyse(reviews(spark)))
    assert by_columns == by_model
    assert list(by_columns[1]["category_breakdown"]) == ["productdetails", "deliverydetails"]
    assert by_columns[1]["category_breakdown"]["deliverydetails"]["keywords"] == ["late", "box"]
    assert by_columns[3]["category_selection"] == [] and CATCH_ALL_KEY in by_columns[3]["category_breakdown"]
    assert by_columns[0]["all_categories"] == ["productdetails", "deliverydetails"]


def scripted(identify, fill):
    """A model answering from functions of the feedback."""

    def make(settings):
        def complete(prompts):
            out = []
            for p in prompts:
                feedback = p.split("\nfeedback: ", 1)[1]
                out.append((identify if IDENTIFY_TASK in p else fill)(feedback))
            return pd.Series(out)

        return complete

    return make


def run(spark, identify, fill, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id long, review string").withColumn("rating", F.lit(3))
    return documents(ModelExtraction(two_domains(), scripted(identify, fill), **options).analyse(rows))


def test_replies_of_every_kind(spark):
    listed = {
        "text": json.dumps({"categories": "productdetails, deliverydetails", "rationale": "r"}),
        "odd": json.dumps({"categories": ["Productdetails", "unknown", "deliverydetails", "deliverydetails"]}),
        "nojson": "I think productdetails",
        "partial": json.dumps({"categories": ["productdetails", "deliverydetails"]}),
        "extra": json.dumps({"categories": ["productdetails"]}),
    }
    filled = {
        "text": json.dumps({"productdetails": {"gift": "yes", "ai_rating": 4}, "deliverydetails": {}}),
        "odd": json.dumps({"deliverydetails": {"keywords": ["a", "b"]}}),
        "nojson": json.dumps({CATCH_ALL_KEY: {"keywords": '["x"]'}}),
        "partial": json.dumps({"productdetails": {}}),
        "extra": json.dumps({"productdetails": {"details": "d", "invented": 1}, "deliverydetails": {"details": "no"}}),
    }
    got = run(spark, listed.get, filled.get, list(listed))
    text, odd, nojson, partial, extra = (got[i] for i in range(5))
    assert text["category_breakdown"] == {"productdetails": {"gift": "yes", "ai_rating": "4"}, "deliverydetails": {}}
    assert odd["category_breakdown"] == {"deliverydetails": {"keywords": ["a", "b"]}}
    assert odd["category_selection"] == ["Productdetails", "unknown", "deliverydetails", "deliverydetails"]
    assert nojson["category_breakdown"] == {CATCH_ALL_KEY: {"keywords": '["x"]'}}
    assert partial["category_breakdown"] == {"error": "reply lacks deliverydetails"}
    assert extra["category_breakdown"] == {"productdetails": {"details": "d"}}


def test_replies_of_a_wrong_shape_are_errors(spark):
    replies = {
        "a": {"productdetails": "just text"},
        "b": {"productdetails": {"details": "x", "keywords": "k, l"}},
        "c": {"productdetails": {"details": "x", "keywords": None}, "deliverydetails": 5},
        "d": {"productdetails": None},
    }
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate("abcd")], "review_id long, review string, rating int")
    model = scripted(lambda t: json.dumps({"categories": ["productdetails"]}), lambda t: json.dumps(replies[t]))
    got = {k: d["category_breakdown"].get("error") for k, d in documents(ModelExtraction(two_domains(), model).analyse(frame)).items()}
    shape = "reply has a wrong shape in productdetails"
    assert got == {0: shape, 1: shape + ".keywords", 2: None, 3: shape}


def test_failures_become_data_in_both_passes(spark):
    def identify(feedback):
        if feedback == "first fails":
            raise RuntimeError("no answer")
        return json.dumps({"categories": ["deliverydetails"], "rationale": "why"})

    def fill(feedback):
        if feedback == "second fails":
            raise RuntimeError("it's \"broken\"")
        return "not json" if feedback == "nonsense" else json.dumps({"deliverydetails": {"details": "d"}})

    got = run(spark, identify, fill, ["first fails", "second fails", "fine", "nonsense"], threads=2)
    assert got[0]["category_breakdown"] == {"error": "no answer"}
    assert got[1]["category_breakdown"] == {"error": "it's \"broken\""}
    assert got[1]["category_selection"] == ["deliverydetails"] and got[1]["category_selection_rationale"] == "why"
    assert got[2]["category_breakdown"] == {"deliverydetails": {"details": "d"}}
    assert got[3]["category_breakdown"] == {"error": "reply lacks deliverydetails"}


def test_each_row_is_asked_twice_and_equal_texts_once_when_wanted(spark, tmp_path):
    log = tmp_path / "calls"

    def counting(settings):
        complete = lexicon_model(WORDS)(settings)

        def counted(prompts):
            with open(log, "a") as f:
                f.writelines("x\n" for _ in prompts)
            return complete(prompts)

        return counted

    rows = spark.createDataFrame([(i, "late box", 3) for i in range(20)], "review_id long, review string, rating int")
    got = documents(ModelExtraction(two_domains(), counting).analyse(rows))
    assert len(got) == 20 and len(log.read_text().split()) == 40
    log.write_text("")
    again = documents(ModelExtraction(two_domains(), counting, once_per_text=True).analyse(rows))
    assert again == got and len(log.read_text().split()) == 2


def test_prompts_name_only_the_chosen_fields_and_hide_the_key(spark):
    script = scripted(
        lambda f: json.dumps({"categories": ["deliverydetails"]}), lambda f: json.dumps({"deliverydetails": {}})
    )

    def make(settings):
        assert settings.key == "secret" and settings.temperature == 0.7 and settings.max_tokens == 500

        def complete(prompts):
            for p in prompts:
                if FILL_TASK in p:
                    head = p.split("\nfeedback: ")[0]
                    assert "deliverydetails" in head and "gift" not in head and '"braced"' not in head
            return script(settings)(prompts)

        return complete

    settings = ModelSettings("m", "e", "secret", temperature=0.7)
    assert "secret" not in repr(settings)
    rows = spark.createDataFrame([(1, "x", 1)], "review_id long, review string, rating int")
    analysed = ModelExtraction(two_domains(), make, settings).analyse(rows)
    assert "secret" not in analysed._jdf.queryExecution().toString()
    assert documents(analysed)[1]["category_breakdown"] == {"deliverydetails": {}}


def test_few_requests_are_begun_ahead():
    """The prompts of a batch are neither cut into requests nor sent all at once."""
    from concurrent.futures import ThreadPoolExecutor

    from voxsift.plans import model

    taken = []
    pieces = (taken.append(i) or [str(i)] for i in range(1000))
    with ThreadPoolExecutor(2) as pool:
        for done, answer in enumerate(model._in_order(pool, lambda p: p, pieces, 2), 1):
            assert answer == [str(done - 1)] and len(taken) - done < model.AHEAD * 2
    assert len(taken) == 1000


def test_model_call_in_batches_and_requests(spark):
    """NULL prompts, failing ones, missing replies and whole batches, in order."""
    from voxsift.plans.model import model_call

    def make(settings):
        def complete(prompts):
            if (prompts == "7").any():
                raise ValueError("no 7")
            return prompts.map(lambda p: None if p == "9" else f"<{p}>")

        return complete

    ids = spark.range(0, 1500, 1, 1)
    text = F.when(F.col("id") % 5 != 0, F.col("id").cast("string"))
    for threads, chunk in ((1, 1), (3, 4), (2, 700)):
        rows = ids.select("id", model_call(text, make, ModelSettings(), threads, chunk).alias("c")).orderBy("id").collect()
        for r in rows:
            empty = r["id"] % 5 == 0 or r["id"] in (7, 9)
            assert r["c"]["reply"] == (None if empty else f"<{r['id']}>"), (threads, chunk, r)
            assert r["c"]["error"] == ("no 7" if r["id"] == 7 else None)


def test_listed_words_are_whole_words():
    complete = lexicon_model({"a": ["Box", "x-y", "é"]})(ModelSettings())
    said = ["box", "boxes, inbox", "inbox _box_", "x-y", "café é!", ""]
    named = complete(pd.Series([f"{IDENTIFY_TASK}\nfeedback: {s}" for s in said]))
    assert [bool(json.loads(r)["categories"]) for r in named] == [True, False, True, False, True, False]
