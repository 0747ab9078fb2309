"""Inputs shared by the checks: the given tables seen as reviews, and their SQL twins."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxsift.domains import Domain, DomainSet
from voxsift.plans.extraction import FILL_TASK, FEEDBACK_MARK, LexiconExtraction, lexicon_model
from voxsift.sources.search_index import SearchIndex, scratch_index

Query = Callable[[SparkSession, str], DataFrame]

_made: dict[tuple, Any] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def once(spark: SparkSession, sf: str, name: str, make: Callable[[], Any]) -> Any:
    """Made once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("rating"),
        F.col("text").alias("review"),
        F.col("source").alias("brand"),
        "lang",
    )


REVIEWS = """SELECT doc_id AS review_id, CAST(doc_id % 5 + 1 AS INTEGER) AS rating, text AS review,
  source AS brand, lang FROM documents"""


def domains() -> DomainSet:
    """Two domains; the words to find are frequent ones of the invented texts."""
    product = Domain("product", "when {topic} is about the thing bought", "<summary of the product part>")
    product.with_additional_info("arrived_whole", "did the {topic} arrive undamaged <yes/no/unsure>")
    delivery = Domain("Delivery", "when the review is about shipping", "<summary of the delivery part>")
    return DomainSet([product, delivery])


WORDS = {"product": ["that", "with"], "Delivery": ["this", "der", "from"]}
REFUSED = "und"  # reviews with this word make the failing model raise


def lexicon() -> LexiconExtraction:
    return LexiconExtraction(domains(), WORDS)


def failing_model(settings):
    """The lexicon model, except that it cannot fill in reviews with a certain word."""
    complete = lexicon_model(WORDS)(settings)

    def checked(prompts):
        for prompt in prompts:
            head, _, feedback = prompt.partition(FEEDBACK_MARK)
            if FILL_TASK in head and f" {REFUSED} " in feedback:
                raise ValueError(f"cannot read '{REFUSED}'")
        return complete(prompts)

    return checked


def wordy_model(settings):
    """The lexicon model, except that it fills in text where an object is asked for, in reviews with a certain word."""
    complete = lexicon_model(WORDS)(settings)

    def filled(prompt: str, reply: str) -> str:
        head, _, feedback = prompt.partition(FEEDBACK_MARK)
        if FILL_TASK in head and f" {REFUSED} " in feedback:
            return json.dumps({category: "just text" for category in json.loads(reply)})
        return reply

    return lambda prompts: pd.Series([filled(p, r) for p, r in zip(prompts, complete(prompts))])


def search_index(spark: SparkSession, sf: str, tokenizer: str = "plain") -> SearchIndex:
    return once(
        spark, sf, f"index-{tokenizer}", lambda: scratch_index(reviews(spark, sf), tokenizer=tokenizer)
    )


def sql_tokens(text: str, min_chars: int = 1) -> str:
    words = rf"regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+')"
    return f"list_filter({words}, lambda w: length(w) >= {min_chars})"


#: Frequent words of the four languages; a document's vector is 1 and how often it has each, which SQL can state too.
COUNTED = ("the", "that", "of", "and", "la", "de", "que", "der", "und", "el")


def counted_vector(tokens: Column) -> Column:
    listed = F.array(*[F.lit(w) for w in COUNTED])
    counts = F.transform(listed, lambda w: F.size(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t == w)).cast("double"))
    return F.concat(F.array(F.lit(1.0)), counts)


def counted_embedding(sentence: str) -> list[float]:
    words = sentence.lower().split()
    return [1.0, *(float(words.count(w)) for w in COUNTED)]


def sql_counted_vector(toks: str) -> str:
    counts = f"list_transform({sql_list(COUNTED)}, lambda x: len(list_filter(coalesce({toks}, []), lambda t: t = x))::DOUBLE)"
    return f"list_concat([1.0::DOUBLE], {counts})"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_matched(words: str) -> str:
    return (
        f"CASE WHEN len({words}) > 0 THEN 'matched ' || array_to_string({words}, ', ') "
        "ELSE 'matched no listed word' END"
    )


# review_id, rating, review, p and d (listed words found per domain), mood, error
MATCHED = f"""r AS ({REVIEWS}),
  t AS (SELECT *, {sql_tokens('review')} AS toks FROM r),
  m AS (SELECT *, list_filter({sql_list(WORDS['product'])}, lambda k: list_contains(toks, k)) AS p,
          list_filter({sql_list(WORDS['Delivery'])}, lambda k: list_contains(toks, k)) AS d,
          CASE WHEN rating >= 4 THEN 'positive' WHEN rating >= 3 THEN 'neutral' ELSE 'negative' END AS mood,
          contains(review, ' {REFUSED} ') AS refused FROM t)"""
# chosen categories as text, in the order of the domains
SELECTION = (
    "array_to_string(list_filter([CASE WHEN len(p) > 0 THEN 'productdetails' END, "
    "CASE WHEN len(d) > 0 THEN 'deliverydetails' END], lambda c: c IS NOT NULL), ',')"
)
EVERY_WORD = "list_concat(p, d)"
