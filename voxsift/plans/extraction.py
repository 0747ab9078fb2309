"""Two-pass extraction: which domains is a review about, then the fields of those domains.

Everything but the model call is a column expression: prompts, parsing, the choice of valid
categories, the per-row field list and the result document. ``ModelExtraction`` asks an external
model; ``LexiconExtraction`` looks for listed words and needs none, so that jobs run without a
network. It is a stand-in with reproducible results, not a model of comparable quality.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxsift.domains import CATCH_ALL_FIELDS, CATCH_ALL_KEY, DomainSet
from voxsift.functions import documents as doc
from voxsift.functions.domain_columns import split_categories, valid_categories
from voxsift.functions.text import tokens
from voxsift.operators.joins import hot_keys, join_salted
from voxsift.plans.model import MakeComplete, ModelSettings, model_call
from voxsift.staging import spread_input, stage

FEEDBACK_MARK = "\nfeedback: "
IDENTIFY_TASK = "task: name the categories of one customer review"
FILL_TASK = "task: fill in the fields of the categories of one customer review"
ANALYST = (
    "You read customer reviews from every channel and turn each into structured facts. "
    "Answer with one JSON object and nothing else."
)
CATCH_ALL_WHEN = "the parts of the review that belong to no other category"


class Extraction:
    """Common part: adds the document column, from a breakdown, a selection and its rationale."""

    tasks: int | None = None  # the tasks of an analysis, where they bound the calls in flight

    def __init__(self, domains: DomainSet, review: str = "review", rating: str = "rating",
                 result: str = doc.RESULT_COLUMN, catch_all: Mapping[str, str] = CATCH_ALL_FIELDS):
        self.domains = domains
        self.review = review
        self.rating = rating
        self.result = result
        self.catch_all = dict(catch_all)

    @property
    def feedback(self) -> Column:
        return F.coalesce(F.col(self.review).cast("string"), F.lit(""))

    @property
    def rating_text(self) -> Column:
        return F.coalesce(F.col(self.rating).cast("string"), F.lit("null"))

    def breakdown_type(self) -> str:
        return doc.breakdown_type(self.domains, self.catch_all)

    def analyse(self, reviews: DataFrame) -> DataFrame:
        """``reviews`` with the result column set on every row, failures included."""
        raise NotImplementedError


def identify_prompt(feedback: Column, keys: Sequence[str], conditions: Mapping[str, str]) -> Column:
    head = "\n".join(
        [
            ANALYST,
            IDENTIFY_TASK,
            f"categories: {', '.join(keys)}",
            f"when to use each: {json.dumps(dict(conditions), ensure_ascii=False)}",
            f"use {CATCH_ALL_KEY} if none of them applies",
            'reply: {"categories": [names], "rationale": the reasons, step by step}',
        ]
    )
    return F.concat(F.lit(head + FEEDBACK_MARK), feedback)


def field_list(categories: Column, domains: DomainSet, catch_all: Mapping[str, str] = CATCH_ALL_FIELDS) -> Column:
    """The reply schema of a row: the fields of its own categories only, all optional."""

    def described(fields: Mapping[str, str], when: str) -> str:
        return json.dumps({"when": when, "fields": dict(fields)}, ensure_ascii=False)

    texts = {d.key: described(d.extracted_fields(), d.condition) for d in domains}
    texts[CATCH_ALL_KEY] = described(catch_all, CATCH_ALL_WHEN)
    lookup = F.create_map(*[F.lit(part) for pair in texts.items() for part in pair])
    entries = F.transform(categories, lambda c: F.concat(F.lit('"'), c, F.lit('": '), F.element_at(lookup, c)))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def fill_prompt(feedback: Column, rating: Column, schema: Column) -> Column:
    head = f"{ANALYST}\n{FILL_TASK}\nreply: an object per category with these fields, each optional\nschema: "
    note = "\nthe rating, 1 horrible to 5 great, tells how the review is meant\nrating: "
    return F.concat(F.lit(head), schema, F.lit(note), rating, F.lit(FEEDBACK_MARK), feedback)


class ModelExtraction(Extraction):
    """Extraction by an external model: one identify call and one fill call per row.

    ``identify`` and ``fill`` replace the prompt builders. ``threads`` is the number of calls a task
    has open at once and ``tasks`` the number of tasks, so tasks x threads bounds the calls in flight.
    ``once_per_text`` sends equal (review, rating) pairs only once.
    """

    def __init__(self, domains: DomainSet, make_complete: MakeComplete, settings: ModelSettings | None = None,
                 threads: int = 1, tasks: int | None = None, once_per_text: bool = False,
                 identify=identify_prompt, fill=fill_prompt, **columns):
        super().__init__(domains, **columns)
        self.make_complete = make_complete
        self.settings = settings or ModelSettings()
        self.threads = threads
        self.tasks = tasks
        self.once_per_text = once_per_text
        self.identify = identify
        self.fill = fill

    def _ask(self, prompt: Column) -> Column:
        return model_call(prompt, self.make_complete, self.settings, self.threads)

    def analyse(self, reviews: DataFrame) -> DataFrame:
        return self._once_per_text(reviews) if self.once_per_text else self._analyse(reviews)

    def _once_per_text(self, reviews: DataFrame) -> DataFrame:
        """Analyse the distinct (review, rating) pairs and give each row its pair's document."""
        rows = reviews.drop(self.result)
        pair = {"_review": F.col(self.review), "_rating": F.col(self.rating)}
        # NULL equals NULL here: a flag beside a value that is never NULL
        keyed = rows
        for name, value in pair.items():
            keyed = keyed.withColumn(name, F.coalesce(value.cast("string"), F.lit(""))).withColumn(f"{name}_null", value.isNull())
        on = [n for name in pair for n in (name, f"{name}_null")]
        counted = keyed.groupBy(self.review, self.rating, *on).agg(F.count(F.lit(1)).alias("_copies"))
        pairs = stage(counted, "distinct-reviews")
        answers = self._analyse(pairs.drop("_copies")).select(*on, self.result)
        # a pair with very many copies is divided over several tasks by the rows' other columns
        joined = join_salted(keyed, answers, on, F.xxhash64(*rows.columns), hot=hot_keys(pairs, on, "_copies"))
        return joined.select(*rows.columns, self.result)

    def _analyse(self, reviews: DataFrame) -> DataFrame:
        rows = reviews.drop(self.result)
        kept = rows.columns
        rows = rows.repartition(self.tasks) if self.tasks else spread_input(rows)
        keys = self.domains.keys()
        named = rows.withColumn("_named", self._ask(self.identify(self.feedback, keys, self.domains.conditions())))
        listed = doc.json_path("_named.reply", "categories")
        chosen = (
            named.withColumn("_listed", F.coalesce(doc.json_strings(listed), split_categories(listed)))
            .withColumn("_why", doc.json_path("_named.reply", "rationale"))
            .withColumn("_valid", valid_categories(F.col("_listed"), keys))
        )
        # a row whose first call failed is not sent again: its prompt is NULL
        schema = field_list(F.col("_valid"), self.domains, self.catch_all)
        second = F.when(F.col("_named.error").isNull(), self.fill(self.feedback, self.rating_text, schema))
        filled = chosen.withColumn("_filled", self._ask(second))
        texts = doc.breakdown_type(self.domains, self.catch_all, keywords="STRING")
        parsed = filled.withColumn(
            "_reply", F.from_json("_filled.reply", self.breakdown_type(), {"mode": "PERMISSIVE"})
        ).withColumn("_sent", F.from_json("_filled.reply", texts, {"mode": "PERMISSIVE"}))
        parsed = parsed.withColumn("_problem", self._problem())
        return parsed.select(
            *kept,
            doc.encode(self._breakdown(), F.col("_listed"), F.col("_why"), keys).alias(self.result),
        )

    def _misshapen(self) -> Column:
        """Names of what a reply holds in another shape than asked for: chosen categories, and keywords of these."""
        found = []
        for category in [*self.domains.keys(), CATCH_ALL_KEY]:
            chosen = F.array_contains("_valid", category)
            found.append(F.when(chosen & F.col("_reply")[category].isNull(), F.lit(category)))
        for d in self.domains:
            if "keywords" in d.extracted_fields():  # the one field that is no text, which takes any value
                lost = F.col("_sent")[d.key]["keywords"].isNotNull() & F.col("_reply")[d.key]["keywords"].isNull()
                found.append(F.when(F.array_contains("_valid", d.key) & lost, F.lit(f"{d.key}.keywords")))
        return F.array_compact(F.array(*found))

    def _problem(self) -> Column:
        """Why a row has no breakdown: a failed call, or a reply that lacks a chosen category or has a wrong shape."""
        missing = F.filter(
            F.col("_valid"), lambda c: ~F.array_contains(F.coalesce(F.json_object_keys("_filled.reply"), F.array()), c)
        )
        misshapen = self._misshapen()
        return F.coalesce(
            F.col("_named.error"),
            F.col("_filled.error"),
            F.when(
                F.size(missing) > 0, F.concat(F.lit("reply lacks "), F.array_join(missing, ", "))
            ),
            F.when(
                F.size(misshapen) > 0, F.concat(F.lit("reply has a wrong shape in "), F.array_join(misshapen, ", "))
            ),
        )

    def _breakdown(self) -> Column:
        ok = F.col("_problem").isNull()
        categories = [*self.domains.keys(), CATCH_ALL_KEY]
        filled = [
            F.when(ok & F.array_contains("_valid", c), F.col("_reply")[c]).alias(c) for c in categories
        ]
        return F.struct(F.col("_problem").alias("error"), *filled)


class LexiconExtraction(Extraction):
    """Extraction by listed words: a domain is chosen when one of its words is a token of the review.

    Sentiment and ai_rating follow the review's rating: 4 and more positive, 3 neutral, less negative.
    """

    def __init__(self, domains: DomainSet, words: Mapping[str, Sequence[str]], **columns):
        super().__init__(domains, **columns)
        self.words = {d.key: [w.lower() for w in words[d.topic]] for d in domains}

    def analyse(self, reviews: DataFrame) -> DataFrame:
        rows = spread_input(reviews.drop(self.result))
        keys = self.domains.keys()
        found = rows.withColumn("_tokens", F.array_distinct(tokens(self.feedback)))
        for key, words in self.words.items():
            listed = F.array(*[F.lit(w) for w in words]).cast("array<string>")
            found = found.withColumn(f"_{key}", F.array_intersect(listed, F.col("_tokens")))
        selection = F.array_compact(F.array(*[F.when(F.size(f"_{k}") > 0, F.lit(k)) for k in keys]))
        every = F.array_distinct(F.flatten(F.array(*[F.col(f"_{k}") for k in keys])))
        chosen = found.withColumn("_selection", selection).withColumn("_why", matched_text(every))
        valid = valid_categories(F.col("_selection"), keys)
        parts = [self._domain(d).alias(d.key) for d in self.domains]
        parts.append(F.when(F.array_contains(valid, CATCH_ALL_KEY), self._catch_all()).alias(CATCH_ALL_KEY))
        document = doc.encode(F.struct(*parts), F.col("_selection"), F.col("_why"), keys)
        return chosen.select(*rows.columns, document.alias(self.result))

    def _values(self, words: Column, keywords: Column) -> dict[str, Column]:
        stars = F.col(self.rating).cast("double")
        mood = F.when(stars >= 4, "positive").when(stars >= 3, "neutral").when(stars < 3, "negative")
        return {
            "details": F.concat(F.lit("mentions "), F.array_join(words, ", ")),
            "sentiment": mood,
            "keywords": keywords,
            "ai_rating": F.col(self.rating).cast("string"),
            "rationale": matched_text(words),
        }

    def _domain(self, domain) -> Column:
        words = F.col(f"_{domain.key}")
        values = self._values(words, words)
        known = [v.alias(f) for f, v in values.items() if f in domain.extracted_fields()]
        return F.when(F.size(words) > 0, F.struct(*known))

    def _catch_all(self) -> Column:
        values = self._values(F.array().cast("array<string>"), F.lit("[]"))
        values["details"] = F.lit("mentions no listed word")
        return F.struct(*[v.alias(f) for f, v in values.items() if f in self.catch_all])


def matched_text(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.concat(F.lit("matched "), F.array_join(words, ", "))).otherwise(
        F.lit("matched no listed word")
    )


def lexicon_model(words: Mapping[str, Sequence[str]]) -> MakeComplete:
    """The lexicon rules behind the model contract, answering prompts; for tests and dry runs."""
    lexicon = {topic.lower() + "details": [w.lower() for w in listed] for topic, listed in words.items()}

    def answer(prompt: str) -> str:
        head, _, feedback = prompt.partition(FEEDBACK_MARK)
        said = feedback.lower()
        hits = {key: [w for w in listed if _is_word(w, said)] for key, listed in lexicon.items()}
        if IDENTIFY_TASK in head:
            every = list(dict.fromkeys(w for found in hits.values() for w in found))
            return json.dumps({"categories": [k for k, found in hits.items() if found], "rationale": _matched(every)})
        rating = head.rsplit("rating: ", 1)[1]
        stars = float(rating)
        mood = "positive" if stars >= 4 else "neutral" if stars >= 3 else "negative"
        common = {"sentiment": mood, "ai_rating": rating}
        filled = {
            key: {"details": "mentions " + ", ".join(found), "keywords": found, "rationale": _matched(found), **common}
            for key, found in hits.items()
            if found
        }
        if not filled:
            filled[CATCH_ALL_KEY] = {"details": "mentions no listed word", "keywords": "[]",
                                     "rationale": _matched([]), **common}
        return json.dumps(filled, ensure_ascii=False)

    return lambda settings: lambda prompts: prompts.map(answer)


def _is_word(word: str, text: str) -> bool:
    """Whether ``word`` is one of the runs of letters and digits of ``text``, which is not cut into words for it."""
    if not word.isalnum():
        return word in re.split(r"[\W_]+", text)
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not (text[at - 1 : at].isalnum() or text[end : end + 1].isalnum()):
            return True
        at = text.find(word, at + 1)
    return False


def _matched(words: list[str]) -> str:
    return "matched " + ", ".join(words) if words else "matched no listed word"
