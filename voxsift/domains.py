"""Topic domains: what to look for in a review and which fields to extract for it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

# Default field descriptions of a domain, and the names the documents are built from.
SENTIMENT_TEXT = "<positive/negative/mixed/neutral>"
KEYWORDS_TEXT = "[<keyword1>,<keyword2>,...] should be a valid list of strings"
AI_RATING_TEXT = "generate a rating between <1-5/null> based on feedback with regards to {topic}"
RATIONALE_TEXT = "explain your thoughts step by step on why you arrived at the conclusion with regards to {topic}"
KEY_SUFFIX = "details"
CATCH_ALL_KEY = "catchalldetails"
SERIALIZED = "serialized"
# The catch-all domain's fields with their descriptions, in order.
CATCH_ALL_FIELDS = {
    "details": "details of the feedback",
    "sentiment": "sentiment of the feedback <positive/negative/neutral/mixed>",
    "keywords": 'keywords in the feedback ["keyword1", "keyword2", "keyword3", ...]. '
    "This should be a valid list of strings.",
    "ai_rating": "rating the feedback 1-5 1 being the worst 5 being the best. this should be a string",
    "rationale": "rationale for the rating and sentiment",
}

# The plain fields of a domain, in the order they appear in a flat row.
BASE_FIELDS = ("topic", "when", "details", "sentiment", "keywords", "ai_rating", "rationale")

DOMAIN_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in BASE_FIELDS]
    + [
        T.StructField(
            "extras",
            T.ArrayType(
                T.StructType(
                    [T.StructField("item_name", T.StringType()), T.StructField("item_description", T.StringType())]
                )
            ),
        )
    ]
)

# A configuration is read by people and sent to every task; more rows than this is a mistake.
MAX_DOMAINS = 10_000


@dataclass(frozen=True)
class Extra:
    """One more field to extract. ``{topic}`` in the description stands for the topic."""

    item_name: str
    item_description: str


@dataclass
class Domain:
    """A topic, the condition under which a review belongs to it, and what to extract.

    ``ai_rating`` and ``rationale`` are built from the topic unless given.
    """

    topic: str
    when: str
    details: str
    sentiment: str = SENTIMENT_TEXT
    keywords: str = KEYWORDS_TEXT
    ai_rating: str | None = None
    rationale: str | None = None
    extras: list[Extra] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.topic:
            raise ValueError("a domain needs a topic")
        self.ai_rating = self.ai_rating or AI_RATING_TEXT.replace("{topic}", self.topic)
        self.rationale = self.rationale or RATIONALE_TEXT.replace("{topic}", self.topic)
        self.extras = [e if isinstance(e, Extra) else Extra(**e) for e in self.extras]

    def with_additional_info(self, item_name: str, item_description: str) -> Domain:
        self.extras.append(Extra(item_name, item_description))
        return self

    @property
    def key(self) -> str:
        """The domain's name in a document: lower case, whatever the topic's case."""
        return self.topic.lower() + KEY_SUFFIX

    @property
    def condition(self) -> str:
        return self.when.replace("{topic}", self.key)

    def fields(self) -> dict[str, str]:
        """Field to description, extras included; an extra named like a base field replaces it."""
        described = {name: getattr(self, name) for name in BASE_FIELDS}
        described.update({e.item_name: e.item_description.replace("{topic}", self.topic) for e in self.extras})
        return described

    def extracted_fields(self) -> dict[str, str]:
        """The fields a model fills in."""
        return {k: v for k, v in self.fields().items() if k not in ("topic", "when")}

    def to_kwargs(self) -> dict[str, str]:
        """The flat row, with ``raw``, its own JSON text, as last column."""
        flat = self.fields()
        return {**flat, "raw": json.dumps(flat)}

    def as_dict(self) -> dict:
        plain = {name: getattr(self, name) for name in BASE_FIELDS}
        plain["extras"] = [{"item_name": e.item_name, "item_description": e.item_description} for e in self.extras]
        return plain

    def to_row(self) -> dict:
        return {"topic": self.topic, SERIALIZED: self.as_dict()}


class DomainSet:
    """The domains of one configuration; keys are unique."""

    def __init__(self, topics: Iterable[Domain] = ()):
        self.topics: list[Domain] = []
        for topic in topics:
            self.with_topic(topic)

    def with_topic(self, topic: Domain) -> DomainSet:
        if topic.key in {*self.keys(), CATCH_ALL_KEY}:
            raise ValueError(f"key {topic.key} is taken")
        if len(self.topics) >= MAX_DOMAINS:
            raise ValueError(f"more than {MAX_DOMAINS} domains")
        self.topics.append(topic)
        return self

    def keys(self) -> list[str]:
        return [t.key for t in self.topics]

    def conditions(self) -> dict[str, str]:
        return {t.key: t.condition for t in self.topics}

    def __iter__(self) -> Iterator[Domain]:
        return iter(self.topics)

    def __len__(self) -> int:
        return len(self.topics)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([t.as_dict() for t in self.topics], DOMAIN_SCHEMA)

    @classmethod
    def from_frame(cls, frame: DataFrame) -> DomainSet:
        """Domains from rows of ``DOMAIN_SCHEMA``, ordered by topic. Refuses an oversized table."""
        rows = frame.orderBy("topic").limit(MAX_DOMAINS + 1).collect()
        return cls(
            Domain(**{**row.asDict(), "extras": [Extra(*e) for e in row["extras"] or []]}) for row in rows
        )
