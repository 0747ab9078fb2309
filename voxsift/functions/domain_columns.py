"""Domain configuration as columns, for frames of ``DOMAIN_SCHEMA`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxsift.domains import BASE_FIELDS, CATCH_ALL_KEY, KEY_SUFFIX, SERIALIZED


def category_key(topic: Column) -> Column:
    return F.concat(F.lower(topic), F.lit(KEY_SUFFIX))


def fill_topic(text: Column, value: Column) -> Column:
    return F.replace(text, F.lit("{topic}"), value)


def condition_map(domains: DataFrame) -> DataFrame:
    """One row: category key to the condition with ``{topic}`` filled by the key."""
    key = category_key(F.col("topic"))
    entries = F.collect_list(F.struct(key.alias("key"), fill_topic(F.col("when"), key).alias("value")))
    return domains.agg(F.map_from_entries(F.array_sort(entries)).alias("conditions"))


def field_map() -> Column:
    """Field to description; the last extra of a name wins, also over a base field."""
    extras = F.coalesce(F.col("extras"), F.array().cast("array<struct<item_name:string,item_description:string>>"))
    last_of_name = F.filter(
        extras,
        lambda e, i: ~F.exists(
            F.slice(extras, i + 2, F.size(extras) + 1), lambda later: later["item_name"] == e["item_name"]
        ),
    )
    named = F.transform(
        last_of_name,
        lambda e: F.struct(e["item_name"].alias("key"), fill_topic(e["item_description"], F.col("topic")).alias("value")),
    )
    base = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in BASE_FIELDS])
    kept = F.filter(base, lambda b: ~F.exists(named, lambda n: n["key"] == b["key"]))
    return F.map_from_entries(F.concat(kept, named))


def flat_rows(domains: DataFrame) -> DataFrame:
    """topic, ``fields`` (field to description) and ``raw``, its JSON text."""
    return domains.select("topic", field_map().alias("fields")).withColumn("raw", F.to_json("fields"))


def config_rows(domains: DataFrame) -> DataFrame:
    """The two columns of the stored configuration: topic and the domain as JSON."""
    serialized = F.struct(*[F.col(f) for f in (*BASE_FIELDS, "extras")]).alias(SERIALIZED)
    return domains.select("topic", F.to_json(F.struct(F.col("topic"), serialized)).alias("raw"))


def split_categories(text: Column) -> Column:
    """A reply given as text, 'a, b', as a list."""
    return F.transform(F.split(text, ","), lambda name: F.trim(name))


def valid_categories(categories: Column, valid: Column | Sequence[str]) -> Column:
    """The named categories that exist, exact case, each once; the catch-all when none is left."""
    known = valid if isinstance(valid, Column) else F.array(*[F.lit(v) for v in valid]).cast("array<string>")
    known = F.array_append(known, F.lit(CATCH_ALL_KEY))
    kept = F.array_distinct(F.filter(categories, lambda name: F.array_contains(known, name)))
    fallback = F.array(F.lit(CATCH_ALL_KEY))
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, kept).otherwise(fallback)
