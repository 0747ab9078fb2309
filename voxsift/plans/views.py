"""Relational views over the analysis documents: one per domain, the catch-all, and the failures."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxsift.domains import CATCH_ALL_FIELDS, CATCH_ALL_KEY, Domain, DomainSet
from voxsift.functions.documents import BREAKDOWN, RESULT_COLUMN, fields_type, quoted

# Names and texts a reader of the views relies on.
VIEW_PREFIX = "analysis_"
CATCH_ALL_VIEW = "catchall"
ERROR_VIEW = "errors"
KEY_COMMENT = "the primary key of the reviews"


@dataclass(frozen=True)
class ViewSource:
    """The analysed table and how its document column is laid out."""

    table: str
    key: str = "review_id"
    column: str = RESULT_COLUMN
    top_key: str = BREAKDOWN


@dataclass(frozen=True)
class ViewDefinition:
    """A view's name, its columns with their comments, and its SELECT text."""

    name: str
    comments: Mapping[str, str | None]
    select: str

    def statement(self, schema: str | None = None, temporary: bool = False) -> str:
        kind = "TEMPORARY VIEW" if temporary else "VIEW"
        name = quoted(self.name) if temporary or not schema else f"{schema}.{quoted(self.name)}"
        columns = ", ".join(quoted(c) + (f" COMMENT '{escaped(t)}'" if t else "") for c, t in self.comments.items())
        return f"CREATE OR REPLACE {kind} {name} ({columns}) AS {self.select}"


def escaped(comment: str) -> str:
    return comment.replace("\\", "\\\\").replace("'", "\\'")


def _category_select(source: ViewSource, category: str, fields: Mapping[str, str]) -> str:
    """Rows whose document holds ``category``, one column per field.

    The document is parsed once per row: exploding the one category found (none when it is absent)
    keeps the parse out of both the row filter and the single fields.
    """
    document = f"STRUCT<{quoted(source.top_key)}: STRUCT<{quoted(category)}: {fields_type(fields)}>>"
    found = f"from_json({quoted(source.column)}, '{escaped(document)}').{quoted(source.top_key)}.{quoted(category)}"
    columns = [f"t.{quoted(source.key)} AS {quoted(source.key)}"]
    for f in fields:
        value = f"c.found.{quoted(f)}"
        columns.append(f"from_json({value}, 'array<string>') AS {f}" if f == "keywords" else f"{value} AS {quoted(f)}")
    return (
        f"SELECT {', '.join(columns)} FROM {source.table} t "
        f"LATERAL VIEW explode(array_compact(array({found}))) c AS found"
    )


def domain_view(source: ViewSource, domain: Domain, prefix: str = VIEW_PREFIX) -> ViewDefinition:
    fields = domain.extracted_fields()
    select = _category_select(source, domain.key, fields)
    return ViewDefinition(_prefixed(prefix, domain.topic), {source.key: KEY_COMMENT, **fields}, select)


def catch_all_view(
    source: ViewSource, prefix: str = VIEW_PREFIX, fields: Mapping[str, str] = CATCH_ALL_FIELDS
) -> ViewDefinition:
    select = _category_select(source, CATCH_ALL_KEY, fields)
    return ViewDefinition(_prefixed(prefix, CATCH_ALL_VIEW), {source.key: KEY_COMMENT, **fields}, select)


def error_view(source: ViewSource, prefix: str = VIEW_PREFIX) -> ViewDefinition:
    found = f"get_json_object({quoted(source.column)}, '$.{source.top_key}.error')"
    select = (
        f"SELECT t.{quoted(source.key)} AS {quoted(source.key)}, c.found AS error_details FROM {source.table} t "
        f"LATERAL VIEW explode(array_compact(array({found}))) c AS found"
    )
    comments = {source.key: KEY_COMMENT, "error_details": "why the row could not be analysed"}
    return ViewDefinition(_prefixed(prefix, ERROR_VIEW), comments, select)


def _prefixed(prefix: str, name: str) -> str:
    return (prefix if prefix.endswith("_") or not prefix else prefix + "_") + name


def analysis_views(
    source: ViewSource,
    domains: DomainSet,
    prefix: str = VIEW_PREFIX,
    catch_all: Callable[..., ViewDefinition] = catch_all_view,
    errors: Callable[..., ViewDefinition] = error_view,
    catch_all_fields: Mapping[str, str] = CATCH_ALL_FIELDS,
) -> list[ViewDefinition]:
    """All views of a table. ``catch_all`` and ``errors`` replace the last two definitions."""
    return [
        *[domain_view(source, d, prefix) for d in domains],
        catch_all(source, prefix, catch_all_fields),
        errors(source, prefix),
    ]


def build_analysis_views(
    spark: SparkSession, source: ViewSource, domains: DomainSet, schema: str | None = None, temporary: bool = False,
    **options,
) -> list[str]:
    """Create or replace all views and return their names."""
    views = analysis_views(source, domains, **options)
    for view in views:
        spark.sql(view.statement(schema, temporary))
    return [v.name for v in views]


def read_view(analysed: DataFrame, define: Callable[..., ViewDefinition], *args, key: str = "review_id",
              column: str = RESULT_COLUMN) -> DataFrame:
    """The rows of a view over a DataFrame, without a catalog entry."""
    view = define(ViewSource("{analysed}", key, column), *args)
    return analysed.sparkSession.sql(view.select, analysed=analysed)


def domain_summary(analysed: DataFrame, domains: DomainSet, key: str = "review_id",
                   column: str = RESULT_COLUMN) -> DataFrame:
    """Rows and mean ai_rating per domain and sentiment, in one pass over the documents.

    All domains are parsed together and unpivoted, instead of one scan per domain view.
    """
    common = fields_type(["sentiment", "ai_rating"])
    keys = [*domains.keys(), CATCH_ALL_KEY]
    schema = f"STRUCT<{BREAKDOWN}: STRUCT<{', '.join(f'{quoted(k)}: {common}' for k in keys)}>>"
    parsed = analysed.select(F.from_json(column, schema)[BREAKDOWN].alias("_b"))
    found = F.array_compact(
        F.array(
            *[
                F.when(F.col("_b")[k].isNotNull(), F.struct(F.lit(k).alias("domain"), F.col("_b")[k].alias("found")))
                for k in keys
            ]
        )
    )
    return (
        parsed.select(F.explode(found).alias("d"))
        .groupBy("d.domain", F.col("d.found.sentiment").alias("sentiment"))
        .agg(
            F.count(F.lit(1)).alias("reviews"),
            F.round(F.avg(F.col("d.found.ai_rating").try_cast("double")), 6).alias("mean_ai_rating"),
        )
    )
