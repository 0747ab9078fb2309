"""The analysis document of a row: one JSON text per review."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxsift.domains import CATCH_ALL_FIELDS, CATCH_ALL_KEY, DomainSet

BREAKDOWN = "category_breakdown"
RESULT_COLUMN = "analysis"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fields_type(fields, keywords: str = "STRING") -> str:
    return "STRUCT<" + ", ".join(f"{quoted(f)}: {keywords if f == 'keywords' else 'STRING'}" for f in fields) + ">"


def breakdown_type(domains: DomainSet, catch_all=CATCH_ALL_FIELDS, keywords: str = "ARRAY<STRING>") -> str:
    """Type of a model's filled-in reply: one optional struct per category."""
    parts = [f"{quoted(d.key)}: {fields_type(d.extracted_fields(), keywords)}" for d in domains]
    parts.append(f"{quoted(CATCH_ALL_KEY)}: {fields_type(catch_all)}")
    return "STRUCT<" + ", ".join(parts) + ">"


def encode(breakdown: Column, selection: Column, rationale: Column, all_categories: list[str]) -> Column:
    """The four-key document. Fields without a value are left out."""
    every = F.array(*[F.lit(c) for c in all_categories]).cast("array<string>")
    return F.to_json(
        F.struct(
            breakdown.alias(BREAKDOWN),
            selection.alias("category_selection"),
            rationale.alias("category_selection_rationale"),
            every.alias("all_categories"),
        )
    )


def json_path(column: Column | str, *keys: str) -> Column:
    """Text at a path of a JSON string; NULL when absent or not JSON."""
    return F.get_json_object(column, "$" + "".join(f"['{k}']" for k in keys))


def json_strings(text: Column) -> Column:
    """A JSON list of strings as an array; NULL for anything else."""
    return F.from_json(text, "array<string>")


def error_of(column: str = RESULT_COLUMN, top_key: str = BREAKDOWN) -> Column:
    return json_path(column, top_key, "error")
