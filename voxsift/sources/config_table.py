"""The domain configuration as a table of (topic, raw), raw being the domain as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxsift.domains import DOMAIN_SCHEMA, SERIALIZED, DomainSet
from voxsift.functions.domain_columns import config_rows
from voxsift.sources.tables import DEFAULT_FORMAT, read_table, write_table


def save_domains(spark: SparkSession, domains: DomainSet, ref: str, fmt: str = DEFAULT_FORMAT) -> DomainSet:
    """Replace the stored configuration. Texts are data here, so quotes and backslashes need no care."""
    write_table(config_rows(domains.to_frame(spark)).coalesce(1), ref, fmt)
    return domains


def parse_config(rows: DataFrame) -> DataFrame:
    """Stored rows back as one column per field."""
    schema = f"STRUCT<{SERIALIZED}: {DOMAIN_SCHEMA.simpleString()}>"
    return rows.select(F.from_json("raw", schema)[SERIALIZED].alias("d")).select("d.*")


def load_domains(spark: SparkSession, ref: str, fmt: str = DEFAULT_FORMAT) -> DomainSet:
    return DomainSet.from_frame(parse_config(read_table(spark, ref, fmt)))
