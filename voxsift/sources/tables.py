"""Reading and writing review tables, by catalog name or by path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voxsift.functions.documents import RESULT_COLUMN
from voxsift.operators.keys import with_surrogate_key

# parquet needs no extra jar; another installed format (delta, orc) is given by name
DEFAULT_FORMAT = "parquet"
REQUIRED_COLUMNS = ("review_id", "rating", "review")


def is_path(ref: str) -> bool:
    return "/" in ref


def read_table(spark: SparkSession, ref: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    return spark.read.format(fmt).load(ref) if is_path(ref) else spark.table(ref)


def write_table(df: DataFrame, ref: str, fmt: str = DEFAULT_FORMAT, mode: str = "overwrite") -> None:
    writer = df.write.format(fmt).mode(mode)
    writer.save(ref) if is_path(ref) else writer.saveAsTable(ref)


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def list_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {schema}" if schema else "SHOW TABLES")


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return df


def load_reviews(spark: SparkSession, path: str, order_by: Sequence[str], key: str = "review_id") -> DataFrame:
    """Rows of a parquet folder numbered 1..n by ``order_by``.

    Rows equal in ``order_by`` follow their place in the files, so the numbers are the same each time.
    """
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")
    )
    return with_surrogate_key(rows, key, order_by, tie_break=("_file", "_at"), drop=("_file", "_at"))


def create_reviews_table(spark: SparkSession, path: str, target: str, order_by: Sequence[str],
                         key: str = "review_id", fmt: str = DEFAULT_FORMAT) -> None:
    write_table(load_reviews(spark, path, order_by, key), target, fmt)


# --- tables from a declaration ------------------------------------------------------------------

_SCALARS: dict[type, T.DataType] = {
    str: T.StringType(),
    int: T.IntegerType(),
    float: T.DoubleType(),
    bool: T.BooleanType(),
}


@dataclass(frozen=True)
class SourceColumn:
    name: str
    data_type: type
    description: str = ""
    is_extractor_input: bool = False
    is_target_column: bool = True

    def as_field(self) -> T.StructField:
        if self.data_type not in _SCALARS:
            raise ValueError(f"{self.name}: {self.data_type} is none of str, int, float, bool")
        notes = {
            "comment": self.description,
            "is_extractor_input": self.is_extractor_input,
            "is_target_column": self.is_target_column,
        }
        return T.StructField(self.name, _SCALARS[self.data_type], True, notes)


@dataclass
class SourceTable:
    """A declared text source and the table its results go to."""

    schema: str
    table: str
    target_table: str
    target_column: str = RESULT_COLUMN
    columns: list[SourceColumn] = field(default_factory=list)
    fmt: str = DEFAULT_FORMAT

    def with_column(self, name: str, data_type: type, description: str = "", is_extractor_input: bool = False,
                    is_target_column: bool = True) -> SourceTable:
        self.columns.append(SourceColumn(name, data_type, description, is_extractor_input, is_target_column))
        return self

    def source_schema(self) -> T.StructType:
        return T.StructType([c.as_field() for c in self.columns])

    def target_schema(self) -> T.StructType:
        """The extractor's input columns and one text column for the result."""
        inputs = [c.as_field() for c in self.columns if c.is_extractor_input]
        if not inputs:
            raise ValueError("no column is marked as extractor input")
        return T.StructType([*inputs, T.StructField(self.target_column, T.StringType())])

    def create(self, spark: SparkSession) -> DataFrame:
        return self._create_empty(spark, self.table, self.source_schema())

    def create_target(self, spark: SparkSession) -> DataFrame:
        return self._create_empty(spark, self.target_table, self.target_schema())

    def _create_empty(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        return spark.catalog.createTable(f"{self.schema}.{name}", source=self.fmt, schema=schema)

    def conform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the declared columns and types."""
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.source_schema()])

    def target_rows(self, rows: DataFrame) -> DataFrame:
        """``rows`` as the target table takes them, without a result yet."""
        typed = with_empty_result(self.conform(rows), self.target_column)
        return typed.select(*self.target_schema().fieldNames())

    def select_target_columns(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[c.name for c in self.columns if c.is_target_column])


# --- rows with and without a result -------------------------------------------------------------


def with_empty_result(df: DataFrame, column: str = RESULT_COLUMN) -> DataFrame:
    return df.withColumn(column, F.lit(None).cast("string"))


def pending(df: DataFrame, column: str = RESULT_COLUMN) -> DataFrame:
    return df.where(F.col(column).isNull())


def processed(df: DataFrame, column: str = RESULT_COLUMN) -> DataFrame:
    return df.where(F.col(column).isNotNull())
