"""Folders that are replaced as a whole: write a new version, then point to it.

Readers keep the version they opened; a failed write leaves the pointer where it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

_POINTER = "published"


def new_version(root: str) -> str:
    return f"version={uuid.uuid4().hex[:12]}"


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Make a completely written version the current one."""
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    row.write.mode("append").parquet(f"{root}/{_POINTER}")


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version, None when nothing was published."""
    if not path_exists(spark, f"{root}/{_POINTER}"):
        return None
    pointers = spark.read.schema("version string, published_at timestamp").parquet(f"{root}/{_POINTER}")
    latest = pointers.agg(F.max_by("version", "published_at").alias("version")).first()
    return f"{root}/{latest['version']}" if latest["version"] else None


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def drop_old_versions(spark: SparkSession, root: str) -> list[str]:
    """Maintenance, run when no reader holds an old version: delete all versions but the current."""
    keep = current(spark, root)
    hadoop_root = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = hadoop_root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for status in files.listStatus(hadoop_root):
        name = status.getPath().getName()
        if name.startswith("version=") and keep is not None and f"{root}/{name}" != keep:
            files.delete(status.getPath(), True)
            dropped.append(name)
    return dropped
