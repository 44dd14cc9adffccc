"""Publish / load the published cubes (sink and source of the analytics layer).

A cube is a snapshot table partitioned by ``install_date``
(``sources/snapshots.py``): a publish of the whole table, of a range or of
single install dates becomes visible in one step, dates outside stay, and
readers keep to the version that they resolved.  Reads prune partitions on
install_date.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from cohortflow.session import checkpoint_dir
from cohortflow.sources.snapshots import SnapshotTable


def publish(df: DataFrame, path: str, partition_col: str = "install_date",
            replace_range: tuple[date, date] | None = None, files_per_date: int = 1,
            replace_dates: list[date] | None = None, note: str | None = None) -> str:
    """Replace the table at ``path``, or the dates of ``replace_range``, or
    exactly ``replace_dates`` in it.  Replaced dates without rows are gone
    afterwards."""
    SnapshotTable(df.sparkSession, path, partition_col).publish(
        df, replace_range, replace_dates, files_per_date, note)
    return path


def load(spark: SparkSession, path: str, schema=None, version: int | None = None) -> DataFrame:
    """Read a published table: its newest version, or the given one."""
    return SnapshotTable(spark, path).load(version, schema)


def expire(spark: SparkSession, path: str, keep: int = 2, grace_seconds: float = 24 * 3600) -> list[str]:
    """Remove versions older than the newest ``keep`` and what only they hold."""
    return SnapshotTable(spark, path).expire(keep, grace_seconds)


def published_schema(df: DataFrame, partition_col: str = "install_date"):
    """Schema of ``df`` as read back after ``publish`` (partition column last)."""
    from pyspark.sql.types import StructType
    fields = [f for f in df.schema.fields if f.name != partition_col]
    part = [f for f in df.schema.fields if f.name == partition_col]
    return StructType(fields + part)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/cohortflow/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: cuts the lineage (a lost executor re-reads files instead of
    recomputing the upstream scan), lets later reads prune columns, and keeps
    no physical partitioning, so skewed keys can still be split by AQE."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
