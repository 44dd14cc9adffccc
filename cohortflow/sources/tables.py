"""Canonical tables stored as Parquet (the production layout).

``<base>/events`` is expected to be partitioned by ``date`` so the date band
prunes whole directories; the other tables are plain Parquet folders.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.sources.base import EventSource


class TableSource(EventSource):
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    def players(self) -> DataFrame:
        return self._read("players")

    def events(self, start: date, end: date, names: list[str] | None = None) -> DataFrame:
        ev = self._read("events").filter(F.col("date").between(F.lit(start), F.lit(end)))
        if names is not None:
            ev = ev.filter(F.col("mp_event_name").isin(list(names)))
        return ev.select("distinct_id", "mp_event_name", "res_timestamp", "date",
                         F.col("chapter").try_cast("int").alias("chapter"),
                         F.col("dialog_id").cast("string").alias("dialog_id"))

    def source_names(self) -> DataFrame:
        return self._read("source_names")

    def countries(self) -> DataFrame:
        return self._read("countries")

    def exclusions(self) -> DataFrame:
        return self._read("exclusions")
