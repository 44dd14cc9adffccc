"""Canonical tables registered in the session catalog (metastore tables or views).

``write_bucketed_events`` lays the event log out for the engine's access
pattern: partitioned by ``date`` (the date band prunes directories) and
bucketed + sorted by ``distinct_id``.  Every per-user stage of the funnel and
retention jobs (anchor aggregation, distinct user-days, the joins with the
cohort and the anchors table) is keyed by ``distinct_id``, so with a bucketed
log Spark reads the buckets in place instead of shuffling the largest table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.sources.base import EventSource

DEFAULT_TABLES = {"players": "players", "events": "events", "source_names": "source_names",
                  "countries": "countries", "exclusions": "exclusions"}


class CatalogSource(EventSource):
    def __init__(self, spark: SparkSession, tables: dict[str, str] | None = None,
                 database: str | None = None):
        self.spark = spark
        names = dict(DEFAULT_TABLES, **(tables or {}))
        self.tables = {k: (f"{database}.{v}" if database and "." not in v else v)
                       for k, v in names.items()}

    def _t(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def players(self) -> DataFrame:
        return self._t("players")

    def events(self, start: date | None = None, end: date | None = None,
               names: list[str] | None = None) -> DataFrame:
        ev = self._t("events")
        if start is not None:
            ev = ev.filter(F.col("date") >= F.lit(start))
        if end is not None:
            ev = ev.filter(F.col("date") <= F.lit(end))
        if names is not None:
            ev = ev.filter(F.col("mp_event_name").isin(list(names)))
        return ev.select("distinct_id", "mp_event_name", "res_timestamp", "date",
                         F.col("chapter").try_cast("int").alias("chapter"),
                         F.col("dialog_id").cast("string").alias("dialog_id"))

    def source_names(self) -> DataFrame:
        return self._t("source_names")

    def countries(self) -> DataFrame:
        return self._t("countries")

    def exclusions(self) -> DataFrame:
        return self._t("exclusions")


def write_bucketed_events(events: DataFrame, table: str, buckets: int) -> None:
    """Save canonical events partitioned by date, bucketed and sorted by user."""
    (events.write.mode("overwrite").partitionBy("date")
     .bucketBy(buckets, "distinct_id").sortBy("distinct_id").saveAsTable(table))
