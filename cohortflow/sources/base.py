"""Source interface."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame


class EventSource:
    """A provider of the five canonical tables.

    ``events(start, end)`` must apply the date band *before* any projection so
    that the filter reaches the scan (partition pruning on a ``date``
    partitioned log, row-group pruning on a raw timestamp column).
    ``names`` optionally restricts event names, also pushed to the scan.
    """

    def players(self) -> DataFrame:
        raise NotImplementedError

    def events(self, start: date, end: date, names: list[str] | None = None) -> DataFrame:
        raise NotImplementedError

    def source_names(self) -> DataFrame:
        raise NotImplementedError

    def countries(self) -> DataFrame:
        raise NotImplementedError

    def exclusions(self) -> DataFrame:
        raise NotImplementedError
