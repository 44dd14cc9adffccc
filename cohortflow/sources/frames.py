"""Canonical tables handed in as DataFrames (bring your own data)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.sources.base import EventSource


class FrameSource(EventSource):
    def __init__(self, players: DataFrame, events: DataFrame, source_names: DataFrame,
                 countries: DataFrame, exclusions: DataFrame):
        self._players, self._events = players, events
        self._source_names, self._countries, self._exclusions = source_names, countries, exclusions

    def players(self) -> DataFrame:
        return self._players

    def events(self, start: date | None = None, end: date | None = None,
               names: list[str] | None = None) -> DataFrame:
        ev = self._events
        if start is not None:
            ev = ev.filter(F.col("date") >= F.lit(start))
        if end is not None:
            ev = ev.filter(F.col("date") <= F.lit(end))
        if names is not None:
            ev = ev.filter(F.col("mp_event_name").isin(list(names)))
        return ev

    def source_names(self) -> DataFrame:
        return self._source_names

    def countries(self) -> DataFrame:
        return self._countries

    def exclusions(self) -> DataFrame:
        return self._exclusions
