"""Scheduled refresh of the published cubes."""

from cohortflow.streaming.partials import DailyPartials
from cohortflow.streaming.refresh import Refresher, rebuild, refresh_stream

__all__ = ["DailyPartials", "Refresher", "rebuild", "refresh_stream"]
