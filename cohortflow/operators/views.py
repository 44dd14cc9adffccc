"""One description of what a viewer has chosen, for every cube and report.

A ``View`` is data: install dates with boundary hours, dimensions, versions and
a minimum version.  ``predicate`` compiles it to one condition over the columns
that a cube has; what a cube does not have does not restrict it (the retention
cube has no install hour and no country), so one view means the same installs in
every cube as far as these can tell them apart.  Dates are compared with
literals, so they prune the partitions of a published cube.

Choices follow the dashboard: an empty list of platforms, weeks or months
stands for all of them, an empty list of any other dimension for none; None is
no choice.  NULL dimensions are outside every list.  On the boundary dates only
hours outside the window are taken away, so rows without an hour stay.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.columns import guarded_not, version_num

#: lists for which an empty one stands for all values
EMPTY_IS_ALL = ("platform", "install_week", "install_month")
LISTS = ("platform", "country", "install_week", "install_month", "mediasource", "media_type")
FLAGS = ("is_low_payers_country", "is_usa")


@dataclass(frozen=True)
class View:
    start: date | None = None
    end: date | None = None
    start_hour: int = 0
    end_hour: int = 23
    platform: tuple | None = None
    country: tuple | None = None
    install_week: tuple | None = None
    install_month: tuple | None = None
    mediasource: tuple | None = None
    media_type: tuple | None = None
    is_low_payers_country: bool | None = None
    is_usa: int | None = None
    versions: tuple | None = None
    min_version: str | None = None

    @classmethod
    def of(cls, **chosen) -> View:
        """A view from plain values (lists as well as tuples)."""
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(chosen) - known)
        if unknown:
            raise ValueError(f"a view has no {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, (list, set, frozenset)) else v for k, v in chosen.items()})

    def but(self, **chosen) -> View:
        return replace(self, **{k: tuple(v) if isinstance(v, (list, set)) else v for k, v in chosen.items()})

    def conditions(self, columns: list[str]) -> list[Column]:
        """The view's conditions on a table with these columns."""
        out, has = [], set(columns).__contains__
        d, h = F.col("install_date"), F.col("install_hour")
        if self.start is not None:
            out.append(d >= F.lit(self.start))
            if has("install_hour") and self.start_hour > 0:
                out.append(guarded_not((d == F.lit(self.start)) & (h < self.start_hour)))
        if self.end is not None:
            out.append(d <= F.lit(self.end))
            if has("install_hour") and self.end_hour < 23:
                out.append(guarded_not((d == F.lit(self.end)) & (h > self.end_hour)))
        for name in LISTS:
            chosen = getattr(self, name)
            if chosen is None or not has(name) or (not chosen and name in EMPTY_IS_ALL):
                continue
            out.append(F.col(name).isin(list(chosen)) if chosen else F.lit(False))
        for name in FLAGS:
            chosen = getattr(self, name)
            if chosen is not None and has(name):
                out.append(F.col(name) == F.lit(chosen))
        if self.versions is not None:
            out.append(F.col("install_version").isin(list(self.versions)) if self.versions else F.lit(False))
        least = _number(self.min_version)
        if least is not None:
            out.append(F.coalesce(version_num("install_version"), F.lit(0.0)) >= F.lit(least))
        return out

    def predicate(self, columns: list[str]) -> Column:
        return reduce(lambda a, b: a & b, self.conditions(columns), F.lit(True))

    def apply(self, cube: DataFrame) -> DataFrame:
        """The rows of a cube that the view has."""
        for condition in self.conditions(cube.columns):
            cube = cube.filter(condition)
        return cube


def _number(version: str | None) -> float | None:
    """A minimum version as a number; None (no minimum) if it is none."""
    try:
        return None if version is None else float(version)
    except ValueError:
        return None
