"""Cube filters: date/hour window, dimension IN lists, versions.

pandas drops rows whose predicate is False but *keeps* NaN-compared rows when
the predicate is negated; Spark drops NULL predicates.  Negated predicates are
therefore wrapped with ``guarded_not`` (NULL counts as False before ``~``).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.columns import guarded_not, version_num


def date_hour_window(df: DataFrame, start: date, end: date, start_hour: int = 0,
                     end_hour: int = 23) -> DataFrame:
    """Install dates in [start, end]; on the boundary dates only the hours in range."""
    d, h = F.col("install_date"), F.col("install_hour")
    out = df.filter(d.between(F.lit(start), F.lit(end)))
    out = out.filter(guarded_not((d == F.lit(start)) & (h < start_hour)))
    return out.filter(guarded_not((d == F.lit(end)) & (h > end_hour)))


def dimensions(df: DataFrame, **selected) -> DataFrame:
    """``platform=[...]`` style IN filters; ``None`` (or an empty list for the
    multi-selects the reference treats as "all") means no filter.  A scalar
    value filters by equality (e.g. ``is_low_payers_country=True``)."""
    out = df
    for col, val in selected.items():
        if val is None:
            continue
        if isinstance(val, (list, tuple, set)):
            if len(val) == 0 and col in ("platform", "install_week", "install_month"):
                continue
            out = out.filter(F.col(col).isin(list(val)))
        else:
            out = out.filter(F.col(col) == F.lit(val))
    return out


def versions_at_least(versions: DataFrame, min_version: str, col: str = "install_version"
                      ) -> DataFrame:
    """Versions numerically >= min_version; unparsable versions count as 0.0.
    An unparsable minimum keeps every version."""
    try:
        mv = float(min_version)
    except (TypeError, ValueError):
        return versions
    return versions.filter(F.coalesce(version_num(col), F.lit(0.0)) >= F.lit(mv))


def load_filter(cube: DataFrame, start: date, min_version: float) -> DataFrame:
    """The cube load predicate: recent installs, numeric version >= min, known platform."""
    return cube.filter((F.col("install_date") >= F.lit(start))
                       & (version_num("install_version") >= F.lit(min_version))
                       & (F.col("platform") != F.lit("none")))
