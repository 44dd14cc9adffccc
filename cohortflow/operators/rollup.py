"""Sufficient statistics of the funnel cube, by install date and hour, version
and step.

Weighted rates are ratios of sums, so the reports by version, date or period
need no cells, only what adds up over them:

* ``total_users``, ``raw_step_01``, ``users``, ``prev_users``: sums;
* ``pct_num``, ``ratio_num``: sums of rate (x 10^4) times step-1 users;
* ``pct_sum``, ``ratio_sum``, ``pct_n``, ``ratio_n``: plain sums (x 10^4) and
  counts of the rates that are there.

All are integers: rollups of parts of a cube merge exactly, in any order and
grouping.  A rollup stands in for the long cube wherever dimensions other than
date, hour and version are not asked for; the report functions tell the two by
their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["install_date", "install_hour", "install_week", "install_month", "install_version", "step_no"]
SUMS = ["total_users", "raw_step_01", "users", "prev_users"]
RATES = ["pct", "ratio"]
STATS = SUMS + [f"{m}_{k}" for m in RATES for k in ("num", "sum", "n")]


def rollup(long: DataFrame) -> DataFrame:
    """The statistics of a long cube."""
    zero = F.lit(0).cast("long")
    stats = [F.sum(c).alias(c) for c in SUMS]
    for m in RATES:
        e = F.col(f"{m}_e4")
        stats += [F.sum(F.coalesce(e, zero) * F.col("raw_step_01")).alias(f"{m}_num"),
                  F.coalesce(F.sum(e), zero).alias(f"{m}_sum"), F.count(e).alias(f"{m}_n")]
    return long.groupBy(*KEYS).agg(*stats)


def merge(*parts: DataFrame) -> DataFrame:
    """The rollup of several parts of a cube from theirs."""
    every = parts[0].select(*KEYS, *STATS)
    for p in parts[1:]:
        every = every.unionByName(p.select(*KEYS, *STATS))
    return every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in STATS])


def is_rollup(df: DataFrame) -> bool:
    return "pct_num" in df.columns
