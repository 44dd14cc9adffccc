"""Stored daily partials of the event log: what a refresh reads in place of it.

Two tables by event date, each replaced a date at a time in one step
(``sources/snapshots.py``):

* ``firsts``: a row per (user, activity day) with the number of events, the
  first one, and the first time of every event that a funnel looks at; rows of
  several dates merge by ``sum`` and ``min``, activity by ``bit_or``;
* ``late``: the distinct events of steps with a lower bound in time, which no
  first time decides.

``update`` reads the log of the given dates and nothing else.  Cubes come from
``rows`` and ``late_rows`` through ``operators/shared.py``.  The folder names
carry a digest of the events looked at: other funnels have tables of their own.
"""

from __future__ import annotations

from datetime import date, timedelta
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.operators import shared as sh
from cohortflow.sources.snapshots import SnapshotTable


class DailyPartials:
    def __init__(self, spark: SparkSession, path: str, runs: list[sh.FunnelRun]):
        self.spark, self.runs = spark, runs
        looked_at = [sh.match_column(m) for m in sh.matches(runs)] + sh.late_names(runs)
        tag = sha256("\n".join(looked_at).encode()).hexdigest()[:12]
        self.firsts = SnapshotTable(spark, f"{path.rstrip('/')}/firsts-{tag}", "date")
        self.late = SnapshotTable(spark, f"{path.rstrip('/')}/late-{tag}", "date")

    def dates(self) -> set[date]:
        """Event dates that are held (dates without events are not)."""
        m = self.firsts.manifest()
        return set() if m is None else {date.fromisoformat(v) for v in m.folders}

    def through(self) -> date | None:
        """The date up to which all dates of the band have been gathered."""
        m = self.firsts.manifest()
        return None if m is None or m.note is None else date.fromisoformat(m.note)

    def update(self, src, dates: list[date], through: date | None = None) -> None:
        """Gather the log of ``dates`` anew; dates that have no events any more
        go.  Running it again gives the same tables."""
        if not dates:
            return
        through = max([d for d in (through, self.through()) if d is not None], default=None)
        note = None if through is None else through.isoformat()
        log = src.events(min(dates), max(dates))
        if (max(dates) - min(dates)).days + 1 > len(set(dates)):
            log = log.filter(F.col("date").isin(list(dates)))
        self.late.publish(log.filter(F.col("mp_event_name").isin(sh.late_names(self.runs)))
                          .select(*sh.LATE_COLUMNS).distinct(), replace_values=dates, note=note)
        self.firsts.publish(sh.daily_firsts(log, self.runs), replace_values=dates, note=note)

    def rows(self, lo: date, hi: date) -> DataFrame:
        return self.firsts.load().filter(F.col("date").between(F.lit(lo), F.lit(hi)))

    def late_rows(self, lo: date, hi: date) -> DataFrame:
        return self.late.load().filter(F.col("date").between(F.lit(lo), F.lit(hi)))

    def versions(self) -> dict[str, int] | None:
        """The newest version of either table."""
        held = {k: t.manifest() for k, t in (("firsts", self.firsts), ("late", self.late))}
        return None if None in held.values() else {k: m.version for k, m in held.items()}

    def changed_users(self, before: dict[str, int]) -> DataFrame | None:
        """Users (distinct_id) whose rows differ between the versions
        ``before`` and the newest ones; None if those have expired.  Only dates
        that have been replaced since are read, and compared by user through a
        digest of the user's rows."""
        marks = []
        for k, t in (("firsts", self.firsts), ("late", self.late)):
            if before[k] not in t.versions():
                return None
            old, new = t.manifest(before[k]).folders, t.manifest().folders
            dates = [date.fromisoformat(d) for d in sorted(old.keys() | new.keys()) if old.get(d) != new.get(d)]
            for side, version in (("old", before[k]), ("new", None)):
                df = t.load(version)
                marks.append(df.filter(F.col("date").isin(dates)).select(
                    "distinct_id", F.lit(side).alias("side"), F.xxhash64(F.lit(k), *sorted(df.columns)).alias("mark")))
        every = marks[0]
        for m in marks[1:]:
            every = every.unionByName(m)
        digest = lambda side: F.bit_xor(F.when(F.col("side") == side, F.col("mark")))
        return (every.groupBy("distinct_id").agg(digest("old").alias("old"), digest("new").alias("new"))
                .where(~F.col("old").eqNullSafe(F.col("new"))).select("distinct_id"))

    def expire(self, keep: int = 2, grace_seconds: float = 24 * 3600) -> None:
        for t in (self.firsts, self.late):
            t.expire(keep, grace_seconds)


def changed_install_dates(partials: DailyPartials, src, before: dict[str, int]) -> list[date] | None:
    """Install dates whose cells the changes since the versions ``before`` can
    touch: those of the changed users (at most as many values as there are
    install dates); None if these versions are no longer there."""
    users = partials.changed_users(before)
    if users is None:
        return None
    rows = (src.players().join(users, "distinct_id", "left_semi").where("install_date is not null")
            .select("install_date").distinct().collect())
    return sorted(r[0] for r in rows)


def build_from_partials(partials: DailyPartials, src, cfg: EngineConfig, retention: sh.Retention | None,
                        install_dates: list[date] | None = None) -> sh.SharedBuild:
    """All cubes (or their cells of ``install_dates``) without the log."""
    lo, hi = sh.scan_band(cfg, partials.runs, retention)
    return sh.build_all(src, cfg, partials.runs, retention, partials.rows(lo, hi), partials.late_rows(lo, hi),
                        install_dates)


def all_dates(lo: date, hi: date) -> list[date]:
    return [lo + timedelta(days=i) for i in range((hi - lo).days + 1)]
