"""Several funnels and the retention cube from one pass over the event log.

The daily job builds the same per-user facts for every cube: first times of
events, and days of activity.  Here they are gathered once:

1. ``user_times``: one aggregation by user over the log with the first time of
   every distinct event that any funnel looks at, within each funnel's own band
   of event dates, and the activity bitmap (partial before the shuffle).
2. ``build_users``: the players of all cubes (they share the country and
   exclusion rules and differ in their install dates) left-joined with these,
   written once: one row per player.
3. One pass over the events of steps with a lower bound, joined with players
   that have an anchor of any funnel; flags of all funnels in one aggregation,
   written once.
4. Per funnel the gates and counts, and the retention cells, from those tables.

So the log is scanned twice, however many cubes there are.  Step 1 reads either
the log or rows that have been gathered by day before (``daily_firsts``): both
have a time per event and merge by ``min``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.operators import activity, idfilter
from cohortflow.operators import funnel as fu
from cohortflow.operators import retention as rt
from cohortflow.operators.cohort import COHORT_DIMS, not_in, with_cohort_dims
from cohortflow.plans.steps import EventMatch, FunnelSpec
from cohortflow.sources import cube_store

LATE_COLUMNS = ["distinct_id", "mp_event_name", "res_timestamp", "date", "chapter", "dialog_id"]


@dataclass(frozen=True)
class FunnelRun:
    """A funnel with its lags: installs and events up to so many days before
    ``as_of``."""

    name: str
    spec: FunnelSpec
    install_lag_days: int
    event_lag_days: int

    @classmethod
    def main(cls, cfg: EngineConfig, spec: FunnelSpec, name: str = "funnel") -> FunnelRun:
        return cls(name, spec, cfg.install_lag_days, cfg.event_lag_days)

    @classmethod
    def observed(cls, cfg: EngineConfig, spec: FunnelSpec, name: str = "funnel_72h") -> FunnelRun:
        """With an observation window after the install."""
        if spec.observation_ms is None:
            from dataclasses import replace
            spec = replace(spec, observation_ms=cfg.observation_ms)
        return cls(name, spec, cfg.lag_72h_days, cfg.lag_72h_days)

    @property
    def prefix(self) -> str:
        return f"{self.name}__"

    def event_band(self, cfg: EngineConfig) -> tuple[date, date]:
        return fu.event_window(cfg, self.event_lag_days)

    def install_band(self, cfg: EngineConfig) -> tuple[date, date]:
        return cfg.as_of - timedelta(days=cfg.lookback_days), cfg.as_of - timedelta(days=self.install_lag_days)

    def in_band(self, cfg: EngineConfig) -> Column:
        lo, hi = self.event_band(cfg)
        return F.col("date").between(F.lit(lo), F.lit(hi))

    def firsts(self) -> list[tuple[str, EventMatch]]:
        """(column of the funnel's anchors table, event whose first time it is)."""
        out = [(fu.anchor_col(a.name), a.match) for a in self.spec.anchors]
        for s in self.spec.steps:
            if fu.by_first_time(s):
                out.append((fu.first_col(s), s.match))
                if s.alt is not None:
                    out.append((fu.first_col(s, alt=True), s.alt))
        return out


def match_column(m: EventMatch) -> str:
    """A name for an event's first time that depends on the event alone."""
    return "m_" + sha256(repr((m.event, m.chapter, m.dialog_id)).encode()).hexdigest()[:12]


def matches(runs: list[FunnelRun]) -> list[EventMatch]:
    """The distinct events whose first times the funnels need."""
    held = {match_column(m): m for r in runs for _, m in r.firsts()}
    return [held[k] for k in sorted(held)]


def late_names(runs: list[FunnelRun]) -> list[str]:
    return sorted({n for r in runs for n in fu.late_events(r.spec)})


def event_rows(events: DataFrame, runs: list[FunnelRun]) -> DataFrame:
    """The log as rows to gather: a time per event that matches."""
    t = F.col("res_timestamp")
    return events.select("distinct_id", "date", activity.event_day().alias("activity_date"),
                         F.lit(1).cast("long").alias("n_events"), t.alias("first_event_ms"),
                         *[F.when(fu._match(m), t).alias(match_column(m)) for m in matches(runs)])


def daily_firsts(events: DataFrame, runs: list[FunnelRun]) -> DataFrame:
    """``event_rows`` gathered by user and day: counts and first times, which
    merge with those of other days."""
    own = [match_column(m) for m in matches(runs)]
    return event_rows(events, runs).groupBy("date", "distinct_id", "activity_date").agg(
        F.sum("n_events").alias("n_events"), F.min("first_event_ms").alias("first_event_ms"),
        *[F.min(c).alias(c) for c in own])


@dataclass(frozen=True)
class Retention:
    """Band of installs of the retention cube, and its last day."""

    start: date
    end: date
    max_day: int

    @classmethod
    def of(cls, cfg: EngineConfig) -> Retention:
        return cls(cfg.retention_start, cfg.as_of, cfg.retention_max_day)

    def n_days(self, cfg: EngineConfig) -> int:
        return rt.activity_band(self.start, cfg.as_of, self.end, self.max_day)


def scan_band(cfg: EngineConfig, runs: list[FunnelRun], retention: Retention | None) -> tuple[date, date]:
    """Event dates that any cube looks at."""
    bands = [r.event_band(cfg) for r in runs]
    if retention is not None:
        bands.append((retention.start, retention.end + timedelta(days=retention.max_day + 1)))
    return min(lo for lo, _ in bands), max(hi for _, hi in bands)


def user_times(rows: DataFrame, cfg: EngineConfig, runs: list[FunnelRun], retention: Retention | None) -> DataFrame:
    """One row per user: per funnel the number of events, the first one and all
    first times, each within the funnel's band, and the activity words."""
    aggs = []
    for r in runs:
        inside, p = r.in_band(cfg), r.prefix
        aggs += [F.sum(F.when(inside, F.col("n_events"))).alias(f"{p}n_events"),
                 F.min(F.when(inside, F.col("first_event_ms"))).alias(f"{p}first_event_ms")]
        aggs += [F.min(F.when(inside, F.col(c))).alias(p + c) for c in sorted({match_column(m) for _, m in r.firsts()})]
    if retention is not None:
        lo, hi = retention.start, retention.end + timedelta(days=retention.max_day + 1)
        aggs += activity.word_aggregates(F.col("activity_date"), retention.start, retention.n_days(cfg),
                                         F.col("date").between(F.lit(lo), F.lit(hi)))
    return rows.groupBy("distinct_id").agg(*aggs)


def all_players(src, cfg: EngineConfig, runs: list[FunnelRun], retention: Retention | None,
                install_dates: list[date] | None = None) -> DataFrame:
    """The players of all cubes with their dimensions, or those of
    ``install_dates`` alone."""
    bands = [r.install_band(cfg) for r in runs] + ([(retention.start, retention.end)] if retention else [])
    lo, hi = min(b[0] for b in bands), max(b[1] for b in bands)
    p = src.players().filter(F.col("install_date").between(F.lit(lo), F.lit(hi))
                             & ~F.col("first_country").isin(list(cfg.excluded_countries)))
    if install_dates is not None:
        p = p.filter(F.col("install_date").isin(list(install_dates)))
    p = not_in(p, src.exclusions(), "distinct_id")
    return with_cohort_dims(p, src.source_names(), src.countries(), cfg)


def build_users(players: DataFrame, times: DataFrame, runs: list[FunnelRun]) -> DataFrame:
    """Every player with the columns of all funnels' anchors tables (prefixed)
    and the activity words.  A first time beyond a funnel's observation window
    is none."""
    who = players.select("distinct_id", "is_buggy_version",
                         F.unix_millis("first_event_time").alias("install_ms"), *COHORT_DIMS)
    joined = who.join(times, "distinct_id", "left")
    cols = []
    for r in runs:
        p, end = r.prefix, None
        if r.spec.observation_ms is not None:
            end = F.col("install_ms") + F.lit(r.spec.observation_ms)
        inside = F.lit(True) if end is None else F.col(f"{p}first_event_ms") <= end
        cols.append((F.coalesce(F.col(f"{p}n_events") > 0, F.lit(False)) & F.coalesce(inside, F.lit(False)))
                    .alias(f"{p}present"))
        for name, m in r.firsts():
            t = F.col(p + match_column(m))
            cols.append((t if end is None else F.when(t <= end, t)).alias(p + name))
    words = [c for c in times.columns if c.startswith("activity_")]
    return joined.select(*who.columns, *words, *cols)


def shared_flags(late: DataFrame, users: DataFrame, cfg: EngineConfig, runs: list[FunnelRun]) -> DataFrame:
    """The players that any funnel counts, with the raw flags of all of them."""
    present = F.lit(False)
    reached, needed, aggs = F.lit(False), [], []
    for r in runs:
        p, spec = r.prefix, r.spec
        here = F.col(f"{p}present")
        present = present | here
        reached = reached | (here & fu.reaches_late(spec, p))
        needed += [f"{p}present", *[p + fu.anchor_col(x) for x in fu.late_anchors(spec)]]
        inside = r.in_band(cfg)
        if spec.observation_ms is not None:
            inside = inside & (F.col("res_timestamp") <= F.col("install_ms") + F.lit(spec.observation_ms))
        aggs += [F.max(fu._flag(inside & fu.step_predicate(s, spec, prefix=p))).alias(p + fu.step_col(s.no))
                 for s in spec.steps if not fu.by_first_time(s)]
    keep = ["distinct_id", *COHORT_DIMS, *[f"{r.prefix}present" for r in runs]]
    out = users.filter(present).select(*keep, *[c for r in runs for c in fu.early_flags(r.spec, r.prefix)])
    if aggs:
        own = users.filter(reached).select("distinct_id", "is_buggy_version", "install_ms", *needed)
        flags = (late.filter(F.col("mp_event_name").isin(late_names(runs))).join(own, "distinct_id")
                 .groupBy("distinct_id").agg(*aggs))
        out = out.join(flags, "distinct_id", "left")
    return out


def run_counts(flagged: DataFrame, cfg: EngineConfig, run: FunnelRun, source_names: DataFrame) -> DataFrame:
    """One funnel's cell counts."""
    lo, hi = run.install_band(cfg)
    own = flagged.filter(F.col(f"{run.prefix}present") & F.col("install_date").between(F.lit(lo), F.lit(hi))).select(
        "distinct_id", *COHORT_DIMS, *[F.coalesce(F.col(run.prefix + fu.step_col(s.no)), F.lit(0)).alias(
            fu.step_col(s.no)) for s in run.spec.steps])
    mono = fu.monotonic(own, run.spec)
    return fu.cube_counts(mono, mono, run.spec, source_names)


@dataclass
class SharedBuild:
    """``counts`` by funnel name, and the retention cube."""

    users: DataFrame
    flagged: DataFrame
    counts: dict[str, DataFrame]
    retention: DataFrame | None


def build_all(src, cfg: EngineConfig, runs: list[FunnelRun], retention: Retention | None,
              rows: DataFrame | None = None, late: DataFrame | None = None,
              install_dates: list[date] | None = None, cohort_filter: bool = False) -> SharedBuild:
    """All cubes over a source.  ``rows`` and ``late`` stand in for the log
    where it has been gathered by day (``daily_firsts``, and the events that
    ``late_names`` lists); ``install_dates`` restricts the players, and with
    them the cells, to those dates.  With ``cohort_filter`` the players are
    written first, and a Bloom filter of their ids keeps most other users'
    events out of the first exchange."""
    lo, hi = scan_band(cfg, runs, retention)
    players = all_players(src, cfg, runs, retention, install_dates)
    if rows is None:
        rows = event_rows(src.events(lo, hi), runs)
    if late is None:
        late = src.events(lo, hi, names=late_names(runs))
    if install_dates is not None or cohort_filter:
        players = cube_store.materialize(players, "shared_players")
        rows = idfilter.restrict(rows, players, players.count())
    users = cube_store.materialize(build_users(players, user_times(rows, cfg, runs, retention), runs), "shared_users")
    flagged = users
    if runs:
        flagged = cube_store.materialize(shared_flags(late, users, cfg, runs), "shared_flags")
    cube = None
    if retention is not None:
        start, end = retention.start, retention.end
        own = users.filter(F.col("install_date").between(F.lit(start), F.lit(end))).withColumn(
            "is_usa", F.when(F.col("country") == F.lit(cfg.us_country), 1).otherwise(0).cast("int"))
        cube = rt.cube_from_user_words(own, start, retention.n_days(cfg), cfg.as_of, retention.max_day)
    return SharedBuild(users, flagged, {r.name: run_counts(flagged, cfg, r, src.source_names()) for r in runs}, cube)
