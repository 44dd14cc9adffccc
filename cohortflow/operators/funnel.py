"""Anchored funnel: events + cohort + FunnelSpec -> per-cell funnel cube.

Plan (per build):

1. ``first_times``: one ``groupBy(distinct_id)`` over the event log in the
   date band with the first time of every anchor and of every step that has
   no lower bound in time (its first match decides it).  The aggregation
   comes before any join and has numeric buffers only, so it runs as a hash
   aggregate with partial sums before the shuffle: one row per user and map
   task moves, never the raw events.
2. ``anchors``: those rows joined with the cohort (one row per user on either
   side), which brings the cohort dimensions.
3. ``user_flags``: steps without a lower bound are read off the first times;
   for the others, only the events that they name are joined to the users
   and aggregated (``max(when(predicate, 1))``).
4. ``monotonic``: the spine flags form an array; the first failing position
   (``array_position(flags, 0)``) gives the depth reached, which gates every
   later spine step; optional branch steps are gated by the spine before them
   and by their own chain, and do not gate the spine.
5. ``cube``: per-cell counts (one aggregation, partial before the shuffle),
   media-type lookup, rates as exact 4-digit rounding, long or wide layout.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.functions.columns import exact_ratio_e, from_e
from cohortflow.operators.cohort import COHORT_DIMS, cohort_from_source, media_type_lookup
from cohortflow.plans.steps import EventMatch, FunnelSpec, Step
from cohortflow.sources import cube_store

CUBE_DIMS = COHORT_DIMS + ["media_type"]
T = "res_timestamp"


def step_col(no: int) -> str:
    return f"step_{no:02d}"


def anchor_col(name: str) -> str:
    return f"ts_{name}"


def event_window(cfg: EngineConfig, event_lag_days: int | None = None):
    lag = cfg.event_lag_days if event_lag_days is None else event_lag_days
    return cfg.as_of - timedelta(days=cfg.lookback_days), cfg.as_of - timedelta(days=lag)


def funnel_events(events: DataFrame, cohort: DataFrame, spec: FunnelSpec) -> DataFrame:
    """Events of cohort players with every cohort column the build needs."""
    c = cohort.select("distinct_id", "is_buggy_version",
                      F.unix_millis("first_event_time").alias("install_ms"), *COHORT_DIMS)
    ev = events.join(c, "distinct_id", "inner")
    return observed(ev, spec)


def observed(ev: DataFrame, spec: FunnelSpec) -> DataFrame:
    if spec.observation_ms is None:
        return ev
    return ev.filter(F.col(T) <= F.col("install_ms") + F.lit(spec.observation_ms))


def user_events(events: DataFrame, cohort: DataFrame) -> DataFrame:
    """Events of cohort players carrying every cohort dimension."""
    return events.join(cohort.select("distinct_id", *COHORT_DIMS), "distinct_id", "inner")


def first_event_ts(ev: DataFrame, event: str) -> DataFrame:
    """First time each user fired ``event`` (partial aggregation per task)."""
    return (ev.filter(F.col("mp_event_name") == F.lit(event))
            .groupBy("distinct_id").agg(F.min(T).alias(f"first_{event}_ts")))


def _match(m: EventMatch) -> Column:
    cond = F.col("mp_event_name") == F.lit(m.event)
    if m.chapter is not None:
        cond = cond & (F.col("chapter") == F.lit(m.chapter))
    if m.dialog_id is not None:
        cond = cond & (F.col("dialog_id") == F.lit(m.dialog_id))
    return cond


USER_COLS = ["is_buggy_version", "install_ms"] + COHORT_DIMS


def first_col(step: Step, alt: bool = False) -> str:
    return f"first_{step.no:02d}{'_alt' if alt else ''}"


def by_first_time(step: Step) -> bool:
    """Whether a step's first match decides it: it has no lower bound in time,
    and upper bounds hold for the first match if for any."""
    return not step.after


def first_times(events: DataFrame, spec: FunnelSpec) -> DataFrame:
    """One row per user of the log: event count, first event, and the first
    time of every anchor and of every step that is decided by it."""
    def first(m: EventMatch, name: str) -> Column:
        return F.min(F.when(_match(m), F.col(T))).alias(name)

    aggs = [first(a.match, anchor_col(a.name)) for a in spec.anchors]
    for s in spec.steps:
        if by_first_time(s):
            aggs.append(first(s.match, first_col(s)))
            if s.alt is not None:
                aggs.append(first(s.alt, first_col(s, alt=True)))
    return events.groupBy("distinct_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min(T).alias("first_event_ms"), *aggs)


def anchors(events: DataFrame, cohort: DataFrame, spec: FunnelSpec) -> DataFrame:
    """One row per cohort user with events: the user's ``first_times`` and
    cohort columns.  With an observation window, a first time counts if it
    lies within it (the first of the bounded set), and a user if the first
    event does; ``n_events`` is then that of the whole band."""
    times = first_times(events, spec)
    users = cohort.select("distinct_id", "is_buggy_version",
                          F.unix_millis("first_event_time").alias("install_ms"), *COHORT_DIMS)
    out = times.join(users, "distinct_id")
    if spec.observation_ms is not None:
        end = F.col("install_ms") + F.lit(spec.observation_ms)
        own = [c for c in times.columns if c.startswith(("ts_", "first_"))]
        out = out.filter(F.col("first_event_ms") <= end).withColumns(
            {c: F.when(F.col(c) <= end, F.col(c)) for c in own})
    return out


def step_predicate(step: Step, spec: FunnelSpec, t: Column | None = None, prefix: str = "") -> Column:
    """Whether an event is one of the step's, or (with ``t``) whether a match
    at that time is.  ``prefix`` is that of the anchors' columns."""
    w = F.lit(spec.window_ms)
    a = lambda name: F.col(prefix + anchor_col(name))
    if t is None:
        t = F.col(T)
        cond = _match(step.match)
        if step.alt is not None:
            cond = F.when(F.col("is_buggy_version"), _match(step.alt)).otherwise(cond)
    else:
        cond = t.isNotNull()
    for x in step.requires:
        cond = cond & a(x).isNotNull()
    for x in step.after:
        cond = cond & a(x).isNotNull() & (t >= a(x))
    for x in step.within:
        cond = cond & ((t - a(x)) <= w)
    for x in step.before:
        cond = cond & (a(x).isNull() | (t < a(x)))
    for x in step.until:
        cond = cond & (a(x).isNull() | (t <= a(x)))
    for x, y in step.gap:
        cond = cond & ((a(y) - a(x)) <= w)
    return cond


def late_events(spec: FunnelSpec) -> list[str]:
    """Names of the events that steps with a lower bound match."""
    late = [s for s in spec.steps if not by_first_time(s)]
    return sorted({m.event for s in late for m in (s.match, s.alt) if m is not None})


def late_anchors(spec: FunnelSpec) -> list[str]:
    """Anchors that the steps with a lower bound refer to."""
    return sorted({x for s in spec.steps if not by_first_time(s) for x in s.anchors_used})


def reaches_late(spec: FunnelSpec, prefix: str = "") -> Column:
    """Whether a user has the anchors of any step with a lower bound."""
    reached = F.lit(False)
    for s in spec.steps:
        if not by_first_time(s):
            ok = F.lit(True)
            for x in s.after:
                ok = ok & F.col(prefix + anchor_col(x)).isNotNull()
            reached = reached | ok
    return reached


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def early_flags(spec: FunnelSpec, prefix: str = "") -> list[Column]:
    """Flags of the steps that the first times decide."""
    out = []
    for s in spec.steps:
        if by_first_time(s):
            t = F.col(prefix + first_col(s))
            if s.alt is not None:
                t = F.when(F.col("is_buggy_version"), F.col(prefix + first_col(s, alt=True))).otherwise(t)
            out.append(_flag(step_predicate(s, spec, t, prefix)).alias(prefix + step_col(s.no)))
    return out


def user_flags(events: DataFrame, spec: FunnelSpec, users: DataFrame) -> DataFrame:
    """Raw 0/1 flag per step for every user of ``users`` (the anchors table).

    ``events`` is the event log in the date band; only the event names of
    steps with a lower bound are read (pushed to the scan), and only for
    users that have the anchor of one.  Joining to ``users`` restricts the
    events to the cohort, so the cohort is built only once.
    """
    late = [s for s in spec.steps if not by_first_time(s)]
    dims = [c for c in COHORT_DIMS if c in users.columns]
    out = users.select("distinct_id", *dims, *early_flags(spec))
    if late:
        rel = events.filter(F.col("mp_event_name").isin(late_events(spec)))
        j = observed(rel.join(users.filter(reaches_late(spec)).select(
            "distinct_id", "is_buggy_version", "install_ms", *[anchor_col(x) for x in late_anchors(spec)]),
            "distinct_id", "inner"), spec)
        flags = j.groupBy("distinct_id").agg(*[
            F.max(_flag(step_predicate(s, spec))).alias(step_col(s.no)) for s in late])
        out = out.join(flags, "distinct_id", "left")
    return out.select("distinct_id", *dims, *[F.coalesce(F.col(step_col(s.no)), F.lit(0))
                                              .alias(step_col(s.no)) for s in spec.steps])


def user_flags_window(ev: DataFrame, spec: FunnelSpec) -> tuple[DataFrame, DataFrame]:
    """Alternative plan: anchors as window minima over each user's events,
    then one aggregation per user.  One event scan and one exchange, but every
    user's whole history must fit one task (no split for a hot user), so the
    aggregate form above is the default.  Returns (users, flags)."""
    w = Window.partitionBy("distinct_id")
    with_anchors = ev.select("*", *[F.min(F.when(_match(a.match), F.col(T))).over(w)
                                    .alias(anchor_col(a.name)) for a in spec.anchors])
    agg = with_anchors.groupBy("distinct_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.first(anchor_col(a.name)).alias(anchor_col(a.name)) for a in spec.anchors],
        *[F.any_value(c).alias(c) for c in USER_COLS],
        *[F.max(F.when(step_predicate(s, spec), F.lit(1)).otherwise(F.lit(0)))
          .alias(step_col(s.no)) for s in spec.steps])
    users = agg.drop(*[step_col(s.no) for s in spec.steps])
    flags = agg.select("distinct_id", *[step_col(s.no) for s in spec.steps])
    return users, flags


def monotonic(flags: DataFrame, spec: FunnelSpec) -> DataFrame:
    """Gate every step by the spine before it (optional branches do not gate)."""
    spine = spec.spine
    arr = F.array(*[F.col(step_col(s.no)) for s in spine])
    first_fail = F.array_position(arr, 0)
    depth = F.when(first_fail == 0, F.lit(len(spine))).otherwise(first_fail - 1)
    d = flags.withColumn("_depth", depth)
    dims = [c for c in COHORT_DIMS if c in flags.columns]
    cols = []
    for s in spec.steps:
        need_spine, chain = spec.gate(s)
        ok = F.col("_depth") >= F.lit(need_spine)
        for b in chain:
            ok = ok & (F.col(step_col(b)) == 1)
        cols.append(ok.cast("int").alias(step_col(s.no)))
    return d.select("distinct_id", *dims, F.col("_depth").cast("int").alias("depth"), *cols)


def depth_histogram(mono: DataFrame, spec: FunnelSpec) -> DataFrame:
    """Users per cell, depth reached and branch steps passed: what all step
    counts of a cell follow from.  One count per user is aggregated, not a sum
    per step."""
    branch = [step_col(s.no) for s in spec.steps if s.branch]
    return mono.groupBy(*COHORT_DIMS, "depth", *branch).agg(F.count(F.lit(1)).alias("n"))


def counts_of_histogram(hist: DataFrame, spec: FunnelSpec) -> DataFrame:
    """Per cell total_users and the users of every step: for a spine step those
    of its depth or more, for a branch step those who passed it."""
    place = {s.no: i + 1 for i, s in enumerate(spec.spine)}

    def users(s: Step) -> Column:
        passed = F.col(step_col(s.no)) == 1 if s.branch else F.col("depth") >= place[s.no]
        return F.sum(F.when(passed, F.col("n")).otherwise(F.lit(0))).cast("long").alias(step_col(s.no))

    return hist.groupBy(*COHORT_DIMS).agg(F.sum("n").alias("total_users"), *[users(s) for s in spec.steps])


def cube_counts(mono: DataFrame, users: DataFrame, spec: FunnelSpec,
                source_names: DataFrame, strategy: str = "histogram") -> DataFrame:
    """Per-cell user counts (wide): dims, total_users, step_NN counts.
    ``users`` is any per-user table carrying the cohort dimensions.
    ``strategy="sums"`` adds up every step's flag over all users instead of
    going by the histogram of depths."""
    if all(c in mono.columns for c in COHORT_DIMS):
        u = mono                       # dimensions already carried per user
    else:
        u = mono.join(users.select("distinct_id", *COHORT_DIMS), "distinct_id", "inner")
    if strategy == "histogram":
        counts = counts_of_histogram(depth_histogram(u, spec), spec)
    else:
        counts = u.groupBy(*COHORT_DIMS).agg(
            F.count(F.lit(1)).alias("total_users"),
            *[F.sum(step_col(s.no)).cast("long").alias(step_col(s.no)) for s in spec.steps])
    first = step_col(spec.steps[0].no)
    counts = counts.filter(F.coalesce(F.col(first), F.lit(0)) != 0)
    return (media_type_lookup(counts, source_names)
            .select(*CUBE_DIMS, "total_users", *[step_col(s.no) for s in spec.steps]))


def pct_name(s: Step) -> str:
    return f"pct_{s.no:02d}_{s.name}"


def ratio_name(s: Step, spec: FunnelSpec) -> str:
    p = spec.prev_spine_no(s)
    return f"ratio_{s.no:02d}_to_prev" if p is None else f"ratio_{s.no:02d}_to_{p:02d}"


def wide_cube(counts: DataFrame, spec: FunnelSpec) -> DataFrame:
    """The published table layout: raw_step_01, pct_NN_<name>, ratio_NN_to_PP."""
    first = F.col(step_col(spec.steps[0].no))
    pcts = [from_e(exact_ratio_e(F.col(step_col(s.no)), first)).alias(pct_name(s))
            for s in spec.steps]
    ratios = []
    for s in spec.steps:
        p = spec.prev_spine_no(s)
        r = F.lit(1.0) if p is None else from_e(exact_ratio_e(F.col(step_col(s.no)),
                                                                F.col(step_col(p))))
        ratios.append(r.alias(ratio_name(s, spec)))
    return counts.select(*CUBE_DIMS, "total_users", first.alias("raw_step_01"), *pcts, *ratios)


def long_cube(counts: DataFrame, spec: FunnelSpec) -> DataFrame:
    """One row per (cell, step): users, prev_users, exact rates (e4) and doubles."""
    first = step_col(spec.steps[0].no)
    entries = []
    for s in spec.steps:
        p = spec.prev_spine_no(s)
        prev = F.lit(None).cast("long") if p is None else F.col(step_col(p))
        entries.append(F.struct(F.lit(s.no).alias("step_no"),
                                F.col(step_col(s.no)).alias("users"),
                                prev.alias("prev_users")))
    x = counts.select(*CUBE_DIMS, "total_users", F.col(first).alias("raw_step_01"),
                      F.inline(F.array(*entries)))
    pct_e = exact_ratio_e(F.col("users"), F.col("raw_step_01"))
    ratio_e = F.when(F.col("prev_users").isNull(), F.lit(10000).cast("long")).otherwise(
        exact_ratio_e(F.col("users"), F.col("prev_users")))
    return x.select(*CUBE_DIMS, "total_users", "raw_step_01", "step_no", "users",
                    "prev_users", pct_e.alias("pct_e4"), from_e(pct_e).alias("pct"),
                    ratio_e.alias("ratio_e4"), from_e(ratio_e).alias("ratio"))


def metric_columns(spec: FunnelSpec, family: str = "pct",
                   include_groups: tuple[str, ...] | None = None) -> list[tuple[Step, str]]:
    """(step, column) of a metric family in step order; hidden groups left out
    unless listed in ``include_groups``."""
    shown = set(include_groups or ())
    out = []
    for s in spec.steps:
        if s.group in spec.hidden_groups and s.group not in shown:
            continue
        out.append((s, pct_name(s) if family == "pct" else ratio_name(s, spec)))
    return out


def unpivot_metric(wide: DataFrame, spec: FunnelSpec, family: str = "pct",
                   include_groups: tuple[str, ...] | None = None) -> DataFrame:
    """Wide cube -> (cell dims, metric, value) for one metric family."""
    cols = [c for _, c in metric_columns(spec, family, include_groups)]
    return wide.unpivot(ids=CUBE_DIMS + ["total_users", "raw_step_01"], values=cols,
                        variableColumnName="metric", valueColumnName="value")


def step_dim(spark, spec: FunnelSpec) -> DataFrame:
    """Step metadata as a DataFrame (size bounded by the number of steps)."""
    schema = ("step_no int, step_name string, event string, description string, "
              "is_branch boolean, step_group string, prev_spine_no int")
    rows = [(r["step_no"], r["step_name"], r["event"], r["description"], r["is_branch"],
             r["step_group"], r["prev_spine_no"]) for r in spec.step_rows()]
    return spark.createDataFrame(rows, schema)


@dataclass
class FunnelBuild:
    spec: FunnelSpec
    cohort: DataFrame
    events: DataFrame
    anchors: DataFrame
    flags: DataFrame
    monotonic: DataFrame
    counts: DataFrame

    @property
    def wide(self) -> DataFrame:
        return wide_cube(self.counts, self.spec)

    @property
    def long(self) -> DataFrame:
        return long_cube(self.counts, self.spec)


def build_funnel(src, cfg: EngineConfig, spec: FunnelSpec,
                 install_lag_days: int | None = None,
                 event_lag_days: int | None = None,
                 materialize: bool = True, strategy: str = "aggregate") -> FunnelBuild:
    """The whole funnel job over a source.

    With ``materialize`` the per-user anchors table (one row per cohort user
    with events) is written as a Parquet table in the shared checkpoint
    folder: it is read three times downstream (flags join, user list, cube
    dimensions); writing it once avoids recomputing the first event scan for
    each use and cuts the lineage, so a lost executor re-reads files instead
    of re-running the scan.  Everything else stays lazy."""
    cohort = cohort_from_source(src, cfg, install_lag_days)
    lo, hi = event_window(cfg, event_lag_days)
    log = src.events(lo, hi)
    ev = funnel_events(log, cohort, spec)
    if strategy == "window":
        anc, flags = user_flags_window(ev, spec)
        mono = monotonic(flags, spec)
        counts = cube_counts(mono, anc, spec, src.source_names())
        return FunnelBuild(spec, cohort, ev, anc, flags, mono, counts)
    anc = anchors(log, cohort, spec)
    if materialize:
        anc = cube_store.materialize(anc, f"anchors_{spec.name}")
    flags = user_flags(src.events(lo, hi, names=late_events(spec)), spec, anc)
    mono = monotonic(flags, spec)
    counts = cube_counts(mono, anc, spec, src.source_names())
    return FunnelBuild(spec, cohort, ev, anc, flags, mono, counts)


def build_funnel_72h(src, cfg: EngineConfig, spec: FunnelSpec, strict: bool = False
                     ) -> FunnelBuild:
    """Observation-window variant.

    Reference mode: installs and events both up to ``as_of - 3``, so the
    newest cohorts see less than the full window.  ``strict``: events up to
    ``as_of - 1`` and only installs whose whole window has elapsed
    (``as_of - 1 - ceil(window in days)``)."""
    if spec.observation_ms is None:
        from dataclasses import replace
        spec = replace(spec, observation_ms=cfg.observation_ms)
    if strict:
        days = -(-spec.observation_ms // 86_400_000)
        return build_funnel(src, cfg, spec, install_lag_days=cfg.event_lag_days + days,
                            event_lag_days=cfg.event_lag_days)
    return build_funnel(src, cfg, spec, install_lag_days=cfg.lag_72h_days,
                        event_lag_days=cfg.lag_72h_days)
