"""Registered Spark queries (one per operator group of the inventory).

Every query reads the driver's tables in ``sf_dir`` through
``TestdataSource`` and runs the library's DataFrame jobs on whole tables.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.functions.columns import version_num
from cohortflow.operators import cohort as co
from cohortflow.operators import funnel as fu
from cohortflow.operators import compare as cmpm
from cohortflow.operators import filters as fi
from cohortflow.operators import metrics as me
from cohortflow.operators import retention as re
from cohortflow.operators import rollup as ro
from cohortflow.sources import cube_store as store
from cohortflow.plans.steps import demo_funnel, main_funnel
from cohortflow.plans.steps import funnel_72h as funnel_72h_spec
from cohortflow.session import app_id, prepare
from cohortflow.sources.scripted import ScriptedSource
from cohortflow.sources.testdata import TestdataSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def ctx(spark: SparkSession, sf_dir: str):
    prepare(spark)
    return TestdataSource(spark, sf_dir), EngineConfig.for_testdata()


def spec():
    return demo_funnel()


def funnel(spark, sf_dir) -> fu.FunnelBuild:
    src, cfg = ctx(spark, sf_dir)
    return fu.build_funnel(src, cfg, spec())


def funnel_72h(spark, sf_dir) -> fu.FunnelBuild:
    src, cfg = ctx(spark, sf_dir)
    return fu.build_funnel_72h(src, cfg, spec())


# The analytics layer reads published cubes, as the dashboard reads the daily
# table: the first query that needs a cube builds it from the whole tables and
# publishes it (Parquet, partitioned by install_date, under the shared
# checkpoint folder); later queries of the same application read it.  Only the
# location is remembered here, never data.
_PUBLISHED: dict[tuple, tuple] = {}
_PUBLISH_LOCK = threading.RLock()     # a cube may be made of another one


def _stamp(spark, sf_dir: str) -> tuple:
    """Names, sizes and times of the input files: a cube of other files is not
    taken for one of these."""
    top = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return tuple(sorted((e.getPath().getName(), e.getLen(), e.getModificationTime())
                        for e in fs.listStatus(top)))


def published(spark, sf_dir, kind: str) -> DataFrame:
    key = (app_id(spark), sf_dir.rstrip("/"), _stamp(spark, sf_dir), kind)
    with _PUBLISH_LOCK:   # one build per cube even when queries run in threads
        hit = _PUBLISHED.get(key)
        if hit is None:
            hit = _PUBLISHED[key] = _publish(spark, sf_dir, kind)
    return store.load(spark, *hit)


def _publish(spark, sf_dir, kind: str) -> tuple:
    build = {
        "funnel": lambda: funnel(spark, sf_dir).counts,
        "funnel_72h": lambda: funnel_72h(spark, sf_dir).counts,
        "retention": lambda: re.build_retention(*ctx(spark, sf_dir)),
        "main": lambda: main_funnel_cube(spark, sf_dir),
        "rollup": lambda: ro.rollup(long(spark, sf_dir)),
    }[kind]
    path = store.scratch_path(spark, f"published_{kind}")
    df = build()
    store.publish(df, path)
    return path, store.published_schema(df)


def all_players(spark, sf_dir) -> DataFrame:
    src, cfg = ctx(spark, sf_dir)
    return co.with_cohort_dims(src.players(), src.source_names(), src.countries(), cfg)


# --------------------------------------------------------------------------- cohort
@register
def players_cohort(spark, sf_dir):
    src, cfg = ctx(spark, sf_dir)
    return co.cohort_from_source(src, cfg).select("distinct_id", *co.COHORT_DIMS,
                                                  "is_buggy_version")


@register
def low_payer_flag(spark, sf_dir):
    return all_players(spark, sf_dir).select("distinct_id", "country", "is_low_payers_country")


@register
def mediasource_normalised(spark, sf_dir):
    return all_players(spark, sf_dir).select("distinct_id", "first_mediasource", "mediasource")


@register
def version_band_flag(spark, sf_dir):
    p = all_players(spark, sf_dir)
    return p.select("install_version", version_num("install_version").alias("version_num"),
                    "is_buggy_version").distinct()


@register
def fraud_anti_join(spark, sf_dir):
    src, _ = ctx(spark, sf_dir)
    return co.not_in(src.players(), src.exclusions(), "distinct_id").select(
        "distinct_id", "install_date")


@register
def source_name_dedupe(spark, sf_dir):
    src, _ = ctx(spark, sf_dir)
    return co.source_name_map(src.source_names())


@register
def media_type_dedupe(spark, sf_dir):
    src, _ = ctx(spark, sf_dir)
    return co.media_type_map(src.source_names())


@register
def media_type_lookup(spark, sf_dir):
    src, cfg = ctx(spark, sf_dir)
    c = co.cohort_from_source(src, cfg).select("mediasource").distinct()
    return co.media_type_lookup(c, src.source_names()).select("mediasource", "media_type")


# --------------------------------------------------------------------------- events
@register
def events_in_window(spark, sf_dir):
    src, cfg = ctx(spark, sf_dir)
    lo, hi = fu.event_window(cfg)
    ev = fu.user_events(src.events(lo, hi), co.cohort_from_source(src, cfg))
    return ev.select("distinct_id", "mp_event_name", "chapter", "res_timestamp", "dialog_id",
                     *co.COHORT_DIMS)


@register
def events_observation_window(spark, sf_dir):
    b = funnel_72h(spark, sf_dir)
    return b.events.select("distinct_id", "mp_event_name", "res_timestamp", "install_ms")



@register
def first_event_ts(spark, sf_dir):
    b = funnel(spark, sf_dir)
    return fu.first_event_ts(b.events, "purchase")


# --------------------------------------------------------------------------- funnel
@register
def funnel_anchors(spark, sf_dir):
    b = funnel(spark, sf_dir)
    return b.anchors.select("distinct_id", "n_events",
                            *[fu.anchor_col(a.name) for a in b.spec.anchors])


@register
def funnel_user_flags(spark, sf_dir):
    return funnel(spark, sf_dir).flags.select(
        "distinct_id", *[fu.step_col(s.no) for s in spec().steps])


@register
def funnel_monotonic(spark, sf_dir):
    return funnel(spark, sf_dir).monotonic.select(
        "distinct_id", "depth", *[fu.step_col(s.no) for s in spec().steps])


@register
def funnel_cube_counts(spark, sf_dir):
    return funnel(spark, sf_dir).long.select(*fu.CUBE_DIMS, "total_users", "step_no", "users")


@register
def funnel_cube_pct(spark, sf_dir):
    return funnel(spark, sf_dir).long.select(*fu.CUBE_DIMS, "total_users", "raw_step_01",
                                             "step_no", "users", "pct_e4", "pct")


@register
def funnel_cube_ratio(spark, sf_dir):
    return funnel(spark, sf_dir).long.select(*fu.CUBE_DIMS, "step_no", "users", "prev_users",
                                             "ratio_e4", "ratio")


@register
def funnel_unpivot(spark, sf_dir):
    return fu.unpivot_metric(wide(spark, sf_dir), spec(), "pct")


@register
def step_reference(spark, sf_dir):
    dim = fu.step_dim(spark, spec()).drop("description")
    totals = long(spark, sf_dir).groupBy("step_no").agg(F.sum("users").alias("users"),
                                           me.weighted_value("pct").alias("weighted_pct"))
    label = F.concat(F.lpad(F.col("step_no").cast("string"), 2, "0"), F.lit(": "),
                     F.col("step_name"))
    return (F.broadcast(dim).join(totals, "step_no", "left")
            .select("step_no", label.alias("step_label"), "step_name", "event", "is_branch",
                    "step_group", "prev_spine_no", "users", "weighted_pct"))


@register
def step_subset(spark, sf_dir):
    _, cfg = ctx(spark, sf_dir)
    sub = rolled(spark, sf_dir).filter(F.col("install_version").startswith(cfg.default_version_prefix)
                      & F.col("step_no").between(2, 6))
    return me.weighted_steps(sub, ["install_version"]).select(
        "install_version", "step_no", "value")


@register
def main_funnel_cube(spark, sf_dir):
    """The 50-step funnel over the scripted log."""
    prepare(spark)
    return fu.build_funnel(ScriptedSource(spark, sf_dir), EngineConfig.for_testdata(), main_funnel()).counts


@register
def main_funnel_72h_cube(spark, sf_dir):
    """The 48-step funnel, events within 72 hours of the install."""
    prepare(spark)
    return fu.build_funnel_72h(ScriptedSource(spark, sf_dir), EngineConfig.for_testdata(), funnel_72h_spec()).counts


@register
def cube_load(spark, sf_dir):
    _, cfg = ctx(spark, sf_dir)
    return fi.load_filter(wide(spark, sf_dir), cfg.cube_start, cfg.min_version)


@register
def cube_load_72h(spark, sf_dir):
    _, cfg = ctx(spark, sf_dir)
    w72 = fi.load_filter(fu.wide_cube(published(spark, sf_dir, "funnel_72h"), spec()), cfg.cube_start,
                         cfg.min_version)
    return w72.filter(F.col("install_date") < F.lit(cfg.as_of - timedelta(days=3)))


@register
def cube_roundtrip(spark, sf_dir):
    """The table is replaced: an older, larger cube was published there before."""
    path = store.scratch_path(spark, "demo_cube")
    cube = store.materialize(funnel(spark, sf_dir).wide, "cube")
    store.publish(cube.union(cube.withColumn("install_date", F.date_add("install_date", 400))
                             .select(*cube.columns)), path)
    store.publish(cube, path)
    return store.load(spark, path)


# --------------------------------------------------------------------------- retention
def retention(spark, sf_dir) -> DataFrame:
    return published(spark, sf_dir, "retention")


@register
def retention_cohort(spark, sf_dir):
    src, cfg = ctx(spark, sf_dir)
    return re.retention_cohort(src.players(), src.exclusions(), cfg, cfg.retention_start,
                               cfg.as_of)


@register
def daily_activity(spark, sf_dir):
    src, cfg = ctx(spark, sf_dir)
    coh = re.retention_cohort(src.players(), src.exclusions(), cfg, cfg.retention_start,
                              cfg.as_of)
    last = cfg.as_of + timedelta(days=91)
    return re.daily_activity(src.events(cfg.retention_start, last), coh, cfg.retention_start, last)


@register
def retention_cube(spark, sf_dir):
    src, cfg = ctx(spark, sf_dir)
    return re.build_retention(src, cfg)


@register
def retention_weighted(spark, sf_dir):
    cube = retention(spark, sf_dir).filter(F.col("days_since_install") <= 14)
    return re.retention_by(cube, ["install_version", "days_since_install"])


@register
def retention_matrix(spark, sf_dir):
    return re.retention_matrix(retention(spark, sf_dir), ["platform", "install_version"])


@register
def retention_curve(spark, sf_dir):
    return re.retention_curve(retention(spark, sf_dir), ["platform", "install_version"], 14)


@register
def retention_curve_split(spark, sf_dir):
    _, cfg = ctx(spark, sf_dir)
    cube = re.with_period(retention(spark, sf_dir), cfg.test_start.date())
    return re.retention_curve(cube, ["platform", "install_version", "period"], 14)


@register
def daily_retention(spark, sf_dir):
    return re.daily_retention(retention(spark, sf_dir))


@register
def filter_retention(spark, sf_dir):
    from datetime import date
    cube = retention(spark, sf_dir)
    cube = cube.filter(F.col("install_date").between(F.lit(date(2024, 1, 1)),
                                                     F.lit(date(2024, 1, 8))))
    return fi.dimensions(cube, platform=["BUILDING", "MACHINERY"], is_usa=0)


# --------------------------------------------------------------------------- filters / metrics
def wide(spark, sf_dir):
    return fu.wide_cube(published(spark, sf_dir, "funnel"), spec())


def long(spark, sf_dir):
    return fu.long_cube(published(spark, sf_dir, "funnel"), spec())


def rolled(spark, sf_dir) -> DataFrame:
    """The published rollup: what the reports by version and date read."""
    return published(spark, sf_dir, "rollup")


def long_72h(spark, sf_dir):
    return fu.long_cube(published(spark, sf_dir, "funnel_72h"), spec())


@register
def filter_date_hour(spark, sf_dir):
    from datetime import date
    return fi.date_hour_window(wide(spark, sf_dir), date(2024, 1, 2), date(2024, 1, 5), 6, 18)


@register
def filter_dimensions(spark, sf_dir):
    from datetime import date
    return fi.dimensions(wide(spark, sf_dir),
                         platform=["AUTOMOBILE", "BUILDING", "FURNITURE"],
                         install_month=[date(2024, 1, 1)], media_type=None,
                         is_low_payers_country=False)


def cube_versions(spark, sf_dir) -> DataFrame:
    return wide(spark, sf_dir).select("install_version").distinct()


def retention_versions(spark, sf_dir) -> DataFrame:
    return retention(spark, sf_dir).select("install_version").distinct()


@register
def versions_at_least(spark, sf_dir):
    return fi.versions_at_least(cube_versions(spark, sf_dir), "0.3812")


@register
def versions_ordered(spark, sf_dir):
    from cohortflow.functions.columns import version_sort_key
    v = cube_versions(spark, sf_dir).union(retention_versions(spark, sf_dir)).distinct()
    return v.select("install_version", version_sort_key("install_version").alias("version_key")) \
        .orderBy("version_key", "install_version")


@register
def versions_retention_only(spark, sf_dir):
    return retention_versions(spark, sf_dir).subtract(cube_versions(spark, sf_dir))


@register
def weighted_conversion(spark, sf_dir):
    return me.weighted_steps(rolled(spark, sf_dir), ["install_version"])


@register
def monotonic_cap(spark, sf_dir):
    sp = spec()
    spine = [s.no for s in sp.spine if s.group not in sp.hidden_groups]
    ws = me.weighted_steps(rolled(spark, sf_dir).filter(F.col("step_no").isin(spine)), ["install_version"])
    return me.running_min(ws, ["install_version"], "value", out="capped").select(
        "install_version", "step_no", "value", "capped")


@register
def dimension_counts(spark, sf_dir):
    from cohortflow.operators import reports as rp
    return rp.dimension_counts(wide(spark, sf_dir),
                               ["platform", "country", "media_type", "mediasource",
                                "install_version"])


@register
def coverage(spark, sf_dir):
    from cohortflow.operators import reports as rp
    _, cfg = ctx(spark, sf_dir)
    w = wide(spark, sf_dir)
    return rp.coverage(w, F.col("platform").isin("BUILDING", "MACHINERY"), cfg.test_start.date())


# --------------------------------------------------------------------------- before / after
def comparison(spark, sf_dir) -> cmpm.Comparison:
    _, cfg = ctx(spark, sf_dir)
    return cmpm.Comparison.around_test_start(cfg, 0.381, 0.3811, cfg.cube_start,
                                             cfg.as_of - timedelta(days=cfg.install_lag_days))


def ba_base(spark, sf_dir):
    return cmpm.ba_funnel(rolled(spark, sf_dir), spec(), comparison(spark, sf_dir))


@register
def ba_users(spark, sf_dir):
    return cmpm.ba_users(rolled(spark, sf_dir), comparison(spark, sf_dir))


@register
def ba_versions(spark, sf_dir):
    from cohortflow.functions.columns import version_sort_key
    c = comparison(spark, sf_dir)
    v = cube_versions(spark, sf_dir)
    k = version_sort_key("install_version")
    return (v.filter(k >= c.before.min_version).union(v.filter(k >= c.after.min_version))
            .distinct())


@register
def ba_funnel(spark, sf_dir):
    return ba_base(spark, sf_dir)


@register
def ba_lift(spark, sf_dir):
    return cmpm.ba_lift(ba_base(spark, sf_dir))


@register
def ba_lift_summary(spark, sf_dir):
    s = cmpm.ba_lift_summary(ba_base(spark, sf_dir), min_n=10)
    return s.withColumn("avg_lift_pp", F.round("avg_lift_pp", 9))


@register
def ba_significance(spark, sf_dir):
    return cmpm.ba_significance(ba_base(spark, sf_dir), min_n=10)


@register
def ba_detail(spark, sf_dir):
    return cmpm.ba_detail(ba_base(spark, sf_dir), spec(), min_n=10)


@register
def ba_start_finish(spark, sf_dir):
    return cmpm.ba_start_finish(ba_base(spark, sf_dir))


@register
def dropoff_transitions(spark, sf_dir):
    return cmpm.dropoff_transitions(ba_base(spark, sf_dir))


@register
def ba_retention(spark, sf_dir):
    return cmpm.ba_retention(retention(spark, sf_dir), comparison(spark, sf_dir))


@register
def ba_retention_daily(spark, sf_dir):
    _, cfg = ctx(spark, sf_dir)
    return cmpm.ba_retention_daily(retention(spark, sf_dir), cfg.test_start.date())


# --------------------------------------------------------------------------- reports
def shown(spark, sf_dir) -> list[int]:
    return cmpm.shown_steps(spec())


@register
def version_funnel(spark, sf_dir):
    from cohortflow.operators import reports as rp
    return rp.version_funnel(rolled(spark, sf_dir), shown(spark, sf_dir))


@register
def version_funnel_split(spark, sf_dir):
    from cohortflow.operators import reports as rp
    _, cfg = ctx(spark, sf_dir)
    lg = rolled(spark, sf_dir).withColumn("period", rp.period_of(cfg.test_start.date()))
    ws = rp.weighted_by(lg.filter(F.col("step_no").isin(shown(spark, sf_dir))),
                        ["install_version", "period"])
    return ws.select("install_version", "period", "step_no", "value", "users")


@register
def version_funnel_ratio(spark, sf_dir):
    from cohortflow.operators import reports as rp
    return rp.version_funnel(rolled(spark, sf_dir), shown(spark, sf_dir), metric="ratio")


def _trend(spark, sf_dir, col, metric="pct"):
    from cohortflow.operators import reports as rp
    return rp.trend(rolled(spark, sf_dir), col, shown(spark, sf_dir), metric)


@register
def step_trend_day_ratio(spark, sf_dir):
    return _trend(spark, sf_dir, "install_date", "ratio")


@register
def step_trend_day(spark, sf_dir):
    return _trend(spark, sf_dir, "install_date")


@register
def step_trend_week(spark, sf_dir):
    return _trend(spark, sf_dir, "install_week")


@register
def step_trend_month(spark, sf_dir):
    return _trend(spark, sf_dir, "install_month")


@register
def trend_averages(spark, sf_dir):
    _, cfg = ctx(spark, sf_dir)
    t = _trend(spark, sf_dir, "install_date")
    before = F.col("period") < F.lit(cfg.test_start.date())
    return t.groupBy("step_no").agg(
        F.round(F.avg(F.when(before, F.col("value"))), 9).alias("avg_before"),
        F.round(F.avg(F.when(~before, F.col("value"))), 9).alias("avg_after"))


@register
def trend_ba_summary(spark, sf_dir):
    from cohortflow.operators import reports as rp
    _, cfg = ctx(spark, sf_dir)
    s = rp.split_summary(rolled(spark, sf_dir), [], cfg.test_start.date(), shown(spark, sf_dir))
    has_after = F.col("users_after") > 0
    delta = F.col("after") - F.col("before")
    pct = F.when(F.col("before") > 0, delta / F.col("before") * 100).otherwise(F.lit(0.0))
    return s.select("step_no", "before", F.when(has_after, F.col("after")).alias("after"),
                    F.when(has_after, delta).alias("delta"),
                    F.when(has_after, pct).alias("pct_change"))


@register
def daily_steps(spark, sf_dir):
    from cohortflow.operators import reports as rp
    ws = rp.weighted_by(rolled(spark, sf_dir).filter(F.col("step_no").isin(shown(spark, sf_dir))),
                        ["install_date", "install_version"])
    return ws.select("install_date", "install_version", "step_no", "value", "users") \
        .na.drop(subset=["value"])


@register
def daily_ba_summary(spark, sf_dir):
    from cohortflow.operators import reports as rp
    _, cfg = ctx(spark, sf_dir)
    return rp.split_summary(rolled(spark, sf_dir), ["install_version"], cfg.test_start.date(),
                            shown(spark, sf_dir))


@register
def daily_ba_summary_ratio(spark, sf_dir):
    from cohortflow.operators import reports as rp
    _, cfg = ctx(spark, sf_dir)
    return rp.split_summary(rolled(spark, sf_dir), ["install_version"], cfg.test_start.date(),
                            shown(spark, sf_dir), metric="ratio")


@register
def version_delta(spark, sf_dir):
    """Per version and step: after minus before, NULL unless both are above 0."""
    s = daily_ba_summary(spark, sf_dir)
    return s.select("install_version", "step_no", "before", "after", F.when(
        (F.col("before") > 0) & (F.col("after") > 0), F.col("after") - F.col("before")).alias("delta"))


def _installs_by(spark, sf_dir, col):
    return (wide(spark, sf_dir).groupBy(col).agg(F.sum("total_users").alias("users"))
            .filter(F.col(col).isNotNull()).orderBy(F.desc("users"), col))


@register
def installs_by_version(spark, sf_dir):
    return _installs_by(spark, sf_dir, "install_version")


@register
def installs_by_media_type(spark, sf_dir):
    return _installs_by(spark, sf_dir, "media_type")


@register
def top_media_sources(spark, sf_dir):
    return _installs_by(spark, sf_dir, "mediasource").limit(15)


@register
def install_summary(spark, sf_dir):
    from cohortflow.operators import reports as rp
    s = wide(spark, sf_dir).groupBy("install_version").agg(
        F.sum("total_users").alias("total_installs"),
        F.countDistinct("install_date").alias("days_with_data"))
    return rp.share_of_total(s, "total_installs", "share_pct", 1)


@register
def best_worst_version(spark, sf_dir):
    from cohortflow.operators import alerts as al
    return al.best_worst(rolled(spark, sf_dir), shown(spark, sf_dir)[-1])


# --------------------------------------------------------------------------- anomalies / alerts
@register
def anomaly_upticks(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.upticks(rolled(spark, sf_dir), shown(spark, sf_dir), cfg.min_sample_users,
                      cfg.uptick_tolerance, cfg.known_uptick_steps)


@register
def biggest_dropoffs(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.biggest_dropoffs(rolled(spark, sf_dir), shown(spark, sf_dir), cfg.min_sample_users)


@register
def top3_drops(spark, sf_dir):
    from cohortflow.operators import alerts as al
    return al.top_drops_first_version(rolled(spark, sf_dir), shown(spark, sf_dir), 3)


@register
def alerts_funnel(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.funnel_alerts(rolled(spark, sf_dir), shown(spark, sf_dir)[-1],
                            cfg.min_sample_users)


@register
def alerts_trend(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.trend_alerts(rolled(spark, sf_dir), shown(spark, sf_dir), cfg.test_start.date())


@register
def alerts_installs(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.install_alerts(wide(spark, sf_dir), cfg.small_version_users)


@register
def alerts_retention(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.retention_alerts(retention(spark, sf_dir), cfg.test_start.date(),
                               cfg.min_sample_users)


@register
def ba_funnel_ratio(spark, sf_dir):
    return cmpm.ba_funnel(rolled(spark, sf_dir), spec(), comparison(spark, sf_dir), metric="ratio")


@register
def ba_funnel_hints(spark, sf_dir):
    return cmpm.ba_funnel(rolled(spark, sf_dir), spec(), comparison(spark, sf_dir),
                          include_groups=("hint",))


def ba_hints(spark, sf_dir) -> DataFrame:
    return cmpm.ba_funnel(rolled(spark, sf_dir), spec(), comparison(spark, sf_dir),
                          include_groups=("hint",))


def ba_ratio(spark, sf_dir) -> DataFrame:
    return cmpm.ba_funnel(rolled(spark, sf_dir), spec(), comparison(spark, sf_dir), metric="ratio")


@register
def ba_lift_hints(spark, sf_dir):
    return cmpm.ba_lift(ba_hints(spark, sf_dir))


@register
def ba_significance_hints(spark, sf_dir):
    return cmpm.ba_significance(ba_hints(spark, sf_dir), min_n=10)


@register
def ba_detail_hints(spark, sf_dir):
    return cmpm.ba_detail(ba_hints(spark, sf_dir), spec(), min_n=10)


@register
def dropoff_transitions_hints(spark, sf_dir):
    return cmpm.dropoff_transitions(ba_hints(spark, sf_dir))


@register
def ba_lift_ratio(spark, sf_dir):
    return cmpm.ba_lift(ba_ratio(spark, sf_dir))


@register
def ba_significance_ratio(spark, sf_dir):
    return cmpm.ba_significance(ba_ratio(spark, sf_dir), min_n=10)


@register
def ba_detail_ratio(spark, sf_dir):
    return cmpm.ba_detail(ba_ratio(spark, sf_dir), spec(), min_n=10)


@register
def ba_funnel_72h(spark, sf_dir):
    return cmpm.ba_funnel(long_72h(spark, sf_dir), spec(), comparison(spark, sf_dir))


@register
def ba_lift_72h(spark, sf_dir):
    return cmpm.ba_lift(ba_funnel_72h(spark, sf_dir))


@register
def ba_funnel_filtered(spark, sf_dir):
    """Platforms and a version list chosen before the comparison."""
    chosen = fi.dimensions(long(spark, sf_dir), platform=["AUTOMOBILE", "BUILDING", "FURNITURE"],
                           install_version=["0.3811", "0.3812", "0.3813"])
    return cmpm.ba_funnel(chosen, spec(), comparison(spark, sf_dir))


# --------------------------------------------------------------------------- documented modes
@register
def cube_load_72h_strict(spark, sf_dir):
    """72-hour cube where every install has its whole window observed."""
    src, cfg = ctx(spark, sf_dir)
    wide72 = fu.build_funnel_72h(src, cfg, spec(), strict=True).wide
    return fi.load_filter(wide72, cfg.cube_start, cfg.min_version)


@register
def weighted_conversion_exact(spark, sf_dir):
    lg = rolled(spark, sf_dir)
    pct = me.weighted_steps(lg, ["install_version"], "pct", mode="exact")
    ratio = me.weighted_steps(lg, ["install_version"], "ratio", mode="exact")
    return pct.select("install_version", "step_no", F.col("value").alias("pct_exact"), "users") \
        .join(ratio.select("install_version", "step_no", F.col("value").alias("ratio_exact")),
              ["install_version", "step_no"])


@register
def retention_weighted_all_cells(spark, sf_dir):
    cube = retention(spark, sf_dir).filter(F.col("days_since_install") <= 14)
    return re.retention_by(cube, ["install_version", "days_since_install"],
                           active_cells_only=False)


@register
def ba_funnel_hints_reference_cap(spark, sf_dir):
    return cmpm.ba_funnel(long(spark, sf_dir), spec(), comparison(spark, sf_dir),
                          include_groups=("hint",), cap="reference")


# --------------------------------------------------------------------------- the 50-step cube
def main_long(spark, sf_dir) -> DataFrame:
    return fu.long_cube(published(spark, sf_dir, "main"), main_funnel())


@register
def main_upticks(spark, sf_dir):
    """Upticks over all steps shown, the optional ones included, with causes."""
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.explained(al.upticks(main_long(spark, sf_dir), cmpm.shown_steps(main_funnel(), ("hint",)),
                                   cfg.min_sample_users, cfg.uptick_tolerance, cfg.known_uptick_steps))


@register
def main_dropoffs(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.biggest_dropoffs(main_long(spark, sf_dir), cmpm.shown_steps(main_funnel(), ("hint",)),
                               cfg.min_sample_users)


@register
def main_funnel_alerts(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.funnel_alerts(main_long(spark, sf_dir), cmpm.shown_steps(main_funnel())[-1], cfg.min_sample_users)


@register
def main_trend_alerts(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.trend_alerts(main_long(spark, sf_dir), cmpm.shown_steps(main_funnel()), cfg.test_start.date())


# --------------------------------------------------------------------------- totals and extremes
@register
def retention_d1_extremes(spark, sf_dir):
    return re.d1_extremes(retention(spark, sf_dir))


@register
def tracking_summary(spark, sf_dir):
    from cohortflow.operators import reports as rp
    _, cfg = ctx(spark, sf_dir)
    return rp.tracking_summary(wide(spark, sf_dir), retention(spark, sf_dir), cfg.test_start.date())


@register
def versions_retention_only_chosen(spark, sf_dir):
    """Versions of the retention cube that a minimum version hides in the funnel."""
    shown = fi.versions_at_least(cube_versions(spark, sf_dir), "0.3812").select("install_version")
    return retention_versions(spark, sf_dir).subtract(shown)


@register
def alerts_installs_one_day(spark, sf_dir):
    """Install alerts of a view restricted to one late install date."""
    from datetime import date
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    day = wide(spark, sf_dir).filter(F.col("install_date") == F.lit(date(2024, 1, 10)))
    return al.install_alerts(day, cfg.small_version_users)


# --------------------------------------------------------------------------- builds by a shared pass, and from partials
def _shared(spark, sf_dir, src, main, other):
    from cohortflow.operators import shared as sh
    cfg = EngineConfig.for_testdata()
    return sh.build_all(src, cfg, [sh.FunnelRun.main(cfg, main), sh.FunnelRun.observed(cfg, other)],
                        sh.Retention.of(cfg))


@register
def shared_main_cube(spark, sf_dir):
    """The 50-step cube out of the pass that makes three."""
    prepare(spark)
    return _shared(spark, sf_dir, ScriptedSource(spark, sf_dir), main_funnel(), funnel_72h_spec()).counts["funnel"]


@register
def shared_main_72h_cube(spark, sf_dir):
    prepare(spark)
    return _shared(spark, sf_dir, ScriptedSource(spark, sf_dir), main_funnel(), funnel_72h_spec()).counts["funnel_72h"]


@register
def shared_retention_cube(spark, sf_dir):
    src, _ = ctx(spark, sf_dir)
    return _shared(spark, sf_dir, src, spec(), spec()).retention


def _from_partials(spark, sf_dir):
    """Partials of every date, those of one date gathered twice, then the cubes
    without the log."""
    from datetime import date
    from cohortflow.operators import shared as sh
    from cohortflow.streaming import partials as pa
    src, cfg = ctx(spark, sf_dir)
    runs, keep = [sh.FunnelRun.main(cfg, spec())], sh.Retention.of(cfg)
    held = pa.DailyPartials(spark, store.scratch_path(spark, "partials"), runs)
    lo, hi = sh.scan_band(cfg, runs, keep)
    held.update(src, pa.all_dates(lo, hi))
    held.update(src, [date(2024, 1, 9)])
    return pa.build_from_partials(held, src, cfg, keep), runs[0]


@register
def partials_funnel_counts(spark, sf_dir):
    build, run = _from_partials(spark, sf_dir)
    return fu.long_cube(build.counts[run.name], run.spec).select(*fu.CUBE_DIMS, "total_users", "step_no", "users")


@register
def partials_retention_cube(spark, sf_dir):
    return _from_partials(spark, sf_dir)[0].retention


# --------------------------------------------------------------------------- reports of a view
def chosen_view():
    """Dates with hours, platforms, versions with a minimum, and flags at once."""
    from datetime import date
    from cohortflow.operators.views import View
    return View.of(start=date(2024, 1, 1), end=date(2024, 1, 6), start_hour=6, end_hour=18,
                   platform=["AUTOMOBILE", "BUILDING", "MACHINERY"], install_month=[], is_low_payers_country=False,
                   is_usa=0, versions=["0.3810", "0.3812", "0.3813"], min_version="0.3811")


def view_long(spark, sf_dir) -> DataFrame:
    return chosen_view().apply(long(spark, sf_dir))


@register
def view_version_funnel(spark, sf_dir):
    from cohortflow.operators import reports as rp
    return rp.version_funnel(view_long(spark, sf_dir), shown(spark, sf_dir))


@register
def view_step_trend_day(spark, sf_dir):
    from cohortflow.operators import reports as rp
    return rp.trend(view_long(spark, sf_dir), "install_date", shown(spark, sf_dir), "pct")


@register
def view_dimension_counts(spark, sf_dir):
    from cohortflow.operators import reports as rp
    return rp.dimension_counts(chosen_view().apply(wide(spark, sf_dir)),
                               ["platform", "country", "media_type", "mediasource", "install_version"])


@register
def view_biggest_dropoffs(spark, sf_dir):
    from cohortflow.operators import alerts as al
    return al.biggest_dropoffs(view_long(spark, sf_dir), shown(spark, sf_dir), 1)


@register
def view_retention_matrix(spark, sf_dir):
    return re.retention_matrix(chosen_view().apply(retention(spark, sf_dir)), ["platform", "install_version"])


@register
def view_alerts_installs(spark, sf_dir):
    from cohortflow.operators import alerts as al
    _, cfg = ctx(spark, sf_dir)
    return al.install_alerts(chosen_view().apply(wide(spark, sf_dir)), cfg.small_version_users)


@register
def view_coverage(spark, sf_dir):
    """What a view selects of all users."""
    from cohortflow.operators import reports as rp
    _, cfg = ctx(spark, sf_dir)
    w = wide(spark, sf_dir)
    return rp.coverage(w, chosen_view().predicate(w.columns), cfg.test_start.date())
