"""Invariants of the cubes on the driver's sf0.01 tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from cohortflow.config import EngineConfig
from cohortflow.operators import funnel as fu
from cohortflow.operators import retention as re
from cohortflow.plans.steps import demo_funnel
from cohortflow.sources import TestdataSource


@pytest.fixture(scope="module")
def build(spark):
    return fu.build_funnel(TestdataSource(spark, SF01), EngineConfig.for_testdata(), demo_funnel())


@pytest.fixture(scope="module")
def rcube(spark):
    return re.build_retention(TestdataSource(spark, SF01), EngineConfig.for_testdata()).cache()


def test_spine_counts_non_increasing(build):
    spec = build.spec
    tot = {r["step_no"]: r["u"] for r in
           build.long.groupBy("step_no").agg(F.sum("users").alias("u")).collect()}
    spine = [s.no for s in spec.spine]
    assert all(tot[a] >= tot[b] for a, b in zip(spine, spine[1:]))
    for s in spec.steps:
        if s.branch:
            assert tot[s.no] <= tot[spec.prev_spine_no(s)]


def test_cells_sum_to_users_with_entry(build):
    cells = build.counts.agg(F.sum("total_users")).first()[0]
    users = build.monotonic.join(build.anchors, "distinct_id").join(
        build.counts.select(*fu.COHORT_DIMS).distinct(), fu.COHORT_DIMS, "left_semi").count()
    assert cells == users


def test_golden_demo_counts_without_filters(spark):
    # whole player table (no cohort filters): 150, 81, 54, 38, 23 along the spine
    from cohortflow.operators.cohort import with_cohort_dims
    src = TestdataSource(spark, SF01)
    cfg = EngineConfig.for_testdata()
    spec = demo_funnel()
    pl = with_cohort_dims(src.players(), src.source_names(), src.countries(), cfg)
    anc = fu.anchors(src.events(), pl, spec)
    mono = fu.monotonic(fu.user_flags(src.events(), spec, anc), spec)
    s = mono.agg(*[F.sum(fu.step_col(n)).alias(str(n)) for n in (1, 2, 3, 5, 6)]).first()
    assert [s[str(n)] for n in (1, 2, 3, 5, 6)] == [150, 81, 54, 38, 23]


def test_long_equals_wide(build):
    w = build.wide
    lg = build.long.filter(F.col("step_no") == 5)
    a = sorted(r[0] for r in w.select("pct_05_purchase_after_click").collect())
    b = sorted(r[0] for r in lg.select("pct").collect())
    assert a == b


def test_retention_bounds(rcube):
    assert rcube.filter(F.col("users_active") > F.col("cohort_size")).count() == 0
    # cohort size is the same on every observable day of a cell
    v = rcube.groupBy("install_date", "install_version", "platform", "is_usa").agg(
        F.countDistinct("cohort_size").alias("k"))
    assert v.filter(F.col("k") > 1).count() == 0
    assert rcube.filter((F.col("days_since_install") < 0) | (F.col("days_since_install") > 90)).count() == 0


def test_retention_matches_per_user_cross_join(spark, rcube):
    """The per-cell expansion equals the reference's per-user cross join."""
    from datetime import timedelta
    src = TestdataSource(spark, SF01)
    cfg = EngineConfig.for_testdata()
    coh = re.retention_cohort(src.players(), src.exclusions(), cfg, cfg.retention_start, cfg.as_of)
    act = re.daily_activity(src.events(cfg.retention_start, cfg.as_of + timedelta(days=91)), coh)
    days = spark.range(0, 91).select(F.col("id").cast("int").alias("days_since_install"))
    cd = coh.crossJoin(days).withColumn(
        "activity_date", F.date_add("install_date", F.col("days_since_install"))) \
        .filter(F.col("activity_date") < F.lit(cfg.as_of))
    j = cd.join(act.withColumnRenamed("distinct_id", "aid"),
                (F.col("distinct_id") == F.col("aid")) & (cd.activity_date == act.activity_date), "left")
    ref = j.groupBy("install_date", "install_version", "platform", "is_usa", "days_since_install") \
        .agg(F.countDistinct("distinct_id").alias("cohort_size"),
             F.countDistinct("aid").alias("users_active"))
    cols = ref.columns
    assert ref.select(cols).exceptAll(rcube.select(cols)).count() == 0
    assert rcube.select(cols).exceptAll(ref.select(cols)).count() == 0


def test_window_strategy_equals_aggregate(spark, build):
    alt = fu.build_funnel(TestdataSource(spark, SF01), EngineConfig.for_testdata(), demo_funnel(),
                          strategy="window")
    cols = build.long.columns
    assert alt.long.select(cols).exceptAll(build.long.select(cols)).count() == 0
    assert build.long.select(cols).exceptAll(alt.long.select(cols)).count() == 0
