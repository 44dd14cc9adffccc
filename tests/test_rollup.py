"""Reports over the rollup equal those over the cells, and read nothing else."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from cohortflow.catalog import spark_queries as Q
from cohortflow.operators import alerts as al
from cohortflow.operators import compare as cm
from cohortflow.operators import metrics as me
from cohortflow.operators import reports as rp
from cohortflow.operators import rollup as ro

READERS = ["weighted_conversion", "monotonic_cap", "version_funnel", "version_funnel_split", "version_funnel_ratio",
           "step_trend_day", "step_trend_day_ratio", "step_trend_week", "step_trend_month", "trend_averages",
           "trend_ba_summary", "daily_steps", "daily_ba_summary", "daily_ba_summary_ratio", "version_delta",
           "best_worst_version", "anomaly_upticks", "biggest_dropoffs", "top3_drops", "alerts_funnel", "alerts_trend",
           "ba_funnel", "ba_lift", "ba_significance", "ba_users", "weighted_conversion_exact"]


@pytest.fixture(scope="module")
def both(spark):
    cells = Q.long(spark, SF01).cache()
    return cells, ro.rollup(cells).cache()


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_every_report_is_the_same(spark, both):
    cells, rolled = both
    spec, cmp = Q.spec(), Q.comparison(spark, SF01)
    steps, test = cm.shown_steps(spec), Q.ctx(spark, SF01)[1].test_start.date()
    for metric in ("pct", "ratio"):
        for make in (lambda d: rp.version_funnel(d, steps, metric), lambda d: rp.trend(d, "install_week", steps, metric),
                     lambda d: rp.split_summary(d, ["install_version"], test, steps, metric),
                     lambda d: rp.weighted_by(d, ["install_date"], metric),
                     lambda d: cm.ba_table(cm.ba_funnel(d, spec, cmp, metric)),
                     lambda d: me.weighted_steps(d, ["install_version"], metric),
                     lambda d: me.weighted_steps(d, ["install_version"], metric, "exact")):
            assert rows(make(cells)) == rows(make(rolled))
    for make in (lambda d: al.upticks(d, steps, 1, 0.0005, ()), lambda d: al.biggest_dropoffs(d, steps, 1),
                 lambda d: al.funnel_alerts(d, 8, 10), lambda d: al.trend_alerts(d, steps, test),
                 lambda d: cm.ba_users(d, cmp)):
        assert rows(make(cells)) == rows(make(rolled))


def test_parts_merge_exactly(both):
    cells, rolled = both
    part = F.pmod(F.xxhash64("country", "platform"), F.lit(3))
    parts = [ro.rollup(cells.where(part == k)) for k in range(3)]
    merged = ro.merge(*parts)
    assert rows(merged) == rows(rolled) and dict(merged.dtypes) == dict(rolled.dtypes)
    assert rows(ro.merge(rolled)) == rows(rolled) and rolled.count() < both[0].count()


def test_rates_that_are_missing(spark):
    """Cells without step-1 users: the plain mean of the rates that are there."""
    schema = ("install_date date, install_hour int, install_week date, install_month date, install_version string, "
              "step_no int, total_users long, raw_step_01 long, users long, prev_users long, pct_e4 long, pct double, "
              "ratio_e4 long, ratio double")
    cells = spark.createDataFrame([(None, None, None, None, "a", 1, 3, 0, 0, None, 5000, 0.5, 10000, 1.0),
                                   (None, None, None, None, "a", 1, 3, 0, 0, None, None, None, 10000, 1.0),
                                   (None, None, None, None, "b", 1, 3, 0, 0, None, None, None, None, None)], schema)
    for d in (cells, ro.rollup(cells)):
        got = {r.install_version: r.value for r in rp.weighted_by(d, ["install_version"]).collect()}
        assert got == {"a": 0.5, "b": 0.0}


@pytest.mark.parametrize("name", READERS)
def test_reports_scan_the_rollup_alone(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = Q.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x]
    assert scans and all(re.search(r"published_rollup", x) for x in scans)
