"""One pass for several cubes gives the cubes of the single builds."""

import pytest

from conftest import SF001, SF01
from planmetrics import scans
from cohortflow.config import EngineConfig
from cohortflow.operators import funnel as fu
from cohortflow.operators import retention as rt
from cohortflow.operators import shared as sh
from cohortflow.plans.steps import demo_funnel, funnel_72h, main_funnel
from cohortflow.sources import TestdataSource
from cohortflow.sources.scripted import ScriptedSource

CFG = EngineConfig.for_testdata()


def rows(df, columns=None):
    return sorted(map(str, df.select(sorted(columns or df.columns)).collect()))


def runs(main, other):
    return [sh.FunnelRun.main(CFG, main), sh.FunnelRun.observed(CFG, other)]


def test_demo_funnels_and_retention(spark):
    src = TestdataSource(spark, SF01)
    both = runs(demo_funnel(), demo_funnel())
    got = sh.build_all(src, CFG, both, sh.Retention.of(CFG))
    assert rows(got.counts["funnel"]) == rows(fu.build_funnel(src, CFG, demo_funnel()).counts)
    assert rows(got.counts["funnel_72h"]) == rows(fu.build_funnel_72h(src, CFG, demo_funnel()).counts)
    assert rows(got.retention) == rows(rt.build_retention(src, CFG))


def test_50_and_48_steps(spark):
    src = ScriptedSource(spark, SF01)
    got = sh.build_all(src, CFG, runs(main_funnel(), funnel_72h()), sh.Retention.of(CFG))
    main = fu.build_funnel(src, CFG, main_funnel()).counts
    assert rows(got.counts["funnel"]) == rows(main) and main.count() > 0
    assert rows(got.counts["funnel_72h"]) == rows(fu.build_funnel_72h(src, CFG, funnel_72h()).counts)


def test_rows_gathered_by_day_give_the_same(spark):
    """From daily first times in place of the log."""
    src = ScriptedSource(spark, SF001)
    both = runs(main_funnel(), funnel_72h())
    keep = sh.Retention.of(CFG)
    lo, hi = sh.scan_band(CFG, both, keep)
    daily = sh.daily_firsts(src.events(lo, hi), both)
    a = sh.build_all(src, CFG, both, keep)
    b = sh.build_all(src, CFG, both, keep, rows=daily)
    for name in a.counts:
        assert rows(a.counts[name]) == rows(b.counts[name])
    assert rows(a.retention) == rows(b.retention)


def test_some_install_dates(spark):
    src = TestdataSource(spark, SF01)
    both, keep = runs(demo_funnel(), demo_funnel()), sh.Retention.of(CFG)
    whole = sh.build_all(src, CFG, both, keep)
    days = [r[0] for r in whole.retention.select("install_date").distinct().orderBy("install_date").collect()][1:4:2]
    part = sh.build_all(src, CFG, both, keep, install_dates=days)
    for a, b in ((whole.counts["funnel"], part.counts["funnel"]), (whole.retention, part.retention)):
        assert rows(b) == rows(a.where(a.install_date.isin(days))) and b.count() > 0


@pytest.fixture
def canonical(spark, tmp_path):
    """The tables of the production layout, events partitioned by date."""
    from cohortflow.sources import TableSource
    td = TestdataSource(spark, SF001)
    for name in ("players", "source_names", "countries", "exclusions"):
        getattr(td, name)().write.parquet(str(tmp_path / name))
    td.events().write.partitionBy("date").parquet(str(tmp_path / "events"))
    return TableSource(spark, str(tmp_path))


def test_the_log_is_scanned_twice(spark, canonical, monkeypatch):
    """For three cubes: once by user, once for the late events; the tables
    that come of it are written and read from then on."""
    from cohortflow.sources import cube_store
    seen = []
    write = cube_store.materialize

    def materialize(df, name):
        df.write.format("noop").mode("overwrite").save()
        seen.append((name, df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
                     and _event_scans(df)))
        return write(df, name)

    monkeypatch.setattr(cube_store, "materialize", materialize)
    got = sh.build_all(canonical, CFG, runs(demo_funnel(), demo_funnel()), sh.Retention.of(CFG))
    for df in (*got.counts.values(), got.retention):
        df.collect()
        assert scans(df, "/events") == 0
    assert dict(seen) == {"shared_users": 1, "shared_flags": 1}


def _event_scans(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    names = [plan.apply(i).toString() for i in range(plan.size())]
    return sum("res_timestamp" in n for n in names)
