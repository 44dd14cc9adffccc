"""A refresh reads the changed dates' events and equals a full rebuild."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from cohortflow.config import EngineConfig
from cohortflow.operators import shared as sh
from cohortflow.plans.steps import demo_funnel
from cohortflow.sources import TableSource, TestdataSource
from cohortflow.sources import cube_store
from cohortflow.streaming import refresh as rf
from cohortflow.streaming.partials import DailyPartials

CFG = EngineConfig.for_testdata()
CUBES = ("retention_cube", "funnel_cube", "funnel_rollup", "funnel_counts", "funnel_cube_72h", "funnel_rollup_72h",
         "funnel_counts_72h")


class Watched(TableSource):
    """Remembers the bands of the log that were asked for, and the files."""

    def __init__(self, spark, base):
        super().__init__(spark, base)
        self.asked = []

    def events(self, start, end, names=None):
        self.asked.append((start, end))
        return super().events(start, end, names)


@pytest.fixture
def warehouse(spark, tmp_path):
    td = TestdataSource(spark, SF001)
    for name in ("players", "source_names", "countries", "exclusions"):
        getattr(td, name)().write.parquet(str(tmp_path / name))
    td.events().write.partitionBy("date").parquet(str(tmp_path / "events"))
    return str(tmp_path)


def land(spark, warehouse, rows):
    """Late events: (user, name, day, hour, chapter, dialog)."""
    ms = lambda d, h: int(datetime(d.year, d.month, d.day, h, tzinfo=timezone.utc).timestamp() * 1000)
    spark.createDataFrame([(u, n, ms(d, h), d, c, str(k)) for u, n, d, h, c, k in rows],
                          "distinct_id long, mp_event_name string, res_timestamp long, date date, chapter int, "
                          "dialog_id string").write.mode("append").partitionBy("date").parquet(f"{warehouse}/events")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def cubes(spark, out):
    return {n: rows(cube_store.load(spark, f"{out}/{n}")) for n in CUBES}


def full(spark, warehouse, out, cfg=CFG):
    rf.rebuild(TableSource(spark, warehouse), cfg, demo_funnel(), out, demo_funnel())
    return cubes(spark, out)


def test_late_files(spark, warehouse, tmp_path):
    src, out = Watched(spark, warehouse), str(tmp_path / "cubes")
    ref = rf.Refresher(spark, CFG, demo_funnel(), out, demo_funnel())
    assert ref.refresh(src, []) is None                     # the first time: everything
    assert cubes(spark, out) == full(spark, warehouse, str(tmp_path / "full0"))

    users = [r[0] for r in src.players().orderBy("distinct_id").select("distinct_id").limit(4).collect()]
    day = date(2024, 1, 9)
    land(spark, warehouse, [(u, n, day, h, 1, 7) for u in users for h, n in
                            enumerate(("view", "click", "purchase", "view", "click", "error"))])
    src.asked.clear()
    changed = ref.refresh(src, [day])
    assert src.asked == [(day, day)]                        # of the log, this date alone
    installs = {r[0] for r in src.players().where(F.col("distinct_id").isin(users)).select("install_date").collect()}
    assert set(changed) == installs and len(changed) < src.players().select("install_date").distinct().count()
    assert cubes(spark, out) == full(spark, warehouse, str(tmp_path / "full1"))

    # the same files again change nothing; then two dates apart from one another
    assert ref.refresh(src, [day]) == [] and cubes(spark, out) == cubes(spark, str(tmp_path / "full1"))
    land(spark, warehouse, [(users[0], "click", date(2024, 1, 3), 1, 2, 30), (users[1], "purchase", date(2024, 1, 20), 2, 3, 60)])
    ref.refresh(src, [date(2024, 1, 3), date(2024, 1, 20)])
    assert cubes(spark, out) == full(spark, warehouse, str(tmp_path / "full2"))


def test_the_scan_of_an_update_is_the_changed_date(spark, warehouse, tmp_path):
    both = rf.funnel_runs(CFG, demo_funnel(), demo_funnel())
    day = date(2024, 1, 9)
    log = TableSource(spark, warehouse).events(day, day)
    files = sh.daily_firsts(log, both)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in files
    # an update works where the other dates' files are gone
    only = tmp_path / "one"
    for name in ("players", "source_names", "countries", "exclusions"):
        (only).mkdir(exist_ok=True)
        spark.read.parquet(f"{warehouse}/{name}").write.parquet(str(only / name))
    log.write.partitionBy("date").parquet(str(only / "events"))
    p = DailyPartials(spark, str(tmp_path / "p"), both)
    p.update(TableSource(spark, warehouse), [day - timedelta(days=1), day])
    held = rows(p.rows(day - timedelta(days=1), day - timedelta(days=1)))
    p.update(TableSource(spark, str(only)), [day])
    assert p.dates() == {day - timedelta(days=1), day}
    assert rows(p.rows(day - timedelta(days=1), day - timedelta(days=1))) == held and held


def test_events_that_vanish_and_a_clock_that_moves(spark, warehouse, tmp_path):
    """A date whose files are replaced by none, then the next day's run."""
    import shutil
    src, out = Watched(spark, warehouse), str(tmp_path / "cubes")
    early = CFG.with_(as_of=CFG.as_of - timedelta(days=1))
    ref = rf.Refresher(spark, early, demo_funnel(), out, demo_funnel())
    ref.refresh(src, [])
    day = date(2024, 1, 9)
    shutil.move(f"{warehouse}/events/date={day}", str(tmp_path / "taken"))
    ref.refresh(src, [day])
    assert day not in ref.partials.dates()
    assert cubes(spark, out) == full(spark, warehouse, str(tmp_path / "full0"), early)
    src.asked.clear()
    later = rf.Refresher(spark, CFG, demo_funnel(), out, demo_funnel())
    # all install dates; of the log only the day by which the clock has moved
    assert later.refresh(src, []) is None and src.asked == [(early.as_of, early.as_of)]
    assert cubes(spark, out) == full(spark, warehouse, str(tmp_path / "full1"))


def test_dates_outside_the_band_change_nothing(spark, warehouse, tmp_path):
    src, out = Watched(spark, warehouse), str(tmp_path / "cubes")
    ref = rf.Refresher(spark, CFG, demo_funnel(), out)
    ref.refresh(src, [])
    src.asked.clear()
    assert ref.refresh(src, [date(2020, 1, 1)]) == [] and src.asked == []


def test_a_refresh_that_stops_is_made_up_for(spark, warehouse, tmp_path, monkeypatch):
    """Partials are updated, the publish of the cubes fails halfway."""
    src, out = Watched(spark, warehouse), str(tmp_path / "cubes")
    ref = rf.Refresher(spark, CFG, demo_funnel(), out, demo_funnel())
    ref.refresh(src, [])
    before = cubes(spark, out)
    user, day = src.players().orderBy("distinct_id").first()["distinct_id"], date(2024, 1, 9)
    land(spark, warehouse, [(user, n, day, h, 1, 7) for h, n in enumerate(("view", "click", "purchase"))])
    publish, calls = cube_store.publish, []

    def some(df, path, **kw):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return publish(df, path, **kw)

    with monkeypatch.context() as m:
        m.setattr(cube_store, "publish", some)
        with pytest.raises(RuntimeError):
            ref.refresh(src, [day])
    assert cubes(spark, out)["funnel_counts"] == before["funnel_counts"]
    assert ref.refresh(src, []) is None         # the tables differ in what they reflect: all of them anew
    assert cubes(spark, out) == full(spark, warehouse, str(tmp_path / "full"))
