"""Activity bitmaps against sets of days."""

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from planmetrics import exchanged_rows
from cohortflow.config import EngineConfig
from cohortflow.operators import activity as ac
from cohortflow.operators import retention as re
from cohortflow.sources import FrameSource, TestdataSource

ORIGIN = date(2026, 1, 1)


def ms(d: date, hour: int = 12) -> int:
    return int(datetime(d.year, d.month, d.day, hour, tzinfo=timezone.utc).timestamp() * 1000)


def log(spark, seen: dict[int, set[int]], each: int = 1):
    rows = [(u, "view", ms(ORIGIN + timedelta(days=n), h), ORIGIN + timedelta(days=n), None, None)
            for u, days in seen.items() for n in days for h in range(each)]
    return spark.createDataFrame(rows, "distinct_id long, mp_event_name string, res_timestamp long, date date, "
                                       "chapter int, dialog_id string")


@pytest.fixture(scope="module")
def seen():
    rng = random.Random(4)
    out = {u: set(rng.sample(range(200), rng.randint(0, 60))) for u in range(60)}
    return out | {100: {0}, 101: {63}, 102: {64}, 103: {127, 128}, 104: {199}, 105: set(range(200))}


def days_of(words, n):
    rows = ac.active_days(words, ORIGIN, n).collect()
    out = {}
    for r in rows:
        out.setdefault(r.distinct_id, []).append((r.activity_date - ORIGIN).days)
    assert all(len(v) == len(set(v)) for v in out.values())
    return {u: set(v) for u, v in out.items()}


def test_bits_are_the_days(spark, seen):
    for n in (1, 63, 64, 65, 128, 200):
        got = days_of(ac.activity_words(log(spark, seen, each=3), ORIGIN, n), n)
        assert got == {u: {d for d in days if d < n} for u, days in seen.items() if any(d < n for d in days)}


def test_bitmaps_of_single_days_merge(spark, seen):
    n = 200
    ev = log(spark, seen)
    parts = [ac.activity_words(ev.where(F.dayofmonth("date") % 3 == k), ORIGIN, n) for k in range(3)]
    parts.append(parts[0])          # a part that comes twice changes nothing
    assert days_of(ac.merge_words(*parts), n) == {u: d for u, d in seen.items() if d}


def test_bits_since_install(spark, seen):
    """Installs on either side of word bounds, users without any activity."""
    n, max_day = 200, 90
    installs = [0, 1, 62, 63, 64, 65, 100, 127, 128, 150]
    rows = [(u, ORIGIN + timedelta(days=i)) for u in [*seen, 999] for i in installs]
    cohort = spark.createDataFrame(rows, "distinct_id long, install_date date")
    words = ac.activity_words(log(spark, seen), ORIGIN, n)
    got = cohort.join(words, "distinct_id", "left").select(
        "distinct_id", "install_date", *ac.since_install(ORIGIN, n, max_day)).collect()
    for r in got:
        at = (r.install_date - ORIGIN).days
        bits = (r.since_0 & (1 << 64) - 1) | ((r.since_1 & (1 << 64) - 1) << 64)
        want = {d - at for d in seen.get(r.distinct_id, ()) if 0 <= d - at <= max_day}
        assert {i for i in range(max_day + 1) if bits >> i & 1} == want
    sums = cohort.join(words, "distinct_id", "left").select(
        "install_date", *ac.since_install(ORIGIN, n, max_day)).groupBy("install_date").agg(
        ac.day_sums(max_day).alias("s")).collect()
    for r in sums:
        at = (r.install_date - ORIGIN).days
        assert r.s == [sum(at + k in d for d in seen.values()) for k in range(max_day + 1)]


def test_both_forms_give_one_cube(spark):
    src, cfg = TestdataSource(spark, SF001), EngineConfig.for_testdata()
    for as_of in (cfg.as_of, date(2024, 1, 10), date(2024, 1, 2)):
        for max_day in (90, 3):
            a = re.build_retention(src, cfg.with_(as_of=as_of), max_day=max_day)
            b = re.build_retention(src, cfg.with_(as_of=as_of), max_day=max_day, strategy="days")
            rows = lambda d: sorted(map(str, d.select(sorted(b.columns)).collect()))
            assert rows(a) == rows(b)
    assert dict(a.dtypes) == dict(b.dtypes)


def test_a_cell_with_a_null_dimension_counts_its_users(spark):
    players = spark.createDataFrame(
        [(1, ORIGIN, datetime(2026, 1, 1), None, None, "US", None),
         (2, ORIGIN, datetime(2026, 1, 1), "0.38", "ios", "US", None)],
        "distinct_id long, install_date date, first_event_time timestamp, first_app_version string, "
        "first_platform string, first_country string, first_mediasource string")
    none = spark.createDataFrame([], "distinct_id long")
    src = FrameSource(players, log(spark, {1: {0, 2}, 2: {1}}), None, None, none)
    cfg = EngineConfig(as_of=ORIGIN + timedelta(days=3), retention_start=ORIGIN)
    got = {(r.platform, r.days_since_install): (r.cohort_size, r.users_active)
           for r in re.build_retention(src, cfg).collect()}
    assert got == {(None, 0): (1, 1), (None, 1): (1, 0), (None, 2): (1, 1),
                   ("ios", 0): (1, 0), ("ios", 1): (1, 1), ("ios", 2): (1, 0)}


def test_a_user_is_one_row_in_the_exchange(spark, seen, tmp_path):
    """Not a row per active day, nor per event."""
    path = str(tmp_path / "log")
    log(spark, seen, each=4).repartition(2).write.parquet(path)
    ev = spark.read.parquet(path)
    words = ac.activity_words(ev, ORIGIN, 200)
    words.collect()
    users = sum(bool(d) for d in seen.values())
    tasks = ev.rdd.getNumPartitions()
    assert len(exchanged_rows(words)) == 1 and users <= exchanged_rows(words)[0] <= tasks * users
    pairs = ev.select("distinct_id", ac.event_day().alias("d")).distinct()
    pairs.collect()
    assert exchanged_rows(pairs)[0] >= sum(map(len, seen.values())) > 10 * tasks * users
