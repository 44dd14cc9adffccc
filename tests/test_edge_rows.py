"""Edge rows of FIXTURES.md §4 (cohort, dimensions, retention)."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.operators import cohort as co
from cohortflow.operators import retention as re

AS_OF = date(2026, 3, 30)
CFG = EngineConfig(as_of=AS_OF)
PSCHEMA = ("distinct_id long, install_date date, first_event_time timestamp, "
           "first_app_version string, first_platform string, first_country string, "
           "first_mediasource string")


@pytest.fixture(scope="module")
def dims(spark):
    sn = spark.createDataFrame(
        [("fb", "Facebook", "social"), ("fb", "Meta", "paid"), ("gg", None, "search"),
         ("gg", "Google", "search"), ("tt", "TikTok", "video"), ("tt", "TikTok", "social")],
        "cost_data_name string, final_name string, media_type string")
    countries = spark.createDataFrame([("IN", True), ("DE", False), ("IN", True)],
                                      "country_code string, is_low_payers_country boolean")
    return sn, countries


def players(spark, rows):
    return spark.createDataFrame(rows, PSCHEMA)


def test_install_hour_default_and_buckets(spark, dims):
    sn, countries = dims
    p = players(spark, [
        (1, date(2026, 3, 18), datetime(2026, 3, 18, 7, 30), "0.3812", "ios", "DE", "fb"),
        (2, date(2026, 3, 18), datetime(2026, 3, 17, 23, 0), "0.3812", "ios", "DE", None),
        (3, date(2026, 3, 18), None, "0.3812", "ios", "IN", "zz"),
    ])
    out = {r["distinct_id"]: r for r in co.with_cohort_dims(p, sn, countries, CFG).collect()}
    assert out[1]["install_hour"] == 7
    assert out[2]["install_hour"] == 12 and out[3]["install_hour"] == 12
    assert out[1]["install_week"] == date(2026, 3, 16)          # Monday
    assert out[1]["install_month"] == date(2026, 3, 1)
    assert out[3]["is_low_payers_country"] is True and out[1]["is_low_payers_country"] is False
    # smallest final name wins; missing mapping falls back to the raw source; NULL -> organic
    assert out[1]["mediasource"] == "facebook"
    assert out[2]["mediasource"] == "organic"
    assert out[3]["mediasource"] == "zz"


def test_country_and_exclusion_filters(spark, dims):
    sn, countries = dims
    p = players(spark, [
        (1, date(2026, 3, 18), None, "0.3812", "ios", "DE", None),
        (2, date(2026, 3, 18), None, "0.3812", "ios", "IL", None),
        (3, date(2026, 3, 18), None, "0.3812", "ios", None, None),
        (4, date(2026, 3, 18), None, "0.3812", "ios", "DE", None),
        (5, date(2026, 3, 29), None, "0.3812", "ios", "DE", None),   # after as_of - 2
        (6, date(2025, 12, 1), None, "0.3812", "ios", "DE", None),   # before as_of - 90
    ])
    excl = spark.createDataFrame([(4,)], "distinct_id long")
    got = sorted(r[0] for r in co.build_cohort(p, sn, countries, excl, CFG).select("distinct_id").collect())
    assert got == [1]
    with_null = spark.createDataFrame([(4,), (None,)], "distinct_id long")
    assert co.build_cohort(p, sn, countries, with_null, CFG).count() == 0   # NOT IN with a NULL


def test_version_band(spark):
    df = spark.createDataFrame([("abc",), ("0.3731",), ("0.374",), ("0.3741",), (None,)], "v string")
    got = [r[0] for r in df.select(co.is_buggy_version(F.col("v"), (0.3731, 0.374))).collect()]
    assert got == [False, True, True, False, False]


def test_media_type_lookup_fallback(spark, dims):
    sn, _ = dims
    df = spark.createDataFrame([("facebook",), ("organic",), ("unknown",), ("tiktok",)], "mediasource string")
    got = {r[0]: r[1] for r in co.media_type_lookup(df, sn).select("mediasource", "media_type").collect()}
    assert got == {"facebook": "social", "organic": "organic", "unknown": "none", "tiktok": "social"}


def test_retention_day_boundaries(spark):
    coh = spark.createDataFrame([(1, date(2025, 12, 20), "0.38", 0, "ios")],
                                "distinct_id long, install_date date, install_version string, "
                                "is_usa int, platform string")
    day = lambda d: int(datetime(d.year, d.month, d.day, 12).timestamp() * 1000)
    acts = [date(2025, 12, 19), date(2025, 12, 20), date(2026, 3, 20), date(2026, 3, 21)]
    ev = spark.createDataFrame([(1, day(d)) for d in acts], "distinct_id long, res_timestamp long")
    as_of = date(2026, 3, 21)                       # day 91 would be 2026-03-21 == as_of
    cube = re.retention_cube(coh, re.daily_activity(ev, coh), as_of, 90)
    rows = {r["days_since_install"]: r for r in cube.collect()}
    assert set(rows) == set(range(0, 91))          # days 0..90, all before as_of
    active = sorted(d for d, r in rows.items() if r["users_active"] > 0)
    assert active == [0, 90]                        # day -1 and as_of are not counted
    assert all(r["cohort_size"] == 1 for r in rows.values())


def test_weighted_retention_active_cells_only(spark):
    cube = spark.createDataFrame([(10, 5), (10, 0), (20, 4)], "cohort_size long, users_active long")
    ref = cube.agg(re.weighted_retention(True)).first()[0]
    exact = cube.agg(re.weighted_retention(False)).first()[0]
    assert ref == pytest.approx(9 / 30) and exact == pytest.approx(9 / 40)
