"""A view selects the same rows as plain Python does, in every cube."""

import random
from datetime import date, timedelta

import pytest

from conftest import SF001
from cohortflow.catalog import spark_queries as Q
from cohortflow.operators.views import View

D0 = date(2026, 1, 5)


def plain(row, v: View) -> bool:
    has = row.asDict()
    if v.start is not None and not row.install_date >= v.start:
        return False
    if v.end is not None and not row.install_date <= v.end:
        return False
    hour = has.get("install_hour")
    if hour is not None:
        if row.install_date == v.start and hour < v.start_hour:
            return False
        if row.install_date == v.end and hour > v.end_hour:
            return False
    for name in ("platform", "country", "install_week", "install_month", "mediasource", "media_type"):
        chosen = getattr(v, name)
        if chosen is None or name not in has or (not chosen and name in ("platform", "install_week", "install_month")):
            continue
        if has[name] not in chosen:
            return False
    for name in ("is_low_payers_country", "is_usa"):
        if getattr(v, name) is not None and name in has and has[name] != getattr(v, name):
            return False
    if v.versions is not None and row.install_version not in v.versions:
        return False
    try:
        least = None if v.min_version is None else float(v.min_version)
    except ValueError:
        least = None
    if least is not None:
        try:
            own = float(row.install_version)
        except (TypeError, ValueError):
            own = 0.0
        if own < least:
            return False
    return True


@pytest.fixture(scope="module")
def cube(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice([*x, None])
    rows = [(D0 + timedelta(days=rng.randint(0, 5)), pick(0, 5, 6, 18, 23), pick("ios", "android"), pick("US", "DE"),
             D0, pick("fb", "organic"), pick("social", "none"), pick(True, False), rng.choice(["0.38", "0.3811", "abc", "0.39"]),
             rng.randint(1, 9)) for _ in range(400)]
    return spark.createDataFrame(rows, "install_date date, install_hour int, platform string, country string, "
                                       "install_month date, mediasource string, media_type string, "
                                       "is_low_payers_country boolean, install_version string, total_users int")


VIEWS = [View(), View.of(start=D0 + timedelta(days=1), end=D0 + timedelta(days=3), start_hour=6, end_hour=18),
         View.of(start=D0, end=D0, start_hour=5, end_hour=6), View.of(platform=["ios"], country=["US", "DE"]),
         View.of(platform=[], install_month=[], install_week=[]), View.of(country=[]), View.of(versions=[]),
         View.of(media_type=["social"], is_low_payers_country=False, min_version="0.3811"),
         View.of(min_version="x", versions=["abc", "0.39"]), View.of(min_version="0"), View.of(is_usa=1)]


@pytest.mark.parametrize("view", VIEWS)
def test_rows_of_a_view(cube, view):
    for df in (cube, cube.drop("install_hour", "country", "media_type")):
        rows = df.collect()
        want = sorted(str(r) for r in rows if plain(r, view))
        assert sorted(map(str, view.apply(df).collect())) == want
        assert sorted(map(str, df.filter(view.predicate(df.columns)).collect())) == want


def test_unknown_choices_are_refused():
    with pytest.raises(ValueError, match="colour"):
        View.of(colour=["red"])
    assert View.of(platform=["a"]).but(platform=["b"], min_version="1") == View.of(platform=["b"], min_version="1")


def test_a_view_prunes_partitions_of_both_cubes(spark):
    for cube in (Q.wide(spark, SF001), Q.retention(spark, SF001)):
        plan = Q.chosen_view().apply(cube)._jdf.queryExecution().executedPlan().toString()
        scan = next(x for x in plan.split("\n") if "FileScan parquet" in x)
        filters = scan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
        assert "install_date" in filters and ">=" in filters and "<=" in filters


def test_one_view_is_the_same_installs_in_both_cubes(spark):
    """By date, platform and version the cubes hold the same players, but for
    those without a first step and installs of the last days."""
    v = Q.chosen_view().but(start_hour=0, end_hour=23, is_low_payers_country=None, is_usa=None)
    funnel = {(r.install_date, r.platform, r.install_version): r[3] for r in v.apply(Q.wide(spark, SF001)).groupBy(
        "install_date", "platform", "install_version").sum("total_users").collect()}
    ret = {(r.install_date, r.platform, r.install_version): r[3] for r in v.apply(Q.retention(spark, SF001)).where(
        "days_since_install = 0").groupBy("install_date", "platform", "install_version").sum("cohort_size").collect()}
    assert funnel and all(ret.get(k, 0) >= n for k, n in funnel.items())
