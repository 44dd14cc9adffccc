"""Before/after statuses and alert rules on hand-built cube rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import alerts as al
from cohortflow.operators import compare as cm
from cohortflow.operators import reports as rp
from cohortflow.plans.steps import EventMatch, FunnelSpec, Step, Anchor


def spec5():
    m = EventMatch("e")
    steps = (Step(1, "a", m), Step(2, "b", m), Step(3, "hint", m, branch=True, group="hint"),
             Step(4, "c", m), Step(5, "d", m))
    return FunnelSpec("t", (Anchor("x", m),), steps, 1000)


def long_rows(spark, cells):
    """cells: (install_date, hour, version, media_type, [users per step 1..5])"""
    sp = spec5()
    rows = []
    for d, h, v, mt, users in cells:
        n1 = users[0]
        for s in sp.steps:
            u = users[s.no - 1]
            prev = sp.prev_spine_no(s)
            pu = None if prev is None else users[prev - 1]
            pe = (2 * u * 10000 + n1) // (2 * n1)
            re_ = 10000 if pu is None else ((2 * u * 10000 + pu) // (2 * pu) if pu else None)
            rows.append((d, h, date(d.year, d.month, 1), v, "ios", "DE", False, "src", mt, n1, n1,
                         s.no, u, pu, pe, pe / 10000, re_, None if re_ is None else re_ / 10000))
    schema = ("install_date date, install_hour int, install_month date, install_version string, "
              "platform string, country string, is_low_payers_country boolean, mediasource string, "
              "media_type string, total_users long, raw_step_01 long, step_no int, users long, "
              "prev_users long, pct_e4 long, pct double, ratio_e4 long, ratio double")
    return spark.createDataFrame(rows, schema)


CMP = cm.Comparison(cm.Period(0.0, date(2024, 1, 1), date(2024, 1, 1)),
                    cm.Period(0.0, date(2024, 1, 2), date(2024, 1, 2)))


def test_new_branch_step_and_lift(spark):
    lg = long_rows(spark, [
        (date(2024, 1, 1), 10, "1.0", "paid", [100, 80, 0, 60, 50]),      # before: no hint yet
        (date(2024, 1, 2), 10, "1.1", "paid", [200, 180, 90, 140, 100]),  # after
    ])
    f = cm.ba_funnel(lg, spec5(), CMP, include_groups=("hint",))
    t = {r["step_no"]: r for r in cm.ba_detail(f, spec5()).collect()}
    # statistics see the value 0; only the chart has a gap there
    assert t[3]["status"] == "new" and t[3]["lift_pp"] is None and t[3]["before"] == 0.0
    assert f.where("step_no = 3 and period = 'before'").first()["plot_value"] is None
    assert t[2]["status"] == "compared"
    assert t[2]["lift_pp"] == pytest.approx((0.9 - 0.8) * 100)
    s = cm.ba_lift_summary(f).first()
    assert s["steps_compared"] == 4 and s["steps_improved"] == 2   # steps 2 and 4 up by > 0.5 pp
    sig = {r["step_no"]: r for r in cm.ba_significance(f).collect()}
    assert sig[3]["p_label"] == "N/A" and sig[3]["p_value"] == 1.0


def test_branch_step_that_falls_to_zero_is_tested(spark):
    lg = long_rows(spark, [
        (date(2024, 1, 1), 10, "1.0", "paid", [100, 80, 50, 60, 50]),
        (date(2024, 1, 2), 10, "1.1", "paid", [100, 80, 0, 60, 50]),
    ])
    f = cm.ba_funnel(lg, spec5(), CMP, include_groups=("hint",))
    t = {r["step_no"]: r for r in cm.ba_table(f).collect()}
    assert t[3]["status"] == "compared" and t[3]["lift_pp"] == pytest.approx(-50)
    assert t[3]["is_significant"] and t[3]["p_label"] == "p<0.001"


def test_pick_first_and_not_in(spark):
    from cohortflow.operators import cohort as co
    names = spark.createDataFrame([("a", None, "x"), ("a", "zeta", None), ("b", "beta", "y"), ("b", "alpha", "z")],
                                  "cost_data_name string, final_name string, media_type string")
    assert {tuple(r) for r in co.source_name_map(names).collect()} == {("a", None), ("b", "alpha")}
    assert {tuple(r) for r in co.media_type_map(names).collect()} == {
        (None, "x"), ("zeta", None), ("beta", "y"), ("alpha", "z")}
    keys = spark.createDataFrame([("k",), (None,)], "distinct_id string")
    assert co.not_in(keys, keys.where("1 = 0"), "distinct_id").count() == 2
    other = spark.createDataFrame([("z",)], "distinct_id string")
    assert [r[0] for r in co.not_in(keys, other, "distinct_id").collect()] == ["k"]
    assert co.not_in(keys, keys, "distinct_id").count() == 0


def test_uptick_and_known_step(spark):
    lg = long_rows(spark, [(date(2024, 1, 1), 10, "1.0", "paid", [100, 50, 0, 60, 40])])
    # rates are not capped here: step 4 (0.60) is above step 2 (0.50)
    up = al.upticks(lg, [1, 2, 4, 5], min_users=10, tolerance=0.0005, known_steps=(4,)).collect()
    assert [(r["step_no"], r["prev_step_no"], r["status"]) for r in up] == [(4, 2, "Known / Accepted")]
    up2 = al.upticks(lg, [1, 2, 4, 5], min_users=10, tolerance=0.0005, known_steps=()).collect()
    assert up2[0]["status"] == "Investigate"
    assert al.upticks(lg, [1, 2, 4, 5], min_users=1000, tolerance=0.0005, known_steps=()).count() == 0


def test_dropoff_severity(spark):
    lg = long_rows(spark, [(date(2024, 1, 1), 10, "1.0", "paid", [1000, 960, 0, 900, 890])])
    d = {r["step_no"]: r for r in al.biggest_dropoffs(lg, [1, 2, 4, 5], 0).collect()}
    assert d[2]["severity"] == "green"          # 4 % drop
    assert d[4]["severity"] == "yellow"         # 6.25 % drop
    assert d[4]["rank"] == 1 and d[2]["rank"] == 2  # biggest absolute drop (0.06) first


def test_install_alerts(spark):
    lg = long_rows(spark, [
        (date(2024, 1, 1), 10, "1.0", "paid", [900, 1, 0, 1, 1]),
        (date(2024, 1, 1), 11, "1.1", "organic", [40, 1, 0, 1, 1]),
        (date(2024, 1, 1), 12, "1.2", "paid", [60, 1, 0, 1, 1]),
    ])
    wide = lg.filter(F.col("step_no") == 1)
    got = {(r["alert"], r["subject"]) for r in al.install_alerts(wide, 50).collect()}
    assert ("dominant_version", "1.0") in got            # 900 / 1000 > 80 %
    assert ("small_version", "1.1") in got and ("small_version", "1.2") not in got
    assert ("dominant_media_type", "paid") in got         # 960 / 1000 > 70 %


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, v long")
    got = {r["k"]: r["share_pct"] for r in rp.share_of_total(df, "v").collect()}
    assert got == {"a": 25.0, "b": 75.0}


def test_uptick_causes(spark):
    from cohortflow.operators import alerts as al
    ups = spark.createDataFrame([("0.38", 9), ("0.38", 24), ("0.38", 37)], "install_version string, step_no int")
    got = {r.step_no: (r.root_cause, r.suggested_fix) for r in al.explained(ups).collect()}
    assert got == {9: al.UPTICK_CAUSES[9], 24: al.UPTICK_CAUSES[24], 37: al.OTHER_UPTICK}
    own = {r.step_no: r.root_cause for r in al.explained(ups, {37: ("a", "b")}, ("c", "d")).collect()}
    assert own == {9: "c", 24: "c", 37: "a"}


def test_d1_extremes(spark):
    """Ties go to the first version in numeric order; versions without a day-0
    cohort do not count, those without a day 1 have no rate."""
    from cohortflow.operators import retention as rt
    rows = [("ios", v, d, n, k) for v, d, n, k in (
        ("0.9", 0, 10, 10), ("0.9", 1, 10, 5), ("0.10", 0, 10, 10), ("0.10", 1, 10, 5), ("0.8", 0, 10, 9),
        ("0.8", 1, 10, 2), ("0.7", 0, 4, 4), ("0.6", 1, 10, 9))]
    rows += [("web", "0.9", 0, 3, 3)]
    cube = spark.createDataFrame(rows, "platform string, install_version string, days_since_install int, "
                                       "cohort_size long, users_active long")
    got = {r.platform: tuple(r)[1:] for r in rt.d1_extremes(cube).collect()}
    assert got == {"ios": (4, "0.10", 0.5, "0.8", 0.2), "web": (1, None, None, None, None)}


def test_tracking_summary_of_empty_cubes(spark):
    from datetime import date
    from cohortflow.operators import reports as rp
    f = spark.createDataFrame([], "install_date date, install_version string")
    r = spark.createDataFrame([(date(2026, 1, 1), "a"), (date(2026, 1, 1), "b")], "install_date date, install_version string")
    assert tuple(rp.tracking_summary(f, r, date(2026, 1, 1)).first()) == (0, 0, False, 1, 2, True)
