"""Golden values computed by hand or from public formulas (FIXTURES.md §5)."""

import pytest
from pyspark.sql import functions as F

from cohortflow.functions.columns import exact_ratio_e, version_num
from cohortflow.functions.stats import with_significance
from cohortflow.operators import filters as fi
from cohortflow.operators import metrics as me


def test_running_min(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.95), (4, 0.5)], "step_no int, value double")
    out = me.running_min(df.withColumn("g", F.lit(1)), ["g"], "value", out="capped")
    assert [r["capped"] for r in out.orderBy("step_no").collect()] == [1.0, 0.9, 0.9, 0.5]


def test_weighted_conversion(spark):
    # weights 100, 50, NULL; rates .5, NULL, NULL -> (0.5*100) / 150
    df = spark.createDataFrame([(5000, 0.5, 100), (None, None, 50), (None, None, None)],
                               "pct_e4 long, pct double, raw_step_01 long")
    v = df.agg(me.weighted_value("pct").alias("v")).first()["v"]
    assert v == pytest.approx(1 / 3, abs=1e-10)
    df2 = spark.createDataFrame([(9000, 0.9, 100), (8000, 0.8, 50)],
                                "pct_e4 long, pct double, raw_step_01 long")
    assert df2.agg(me.weighted_value("pct").alias("v")).first()["v"] == pytest.approx(0.8666666667)
    # zero weight: plain mean of the rates
    df3 = spark.createDataFrame([(9000, 0.9, 0), (8000, 0.8, 0)],
                                "pct_e4 long, pct double, raw_step_01 long")
    assert df3.agg(me.weighted_value("pct").alias("v")).first()["v"] == pytest.approx(0.85)


@pytest.mark.parametrize("pb,nb,pa,na,chi2,p,sig,label", [
    (0.5, 100, 0.6, 100, 1.6363636364, 0.2008251, False, "p=0.20"),
    (0.5, 1000, 0.6, 1000, 19.8, 8.598e-06, True, "p<0.001"),
    (0.54, 150, 0.4166666666666667, 120, 3.5811068702, 0.0584402, False, "p=0.06"),
    (0.5, 9, 0.6, 100, None, 1.0, False, "N/A"),
    (1.0, 100, 1.0, 100, None, 1.0, False, "N/A"),
])
def test_significance(spark, pb, nb, pa, na, chi2, p, sig, label):
    df = spark.createDataFrame([(pb, nb, pa, na)], "b double, nb long, a double, na long")
    r = with_significance(df, "b", "nb", "a", "na", 10).first()
    if chi2 is None:
        assert r["chi2"] is None
    else:
        assert r["chi2"] == pytest.approx(chi2, rel=1e-9)
    assert r["p_value"] == pytest.approx(p, rel=2e-6)
    assert r["is_significant"] is sig
    assert r["p_label"] == label


def test_dropoff(spark):
    vals = [1, .9, .9, .45, 0, 0]
    df = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(vals)],
                               "step_no int, value double").withColumn("g", F.lit(1))
    out = me.dropoff(df, ["g"]).orderBy("step_no").collect()
    assert [round(r["drop_rate"], 10) for r in out] == [0.1, 0.0, 0.5, 1.0, 0.0]


def test_versions_at_least(spark):
    df = spark.createDataFrame([("0.3811",), ("0.3812",), ("0.382",), ("abc",)], "install_version string")
    got = sorted(r[0] for r in fi.versions_at_least(df, "0.3812").collect())
    assert got == ["0.3812", "0.382"]
    assert fi.versions_at_least(df, "not-a-number").count() == 4


def test_version_num_rejects_suffixes(spark):
    df = spark.createDataFrame([("0.38",), ("0.38f",), (" 0.4 ",), ("1e-1",), (None,)], "v string")
    got = [r[0] for r in df.select(version_num("v")).collect()]
    assert got == [0.38, None, 0.4, 0.1, None]


def test_exact_rounding_half_up(spark):
    # 1/160 = 0.00625 -> 0.0063 (exact rational, half up); 1/3 -> 0.3333; d = 0 -> NULL
    df = spark.createDataFrame([(1, 160), (1, 3), (2, 3), (5, 0), (7, 7)], "n long, d long")
    got = [r[0] for r in df.select(exact_ratio_e(F.col("n"), F.col("d"))).collect()]
    assert got == [63, 3333, 6667, None, 10000]


def test_date_hour_window(spark):
    from datetime import date
    rows = [(date(2024, 1, 1), 5), (date(2024, 1, 1), 6), (date(2024, 1, 2), 23),
            (date(2024, 1, 3), 18), (date(2024, 1, 3), 19), (date(2024, 1, 3), None)]
    df = spark.createDataFrame(rows, "install_date date, install_hour int")
    out = fi.date_hour_window(df, date(2024, 1, 1), date(2024, 1, 3), 6, 18).collect()
    got = sorted((r[0].day, r[1]) for r in out if r[1] is not None)
    assert got == [(1, 6), (2, 23), (3, 18)]
    # NULL hour on a boundary date is kept (pandas keeps NaN rows when negating)
    assert any(r[1] is None for r in out)
