"""The daily build from the command line publishes partitioned cubes."""

import os
import tempfile

from conftest import SF001
from cohortflow.__main__ import main
from cohortflow.sources import cube_store


def newest_folder(path: str) -> str:
    """The snapshot folder that a published table was written to last."""
    data = os.path.join(path, "data")
    return max((os.path.join(data, d) for d in os.listdir(data)), key=os.path.getmtime)


def test_cli_build_demo(spark, capsys):
    out = os.path.join(tempfile.mkdtemp(prefix="cf-cli-"), "cubes")
    main(["build", "--demo", SF001, "--out", out])
    printed = capsys.readouterr().out
    assert "funnel_cube" in printed and "retention_cube" in printed
    funnel = cube_store.load(spark, os.path.join(out, "funnel_cube"))
    retention = cube_store.load(spark, os.path.join(out, "retention_cube"))
    assert funnel.count() > 0 and retention.count() > 0
    assert "install_date" in funnel.columns and "pct_01_signup" in funnel.columns
    assert any(d.startswith("install_date=") for d in os.listdir(newest_folder(os.path.join(out, "funnel_cube"))))


def test_operators_run_on_the_published_folder(spark):
    """A build, then comparison, reports and alerts from the folder alone."""
    from cohortflow.config import EngineConfig
    from cohortflow.operators import alerts, compare, reports
    from cohortflow.plans.steps import demo_funnel
    from cohortflow.streaming.refresh import load_long
    out = os.path.join(tempfile.mkdtemp(prefix="cf-cli-"), "cubes")
    main(["build", "--demo", SF001, "--out", out])
    spec, cfg = demo_funnel(), EngineConfig.for_testdata()
    long = load_long(spark, out, spec)
    steps = compare.shown_steps(spec)
    cmp = compare.Comparison.around_test_start(cfg, 0.381, 0.3811, cfg.cube_start, cfg.as_of)
    assert compare.ba_table(compare.ba_funnel(long, spec, cmp)).count() == len(steps)
    assert reports.version_funnel(long, steps, metric="ratio").count() > 0
    assert alerts.funnel_alerts(long, steps[-1], 10).columns == ["alert", "severity", "subject", "value"]


def test_publish_replaces(spark):
    from datetime import date
    path = os.path.join(tempfile.mkdtemp(prefix="cf-publish-"), "t")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    days = [date(2024, 1, d) for d in (1, 2, 3, 4)]
    rows = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "install_date date, v int")
    got = lambda: {r[0] for r in cube_store.load(spark, path).select("install_date").collect()}
    cube_store.publish(rows, path)
    assert got() == set(days)
    # a range: the emptied date goes, dates outside stay
    cube_store.publish(rows.where("v = 1"), path, replace_range=(days[1], days[2]))
    assert got() == {days[0], days[1], days[3]}
    cube_store.publish(rows.where("v = 1"), path)
    assert got() == {days[1]}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    many = spark.range(0, 4000, 1, 16).selectExpr("date_add(DATE'2024-01-01', cast(id % 5 as int)) AS install_date", "id AS v")
    cube_store.publish(many, path)
    top = newest_folder(path)
    days = [d for d in os.listdir(top) if d.startswith("install_date=")]
    assert len(days) == 5 and all(
        len([f for f in os.listdir(os.path.join(top, d)) if f.endswith(".parquet")]) == 1 for d in days)
