"""Tables by name, with the event log bucketed by user: same cubes, and the
per-user aggregation reads the buckets without shuffling the events."""

from pyspark.sql import functions as F

from conftest import SF001
from cohortflow.config import EngineConfig
from cohortflow.operators import funnel as fu
from cohortflow.plans.steps import demo_funnel
from cohortflow.sources import CatalogSource, TestdataSource, write_bucketed_events


def test_bucketed_catalog_source(spark):
    td = TestdataSource(spark, SF001)
    spark.sql("CREATE DATABASE IF NOT EXISTS cf_wh")
    td.players().write.mode("overwrite").saveAsTable("cf_wh.players")
    write_bucketed_events(td.events(), "cf_wh.events", 4)
    td.source_names().write.mode("overwrite").saveAsTable("cf_wh.source_names")
    td.countries().write.mode("overwrite").saveAsTable("cf_wh.countries")
    td.exclusions().write.mode("overwrite").saveAsTable("cf_wh.exclusions")

    cfg = EngineConfig.for_testdata()
    spec = demo_funnel()
    src = CatalogSource(spark, database="cf_wh")
    got = fu.build_funnel(src, cfg, spec).long
    want = fu.build_funnel(td, cfg, spec).long
    cols = want.columns
    assert got.count() == want.count() > 0
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0

    # per-user anchor aggregation straight from the buckets: no exchange below it
    lo, hi = fu.event_window(cfg)
    agg = src.events(lo, hi).groupBy("distinct_id").agg(F.min("res_timestamp"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount" in plan
