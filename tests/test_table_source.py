"""The production layout (TableSource, events partitioned by date) gives the
same cubes as the adapter over the driver's tables."""

import os
import tempfile
from datetime import date

from conftest import SF001
from cohortflow.config import EngineConfig
from cohortflow.operators import compare, funnel, retention
from cohortflow.plans.steps import demo_funnel
from cohortflow.sources import TableSource, TestdataSource


def test_table_source_matches_adapter(spark):
    base = tempfile.mkdtemp(prefix="cf-warehouse-")
    td = TestdataSource(spark, SF001)
    td.players().write.parquet(os.path.join(base, "players"))
    td.events().write.partitionBy("date").parquet(os.path.join(base, "events"))
    td.source_names().write.parquet(os.path.join(base, "source_names"))
    td.countries().write.parquet(os.path.join(base, "countries"))
    td.exclusions().write.parquet(os.path.join(base, "exclusions"))

    cfg = EngineConfig.for_testdata()
    spec = demo_funnel()
    src = TableSource(spark, base)
    got = funnel.build_funnel(src, cfg, spec).long
    want = funnel.build_funnel(td, cfg, spec).long
    cols = want.columns
    assert got.count() == want.count() > 0
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0

    r1 = retention.build_retention(src, cfg)
    r2 = retention.build_retention(td, cfg)
    assert r1.exceptAll(r2.select(r1.columns)).count() == 0

    cmp = compare.Comparison.around_test_start(cfg, 0.381, 0.3811, date(2024, 1, 1), date(2024, 1, 29))
    table = compare.ba_table(compare.ba_funnel(got, spec, cmp))
    assert table.count() == len(compare.shown_steps(spec))
