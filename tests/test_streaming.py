"""The streaming refresher publishes the same cubes as a batch rebuild."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from cohortflow.config import EngineConfig
from cohortflow.operators import funnel as fu
from cohortflow.plans.steps import demo_funnel
from cohortflow.sources import FrameSource, TestdataSource
from cohortflow.sources import cube_store
from cohortflow.streaming import refresh_stream


def test_refresh_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="cf-stream-")
    td = TestdataSource(spark, SF001)
    cfg = EngineConfig.for_testdata()
    spec = demo_funnel()
    events = td.events()
    events.write.partitionBy("date").parquet(os.path.join(base, "events"))
    landed = spark.read.parquet(os.path.join(base, "events"))

    def make_source():
        ev = spark.read.parquet(os.path.join(base, "events"))
        return FrameSource(td.players(), ev, td.source_names(), td.countries(), td.exclusions())

    q = refresh_stream(spark, os.path.join(base, "events"), landed.schema, make_source, cfg,
                       spec, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    got = cube_store.load(spark, os.path.join(base, "out", "funnel_cube"))
    want = fu.build_funnel(td, cfg, spec).wide
    cols = sorted(want.columns)
    assert got.count() == want.count() > 0
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    ret = cube_store.load(spark, os.path.join(base, "out", "retention_cube"))
    assert ret.filter(F.col("days_since_install") == 0).count() > 0
