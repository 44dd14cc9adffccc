"""The id filter lets every cohort user through, and few others."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from planmetrics import exchanged_rows
from cohortflow.config import EngineConfig
from cohortflow.operators import idfilter as bf
from cohortflow.operators import shared as sh
from cohortflow.plans.steps import demo_funnel
from cohortflow.sources import TestdataSource

CFG = EngineConfig.for_testdata()


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("n", [1, 3, 100, 5000])
def test_no_id_is_lost_and_few_others_pass(spark, n, kind):
    ids = spark.range(n).select(F.col("id").cast(kind).alias("distinct_id"))
    rows = spark.range(40_000).select(F.col("id").cast(kind).alias("distinct_id"))
    kept = bf.restrict(rows, ids, n, false_share=0.02)
    assert kept.join(ids, "distinct_id", "left_semi").count() == n
    shape = bf.BloomShape.of(n, 0.02)
    others = kept.count() - n
    assert others <= max(12, 2 * shape.expected_false_share(n) * 40_000 + 40)


def test_no_ids_and_null_ids(spark):
    none = spark.createDataFrame([], "distinct_id long")
    some = spark.createDataFrame([(1,), (None,)], "distinct_id long")
    assert bf.restrict(some, none, 0).count() == 0
    assert [r[0] for r in bf.restrict(some, some, 2).collect()] == [1]
    assert bf.restrict(none, some, 2).count() == 0


def test_size_is_bounded(spark):
    assert bf.BloomShape.of(10**6, 0.02).bits <= 8.3 * 10**6
    assert bf.BloomShape.of(10**9, 0.02) is None
    rows = spark.range(100).withColumnRenamed("id", "distinct_id")
    assert bf.restrict(rows, rows.limit(1), 1, max_bits=0).count() == 100      # too large: no filter


def test_rows_into_the_first_exchange(spark, tmp_path):
    """Of 20,000 users in the log 200 are players: about as many are moved."""
    spark.range(20_000).select((F.col("id") % 20_000).alias("distinct_id"), F.lit(1).alias("x")).repartition(
        2).write.parquet(str(tmp_path / "log"))
    spark.range(0, 20_000, 100).withColumnRenamed("id", "distinct_id").write.parquet(str(tmp_path / "ids"))
    log, ids = spark.read.parquet(str(tmp_path / "log")), spark.read.parquet(str(tmp_path / "ids"))
    plain = log.groupBy("distinct_id").agg(F.sum("x").alias("x"))
    kept = bf.restrict(log, ids, ids.count()).groupBy("distinct_id").agg(F.sum("x").alias("x"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    a, b = sorted(map(tuple, plain.join(ids, "distinct_id").collect())), sorted(map(tuple, kept.join(ids, "distinct_id").collect()))
    assert a == b and len(a) == 200
    plain.collect(), kept.collect()
    assert max(exchanged_rows(plain)) >= 20_000 and 200 <= max(exchanged_rows(kept)) <= 200 + 3 * 0.02 * 20_000
    assert spark.conf.get(key) == old


def test_cubes_are_the_same(spark):
    src = TestdataSource(spark, SF001)
    runs, keep = [sh.FunnelRun.main(CFG, demo_funnel())], sh.Retention.of(CFG)
    rows = lambda d: sorted(map(str, d.collect()))
    a = sh.build_all(src, CFG, runs, keep)
    b = sh.build_all(src, CFG, runs, keep, cohort_filter=True)
    assert rows(a.counts["funnel"]) == rows(b.counts["funnel"]) and rows(a.retention) == rows(b.retention)
