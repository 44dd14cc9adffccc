"""Step counts from the histogram of depths equal the sums of flags."""

import random

from conftest import SF001
from planmetrics import exchanged_rows
from cohortflow.config import EngineConfig
from cohortflow.operators import funnel as fu
from cohortflow.operators.cohort import COHORT_DIMS
from cohortflow.plans.steps import demo_funnel, main_funnel
from cohortflow.sources import TestdataSource


def users(spark, spec, n=3000):
    rng = random.Random(7)
    steps = [fu.step_col(s.no) for s in spec.steps]
    rows = []
    for i in range(n):
        stop = rng.randint(0, len(steps))
        flags = [int(k < stop or rng.random() < 0.1) for k in range(len(steps))]
        rows.append((i, rng.choice(["a", "b", None]), *flags))
    df = spark.createDataFrame(rows, "distinct_id long, platform string, " + ", ".join(f"{s} int" for s in steps))
    src = TestdataSource(spark, SF001)
    from pyspark.sql import functions as F
    types = dict(fu.cohort_from_source(src, EngineConfig.for_testdata()).dtypes)
    other = {c: F.lit(None).cast(types[c]) for c in COHORT_DIMS if c != "platform"}
    return df.withColumns(other), src.source_names()


def test_both_ways_agree(spark):
    for spec in (demo_funnel(), main_funnel()):
        flags, names = users(spark, spec)
        mono = fu.monotonic(flags, spec)
        rows = lambda how: sorted(map(str, fu.cube_counts(mono, mono, spec, names, how).collect()))
        assert rows("histogram") == rows("sums") and rows("sums")


def test_steps_do_not_rise_along_the_spine(spark):
    spec = main_funnel()
    flags, names = users(spark, spec)
    mono = fu.monotonic(flags, spec)
    for r in fu.cube_counts(mono, mono, spec, names).collect():
        spine = [r[fu.step_col(s.no)] for s in spec.spine]
        assert spine == sorted(spine, reverse=True) and spine[0] <= r.total_users


def test_rows_moved_are_cells_and_depths(spark):
    spec = main_funnel()
    flags, _ = users(spark, spec)
    hist = fu.depth_histogram(fu.monotonic(flags.repartition(2), spec), spec)
    hist.collect()
    assert min(exchanged_rows(hist)) <= 2 * 3 * (len(spec.spine) + 1) * 4
