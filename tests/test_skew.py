"""A user holding a third of all events: results stay exact and AQE splits
the hot partition of the events x anchors join."""

from datetime import date, datetime

from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.operators import funnel as fu
from cohortflow.plans.steps import demo_funnel
from cohortflow.session import prepare
from cohortflow.sources.frames import FrameSource

DAY = 86_400_000
T0 = int(datetime(2024, 1, 2).timestamp() * 1000)


def test_hot_user_split_and_exact(spark):
    prepare(spark)
    n_users, n_cold = 300, 20
    names = ["signup", "view", "click", "purchase", "error"]
    rows = []
    for u in range(n_users):
        for i in range(n_cold):
            rows.append((u, names[i % 5], T0 + u * 1000 + i * 60_000))
    hot = [(0, names[i % 5], T0 + 2 * DAY + i) for i in range(len(rows) // 2)]
    ev = spark.createDataFrame(rows + hot, "distinct_id long, mp_event_name string, res_timestamp long") \
        .withColumn("date", F.to_date(F.timestamp_millis("res_timestamp"))) \
        .withColumn("chapter", F.lit(1)).withColumn("dialog_id", F.lit("1"))
    players = spark.createDataFrame(
        [(u, date(2024, 1, 2), datetime(2024, 1, 2), "0.3812", "ios", "DE", None) for u in range(n_users)],
        "distinct_id long, install_date date, first_event_time timestamp, first_app_version string, "
        "first_platform string, first_country string, first_mediasource string")
    src = FrameSource(players, ev,
                      spark.createDataFrame([("a", "b", "c")], "cost_data_name string, final_name string, media_type string"),
                      spark.createDataFrame([("DE", False)], "country_code string, is_low_payers_country boolean"),
                      spark.createDataFrame([(-1,)], "distinct_id long"))
    cfg = EngineConfig(as_of=date(2024, 1, 31))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",     # as get_session sets it
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        b = fu.build_funnel(src, cfg, demo_funnel())
        flags = b.flags
        got = {r["distinct_id"]: r for r in flags.collect()}
        plan = flags._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
        assert len(got) == n_users
        # every user passes signup; the hot user passes the 48h steps too
        assert all(r["step_01"] == 1 for r in got.values())
        assert got[0]["step_02"] == 1
        window = fu.build_funnel(src, cfg, demo_funnel(), strategy="window").flags
        cols = ["distinct_id"] + [fu.step_col(s.no) for s in demo_funnel().steps]
        assert flags.select(cols).exceptAll(window.select(cols)).count() == 0
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
