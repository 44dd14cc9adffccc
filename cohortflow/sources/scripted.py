"""The synthetic log as an onboarding log: every event becomes one of the
onboarding script's, so that the 50- and 48-step funnels meet deep users.

The n-th event of a user (by time, then type and dialog) is the n-th of the
script, which repeats; its time is the user's first event plus a minute per
event and ``k mod 40`` seconds.  Fixed exceptions by the event's type and
``k``: ``k mod 50 = 31`` (not the first) is no event of the script, ``k = 95``
comes 45 minutes late, an ``error`` with ``k < 3`` 90 seconds early.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.sources.testdata import TestdataSource

# Events of the analysed application in the order of its
# onboarding, with chapter and dialog id where they matter.
SCRIPT = [
    ("impression_privacy", None, None),
    ("impression_scapes", 1, None),
    ("board_tasks_new_task", None, None),
    ("impression_dialog", None, "1001199"),
    ("click_dialog_exit", None, "1001199"),
    ("impression_ftue_flow1_step0", None, None),
    ("impression_ftue_flow1_step1", None, None),
    ("click_board_button_scapes", None, None),
    ("impression_board", None, None),
    ("impression_ftue_flow1_step2", None, None),
    ("generation", None, None),
    ("impression_ftue_flow1_step3", None, None),
    ("merge", None, None),
    ("impression_ftue_flow1_step4", None, None),
    ("board_tasks_task_ready", None, None),
    ("impression_ftue_flow1_step5", None, None),
    ("click_board_tasks_go", None, None),
    ("rewards_board_task", None, None),
    ("impression_ftue_flow1_step6", None, None),
    ("generation", None, None),
    ("impression_ftue_flow1_step7", None, None),
    ("impression_how_to_play", None, None),
    ("click_scapes_button_board", None, None),
    ("impression_ftue_flow2_step0", None, None),
    ("impression_dialog", None, "10013"),
    ("click_scapes_tasks_go_button", None, None),
    ("scapes_tasks_cash_deducted", None, None),
    ("rewards_scape_task", None, None),
    ("click_dialog_exit", None, "10013"),
    ("impression_ftue_flow2_step1", None, None),
    ("impression_dialog", None, "10015"),
    ("impression_ftue_flow2_step2", None, None),
    ("impression_ship_animation_started", None, None),
    ("impression_ftue_flow2_step5", None, None),
    ("impression_ftue_flow2.1_step0", None, None),
    ("impression_ftue_flow2.1_step1", None, None),
    ("impression_ftue_flow3_step0", None, None),
    ("scapes_tasks_new_chapter", 2, None),
    ("impression_ftue_flow3_step1", 2, None),
    ("impression_ftue_flow3_step2", 2, None),
    ("impression_ftue_flow3_step3", 2, None),
    ("click_harvest_collect", 2, None),
    ("impression_ftue_flow3_step6", 2, None),
    ("impression_ftue_flow3_step7", 2, None),
    ("click_reward_center", None, None),
    ("impression_ftue_flow3_step8", 2, None),
    ("impression_ftue_flow3_step9", 2, None),
    ("impression_ftue_flow12_step0", None, None),
    ("impression_ftue_flow12_step4", None, None),
    ("scapes_tasks_new_chapter", 3, None),
    ("click_harvest_collect", 3, None),
    ("scapes_tasks_new_chapter", 4, None),
    ("scapes_tasks_new_chapter", 5, None),
]


class ScriptedSource(TestdataSource):
    """The test tables with the scripted event log.  Ranking a user's events
    is part of this mapping only, the funnel itself does not rank."""

    __test__ = False

    def events(self, start: date | None = None, end: date | None = None,
               names: list[str] | None = None) -> DataFrame:
        raw = super().events()
        user = Window.partitionBy("distinct_id")
        n = F.row_number().over(user.orderBy("res_timestamp", "mp_event_name", "dialog_id")) - 1
        k = F.coalesce(F.col("dialog_id").cast("int"), F.lit(1))
        script = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(c).cast("int").alias("c"),
                                    F.lit(d).cast("string").alias("d")) for e, c, d in SCRIPT])
        ev = raw.select("distinct_id", F.col("mp_event_name").alias("kind"), k.alias("k"), n.alias("n"),
                        F.min("res_timestamp").over(user).alias("base"))
        ev = ev.withColumn("s", F.element_at(script, F.pmod("n", F.lit(len(SCRIPT))) + 1))
        t = (F.col("base") + F.col("n") * 60_000 + F.pmod("k", F.lit(40)) * 1000
             + F.when(F.col("k") == 95, 45 * 60_000).otherwise(0)
             - F.when((F.col("kind") == "error") & (F.col("k") < 3), 90_000).otherwise(0))
        lost = (F.pmod("k", F.lit(50)) == 31) & (F.col("n") > 0)
        out = ev.select(
            "distinct_id", F.when(lost, F.lit("other")).otherwise(F.col("s.e")).alias("mp_event_name"),
            t.cast("long").alias("res_timestamp"), F.to_date(F.timestamp_millis(t.cast("long"))).alias("date"),
            F.col("s.c").alias("chapter"), F.col("s.d").alias("dialog_id"))
        if start is not None:
            out = out.filter(F.col("date") >= F.lit(start))
        if end is not None:
            out = out.filter(F.col("date") <= F.lit(end))
        return out if names is None else out.filter(F.col("mp_event_name").isin(list(names)))
