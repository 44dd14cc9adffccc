"""Anomaly detection and rule-based alerts.

Every rule is a filter / window over small per-version aggregates of the
cubes; the output is one row per fired rule (alert, subject, value).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.operators.reports import version_key, weighted_by, with_total


# Causes and remedies that the analysed application knows for
# upticks, by step, and what it says of any other.
UPTICK_CAUSES = {
    9: ("Rounding artifact (<0.01%). impression_board and click_board_button_scapes fire at the same millisecond.",
        "No action needed — difference is negligible."),
    24: ("Expected: step 23 (click_scapes_button_board) is time-window constrained to only count clicks during the "
         "FTUE session, while step 24 (ftue_flow2_step0) is an anchor event. Some users reach Flow 2 without the "
         "scapes click registering within the FTUE window.",
         "Acceptable — the constraint on step 23 is working correctly. The gap shows ~2% of users enter Flow 2 "
         "through a slightly different path. No action needed."),
}
OTHER_UPTICK = ("Generic event may fire outside FTUE session window.",
                "Add timestamp constraint to only count this event during the FTUE session.")


def explained(ups: DataFrame, causes: dict[int, tuple[str, str]] | None = None,
              other: tuple[str, str] = OTHER_UPTICK) -> DataFrame:
    """``upticks`` with the root cause and the suggested fix that a register
    holds for the step, or those for any other step."""
    causes = UPTICK_CAUSES if causes is None else causes

    def text(k: int) -> F.Column:
        out = F.lit(other[k])
        for step, entry in causes.items():
            out = F.when(F.col("step_no") == step, F.lit(entry[k])).otherwise(out)
        return out

    return ups.select("*", text(0).alias("root_cause"), text(1).alias("suggested_fix"))


def version_steps(long: DataFrame, steps: list[int], min_users: int = 0) -> DataFrame:
    """Per version x shown step: weighted rate, with the previous shown step's rate."""
    ws = weighted_by(long.filter(F.col("step_no").isin(steps)), ["install_version"])
    users = ws.filter(F.col("step_no") == steps[0]).select("install_version",
                                                           F.col("users").alias("vusers"))
    ws = ws.join(users, "install_version").filter(F.col("vusers") >= min_users)
    w = Window.partitionBy("install_version").orderBy("step_no")
    return (ws.withColumn("prev_step_no", F.lag("step_no").over(w))
            .withColumn("prev_value", F.lag("value").over(w)))


def upticks(long: DataFrame, steps: list[int], min_users: int, tolerance: float,
            known_steps: tuple[int, ...]) -> DataFrame:
    """A rate that goes UP from the previous shown step by more than ``tolerance``."""
    v = version_steps(long, steps, min_users)
    up = v.filter(F.col("prev_value").isNotNull()
                  & (F.col("value") > F.col("prev_value") + F.lit(tolerance)))
    status = F.when(F.col("step_no").isin(list(known_steps)) if known_steps else F.lit(False),
                    F.lit("Known / Accepted")).otherwise(F.lit("Investigate"))
    return up.select("install_version", "step_no", "prev_step_no", "value", "prev_value",
                     ((F.col("value") - F.col("prev_value")) * 100).alias("uptick_pct"),
                     status.alias("status"))


def drops(long: DataFrame, steps: list[int], min_users: int = 0) -> DataFrame:
    v = version_steps(long, steps, min_users).filter(F.col("prev_value") > 0)
    drop_abs = F.col("prev_value") - F.col("value")
    return v.select("install_version", "prev_step_no", "step_no",
                    F.col("prev_value").alias("from_value"), F.col("value").alias("to_value"),
                    drop_abs.alias("drop_abs"), (drop_abs / F.col("prev_value") * 100)
                    .alias("drop_pct"))


def biggest_dropoffs(long: DataFrame, steps: list[int], min_users: int, n: int = 5
                     ) -> DataFrame:
    d = drops(long, steps, min_users)
    w = Window.partitionBy("install_version").orderBy(F.desc("drop_abs"), "step_no")
    sev = (F.when(F.col("drop_pct") > 10, "red").when(F.col("drop_pct") > 5, "yellow")
           .otherwise("green"))
    return (d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .withColumn("severity", sev))


def top_drops_first_version(long: DataFrame, steps: list[int], n: int = 3) -> DataFrame:
    """Top relative drops of the lowest version (numeric order)."""
    d = drops(long, steps)
    first = (long.select("install_version").distinct()
             .agg(F.min_by("install_version", F.struct(version_key(), F.col("install_version")))
                  .alias("install_version")))
    d = d.join(first, "install_version", "left_semi")
    w = Window.partitionBy("install_version").orderBy(F.desc("drop_pct"), "step_no")
    return (d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("install_version", "rank", "step_no", "drop_pct", "to_value"))


def last_step_by_version(long: DataFrame, last_step: int) -> DataFrame:
    ws = weighted_by(long.filter(F.col("step_no") == last_step), ["install_version"])
    return ws.select("install_version", "value", "users")


def best_worst(long: DataFrame, last_step: int) -> DataFrame:
    """Best / lowest end-to-end conversion; ties go to the lower version."""
    v = last_step_by_version(long, last_step)
    k = version_key()
    return v.agg(
        F.max_by("install_version", F.struct(F.col("value"), -k, F.col("install_version")))
        .alias("best_version"),
        F.max("value").alias("best_value"),
        F.min_by("install_version", F.struct(F.col("value"), k, F.col("install_version")))
        .alias("worst_version"),
        F.min("value").alias("worst_value"),
        F.count(F.lit(1)).alias("n_versions"),
    ).withColumn("gap", F.col("best_value") - F.col("worst_value"))


def _rows(df: DataFrame, alert: str, severity: str, subject: F.Column, value: F.Column
          ) -> DataFrame:
    return df.select(F.lit(alert).alias("alert"), F.lit(severity).alias("severity"),
                     subject.cast("string").alias("subject"), value.cast("double").alias("value"))


def funnel_alerts(long: DataFrame, last_step: int, low_sample: int, gap_limit: float = 0.10,
                  completion_limit: float = 0.5) -> DataFrame:
    v = last_step_by_version(long, last_step)
    r1 = _rows(v.filter((F.col("users") > 0) & (F.col("users") < low_sample)),
               "low_sample_version", "yellow", F.col("install_version"), F.col("users"))
    bw = best_worst(long, last_step)
    r2 = _rows(bw.filter((F.col("best_value") > 0) & (F.col("worst_value") > 0)
                         & (F.col("gap") > gap_limit)),
               "best_worst_gap", "red", F.concat_ws(" vs ", "best_version", "worst_version"),
               F.col("gap"))
    low = v.filter((F.col("value") > 0) & (F.col("value") < completion_limit))
    first_low = low.agg(F.min_by(F.struct("install_version", "value"),
                                 F.struct(version_key(), F.col("install_version"))).alias("x"))
    r3 = _rows(first_low.filter(F.col("x").isNotNull()), "low_completion", "yellow",
               F.col("x.install_version"), 1 - F.col("x.value"))
    return r1.unionByName(r2).unionByName(r3)


def trend_alerts(long: DataFrame, steps: list[int], test_start: date,
                 limit_pct: float = 1.0) -> DataFrame:
    """Biggest relative gain / regression of a step's rate, installs from the
    test date vs before (ties: the earlier step).  One global aggregation over
    the per-step summary."""
    from cohortflow.operators.reports import split_summary
    s = split_summary(long, [], test_start, steps)
    change = (F.col("after") - F.col("before")) / F.col("before") * 100
    tested = F.col("before") > 0
    entry = F.struct(change.alias("change_pct"), F.col("step_no").alias("step_no"))
    agg = s.agg(
        F.max_by(entry, F.when(tested, F.struct(change, -F.col("step_no")))).alias("g"),
        F.min_by(entry, F.when(tested, F.struct(change, F.col("step_no")))).alias("d"),
        F.max("users_before").alias("ub"), F.max("users_after").alias("ua"))
    agg = agg.filter((F.col("ub") > 0) & (F.col("ua") > 0))
    gain = _rows(agg.filter(F.col("g.change_pct") > limit_pct), "biggest_improvement", "green",
                 F.col("g.step_no"), F.col("g.change_pct"))
    drop = _rows(agg.filter(F.col("d.change_pct") < -limit_pct), "biggest_regression", "red",
                 F.col("d.step_no"), F.col("d.change_pct"))
    return gain.unionByName(drop)


def install_alerts(cube: DataFrame, small_users: int, dominant_version_pct: float = 80,
                   dominant_media_pct: float = 70) -> DataFrame:
    by_v = with_total(cube.groupBy("install_version").agg(F.sum("total_users").alias("users")),
                      "users")
    share_v = F.col("users") / F.col("_total") * 100
    r7 = _rows(by_v.filter(share_v > dominant_version_pct), "dominant_version", "yellow",
               F.col("install_version"), share_v)
    r8 = _rows(by_v.filter(F.col("users") < small_users), "small_version", "yellow",
               F.col("install_version"), F.col("users"))
    by_m = with_total(cube.filter(F.col("media_type").isNotNull()).groupBy("media_type")
                      .agg(F.sum("total_users").alias("users")), "users")
    top = by_m.agg(F.min_by(F.struct("media_type", "users"),
                            F.struct(-F.col("users"), F.col("media_type"))).alias("x"),
                   F.first("_total").alias("_total"))
    share_m = F.col("x.users") / F.col("_total") * 100
    r9 = _rows(top.filter(F.col("_total") > 0).filter(share_m > dominant_media_pct),
               "dominant_media_type", "yellow", F.col("x.media_type"), share_m)
    return r7.unionByName(r8).unionByName(r9)


def retention_alerts(cube: DataFrame, test_start: date, small_cohort: int,
                     delta_limit: float = 0.02) -> DataFrame:
    before = F.col("install_date") < F.lit(test_start)
    d1 = cube.filter(F.col("days_since_install") == 1)

    def side(cond):
        keep = cond & (F.col("users_active") > 0)
        cs = F.sum(F.when(keep, F.col("cohort_size")))
        ua = F.sum(F.when(keep, F.col("users_active")))
        r = F.when(cs > 0, ua.cast("double") / cs.cast("double")).otherwise(F.lit(0.0))
        n = F.coalesce(F.sum(F.when(cond, F.col("cohort_size"))), F.lit(0))
        return r, n

    rb, nb = side(before)
    ra, na = side(~before)
    v = d1.groupBy("install_version").agg(rb.alias("rb"), nb.alias("nb"), ra.alias("ra"),
                                          na.alias("na"))
    has_post = cube.agg(F.bool_or(~before)).scalar()
    v = v.filter(has_post & (F.col("nb") > 0) & (F.col("na") > 0))
    delta = F.col("ra") - F.col("rb")
    up = _rows(v.filter(delta > delta_limit), "d1_retention_improved", "green",
               F.col("install_version"), delta)
    down = _rows(v.filter(delta < -delta_limit), "d1_retention_dropped", "red",
                 F.col("install_version"), delta)
    d0 = (cube.filter(F.col("days_since_install") == 0).groupBy("install_version")
          .agg(F.sum("cohort_size").alias("cd0")))
    small = _rows(d0.filter((F.col("cd0") > 0) & (F.col("cd0") < small_cohort)),
                  "small_cohort", "yellow", F.col("install_version"), F.col("cd0"))
    return up.unionByName(down).unionByName(small)


