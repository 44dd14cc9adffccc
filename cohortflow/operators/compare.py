"""Before/after comparison over the published cubes.

The reference loops over versions and steps in pandas; here every variant is
one lazy plan: tag cube rows with ``period`` (a row may belong to both
periods when the windows overlap: two filtered copies, unioned), aggregate
once per (period, step), pivot the two periods side by side and compute the
lift / significance columns.  Results have at most (#steps x 2) rows, the
heavy lifting is the cube scan and one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.functions.columns import version_sort_key
from cohortflow.functions.stats import with_significance
from cohortflow.operators.metrics import weighted_value
from cohortflow.operators.rollup import is_rollup
from cohortflow.plans.steps import FunnelSpec


@dataclass(frozen=True)
class Period:
    min_version: float
    start: date
    end: date
    start_hour: int = 0
    end_hour: int = 23


@dataclass(frozen=True)
class Comparison:
    before: Period
    after: Period

    @staticmethod
    def around_test_start(cfg: EngineConfig, before_min_version: float,
                          after_min_version: float, first_date: date,
                          last_date: date) -> "Comparison":
        """The reference's defaults: before ends the hour before the test
        start (the whole start day when it starts at hour 0), after runs from
        the test start to the last date."""
        ts: datetime = cfg.test_start
        end_h = ts.hour - 1 if ts.hour > 0 else 23
        return Comparison(Period(before_min_version, first_date, ts.date(), 0, end_h),
                          Period(after_min_version, ts.date(), last_date, ts.hour, 23))


def tag_periods(cube: DataFrame, cmp: Comparison, version_col: str = "install_version",
                hours: bool = True) -> DataFrame:
    """Adds ``period``; a row inside both windows is emitted once per period
    (one pass: an array of matching periods, exploded)."""
    def inside(p: Period) -> F.Column:
        c = version_sort_key(version_col) >= F.lit(p.min_version)
        d = F.col("install_date")
        c = c & d.between(F.lit(p.start), F.lit(p.end))
        if hours:
            h = F.col("install_hour")
            c = c & ~F.coalesce((d == F.lit(p.start)) & (h < p.start_hour), F.lit(False))
            c = c & ~F.coalesce((d == F.lit(p.end)) & (h > p.end_hour), F.lit(False))
        return F.coalesce(c, F.lit(False))

    b, a = inside(cmp.before), inside(cmp.after)
    periods = F.array_compact(F.array(F.when(b, F.lit("before")), F.when(a, F.lit("after"))))
    return cube.filter(b | a).withColumn("period", F.explode(periods))


def shown_steps(spec: FunnelSpec, include_groups: tuple[str, ...] = ()) -> list[int]:
    shown = set(include_groups)
    return [s.no for s in spec.steps if s.group not in spec.hidden_groups or s.group in shown]


def ba_users(long: DataFrame, cmp: Comparison) -> DataFrame:
    """Installs per (period, version) inside each period's window."""
    first = long.filter(F.col("step_no") == 1)
    return (tag_periods(first, cmp).groupBy("period", "install_version")
            .agg(F.sum("total_users").alias("users"), F.sum("raw_step_01").alias("step1")))


def ba_funnel(long: DataFrame, spec: FunnelSpec, cmp: Comparison, metric: str = "pct",
              include_groups: tuple[str, ...] = (), cap: str = "spine") -> DataFrame:
    """Per (period, step): step-1-weighted rate, capped by a running minimum.
    ``plot_value`` is NULL where an optional branch has 0 (a gap in the
    chart); statistics use ``value``, which stays numeric.

    ``cap="spine"`` caps along the spine only (branch steps keep their value);
    ``cap="reference"`` caps along every shown step in order, branch included,
    as the analysed dashboard does (a 0 on a branch then zeroes the rest)."""
    steps = shown_steps(spec, include_groups)
    branch = [s.no for s in spec.steps if s.branch]
    sub = tag_periods(long.filter(F.col("step_no").isin(steps)), cmp)
    agg = sub.groupBy("period", "step_no").agg(
        weighted_value(metric, is_rollup(long)).alias("raw_value"),
        F.sum("total_users").alias("users"), F.sum("raw_step_01").alias("step1"))
    is_branch = F.col("step_no").isin(branch) if branch else F.lit(False)
    if cap == "reference":
        w = (Window.partitionBy("period").orderBy("step_no")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        capped = F.min("raw_value").over(w)
    else:
        w = (Window.partitionBy("period", is_branch).orderBy("step_no")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        capped = F.when(is_branch, F.col("raw_value")).otherwise(F.min("raw_value").over(w))
    plot = F.when(is_branch & (capped == 0), F.lit(None).cast("double")).otherwise(capped)
    return agg.select("period", "step_no", "raw_value", capped.alias("value"),
                      plot.alias("plot_value"), "users", "step1", is_branch.alias("is_branch"))


def side_by_side(funnel: DataFrame) -> DataFrame:
    """One row per step: before/after values and sample sizes (a pivot on
    period by conditional aggregation; no self-join)."""
    def pick(col, p):
        return F.max(F.when(F.col("period") == p, F.col(col)))
    return funnel.groupBy("step_no").agg(
        F.bool_or("is_branch").alias("is_branch"),
        pick("value", "before").alias("before"), pick("value", "after").alias("after"),
        pick("step1", "before").alias("n_before"), pick("step1", "after").alias("n_after"),
        pick("users", "before").alias("users_before"), pick("users", "after").alias("users_after"))


def ba_table(funnel: DataFrame, min_n: int = 10) -> DataFrame:
    """Side-by-side values with lift, status and significance columns."""
    s = side_by_side(funnel)
    before0 = F.coalesce(F.col("before"), F.lit(0.0))
    new_step = F.col("is_branch") & (before0 == 0)
    diff = F.col("after") - F.col("before")
    lift = F.when(~new_step, diff * 100)
    s = with_significance(s, "before", "n_before", "after", "n_after", min_n)
    tested = F.coalesce(F.col("before") > 0, F.lit(False))
    status = (F.when(new_step, "new").when(F.col("before") > 0, "compared").otherwise("na"))
    return s.select(
        "*",
        F.when(~new_step, diff).alias("delta"),
        lift.alias("lift_pp"),
        F.when(~new_step & (F.col("before") > 0), diff / F.col("before") * 100)
        .alias("rel_lift_pct"),
        F.when(lift > 0.1, "up").when(lift < -0.1, "down").otherwise("neutral").alias("direction"),
        status.alias("status"),
    ).withColumn("chi2", F.when(tested, F.col("chi2"))) \
        .withColumn("p_value", F.when(tested, F.col("p_value")).otherwise(F.lit(1.0))) \
        .withColumn("is_significant", F.when(tested, F.col("is_significant")).otherwise(F.lit(False))) \
        .withColumn("p_label", F.when(tested, F.col("p_label")).otherwise(F.lit("N/A")))


def ba_lift(funnel: DataFrame) -> DataFrame:
    return ba_table(funnel).select("step_no", "before", "after", "delta", "lift_pp",
                                   "rel_lift_pct", "direction")


def ba_significance(funnel: DataFrame, min_n: int = 10) -> DataFrame:
    return ba_table(funnel, min_n).select("step_no", "before", "after", "n_before", "n_after",
                                          "chi2", "p_value", "is_significant", "p_label")


def ba_lift_summary(funnel: DataFrame, min_n: int = 10) -> DataFrame:
    t = ba_table(funnel, min_n)
    counted = F.col("lift_pp").isNotNull()
    return t.agg(
        F.avg("lift_pp").alias("avg_lift_pp"),
        F.count_if(F.col("lift_pp") > 0.5).alias("steps_improved"),
        F.count_if(F.col("lift_pp") < -0.5).alias("steps_declined"),
        F.count_if(counted).alias("steps_compared"),
        F.max_by(F.col("lift_pp"), F.when(counted, F.col("step_no"))).alias("last_step_lift_pp"),
        F.count_if(F.col("is_significant")).alias("significant_steps"),
    )


def ba_detail(funnel: DataFrame, spec: FunnelSpec, min_n: int = 10) -> DataFrame:
    t = ba_table(funnel, min_n)
    names = F.create_map(*[x for s in spec.steps for x in (F.lit(s.no), F.lit(s.name))])
    label = F.concat(F.lpad(F.col("step_no").cast("string"), 2, "0"), F.lit(": "),
                     F.element_at(names, F.col("step_no")))
    compared = F.col("status") == "compared"
    return t.select(
        "step_no", label.alias("step_label"), "before", "after",
        F.when(compared, F.col("delta")).alias("delta"),
        F.when(compared, F.col("lift_pp")).alias("lift_pp"),
        F.when(compared, F.col("p_label")).alias("p_label"),
        F.when(compared, F.col("is_significant")).alias("is_significant"),
        "status")


def ba_start_finish(funnel: DataFrame) -> DataFrame:
    """Per period: users started, last-step rate, estimated completions."""
    spine = funnel.filter(~F.col("is_branch"))
    return spine.groupBy("period").agg(
        F.max("users").alias("started_users"),
        F.max_by("value", "step_no").alias("finish_rate"),
    ).withColumn("completed_users", F.col("started_users") * F.col("finish_rate"))


def dropoff_transitions(funnel: DataFrame) -> DataFrame:
    """Per period, transition of shown steps i -> next (shown branch steps
    included): relative drop of the capped rate."""
    spine = funnel
    w = Window.partitionBy("period").orderBy("step_no")
    out = (spine.withColumn("next_step_no", F.lead("step_no").over(w))
           .withColumn("next_value", F.lead("value").over(w))
           .filter(F.col("next_step_no").isNotNull()))
    rate = F.when(F.col("value") > 0, (F.col("value") - F.col("next_value")) / F.col("value")) \
        .otherwise(F.lit(0.0))
    return out.select("period", "step_no", "next_step_no", "value", "next_value",
                      rate.alias("drop_rate"))


def ba_retention(cube: DataFrame, cmp: Comparison, days: range = range(1, 15)) -> DataFrame:
    """Per version x day: before/after weighted retention, cohorts, delta, relative.

    One conditional aggregation per (version, day) gives both periods; a
    version that has rows in a period but none on some day reports a zero
    cohort for that day (the grid of days per version is one explode)."""
    tagged = tag_periods(cube, cmp, hours=False)
    is_b, is_a = F.col("period") == "before", F.col("period") == "after"
    active = F.col("users_active") > 0

    def side(cond):
        cs = F.sum(F.when(cond & active, F.col("cohort_size")))
        ua = F.sum(F.when(cond & active, F.col("users_active")))
        return F.when(cs > 0, ua.cast("double") / cs.cast("double")).otherwise(F.lit(0.0)), cs

    rb, nb = side(is_b)
    ra, na = side(is_a)
    per_day = (tagged.filter(F.col("days_since_install").isin(list(days)))
               .groupBy("install_version", "days_since_install")
               .agg(rb.alias("r_before"), nb.alias("n_before"), ra.alias("r_after"),
                    na.alias("n_after")))
    grid = (tagged.groupBy("install_version")
            .agg(F.bool_or(is_b).alias("hb"), F.bool_or(is_a).alias("ha"))
            .withColumn("days_since_install",
                        F.explode(F.sequence(F.lit(min(days)), F.lit(max(days))))))
    g = grid.join(per_day, ["install_version", "days_since_install"], "left")
    nb = F.when(F.col("hb"), F.coalesce(F.col("n_before"), F.lit(0)))
    na = F.when(F.col("ha"), F.coalesce(F.col("n_after"), F.lit(0)))
    rb = F.coalesce(F.col("r_before"), F.lit(0.0))
    ra = F.coalesce(F.col("r_after"), F.lit(0.0))
    both = (nb > 0) & (na > 0)
    return g.select(
        "install_version", F.col("days_since_install").cast("int").alias("day"),
        F.when(nb > 0, rb).alias("before"), nb.cast("long").alias("cohort_before"),
        F.when(na > 0, ra).alias("after"), na.cast("long").alias("cohort_after"),
        F.when(both, ra - rb).alias("delta"),
        F.when(both & (rb > 0), (ra - rb) / rb).alias("relative"))


def ba_retention_daily(cube: DataFrame, test_start: date, days: range = range(1, 15)
                       ) -> DataFrame:
    """Per version x day: retention of installs before vs on/after the test date."""
    sub = cube.filter(F.col("days_since_install").isin(list(days)))
    before = F.col("install_date") < F.lit(test_start)
    act = F.col("users_active") > 0

    def rate(side):
        cs = F.sum(F.when(side & act, F.col("cohort_size")))
        ua = F.sum(F.when(side & act, F.col("users_active")))
        return F.when(cs > 0, ua.cast("double") / cs.cast("double")).otherwise(F.lit(0.0)), cs

    rb, nb = rate(before)
    ra, na = rate(~before)
    agg = sub.groupBy("install_version", "days_since_install").agg(
        rb.alias("rb"), nb.alias("nb"), ra.alias("ra"), na.alias("na"))
    nbc = F.coalesce(F.col("nb"), F.lit(0))
    nac = F.coalesce(F.col("na"), F.lit(0))
    return agg.select(
        "install_version", F.col("days_since_install").alias("day"),
        F.when(nbc > 0, F.col("rb")).alias("before"),
        F.when(nac > 0, F.col("ra")).alias("after"),
        F.when((nbc > 0) & (nac > 0), F.col("ra") - F.col("rb")).alias("delta"))
