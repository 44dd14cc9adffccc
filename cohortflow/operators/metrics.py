"""Weighted conversion metrics over the long funnel cube.

The reference averages the per-cell *rounded* rates weighted by the cell's
step-1 users (``raw_step_01``), falling back to a plain mean when the weight
sum is zero.  Because the cube keeps each rate as an exact integer
(``pct_e4`` = rate x 10^4), the weighted mean is one exact integer ratio:

    sum(pct_e4 * raw_step_01) / (10^4 * sum(raw_step_01))

so every grouping gives the same double regardless of summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.operators.rollup import is_rollup


def metric_e4(metric: str) -> str:
    if metric not in ("pct", "ratio"):
        raise ValueError("metric must be 'pct' or 'ratio'")
    return f"{metric}_e4"


def weighted_value(metric: str = "pct", rolled: bool = False, where: Column | None = None) -> Column:
    """Aggregate expression: step-1-weighted mean of a cube rate, over the rows
    of ``where``.  ``rolled``: over a rollup's sums instead of cells."""
    e, w = metric_e4(metric), F.col("raw_step_01")

    def over(x: Column) -> Column:
        return x if where is None else F.when(where, x)

    den = F.sum(over(w))
    if rolled:
        num = F.sum(over(F.col(f"{metric}_num")))
        plain = F.try_divide(F.sum(over(F.col(f"{metric}_sum"))), F.sum(over(F.col(f"{metric}_n"))) * 10000)
    else:
        num = F.sum(over(F.coalesce(F.col(e), F.lit(0)) * w))
        plain = F.avg(over(F.col(metric)))
    return (F.when(den > 0, num.cast("double") / (den * 10000).cast("double"))
            .otherwise(F.coalesce(plain, F.lit(0.0))))


def exact_value(metric: str = "pct") -> Column:
    """Aggregate expression, exact mode: pooled counts instead of re-weighted
    rounded rates - sum(users) / sum(step-1 users) for ``pct``,
    sum(users) / sum(previous-step users) for ``ratio`` (1.0 for the first step)."""
    den = F.col("raw_step_01") if metric == "pct" else F.col("prev_users")
    num = F.sum(F.when(den.isNotNull(), F.col("users")))
    total = F.sum(den)
    out = F.when(total > 0, num.cast("double") / total.cast("double"))
    if metric == "ratio":
        out = F.when(F.count(den) == 0, F.lit(1.0)).otherwise(out)
    return out


def weighted_steps(long: DataFrame, group_cols: list[str], metric: str = "pct",
                   mode: str = "reference") -> DataFrame:
    """group_cols + step_no -> value, users (sum total_users), step1 (sum raw_step_01).

    ``mode="reference"`` re-weights the rounded per-cell rates by step-1 users;
    ``mode="exact"`` pools the counts."""
    value = weighted_value(metric, is_rollup(long)) if mode == "reference" else exact_value(metric)
    return long.groupBy(*group_cols, "step_no").agg(
        value.alias("value"),
        F.sum("total_users").alias("users"),
        F.sum("raw_step_01").alias("step1"),
    )


def running_min(df: DataFrame, group_cols: list[str], value: str = "value",
                order: str = "step_no", out: str | None = None) -> DataFrame:
    """Cap each value at the previous one (running minimum along ``order``)."""
    w = (Window.partitionBy(*group_cols).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out or value, F.min(F.col(value)).over(w))


def dropoff(df: DataFrame, group_cols: list[str], value: str = "value",
            order: str = "step_no") -> DataFrame:
    """Per transition i -> next: (v_i - v_next) / v_i, 0 when v_i is not > 0."""
    w = Window.partitionBy(*group_cols).orderBy(order)
    nxt = F.lead(F.col(value)).over(w)
    nxt_no = F.lead(F.col(order)).over(w)
    out = (df.withColumn("next_value", nxt).withColumn("next_step_no", nxt_no)
           .filter(F.col("next_step_no").isNotNull()))
    rate = F.when(F.col(value) > 0, (F.col(value) - F.col("next_value")) / F.col(value)) \
        .otherwise(F.lit(0.0))
    return out.withColumn("drop_rate", rate)
