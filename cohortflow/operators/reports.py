"""Reports over the cubes: distributions, coverage, trends, version tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.operators.metrics import weighted_value
from cohortflow.operators.rollup import is_rollup


def dimension_counts(cube: DataFrame, dims: list[str], weight: str = "total_users"
                     ) -> DataFrame:
    """(dimension, value, users) for several dimensions in one pass: each row
    is exploded into one entry per dimension, then a single aggregation."""
    entries = F.array(*[F.struct(F.lit(d).alias("dimension"),
                                 F.col(d).cast("string").alias("value"),
                                 F.col(weight).alias("w")) for d in dims])
    x = cube.select(F.inline(entries))
    return (x.filter(F.col("value").isNotNull()).groupBy("dimension", "value")
            .agg(F.sum("w").alias("users")))


def coverage(cube: DataFrame, selected: F.Column, test_start: date) -> DataFrame:
    """Selected vs all users, install-date span and post-test presence, in one
    aggregation (``selected`` is the filter predicate of the current view)."""
    sel = F.coalesce(selected, F.lit(False))
    a = cube.agg(F.sum("total_users").alias("total_all"),
                 F.coalesce(F.sum(F.when(sel, F.col("total_users"))), F.lit(0)).cast("long")
                 .alias("total_selected"),
                 F.min("install_date").alias("min_date"),
                 F.max("install_date").alias("max_date"),
                 F.bool_or(F.col("install_date") >= F.lit(test_start)).alias("has_post_test"))
    pct = F.when(F.col("total_all") > 0,
                 F.col("total_selected") / F.col("total_all") * 100).otherwise(F.lit(0.0))
    return a.select("total_all", "total_selected",
                    (F.col("total_all") - F.col("total_selected")).alias("total_excluded"),
                    pct.alias("pct_selected"), "min_date", "max_date", "has_post_test")


def with_total(df: DataFrame, value: str, out: str = "_total") -> DataFrame:
    """Attach the grand total of ``value`` (a scalar subquery: one global
    aggregate, partially aggregated per task, no join and no single-partition
    window)."""
    return df.withColumn(out, df.agg(F.sum(value)).scalar())


def share_of_total(df: DataFrame, value: str, out: str = "share_pct", digits: int = 1
                   ) -> DataFrame:
    """value / sum(value) * 100, rounded."""
    return (with_total(df, value)
            .withColumn(out, F.round(F.col(value) / F.col("_total") * 100, digits))
            .drop("_total"))


def weighted_by(long: DataFrame, group_cols: list[str], metric: str = "pct") -> DataFrame:
    return long.groupBy(*group_cols, "step_no").agg(
        weighted_value(metric, is_rollup(long)).alias("value"), F.sum("total_users").alias("users"),
        F.sum("raw_step_01").alias("step1"))


def version_key(col: str = "install_version") -> F.Column:
    from cohortflow.functions.columns import version_sort_key
    return version_sort_key(col)


def period_of(test_start: date, date_col: str = "install_date") -> F.Column:
    return F.when(F.col(date_col) < F.lit(test_start), F.lit("before")).otherwise(F.lit("after"))


def version_funnel(long: DataFrame, steps: list[int], metric: str = "pct") -> DataFrame:
    """Per version: users and the weighted rate of every shown step (one pivot);
    ``metric="ratio"`` is the conversion against the previous step."""
    ws = weighted_by(long.filter(F.col("step_no").isin(steps)), ["install_version"], metric)
    p = (ws.groupBy("install_version").pivot("step_no", steps)
         .agg(F.first("value").alias("v"), F.first("users").alias("u")))
    return p.select("install_version", F.col(f"{steps[0]}_u").alias("users"),
                    *[F.col(f"{s}_v").alias(f"s{s:02d}") for s in steps])


def trend(long: DataFrame, time_col: str, steps: list[int], metric: str = "pct") -> DataFrame:
    """Per period bucket x step: weighted rate and users."""
    ws = weighted_by(long.filter(F.col("step_no").isin(steps)), [time_col], metric)
    return ws.filter(F.col("users") > 0).select(F.col(time_col).alias("period"), "step_no",
                                                "value", "users")


def split_summary(long: DataFrame, group_cols: list[str], test_start: date,
                  steps: list[int], metric: str = "pct") -> DataFrame:
    """Per group x step: rate for installs before / from the test date; a side
    without rows has rate 0 and users 0 (pandas semantics of the reference)."""
    sub = long.filter(F.col("step_no").isin(steps))
    before = F.col("install_date") < F.lit(test_start)

    def side(cond):
        users = F.coalesce(F.sum(F.when(cond, F.col("total_users"))), F.lit(0))
        return weighted_value(metric, is_rollup(long), cond), users

    vb, ub = side(before)
    va, ua = side(~before)
    return sub.groupBy(*group_cols, "step_no").agg(
        vb.alias("before"), va.alias("after"), ub.alias("users_before"), ua.alias("users_after"))


def tracking_summary(funnel: DataFrame, retention: DataFrame, test_start: date) -> DataFrame:
    """One row: days and versions with data in either cube, and whether any
    install lies after the test's start."""
    def totals(cube: DataFrame, prefix: str) -> DataFrame:
        return cube.agg(
            F.countDistinct("install_date").alias(f"{prefix}_days"),
            F.countDistinct("install_version").alias(f"{prefix}_versions"),
            F.coalesce(F.bool_or(F.col("install_date") >= F.lit(test_start)), F.lit(False)).alias(f"{prefix}_post_test"))

    one = F.lit(1).alias("_one")                # two single rows meet by a key
    return (totals(funnel, "funnel").select("*", one).join(totals(retention, "retention").select("*", one), "_one")
            .drop("_one"))
