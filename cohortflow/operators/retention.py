"""Day-N retention cube and the reports built on it.

The reference crosses every cohort *user* with days 0..90 and left-joins the
distinct (user, activity day) pairs.  Here a user is one row throughout:

1. the event log is aggregated by user into activity bitmaps (a bit per
   calendar day, partial before the shuffle): one row per user moves;
2. the cohort is left-joined with them, and a user's bits are shifted so that
   bit n is day n after the install;
3. per cell (install_date, version, platform, is_usa): users, and the sum of
   every bit, in one aggregation;
4. cells are expanded to the days observable by ``as_of`` (never users).

``retention_cube`` takes (user, day) pairs instead of bitmaps and gives the
same numbers; it is kept for sources that hold such pairs already.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.functions.columns import version_sort_key
from cohortflow.operators import activity
from cohortflow.operators.cohort import not_in

CELL = ["install_date", "install_version", "platform", "is_usa"]


def retention_cohort(players: DataFrame, exclusions: DataFrame, cfg: EngineConfig,
                     start: date, end: date) -> DataFrame:
    p = players.filter(F.col("install_date").between(F.lit(start), F.lit(end))
                       & ~F.col("first_country").isin(list(cfg.excluded_countries)))
    p = not_in(p, exclusions, "distinct_id")
    return p.select(
        "distinct_id", "install_date",
        F.col("first_app_version").cast("string").alias("install_version"),
        F.when(F.col("first_country") == F.lit(cfg.us_country), 1).otherwise(0)
        .cast("int").alias("is_usa"),
        F.col("first_platform").alias("platform"),
    )


def daily_activity(events: DataFrame, cohort: DataFrame, start: date | None = None,
                   end: date | None = None) -> DataFrame:
    """(user, activity day) of cohort users, each once: the set bits of the
    users' activity from ``start`` to ``end``, or without a band the distinct
    pairs of the log."""
    users = cohort.select("distinct_id")
    if start is None or end is None:
        pairs = events.select("distinct_id", activity.event_day().alias("activity_date")).distinct()
        return pairs.join(users, "distinct_id", "left_semi")
    days = (end - start).days + 1
    words = activity.activity_words(events, start, days)
    return activity.active_days(words.join(users, "distinct_id", "left_semi"), start, days)


def retention_cube_from_words(cohort: DataFrame, words: DataFrame, origin: date, n_days: int, as_of: date,
                              max_day: int = 90) -> DataFrame:
    """The cube from activity bitmaps over ``[origin, origin + n_days)``; days
    from ``as_of`` on must not be part of the band."""
    return cube_from_user_words(cohort.select("distinct_id", *CELL).join(words, "distinct_id", "left"),
                                origin, n_days, as_of, max_day)


def cube_from_user_words(users: DataFrame, origin: date, n_days: int, as_of: date, max_day: int = 90) -> DataFrame:
    """The cube from cohort users that carry their activity words (null: none)."""
    last = F.least(F.lit(max_day), F.datediff(F.lit(as_of), F.col("install_date")) - 1)
    cells = (users.select(*CELL, *activity.since_install(origin, n_days, max_day))
             .groupBy(*CELL).agg(F.count(F.lit(1)).alias("cohort_size"), activity.day_sums(max_day).alias("_active"))
             .filter(last >= 0))
    return (cells.select(*CELL, "cohort_size", F.posexplode(F.slice("_active", F.lit(1), (last + 1).cast("int"))))
            .select(*CELL, F.col("pos").cast("int").alias("days_since_install"), "cohort_size",
                    F.col("col").alias("users_active")))


def retention_cube(cohort: DataFrame, pairs: DataFrame, as_of: date,
                   max_day: int = 90) -> DataFrame:
    """The cube from distinct (distinct_id, activity_date) pairs."""
    n = F.datediff(F.col("activity_date"), F.col("install_date"))
    active = (pairs.join(cohort.select("distinct_id", *CELL), "distinct_id", "inner")
              .filter((F.col("activity_date") < F.lit(as_of)) & n.between(0, max_day))
              .groupBy(*CELL, n.cast("int").alias("days_since_install"))
              .agg(F.count(F.lit(1)).alias("users_active")))
    last = F.least(F.lit(max_day), F.datediff(F.lit(as_of), F.col("install_date")) - 1)
    sizes = (cohort.groupBy(*CELL).agg(F.count(F.lit(1)).alias("cohort_size"))
             .filter(last >= 0)
             .select(*CELL, "cohort_size",
                     F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("days_since_install")))
    return (sizes.join(active, CELL + ["days_since_install"], "left")
            .select(*CELL, "days_since_install", "cohort_size",
                    F.coalesce(F.col("users_active"), F.lit(0)).cast("long").alias("users_active")))


def activity_band(start: date, as_of: date, end: date, max_day: int) -> int:
    """Days of activity, from ``start`` on, that the cube can count."""
    return max(1, min((as_of - start).days, (end - start).days + max_day + 1))


def build_retention(src, cfg: EngineConfig, start: date | None = None,
                    end: date | None = None, max_day: int | None = None,
                    strategy: str = "bitmap") -> DataFrame:
    """The retention cube job: one pass over the event log, which moves one
    row per user, and one over the cohort.  ``strategy="days"`` moves a row
    per user and active day, for comparison."""
    start = start or cfg.retention_start
    end = end or cfg.as_of
    max_day = cfg.retention_max_day if max_day is None else max_day
    coh = retention_cohort(src.players(), src.exclusions(), cfg, start, end)
    ev = src.events(start, end + timedelta(days=max_day + 1))
    if strategy == "days":
        from cohortflow.sources import cube_store
        coh = cube_store.materialize(coh, "retention_cohort")
        pairs = ev.select("distinct_id", activity.event_day().alias("activity_date")).distinct()
        return retention_cube(coh, pairs, cfg.as_of, max_day)
    n_days = activity_band(start, cfg.as_of, end, max_day)
    words = activity.activity_words(ev, start, n_days)
    return retention_cube_from_words(coh, words, start, n_days, cfg.as_of, max_day)


# ---------------------------------------------------------------- metrics on the cube
def weighted_retention(active_cells_only: bool = True):
    """Aggregate: sum(active) / sum(size), over active cells only in reference mode."""
    keep = (F.col("users_active") > 0) if active_cells_only else F.lit(True)
    cs = F.sum(F.when(keep, F.col("cohort_size")))
    ua = F.sum(F.when(keep, F.col("users_active")))
    return F.when(cs > 0, ua.cast("double") / cs.cast("double")).otherwise(F.lit(0.0))


def retention_by(cube: DataFrame, group_cols: list[str], active_cells_only: bool = True
                 ) -> DataFrame:
    return cube.groupBy(*group_cols).agg(
        weighted_retention(active_cells_only).alias("retention"),
        F.sum("cohort_size").alias("cohort_size"),
        F.sum("users_active").alias("users_active"))


def retention_curve(cube: DataFrame, group_cols: list[str], max_day: int = 14) -> DataFrame:
    """Per group x day: retention over active cells; days without an active cell dropped."""
    act = cube.filter((F.col("days_since_install") <= max_day) & (F.col("users_active") > 0))
    return act.groupBy(*group_cols, "days_since_install").agg(
        (F.sum("users_active") / F.sum("cohort_size")).alias("retention"),
        F.sum("cohort_size").alias("cohort"))


def retention_matrix(cube: DataFrame, group_cols: list[str], days: range = range(1, 15)
                     ) -> DataFrame:
    """group x D1..Dn: weighted retention (NULL when the day has no cohort);
    groups without day-0 cohort are left out."""
    sub = cube.filter(F.col("days_since_install") <= max(days))
    aggs = [F.sum(F.when(F.col("days_since_install") == 0, F.col("cohort_size")))
            .alias("cohort")]
    for d in days:
        on_day = F.col("days_since_install") == d
        cs_all = F.sum(F.when(on_day, F.col("cohort_size")))
        cs = F.sum(F.when(on_day & (F.col("users_active") > 0), F.col("cohort_size")))
        ua = F.sum(F.when(on_day & (F.col("users_active") > 0), F.col("users_active")))
        r = F.when(cs > 0, ua.cast("double") / cs.cast("double")).otherwise(F.lit(0.0))
        aggs.append(F.when(cs_all > 0, r).alias(f"d{d}"))
    return sub.groupBy(*group_cols).agg(*aggs).filter(F.coalesce(F.col("cohort"), F.lit(0)) > 0)


def daily_retention(cube: DataFrame, days: range = range(1, 15)) -> DataFrame:
    """Per (install_date, version, day): active-cell retention and day-0 cohort."""
    g = ["install_date", "install_version"]
    d0 = (cube.filter(F.col("days_since_install") == 0).groupBy(*g)
          .agg(F.sum("cohort_size").alias("cohort")))
    r = (cube.filter(F.col("days_since_install").isin(list(days)) & (F.col("users_active") > 0))
         .groupBy(*g, "days_since_install")
         .agg((F.sum("users_active") / F.sum("cohort_size")).alias("retention")))
    return r.join(d0, g, "left").na.drop(subset=["retention"])


def with_period(df: DataFrame, test_start: date, date_col: str = "install_date") -> DataFrame:
    return df.withColumn("period", F.when(F.col(date_col) < F.lit(test_start), F.lit("before"))
                         .otherwise(F.lit("after")))


def d1_extremes(cube: DataFrame) -> DataFrame:
    """Per platform: versions with a cohort, and the ones with the best and the
    lowest day-1 retention (ties: the first in version order)."""
    m = retention_matrix(cube, ["platform", "install_version"], range(1, 2))
    key = version_sort_key("install_version")
    seen = F.col("d1").isNotNull()
    return m.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.min_by("install_version", F.when(seen, F.struct(-F.col("d1"), key, F.col("install_version"))))
        .alias("best_version"),
        F.max("d1").alias("best_d1"),
        F.min_by("install_version", F.when(seen, F.struct(F.col("d1"), key, F.col("install_version"))))
        .alias("lowest_version"),
        F.min("d1").alias("lowest_d1"))
