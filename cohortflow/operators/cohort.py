"""Install cohort: player dimension -> per-player cohort dimensions.

Dimension tables (source-name mapping, low-payer countries) are deduplicated
before they are joined, so the joins never fan out; their size is bounded by
the number of media sources / countries and AQE turns the joins into
broadcast joins from the measured runtime size.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.functions.columns import install_hour, version_num

COHORT_DIMS = ["install_date", "install_hour", "install_week", "install_month",
               "install_version", "platform", "country", "is_low_payers_country",
               "mediasource"]


def pick_first(col: str) -> F.Column:
    """Aggregate: the first value in ascending order, where a NULL comes first."""
    return F.when(F.count_if(F.col(col).isNull()) == 0, F.min(col))


def source_name_map(source_names: DataFrame) -> DataFrame:
    """One final name per raw source name: the first one, NULL before any name
    (the raw name is used then)."""
    return source_names.groupBy("cost_data_name").agg(pick_first("final_name").alias("final_name"))


def media_type_map(source_names: DataFrame) -> DataFrame:
    """One media type per normalised (lower-case) final name: the first one,
    NULL before any type."""
    return (source_names.groupBy(F.lower("final_name").alias("mediasource"))
            .agg(pick_first("media_type").alias("media_type")))


def media_type_lookup(df: DataFrame, source_names: DataFrame) -> DataFrame:
    """Adds ``media_type`` for ``mediasource``; unmapped sources fall back to
    ``organic`` (for the organic source) or ``none``."""
    mt = media_type_map(source_names).withColumnRenamed("mediasource", "_ms")
    out = df.join(mt, df.mediasource == mt._ms, "left")
    fallback = (F.when(F.col("mediasource") == "organic", F.lit("organic"))
                .otherwise(F.lit("none")))
    return out.withColumn("media_type", F.coalesce(F.col("media_type"), fallback)).drop("_ms")


def low_payer_countries(countries: DataFrame) -> DataFrame:
    return (countries.filter(F.col("is_low_payers_country") == F.lit(True))
            .select("country_code").distinct())


def not_in(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """SQL ``key NOT IN (SELECT key FROM excluded)`` without a broadcast-only plan.

    Null-aware semantics: a NULL in the list empties the result, a NULL key is
    kept only if the list is empty.  The list itself goes through a shuffle
    anti join (it may be large).  The NULL rules are scalar subqueries (counts
    over the list), evaluated once by the executors; no driver round trip.
    """
    nulls = excluded.agg(F.count_if(F.col(key).isNull())).scalar()
    rows = excluded.agg(F.count(F.lit(1))).scalar()
    out = df.join(excluded.filter(F.col(key).isNotNull()).select(key), key, "left_anti")
    return out.filter((nulls == 0) & (F.col(key).isNotNull() | (rows == 0)))


def is_buggy_version(version: F.Column, band: tuple[float, float]) -> F.Column:
    v = version_num(version)
    return F.coalesce((v >= band[0]) & (v <= band[1]), F.lit(False))


def normalised_mediasource(final_name: F.Column, raw: F.Column) -> F.Column:
    return F.lower(F.coalesce(final_name, raw, F.lit("organic")))


def with_cohort_dims(players: DataFrame, source_names: DataFrame, countries: DataFrame,
                     cfg: EngineConfig) -> DataFrame:
    """All cohort dimensions for every player (no cohort filters)."""
    snm = source_name_map(source_names)
    lpc = low_payer_countries(countries).withColumnRenamed("country_code", "_lpc")
    p = (players
         .join(snm, players.first_mediasource == snm.cost_data_name, "left")
         .join(lpc, players.first_country == lpc._lpc, "left"))
    return p.select(
        "distinct_id",
        "install_date",
        "first_event_time",
        install_hour(F.col("first_event_time"), F.col("install_date")).alias("install_hour"),
        F.trunc("install_date", "week").alias("install_week"),
        F.trunc("install_date", "month").alias("install_month"),
        F.col("first_app_version").cast("string").alias("install_version"),
        F.col("first_platform").alias("platform"),
        F.col("first_mediasource"),
        F.col("first_country").alias("country"),
        F.col("_lpc").isNotNull().alias("is_low_payers_country"),
        normalised_mediasource(F.col("final_name"), F.col("first_mediasource")).alias("mediasource"),
        is_buggy_version(F.col("first_app_version"), cfg.buggy_version_band)
        .alias("is_buggy_version"),
    )


def install_window(cfg: EngineConfig, install_lag_days: int | None = None) -> tuple[date, date]:
    lag = cfg.install_lag_days if install_lag_days is None else install_lag_days
    return cfg.as_of - timedelta(days=cfg.lookback_days), cfg.as_of - timedelta(days=lag)


def build_cohort(players: DataFrame, source_names: DataFrame, countries: DataFrame,
                 exclusions: DataFrame, cfg: EngineConfig,
                 install_lag_days: int | None = None) -> DataFrame:
    """The install cohort: date band, country exclusions, exclusion list."""
    lo, hi = install_window(cfg, install_lag_days)
    p = players.filter(F.col("install_date").between(F.lit(lo), F.lit(hi))
                       & ~F.col("first_country").isin(list(cfg.excluded_countries)))
    p = not_in(p, exclusions, "distinct_id")
    return with_cohort_dims(p, source_names, countries, cfg)


def cohort_from_source(src, cfg: EngineConfig, install_lag_days: int | None = None) -> DataFrame:
    return build_cohort(src.players(), src.source_names(), src.countries(), src.exclusions(),
                        cfg, install_lag_days)
