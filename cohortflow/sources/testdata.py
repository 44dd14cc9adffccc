"""Adapter from the driver's synthetic tables to the canonical schemas.

Mapping (documented in README):

* events: user_id -> distinct_id, event_type -> mp_event_name,
  ts -> res_timestamp (epoch ms, UTC) and date, props.k -> chapter
  (``k div 25 + 1``) and dialog_id (``k`` as text)
* players: one row per user with a ``signup`` event; the first signup gives
  first_event_time / install_date and the version ``'0.38' || (10 + k div 25)``;
  platform = c_mktsegment, country = n_name, media source key
  ``'Brand#' || (user_id % 30 + 1)`` (NULL when ``user_id % 7 = 0``)
* source_names: part (p_brand, p_name, p_type); several rows per brand; the
  final name is NULL for even p_partkey of the brands in UNNAMED_BRANDS
* countries: nation x region, low-payer = region AFRICA
* exclusions: customers with a negative account balance
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.session import app_id
from cohortflow.sources.base import EventSource


#: brands whose parts with an even key have no final name
UNNAMED_BRANDS = ("Brand#3", "Brand#13", "Brand#23")

# One reader per (application, file): Parquet schema inference runs a small
# Spark job, so every table's footer is read once per application.
_READERS: dict[tuple[str, str], DataFrame] = {}


def _ntz(d: date) -> F.Column:
    return F.to_timestamp_ntz(F.lit(datetime.combine(d, time()).strftime("%Y-%m-%d %H:%M:%S")))


class TestdataSource(EventSource):
    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def _t(self, name: str) -> DataFrame:
        key = (app_id(self.spark), f"{self.dir}/{name}.parquet")
        df = _READERS.get(key)
        if df is None or df.sparkSession is not self.spark:
            df = self.spark.read.parquet(key[1])
            _READERS[key] = df
        return df

    @staticmethod
    def _k(col: str = "props") -> F.Column:
        return F.get_json_object(F.col(col), "$.k").try_cast("int")

    def events(self, start: date | None = None, end: date | None = None,
               names: list[str] | None = None) -> DataFrame:
        ev = self._t("events")
        # filter on the raw column first: these reach the Parquet scan
        if start is not None:
            ev = ev.filter(F.col("ts") >= _ntz(start))
        if end is not None:
            ev = ev.filter(F.col("ts") < _ntz(end + timedelta(days=1)))
        if names is not None:
            ev = ev.filter(F.col("event_type").isin(list(names)))
        k = self._k()
        return ev.select(
            F.col("user_id").alias("distinct_id"),
            F.col("event_type").alias("mp_event_name"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("res_timestamp"),
            F.to_date("ts").alias("date"),
            (F.floor(k / 25) + 1).cast("int").alias("chapter"),
            k.cast("string").alias("dialog_id"),
        )

    def players(self) -> DataFrame:
        ev = self._t("events").filter(F.col("event_type") == "signup")
        first = ev.groupBy("user_id").agg(
            F.min("ts").alias("first_ts"),
            F.min_by(self._k(), F.col("ts")).alias("k"),
        )
        cust = self._t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        nation = self._t("nation").select("n_nationkey", "n_name")
        uid = F.col("user_id")
        return (
            first.join(cust, first.user_id == cust.c_custkey, "inner")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                uid.alias("distinct_id"),
                F.to_date("first_ts").alias("install_date"),
                F.col("first_ts").cast("timestamp").alias("first_event_time"),
                F.concat(F.lit("0.38"), (F.floor(F.col("k") / 25) + 10).cast("string"))
                .alias("first_app_version"),
                F.col("c_mktsegment").alias("first_platform"),
                F.col("n_name").alias("first_country"),
                F.when(uid % 7 == 0, F.lit(None).cast("string"))
                .otherwise(F.concat(F.lit("Brand#"), (uid % 30 + 1).cast("string")))
                .alias("first_mediasource"),
            )
        )

    def source_names(self) -> DataFrame:
        return self._t("part").select(
            F.col("p_brand").alias("cost_data_name"),
            F.when(F.col("p_brand").isin(*UNNAMED_BRANDS) & (F.col("p_partkey") % 2 == 0), F.lit(None))
            .otherwise(F.col("p_name")).alias("final_name"),
            F.col("p_type").alias("media_type"),
        )

    def countries(self) -> DataFrame:
        n = self._t("nation")
        r = self._t("region")
        return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
            F.col("n_name").alias("country_code"),
            F.coalesce(F.col("r_name") == "AFRICA", F.lit(False)).alias("is_low_payers_country"),
        )

    def exclusions(self) -> DataFrame:
        return self._t("customer").filter(F.col("c_acctbal") < 0).select(
            F.col("c_custkey").alias("distinct_id"))
