"""Activity as bitmaps: one row per user, one bit per calendar day.

``activity_words`` aggregates the event log by user into 64-bit words over a
band of days (``bit_or`` of shifted ones: long buffers, so a hash aggregate
with partial sums before the shuffle).  A user moves one row per map task,
whatever the number of active days, and bitmaps of disjoint or overlapping logs
merge by ``bit_or`` again.  ``since_install`` shifts a user's words so that bit
n is day n after the install; a cell's count for day n is the sum of bits.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def word_names(n_days: int) -> list[str]:
    """Names of the words that hold ``n_days`` days."""
    return [f"activity_{i}" for i in range(-(-n_days // WORD))]


def event_day() -> Column:
    return F.to_date(F.timestamp_millis(F.col("res_timestamp")))


def _shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _shift_right(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def word_aggregates(day: Column, origin: date, n_days: int, where: Column | None = None) -> list[Column]:
    """The aggregates that gather ``day`` (a date) into words; days outside
    ``[origin, origin + n_days)``, and rows outside ``where``, set no bit."""
    at = F.datediff(day, F.lit(origin))
    bit = _shift_left(F.lit(1).cast("long"), F.pmod(at, F.lit(WORD)))
    inside = (at >= 0) & (at < n_days)
    if where is not None:
        inside = inside & where
    return [F.coalesce(F.bit_or(F.when(inside & (F.floor(at / WORD) == i), bit)), F.lit(0).cast("long")).alias(name)
            for i, name in enumerate(word_names(n_days))]


def activity_words(events: DataFrame, origin: date, n_days: int) -> DataFrame:
    """(distinct_id, activity_0, ...): the days on which each user of the log
    was active."""
    return events.groupBy("distinct_id").agg(*word_aggregates(event_day(), origin, n_days))


def merge_words(*parts: DataFrame) -> DataFrame:
    """The union of bitmaps over one band (of several days' or files' logs)."""
    words = [c for c in parts[0].columns if c.startswith("activity_")]
    every = parts[0].select("distinct_id", *words)
    for p in parts[1:]:
        every = every.unionByName(p.select("distinct_id", *words))
    return every.groupBy("distinct_id").agg(*[F.bit_or(w).alias(w) for w in words])


def active_days(words: DataFrame, origin: date, n_days: int) -> DataFrame:
    """(distinct_id, activity_date) of every bit that is set."""
    held = F.array(*word_names(n_days))
    days = F.filter(F.sequence(F.lit(0), F.lit(n_days - 1)), lambda d: F.call_function(
        "getbit", F.element_at(held, (F.floor(d / WORD) + 1).cast("int")), F.pmod(d, F.lit(WORD))) == 1)
    return words.select("distinct_id", F.explode(days).alias("_day")).select(
        "distinct_id", F.date_add(F.lit(origin), F.col("_day")).alias("activity_date"))


def since_install(origin: date, n_days: int, max_day: int) -> list[Column]:
    """Words ``since_0``, ... whose bit n is day n after ``install_date``
    (0..max_day); a row without words gives zeros."""
    held = F.array(*[F.coalesce(F.col(w), F.lit(0).cast("long")) for w in word_names(n_days)])
    start = F.datediff(F.col("install_date"), F.lit(origin))
    zero = F.lit(0).cast("long")
    out = []
    for r in range(-(-(max_day + 1) // WORD)):
        at = start + r * WORD
        low, by = F.floor(at / WORD).cast("int"), F.pmod(at, F.lit(WORD))
        here, after = F.coalesce(F.get(held, low), zero), F.coalesce(F.get(held, low + 1), zero)
        out.append(F.when(by == 0, here).otherwise(
            _shift_right(here, by).bitwiseOR(_shift_left(after, WORD - by))).alias(f"since_{r}"))
    return out


def day_sums(max_day: int) -> Column:
    """Aggregate: an array with the number of rows whose bit n is set, for
    every n from 0 to ``max_day``."""
    return F.array(*[F.sum(F.getbit(F.col(f"since_{n // WORD}"), F.lit(n % WORD)).cast("long"))
                     for n in range(max_day + 1)])
