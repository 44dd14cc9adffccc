"""Scalar column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# A plain decimal number; Spark's cast also accepts suffixes such as "0.38f",
# which a numeric parse must reject.
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def version_num(col: Column | str) -> Column:
    """Numeric value of a version string, NULL when it is not a number."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def version_sort_key(col: Column | str) -> Column:
    """Numeric version order; unparsable versions sort as 0.0."""
    return F.coalesce(version_num(col), F.lit(0.0))


def exact_ratio_e(num: Column, den: Column, digits: int = 4) -> Column:
    """``round(num / den, digits) * 10**digits`` as an exact integer.

    Half-up rounding of the exact rational value (no binary floating point),
    so every engine produces the same digits.  NULL when ``den`` is 0/NULL.
    """
    scale = 10 ** digits
    x = num.cast("long") * (2 * scale) + den.cast("long")
    y = den.cast("long") * 2
    q = ((x - F.pmod(x, y)) / y).cast("long")   # exact: x - pmod(x, y) is a multiple of y
    return F.when(den.cast("long") > 0, q)


def from_e(e: Column, digits: int = 4) -> Column:
    return e.cast("double") / F.lit(float(10 ** digits))


def guarded_not(pred: Column) -> Column:
    """pandas-style negation: a NULL predicate counts as False before negating."""
    return ~F.coalesce(pred, F.lit(False))


def install_hour(first_event_time: Column, install_date: Column, default: int = 12) -> Column:
    """Hour of the first event when it falls on the install date, else ``default``."""
    return F.when(F.to_date(first_event_time) == install_date,
                  F.hour(first_event_time)).otherwise(F.lit(default)).cast("int")
