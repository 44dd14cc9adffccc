"""A Bloom filter of ids as column expressions.

The event log of a date band holds the events of all users, a cohort's cubes
need those of its players.  ``restrict`` drops most others before the first
exchange: a bit array is built from the players' ids by aggregation (``bit_or``
per 64-bit word), reaches the scan as a scalar subquery, and every row's id is
tested against it inside the generated code.  An id of the cohort always passes;
of the others a bounded share does, so the exact join stays where it is.

Size: bits follow from the number of ids and the wanted share of false
positives.  Beyond ``MAX_BITS`` no filter is made (the plain plan is then the
way), so what reaches a task is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
MAX_BITS = 1 << 27            # 16 MB
LEAST_BITS = 1 << 13          # below it the positions of one id would meet too often


@dataclass(frozen=True)
class BloomShape:
    bits: int                 # a multiple of 64
    hashes: int

    @classmethod
    def of(cls, ids: int, false_share: float = 0.02, max_bits: int = MAX_BITS) -> BloomShape | None:
        """The shape for so many ids; None if it would exceed ``max_bits``."""
        n = max(1, ids)
        bits = max(LEAST_BITS, -(-math.ceil(-n * math.log(false_share) / math.log(2) ** 2) // WORD) * WORD)
        if bits > max_bits:
            return None
        return cls(bits, max(1, min(round(-math.log2(false_share)), round(bits / n * math.log(2)))))

    def expected_false_share(self, ids: int) -> float:
        return (1 - math.exp(-self.hashes * ids / self.bits)) ** self.hashes


def positions(key: Column, shape: BloomShape) -> list[Column]:
    """The bits of an id: two hashes combined, as many as the shape has."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(0x5BD1E995))
    step = F.pmod(b, F.lit(shape.bits))
    return [F.pmod(F.pmod(a, F.lit(shape.bits)) + step * i, F.lit(shape.bits)) for i in range(shape.hashes)]


def bloom_words(ids: DataFrame, key: str, shape: BloomShape) -> DataFrame:
    """One row with the filter: its words as an array.  Only words that have
    bits are gathered (at most ``bits / 64``), the others are filled in."""
    at = ids.where(F.col(key).isNotNull()).select(F.explode(F.array(*positions(F.col(key), shape))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / WORD).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(WORD)).cast("int"))).alias("bits"))
    every = ids.sparkSession.range(shape.bits // WORD).withColumnRenamed("id", "word")
    filled = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def might_contain(words: Column, key: Column, shape: BloomShape) -> Column:
    """Whether an id can be one of the filter's; a null id cannot."""
    hit = key.isNotNull()
    for at in positions(key, shape):
        word = F.element_at(words, (F.floor(at / WORD) + 1).cast("int"))
        hit = hit & (F.getbit(word, F.pmod(at, F.lit(WORD)).cast("int")) == 1)
    return hit


def restrict(rows: DataFrame, ids: DataFrame, n_ids: int, key: str = "distinct_id",
             false_share: float = 0.02, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` whose id can be one of ``ids`` (of which there are ``n_ids``);
    all rows if the filter would be too large."""
    shape = BloomShape.of(n_ids, false_share, max_bits)
    if shape is None:
        return rows
    return rows.filter(might_contain(bloom_words(ids, key, shape).scalar(), F.col(key), shape))
