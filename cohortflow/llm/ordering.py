"""Work in ascending doc_id order without a single-task sort."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2_000
MOST_BUCKETS = 20_000


def bucketed(df: DataFrame, key: str = "doc_id",
             rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """``df`` with a column ``bucket`` (consecutive ranges of ``key``, nulls in
    the last one), and the number of buckets.  The bounds come from
    approximate quantiles (at most MOST_BUCKETS of them on the driver); which
    bucket a row is in follows from the bounds alone, so a recomputed
    partition has the same rows."""
    n = df.count()
    want = max(1, min(MOST_BUCKETS, n // rows_per_bucket))
    marks = df.where(F.col(key).isNotNull()).select(F.col(key).cast("double").alias("k")).approxQuantile(
        "k", [i / want for i in range(1, want)], 0.1 / want) if want > 1 else []
    cuts = [float("-inf"), *sorted(set(marks)), float("inf")]
    if len(cuts) < 3:
        out = df.withColumn("bucket", F.col(key).isNull().cast("int"))
    else:
        out = Bucketizer(splits=cuts, inputCol="_k", outputCol="_b", handleInvalid="keep").transform(
            df.withColumn("_k", F.col(key).cast("double"))).withColumn("bucket", F.col("_b").cast("int"))
    return out.select(*df.columns, "bucket"), len(cuts)


def sorted_buckets(df: DataFrame, buckets: int, key: str = "doc_id", tie: str = "text") -> DataFrame:
    """Each bucket in one partition, partitions sorted by bucket, key and tie."""
    return df.repartition(buckets, "bucket").sortWithinPartitions(
        "bucket", F.col(key).asc_nulls_last(), tie)
