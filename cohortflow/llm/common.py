"""Reading the tables and small Arrow helpers of the operators."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import cohortflow
from cohortflow.llm import textbatch as tb


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_filter(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows of ``df``, picked by a hash of ``key`` (all rows if
    there are fewer); the same rows at every run."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def text_slices(batch: pa.RecordBatch, column: int, budget: int = tb.STEP_CHARS
                ) -> Iterator[tuple[pa.RecordBatch, list]]:
    """``batch`` in consecutive slices of at most ``budget`` characters of a
    text column each (one row at least), with the slice's texts.  Only one
    slice's texts are Python objects at a time."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = int(sizes[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + budget, side="right")))
        part = batch.slice(lo, hi - lo)
        yield part, part.column(column).to_pylist()
        lo = hi


def map_texts(df: DataFrame, step: Callable, schema: str, text: str = "text",
              budget: int = tb.STEP_CHARS) -> DataFrame:
    """Run ``step(batch, texts) -> dict of columns`` over slices of ``df`` of
    at most ``budget`` characters of its ``text`` column each (whole texts)."""
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, batch.schema.get_field_index(text), budget):
                yield record_batch(step(part, texts), target)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Hand memory that Arrow and the C library keep for later back: the worker
    may serve a task of quite another kind next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def record_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        c = cols[field.name]
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        arrays.append(c if isinstance(c, pa.Array) and c.type == field.type
                      else pa.array(c, type=field.type) if not isinstance(c, pa.Array)
                      else c.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    return _arrow_schema(spark, ddl)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "4MB") -> None:
    """Have Spark hand Arrow data to Python in batches of about ``size``: one
    batch is held by the JVM and by the worker at once, and a step works on
    less of it anyway.  A session that has set a size of its own keeps it.  One
    row larger than that is a batch of its own; results do not depend on it."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, size)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application
    (as ``--py-files`` does for a submitted job)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(cohortflow.__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="cohortflow-ship-")) / "cohortflow.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)
