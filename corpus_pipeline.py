"""The corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept, and returns a DataFrame; ``run`` writes each stage's rows
as Parquet and reads them again for the next.  All but the last stage return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import jaccard_join, packing, secrets, site_quality, toxicity
from cohortflow.llm.common import ship, small_batches, table
from cohortflow.llm.queries import held_out, tokenizer_path
from cohortflow.sources.cube_store import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _ready(spark: SparkSession) -> None:
    """The package on the executors, and batches small enough that workers of
    all stages stand beside a full heap."""
    ship(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts 0 for."""
    _ready(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score_documents(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, with source as host and
    language as path."""
    _ready(spark)
    judged = site_quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: words in fives, similarity
    of 0.8 or more, the smallest doc_id stays."""
    _ready(spark)
    return jaccard_join.keep_one(docs.select(*COLUMNS), jaccard_join.JaccardParams(words=5, percent=80))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret's span replaced by a mark."""
    _ready(spark)
    return secrets.redact(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, placed in sequences:
    the pieces of a sequence in order of ``offset`` are its tokens."""
    _ready(spark)
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages learn models and tokenize: no SQL; tests compare them with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
