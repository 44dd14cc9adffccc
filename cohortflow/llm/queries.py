"""The registered queries of this package: each applies one operator, with
its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import (bpe_automaton, byte_bpe, centroids, chat_format, direct_codes, fill_middle,
                            importance, jaccard_join, merkle, packing, secrets, site_quality, toxicity)
from cohortflow.llm.common import ship, table
from cohortflow.sources.cube_store import materialize, scratch_path


def tokenizer_path() -> str:
    """The tokenizer file of the queries; the operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), count_links=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return importance.quality_rules(docs, trusted)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_fingerprints(_documents(spark, sf_dir))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_digests(_documents(spark, sf_dir), tokenizer_path())


def held_out():
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score_documents(docs, model, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return site_quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), ["doc_id"])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    path = scratch_path(spark, "token-shards")
    bases = direct_codes.write_tokens(docs, path, tokenizer_path())
    return direct_codes.read_documents(spark, path, bases)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    done = materialize(chat_format.format_conversations(turns.union(added)), "formatted")
    return chat_format.read_back(done)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_documents(spark, sf_dir))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return byte_bpe.encode_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scans, op2_ngram_jaccard_join, op3_quality_rules, op4_fingerprints, op5_bpe_encode_decode,
    op6_toxicity, op7_packing, op8_quality_classifier, op9_token_files, op10_chat_formatting, op11_centroid_clustering,
    op12_fill_middle, op13_byte_bpe)}
ORACLE: dict[str, str] = {
    "op11_centroid_clustering": centroids.cluster_sql(),
    "op12_fill_middle": fill_middle.digests_sql(),
}
