"""Quality rules: base rules, and a hashed n-gram likelihood ratio.

Two multinomials over hashed uni- and bigrams (words and runs of marks apart)
are counted: one over all trusted documents, one over the whole raw corpus.  A
document's score is the mean, over its n-grams, of the log ratio of the two;
it is kept if no base rule fails and the score reaches a threshold.  The
verdict of a document depends on its text and the counts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import textbatch as tb
from cohortflow.llm.common import arrow_schema, map_texts, record_batch, text_slices
from cohortflow.llm.features import Batch, tokens
from cohortflow.operators.idfilter import BloomShape, bloom_words, might_contain


@dataclass(frozen=True)
class ImportanceParams:
    """``bits``: buckets of each order are 2 ** bits.  ``smoothing``: share of
    the uniform distribution in both models.  ``threshold``: lowest mean log
    ratio that is kept."""

    bits: int = 15
    smoothing: float = 0.05
    threshold: float = -0.3
    least_words: int = 50
    repeat_percent: int = 50


def hashed_ngrams(b: Batch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every uni- and bigram of a batch."""
    starts, _, h = tokens(b)
    bounds = tb.per_text(starts, b.offsets)
    pairs, first = tb.grams(h, bounds, 2)
    shift = np.uint64(64 - bits)
    bucket = np.concatenate([(h >> shift).astype(np.int64), (pairs >> shift).astype(np.int64) + (1 << bits)])
    return bucket, tb.owner(np.concatenate([starts, starts[first]]), b.offsets)


def bucket_counts(docs: DataFrame, p: ImportanceParams) -> DataFrame:
    """bucket, n: the n-grams of all texts of ``docs``.  A task sends one row
    per bucket that it has seen."""
    schema = "bucket int, n long"
    target = arrow_schema(docs.sparkSession, schema)
    size = 2 << p.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch, 0):
                n += np.bincount(hashed_ngrams(Batch.of(texts), p.bits)[0], minlength=size)
        seen = np.flatnonzero(n)
        if len(seen):
            yield record_batch({"bucket": seen.astype(np.int32), "n": n[seen]}, target)

    return docs.select("text").mapInArrow(run, schema)


def trusted_rows(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Every row of ``docs`` whose doc_id is one of ``trusted``.  The ids grow
    with the labels, so they are neither collected nor broadcast: a Bloom
    filter of bounded size (one row, sent once) keeps most other texts out of
    the exchange, a hash join per partition (no sort of texts) decides."""
    kind = docs.schema["doc_id"].dataType
    ids = (trusted.select(F.col("doc_id").try_cast(kind).alias("doc_id"))
           .where("doc_id is not null").distinct())
    rows = docs.select("doc_id", "text")
    shape = BloomShape.of(ids.count())
    if shape is not None:
        words = bloom_words(ids, "doc_id", shape)
        rows = rows.join(F.broadcast(words), might_contain(F.col("words"), F.col("doc_id"), shape), "left_semi")
    return rows.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")


def corpus_counts(docs: DataFrame, trusted: DataFrame, p: ImportanceParams) -> np.ndarray:
    """Counts (raw, target) of every bucket: over all rows of ``docs``, and
    over all whose doc_id is one of ``trusted``."""
    none = F.lit(0).cast("long")
    raw = bucket_counts(docs, p).select("bucket", F.col("n").alias("raw"), none.alias("target"))
    good = bucket_counts(trusted_rows(docs, trusted), p).select("bucket", none.alias("raw"), F.col("n").alias("target"))
    rows = raw.union(good).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    out = np.zeros((2, 2 << p.bits), dtype=np.float64)
    out[0, rows["bucket"]], out[1, rows["bucket"]] = rows["raw"], rows["target"]
    return out


def log_ratios(counts: np.ndarray, p: ImportanceParams) -> np.ndarray:
    """log(target / raw) per bucket, each order's counts normalised apart."""
    out = []
    for order in np.split(counts, 2, axis=1):
        share = [(1 - p.smoothing) * c / max(1.0, c.sum()) + p.smoothing / len(c) for c in order]
        out.append(np.log(share[1]) - np.log(share[0]) if counts[1].sum() else np.zeros(len(share[0])))
    return np.concatenate(out)


def score_documents(docs: DataFrame, ratios: np.ndarray, p: ImportanceParams) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, score."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def step(batch, texts):
        b = Batch.of(texts)
        bucket, of = hashed_ngrams(b, p.bits)
        size = np.bincount(of, minlength=b.n)
        score = np.bincount(of, weights=table.value[bucket], minlength=b.n) / np.maximum(1, size)
        words, repeats = b.n_words(), b.n_repeat_words()
        failed = (words < p.least_words) | (100 * repeats > p.repeat_percent * words)
        return {"doc_id": batch.column(0), "n_words": words, "word_chars": b.word_chars(),
                "n_symbols": b.n_symbols(), "n_dup_lines": b.n_dup_lines()[0], "n_repeat_words": repeats,
                "base_failed": failed, "kept": ~failed & (score >= p.threshold), "score": score}

    return map_texts(docs.select("doc_id", "text"), step,
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, base_failed boolean, kept boolean, score double")


def quality_rules(docs: DataFrame, trusted: DataFrame, params: ImportanceParams | None = None) -> DataFrame:
    """Score and judge every row of ``docs`` (doc_id, text; other columns are
    ignored) against the trusted documents' ids (doc_id).

    A null text has no words, fails the base rules and is not kept, as does an
    empty one; repeated rows stay and count; with no trusted document every
    score is 0; null doc_ids are never trusted; no rows give no rows."""
    p = params or ImportanceParams()
    return score_documents(docs, log_ratios(corpus_counts(docs, trusted, p), p), p)
