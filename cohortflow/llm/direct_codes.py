"""Directly addressable codes of token ids, and their files.

An id is split into chunks, the lowest bits first.  Level k holds, for every
id that needs more than k chunks, its k-th chunk at a fixed width, and a
bitmap that says whether a further chunk follows.  The position of that
further chunk on the next level is the number of set bits before it, which a
directory of cumulative counts gives at once: any id is read by one chunk per
level, without decoding what stands before it.

The files are Parquet tables of shards (a bounded number of tokens each) with
the levels, bitmaps and directories as binary columns, so any store that
Spark writes will do; a shard row also has the ids and ends of its documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import arrow_schema, record_batch, release, text_slices
from cohortflow.llm.ordering import bucketed, sorted_buckets
from cohortflow.llm.pieces import library_cache

WIDTHS = (10, 6, 16)            # bits of the chunks; each even
BLOCK = 512                     # bits of a bitmap per directory entry
SHARD_TOKENS = 1 << 20
END_ID = 2

SHARD_SCHEMA = ("bucket int, shard int, start long, n_tokens long, n_docs long, doc_ids array<long>, "
                "ends binary, levels array<binary>, bitmaps array<binary>, directories array<binary>")


def pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` (even) bits in a row, lowest bits first."""
    group = 4 if width % 4 else 2
    size = group * width // 8
    v = np.zeros(-(-len(values) // group) * group, dtype=np.uint64)
    v[:len(values)] = values
    v = v.reshape(-1, group)
    word = v[:, 0].copy()
    for k in range(1, group):
        word |= v[:, k] << np.uint64(k * width)
    return word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(data: bytes, width: int, lo: int, hi: int) -> np.ndarray:
    """Values ``lo`` to ``hi`` (exclusive) of packed ``data``."""
    group = 4 if width % 4 else 2
    size = group * width // 8
    first, last = lo // group, -(-hi // group)
    raw = np.frombuffer(data, np.uint8, (last - first) * size, first * size).reshape(-1, size)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :size] = raw
    word = wide.view("<u8")[:, 0]
    mask = np.uint64((1 << width) - 1)
    out = np.empty((len(word), group), dtype=np.uint64)
    for k in range(group):
        out[:, k] = (word >> np.uint64(k * width)) & mask
    return out.reshape(-1)[lo - first * group:hi - first * group]


class DirectCodes:
    """One shard's codes: levels (bytes), bitmaps (bytes), directories (bytes)."""

    def __init__(self, n: int, levels: list[bytes], bitmaps: list[bytes], directories: list[bytes]):
        self.n, self.levels, self.bitmaps = n, levels, bitmaps
        self.directories = [np.frombuffer(d, dtype="<u4") for d in directories]

    @classmethod
    def encode(cls, ids: np.ndarray) -> DirectCodes:
        rest, levels, bitmaps, directories = ids.astype(np.uint64), [], [], []
        n = len(rest)
        for k, width in enumerate(WIDTHS):
            chunk = rest & np.uint64((1 << width) - 1)
            rest = rest >> np.uint64(width)
            more = rest > 0
            if k == len(WIDTHS) - 1 and more.any():
                raise ValueError("an id is too large for the chunk widths")
            levels.append(pack(chunk, width))
            bits = np.packbits(more, bitorder="little")
            bitmaps.append(bits.tobytes())
            sums = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else []
            directories.append(np.concatenate([[0], np.cumsum(sums)]).astype("<u4").tobytes())
            rest = rest[more]
            if not len(rest):
                break
        return cls(n, levels, bitmaps, directories)

    def _bits(self, k: int, lo: int, hi: int) -> np.ndarray:
        first = lo // 8
        raw = np.frombuffer(self.bitmaps[k], np.uint8, -(-hi // 8) - first, first)
        return np.unpackbits(raw, bitorder="little")[lo - 8 * first:hi - 8 * first].astype(bool)

    def rank(self, k: int, i: int) -> int:
        """Set bits of level ``k`` before position ``i``: a directory entry and
        less than a block of bits."""
        block = i // BLOCK
        return int(self.directories[k][block]) + int(self._bits(k, block * BLOCK, i).sum())

    def get(self, i: int) -> int:
        """The id at any position."""
        out, shift = 0, 0
        for k, data in enumerate(self.levels):
            out |= int(unpack(data, WIDTHS[k], i, i + 1)[0]) << shift
            shift += WIDTHS[k]
            if not self._bits(k, i, i + 1)[0]:
                break
            i = self.rank(k, i)
        return out

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """The ids of a range of positions."""
        out = np.zeros(hi - lo, dtype=np.uint64)
        at, shift = np.arange(hi - lo), 0
        for k, data in enumerate(self.levels):
            if hi <= lo:
                break
            out[at] |= unpack(data, WIDTHS[k], lo, hi) << np.uint64(shift)
            shift += WIDTHS[k]
            more = self._bits(k, lo, hi)
            at = at[more]
            lo = self.rank(k, lo)
            hi = lo + len(at)
        return out.astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> list[int]:
    """Encode every whole text of ``docs`` (doc_id, text; null text: empty),
    append ``end_id`` to each, and write the shards below ``path`` in
    ascending doc_id order (null ids last, equal ids by text).  Returns each
    bucket's position among all ids of the corpus.  Other columns are
    ignored; repeated rows are written repeatedly; no rows, no shards."""
    ordered = sorted_buckets(*bucketed(docs.select("doc_id", "text")))
    target = arrow_schema(docs.sparkSession, SHARD_SCHEMA)

    def shard(bucket, number, start, held):
        ids = np.concatenate([x for _, x in held])
        codes = DirectCodes.encode(ids)
        return {"bucket": [bucket], "shard": [number], "start": [start], "n_tokens": [len(ids)],
                "n_docs": [len(held)], "doc_ids": [[d for d, _ in held]],
                "ends": [np.cumsum([len(x) for _, x in held]).astype("<u8").tobytes()],
                "levels": [codes.levels], "bitmaps": [codes.bitmaps],
                "directories": [[d.tobytes() for d in codes.directories]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = library_cache(tokenizer)
        held, size, bucket, number, start = [], 0, None, 0, 0
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                keys, buckets = part.column(0).to_pylist(), part.column(2).to_pylist()
                ids, bounds = cache.tokens(texts)
                for i in range(len(texts)):
                    if buckets[i] != bucket or size >= SHARD_TOKENS:
                        if held:
                            yield record_batch(shard(bucket, number, start, held), target)
                        start, number = (start + size, number + 1) if buckets[i] == bucket else (0, 0)
                        held, size, bucket = [], 0, buckets[i]
                    own = np.append(ids[bounds[i]:bounds[i + 1]], np.uint32(end_id))
                    held.append((keys[i], own.astype(np.uint32)))
                    size += len(own)
        if held:
            yield record_batch(shard(bucket, number, start, held), target)
        release()

    ordered.select("doc_id", "text", "bucket").mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").parquet(path)
    spark = docs.sparkSession
    totals = dict(spark.read.schema(SHARD_SCHEMA).parquet(path).groupBy("bucket").agg(
        F.sum("n_tokens")).collect())          # a number per bucket, of which MOST_BUCKETS bounds the count
    bases, at = [], 0
    for b in range(max(totals, default=-1) + 1):
        bases.append(at)
        at += totals.get(b, 0)
    return bases


def read_documents(spark: SparkSession, path: str, bases: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    target = arrow_schema(spark, schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = DirectCodes(row["n_tokens"], row["levels"], row["bitmaps"], row["directories"])
                ends = np.frombuffer(row["ends"], "<u8").astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                ids = codes.slice(0, codes.n).astype("<u4")
                base = bases[row["bucket"]] + row["start"]
                yield record_batch({
                    "doc_id": row["doc_ids"], "start": base + begins, "n_tokens": ends - begins,
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]}, target)

    return spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str, bucket: int, shard: int, positions: list[int]) -> list[int]:
    """Single ids of a shard by position, without decoding the others."""
    row = (spark.read.schema(SHARD_SCHEMA).parquet(path).where((F.col("bucket") == bucket) & (F.col("shard") == shard))
           .select("n_tokens", "levels", "bitmaps", "directories").first())
    codes = DirectCodes(row[0], [bytes(x) for x in row[1]], [bytes(x) for x in row[2]], [bytes(x) for x in row[3]])
    return [codes.get(i) for i in positions]
