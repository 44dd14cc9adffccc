"""Packing documents into sequences by their length histogram.

Documents are cut into full sequences and one rest; the rests' histogram (at
most ``size`` numbers, whatever the corpus) is packed on the driver: lengths
longest first, each into the pack with the most room, a count of equal packs
at a time.  Every place in a pack then stands for a range of ranks among the
pieces of its length.  A task numbers the pieces of each length as it cuts
them; with the pieces that earlier tasks cut of that length (counts by length
and task, added up) this is a piece's rank, so no pieces are sorted.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import arrow_schema, record_batch, release, text_slices
from cohortflow.llm.pieces import library_cache
from cohortflow.sources.cube_store import materialize

SIZE = 4096
END_ID = 2


@dataclass
class Packs:
    """``count`` equal packs of pieces of these lengths."""

    count: int
    lengths: tuple[int, ...]


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[Packs]:
    """Packs for so many pieces of each length.  Longest first, a length goes
    to the packs with the most room left; where fewer pieces than packs are
    left, the packs are split into those with and those without it.  Where no
    pack has room, new ones are filled with the length."""
    room: dict[int, list[Packs]] = {}
    largest: list[int] = []                 # heap of negated rooms

    def put(p: Packs) -> None:
        r = size - sum(p.lengths)
        if not room.get(r):
            room[r] = []
            heapq.heappush(largest, -r)
        room[r].append(p)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown: list[Packs] = []
        while left:
            while largest and not room.get(-largest[0]):
                heapq.heappop(largest)
            if not largest or -largest[0] < length:
                # nothing has room: new packs take as many pieces of this length as fit
                fit = size // length
                if left >= fit:
                    put(Packs(left // fit, (length,) * fit))
                if left % fit:
                    put(Packs(1, (length,) * (left % fit)))
                left = 0
                break
            p = room[-largest[0]].pop()
            n = min(left, p.count)
            if n < p.count:
                put(Packs(p.count - n, p.lengths))
            grown.append(Packs(n, p.lengths + (length,)))
            left -= n
            if not largest or not room.get(-largest[0]):
                for g in grown:
                    put(g)
                grown = []
        for g in grown:
            put(g)
    return [p for ps in room.values() for p in ps if p.count]


@dataclass
class Places:
    """Ranges of ranks, sorted by (length, first rank)."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, packs: list[Packs]) -> Places:
        rows, taken, base = [], {}, 0
        for p in sorted(packs, key=lambda p: (-sum(p.lengths), p.lengths)):
            at = 0
            for length in p.lengths:
                rank = taken.get(length, 0)
                rows.append((length, rank, base, at))
                taken[length] = rank + p.count
                at += length
            base += p.count
        rows.sort()
        cols = np.array(rows, dtype=np.int64).reshape(-1, 4).T
        return cls(*cols)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length << 48 | self.rank, length << 48 | rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID,
                  with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document's ids,
    ``end_id`` after them, in pieces of ``size`` and a rest; with the task
    that cut it (``part``) and how many of that length the task had cut
    before (``own``); with ``ids`` if asked for."""
    schema = f"{PIECE}, part int, own long" + (", ids array<int>" if with_ids else "")
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        cut = np.zeros(size + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for rows, texts in text_slices(batch, 1):
                ids, bounds = library_cache(tokenizer).tokens(texts)
                yield record_batch(_pieces(rows.column(0), ids, bounds, size, end_id, cut, part), target)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _pieces(keys, ids, bounds, size: int, end_id: int, cut: np.ndarray, part: int) -> dict:
    tokens = np.diff(bounds) + 1
    ends = np.cumsum(tokens)
    every = np.full(int(ends[-1]) if len(ends) else 0, end_id, dtype="<u4")
    inner = np.ones(len(every), dtype=bool)
    inner[ends - 1] = False
    every[inner] = ids
    n = -(-tokens // size)
    of = np.repeat(np.arange(len(tokens)), n)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * size
    length = np.minimum(size, tokens[of] - start)
    at = (ends - tokens)[of] + start
    raw = memoryview(every.tobytes())
    crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
    # pieces of equal length, numbered in their order
    by = np.argsort(length, kind="stable")
    first = np.searchsorted(length[by], length)
    own = np.empty(len(of), dtype=np.int64)
    own[by] = np.arange(len(of)) - first[by]
    own += cut[length]
    cut += np.bincount(length, minlength=size + 1)
    return {"doc_id": keys.take(pa.array(of)), "start": start, "length": length, "ids_crc32": crc,
            "doc_tokens": tokens[of], "part": np.full(len(of), part, dtype=np.int32), "own": own,
            "ids": pa.ListArray.from_arrays(pa.array(np.append(at, len(every)), pa.int32()),
                                            pa.array(every.view("<i4")))}


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` its ids (the sequence's tokens
    from that offset on).  ``docs`` has doc_id and text (null: empty, packed
    as its end id alone); other columns are ignored, repeated rows are packed
    repeatedly, null doc_ids like any other, and no rows give no pieces."""
    pieces = materialize(cut_documents(docs, tokenizer, size, with_ids=with_ids), "pieces")
    per_part = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in per_part.groupBy("length").agg(F.sum("n")).collect()}
    places = Places.of(shortest_pack_first(histogram, size))
    # a row per length and task: the window never holds pieces
    earlier = per_part.select("length", "part", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    own = [c.split()[0] for c in PIECE.split(", ")] + (["ids"] if with_ids else [])
    ranked = pieces.join(earlier, ["length", "part"]).select(
        *own, (F.col("before") + F.col("own")).alias("rank"))
    schema = f"{PIECE}, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            length = cols["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = places.find(length, cols["rank"].to_numpy(zero_copy_only=False).astype(np.int64))
            yield record_batch(cols | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}, target)

    return ranked.mapInArrow(run, schema)
