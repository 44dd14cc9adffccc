"""Fill-in-the-middle: whole texts cut into prefix, middle and suffix at unit
boundaries, and written in one of the orders that a model learns from.

A batch's UTF-8 bytes are mapped to character classes and indexed by a wavelet
matrix.  Ranks of classes combine into the number of unit boundaries before any
byte, and the byte at which a unit begins is found by bisection on these counts;
all texts of a batch are asked at once.  Units are code points, words (each with the white space after
it; white space before the first word belongs to it) or lines (each with its
``\\n``).

Forms: ``plain`` is the text itself; ``psm`` is ``<P>prefix<S>suffix<M>middle``,
``spm`` is ``<S>suffix<P>prefix<M>middle``.  A text that holds one of the
markers stays plain, so ``restore`` gives back every text from its output and
form alone.

The draws are the first four 8-digit groups of the hex sha256 of ``salt:doc_id``
(a null doc_id: nothing after the colon).  Null and empty texts are plain and
empty; equal draws or a draw at an end give empty parts; repeated rows give
equal rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import textbatch as tb
from cohortflow.llm.common import arrow_schema, record_batch

MARKERS = ("<P>", "<S>", "<M>")
# classes: bytes within a code point, white space, line feeds, the first byte
# of a word and of every other character of one
INNER, BLANK, FEED, WORD_START, LETTER = range(5)
MARKS = {"code_point": INNER, "word": WORD_START, "line": FEED}


@dataclass(frozen=True)
class MiddleParams:
    unit: str = "code_point"
    salt: str = "1"
    plain_from: int = 90          # h3 % 100 at or above: plain
    spm_below: int = 20           # h4 % 100 below: spm


class WaveletMatrix:
    """Rank queries over a sequence of small symbols: one bit array per level,
    most significant first, each with a directory of the ones before every
    64-bit word; zeros of a level move to the front of the next."""

    def __init__(self, symbols: np.ndarray, bits: int = 3):
        self.n, self.levels = len(symbols), []
        now = np.asarray(symbols, dtype=np.uint8)
        for k in reversed(range(bits)):
            bit = (now >> k & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            zeros = self.n - int(ones[-1])
            self.levels.append((k, words, ones[:-1], zeros))
            now = np.concatenate([now[~bit], now[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & low)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before every position of ``at``."""
        lo, hi = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for k, words, before, zeros in self.levels:
            one_lo, one_hi = self._ones(words, before, lo), self._ones(words, before, hi)
            if symbol >> k & 1:
                lo, hi = zeros + one_lo, zeros + one_hi
            else:
                lo, hi = lo - one_lo, hi - one_hi
        return hi - lo


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of every byte of UTF-8 texts in a row."""
    out = np.full(len(data), LETTER, dtype=np.uint8)
    blank = (data == 0x20) | ((data - np.uint8(9)) < 5)
    before = np.ones(len(data), dtype=bool)
    before[1:] = blank[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[starts] = True
    out[before & ~blank] = WORD_START
    out[blank] = BLANK
    out[data == 0x0A] = FEED
    out[(data & 0xC0) == 0x80] = INNER
    return out


class Boundaries:
    """Unit boundaries of texts in a row, counted by ranks.  Unit 0 of a text
    begins at its first byte, and ``units`` is where the last one ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        self.unit, self.offsets = unit, offsets
        kinds = classes(data, offsets)
        self.matrix = WaveletMatrix(kinds)
        lo, hi = offsets[:-1], offsets[1:]
        self.base = self._raw(lo)
        total = self._raw(hi) - self.base
        if unit == "word":        # a text of white space alone is one unit
            total = np.where((total == 0) & (hi > lo), 1, total)
        elif unit == "line":      # what follows the last line feed is a unit too
            last = np.where(hi > lo, kinds[np.maximum(hi, 1) - 1] if len(kinds) else 0, FEED)
            total = total + (last != FEED)
        self.units = total

    def _raw(self, at: np.ndarray) -> np.ndarray:
        """Marks of units before every byte position: word starts, line feeds,
        or all bytes but those within a code point."""
        found = self.matrix.rank(MARKS[self.unit], at)
        return at - found if self.unit == "code_point" else found

    def locate(self, number: np.ndarray) -> np.ndarray:
        """The byte at which unit ``number`` of every text begins (its end for
        the number of its units): the first one with so many marks before it."""
        lo, hi = self.offsets[:-1].copy(), self.offsets[1:].copy()
        end, begin = hi.copy(), lo.copy()
        # code points and words are marked at their first byte, lines at their last
        want = number if self.unit == "line" else number + 1
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            enough = self._raw(np.minimum(mid + 1, end)) - self.base >= want
            hi = np.where((lo < hi) & enough, mid, hi)
            lo = np.where((lo < hi) & ~enough, mid + 1, lo)
        found = np.minimum(lo + 1, end) if self.unit == "line" else lo
        return np.where(number <= 0, begin, np.where(number >= self.units, end, found))


def _steps(offsets: np.ndarray, budget: int):
    """Consecutive ranges of texts of at most ``budget`` bytes (one text at least)."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        yield lo, hi
        lo = hi


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    held = column.buffers()
    offsets = np.frombuffer(held[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(held[2], np.uint8) if held[2] is not None and len(held[2]) else np.zeros(0, np.uint8)
    return data, offsets


def _write(data, offsets, cut1, cut2, form) -> pa.Array:
    """The output of every text, assembled from byte ranges."""
    raw, out = data.tobytes(), []
    p, s, m = (x.encode() for x in MARKERS)
    for lo, hi, a, b, f in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cut1.tolist(), cut2.tolist(), form):
        if f == "psm":
            out.append(b"".join((p, raw[lo:a], s, raw[b:hi], m, raw[a:b])))
        elif f == "spm":
            out.append(b"".join((s, raw[b:hi], p, raw[lo:a], m, raw[a:b])))
        else:
            out.append(raw[lo:hi])
    return pa.array(out, pa.binary()).cast(pa.string())


def transform(docs: DataFrame, params: MiddleParams = MiddleParams()) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, prefix_chars,
    middle_chars, output): every whole text of ``docs`` in its form; n counts
    units, and the lengths are null for a plain one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{params.salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring("_key", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.lit(False)
    for x in MARKERS:
        marked = marked | F.col("_text").contains(x)
    form = (F.when((F.col("_text") == "") | marked | (draw[2] % 100 >= params.plain_from), "plain")
            .when(draw[3] % 100 < params.spm_below, "spm").otherwise("psm"))
    rows = docs.select(F.col("doc_id").alias("doc_id"), text.alias("_text"), key.alias("_key")).select(
        "doc_id", draw[0].alias("h1"), draw[1].alias("h2"), form.alias("form"), F.col("_text").alias("text"))
    schema = ("doc_id long, n long, form string, prefix_units long, middle_units long, prefix_chars long, "
              "middle_chars long, output string")
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            all_bytes, all_offsets = _text_bytes(batch.column(4))
            for lo, hi in _steps(all_offsets, tb.STEP_CHARS):
                part = batch.slice(lo, hi - lo)
                begin, end = all_offsets[lo], all_offsets[hi]
                yield record_batch(_step(part, all_bytes[begin:end], all_offsets[lo:hi + 1] - begin,
                                         params.unit), target)

    return rows.mapInArrow(run, schema)


def _step(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, unit: str) -> dict:
    marks = Boundaries(data, offsets, unit)
    n = marks.units
    form = part.column(3).to_pylist()
    draws = [part.column(k).to_numpy(zero_copy_only=False) % (n + 1) for k in (1, 2)]
    u1, u2 = np.minimum(*draws), np.maximum(*draws)
    cut1, cut2 = marks.locate(u1), marks.locate(u2)
    plain = np.array([f == "plain" for f in form], dtype=bool)
    points = u1, u2
    if unit != "code_point":
        inner = (data & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(inner)])
        points = before[cut1] - before[offsets[:-1]], before[cut2] - before[offsets[:-1]]
    held = {"prefix_units": u1, "middle_units": u2 - u1,
            "prefix_chars": points[0], "middle_chars": points[1] - points[0]}
    return {"doc_id": part.column(0), "n": n, "form": part.column(3),
            **{k: pa.array(v, pa.int64(), mask=plain) for k, v in held.items()},
            "output": _write(data, offsets, cut1, cut2, form)}


def restore(done: DataFrame) -> DataFrame:
    """``done`` with a column ``text``: the text that ``output`` and ``form``
    were made from.  No part holds a marker, and none can arise where parts and
    markers meet, so the first occurrences separate the parts."""
    out, form = F.col("output"), F.col("form")
    p, s, m = MARKERS
    middle = F.substring_index(out, m, -1)
    head = F.substring_index(out, m, 1)

    def between(first: str, second: str):
        return F.substring_index(F.substring_index(head, second, 1), first, -1), F.substring_index(head, second, -1)

    prefix, suffix = between(p, s)
    late, early = between(s, p)
    return done.withColumn("text", F.when(form == "psm", F.concat(prefix, middle, suffix))
                           .when(form == "spm", F.concat(early, middle, late)).otherwise(out))


def digests(docs: DataFrame, params: MiddleParams = MiddleParams()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256) of every text."""
    return restore(transform(docs, params)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def digests_sql(table: str = "documents", params: MiddleParams = MiddleParams()) -> str:
    """``digests`` for code points as a DuckDB statement; the restored text is
    that of the table, since the forms are reversible."""
    p, s, m = MARKERS
    marked = " OR ".join(f"contains(t, '{x}')" for x in MARKERS)
    draws = ", ".join(f"('0x' || substr(k, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t,
 sha256('{params.salt}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM {table}),
drawn AS (SELECT doc_id, t, length(t) AS n, {draws} FROM texts),
cut AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR {marked} OR h3 % 100 >= {params.plain_from} THEN 'plain'
  WHEN h4 % 100 < {params.spm_below} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
  WHEN 'spm' THEN '{s}' || suffix || '{p}' || prefix || '{m}' || middle ELSE t END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM parts"""
