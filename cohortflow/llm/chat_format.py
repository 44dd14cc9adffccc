"""Chat formatting by columnar byte assembly.

A conversation becomes, per turn, ``### <role>:\\n<text></turn>\\n``.  Within
roles and texts a backslash goes before every backslash and after the first
character of every control string (``### `` and ``</turn>``); in roles also
before a line feed.  So no control string occurs in an escaped text, and
dropping the backslash of every pair gives the text back.

A batch is assembled at once: the lengths of all headers, texts and trailers
give every segment's place by a cumulative sum, and bytes are scattered into
one preallocated buffer that becomes an Arrow column.

Turns are dealt by ranges of their order, so a long conversation is spread
over tasks.  Each task cuts it between turns into segments of bounded size;
the segments in order are the conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import textbatch as tb
from cohortflow.llm.common import arrow_schema, record_batch

HEAD, MIDDLE, TAIL = b"### ", b":\n", b"</turn>\n"
CONTROLS = (b"### ", b"</turn>")
LOSS_ROLE = "assistant"

SEGMENT_CHARS = tb.STEP_CHARS // 8    # a step's batch of records holds many segments
ROLE_KEY, TEXT_KEY = 32, 200          # characters that deal turns to ranges
SCHEMA = "conv_id long, segment long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*?):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_PAIR = re.compile(r"\\(.)", re.S)


def _joined(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the values in a row, and their offsets."""
    coded = [v.encode("utf-8", "surrogatepass") for v in values]
    at = np.zeros(len(coded) + 1, dtype=np.int64)
    np.cumsum([len(c) for c in coded], out=at[1:])
    return np.frombuffer(b"".join(coded), dtype=np.uint8), at


def _hits(data: np.ndarray, at: np.ndarray, word: bytes) -> np.ndarray:
    """Starts of ``word`` that lie within one value."""
    n = len(data) - len(word) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    same = np.ones(n, dtype=bool)
    for k, b in enumerate(word):
        same &= data[k:k + n] == b
    hit = np.flatnonzero(same)
    return hit[np.searchsorted(at, hit, side="right") == np.searchsorted(at, hit + len(word) - 1, side="right")]


def escape(values: list[str], line_feeds: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes of the values in a row, and their offsets."""
    data, at = _joined(values)
    before = np.zeros(len(data) + 1, dtype=bool)       # a backslash goes before this byte
    before[np.flatnonzero(data == 0x5C)] = True
    for word in CONTROLS:
        before[_hits(data, at, word) + 1] = True
    if line_feeds:
        before[np.flatnonzero(data == 0x0A)] = True
    moved = np.cumsum(before)
    out = np.full(len(data) + int(moved[-1] if len(moved) else 0), 0x5C, dtype=np.uint8)
    out[np.arange(len(data)) + moved[:-1]] = data
    shift = np.concatenate([[0], moved])
    return out, at + shift[at]


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text) if "\\" in text else text


def _scatter(buffer: np.ndarray, places: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
    """Copy segment i of ``data`` (``at[i]`` to ``at[i + 1]``) to ``places[i]``."""
    size = np.diff(at)
    buffer[np.repeat(places - at[:-1], size) + np.arange(at[-1])] = data[:at[-1]]


def assemble(convs: list, roles: list, texts: list) -> dict:
    """Formatted conversations of rows that are ordered by conversation and turn."""
    n = len(convs)
    first = np.array([i == 0 or convs[i] != convs[i - 1] for i in range(n)], dtype=bool)
    begins = np.flatnonzero(first)
    roles = [r or "" for r in roles]
    kinds = sorted(set(roles))
    which = np.array([kinds.index(r) for r in roles], dtype=np.int64) if len(kinds) < 50 else \
        np.searchsorted(np.array(kinds, dtype=object), np.array(roles, dtype=object))
    named, named_at = escape(kinds, line_feeds=True)
    heads = [HEAD + named[named_at[k]:named_at[k + 1]].tobytes() + MIDDLE for k in range(len(kinds))]
    head_data = np.frombuffer(b"".join(heads), dtype=np.uint8)
    head_at = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int64)
    body, body_at = escape([t or "" for t in texts])
    head_size, body_size = np.diff(head_at)[which], np.diff(body_at)
    ends = np.cumsum(head_size + body_size + len(TAIL))
    starts = ends - (head_size + body_size + len(TAIL))
    buffer = np.empty(int(ends[-1]) if n else 0, dtype=np.uint8)
    own = np.concatenate([[0], np.cumsum(head_size)]).astype(np.int64)
    buffer[np.repeat(starts - own[:-1], head_size) + np.arange(own[-1])] = head_data[
        np.repeat(head_at[which] - own[:-1], head_size) + np.arange(own[-1])]
    _scatter(buffer, starts + head_size, body, body_at)
    tail = np.frombuffer(TAIL, dtype=np.uint8)
    buffer[((ends - len(TAIL))[:, None] + np.arange(len(TAIL))).reshape(-1)] = np.tile(tail, n)
    offsets = np.append(starts[begins], ends[-1] if n else 0)
    formatted = pa.StringArray.from_buffers(
        len(begins), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buffer)) \
        if offsets[-1] < 1 << 31 else pa.LargeStringArray.from_buffers(
        len(begins), pa.py_buffer(offsets), pa.py_buffer(buffer))
    # the loss mask in code points of the conversation
    points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
    conv = np.cumsum(first) - 1
    loss = np.array([r == LOSS_ROLE for r in roles], dtype=bool)
    base = points[starts[begins]][conv]
    lo = (points[starts + head_size] - base)[loss]
    hi = (points[starts + head_size + body_size] - base)[loss]
    cut = np.concatenate([[0], np.cumsum(np.bincount(conv[loss], minlength=len(begins)))]).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int64))) for x in (lo, hi)]
    return {"conv_id": [convs[i] for i in begins], "n_turns": np.diff(np.append(begins, n)),
            "formatted": formatted, "loss_starts": spans[0], "loss_ends": spans[1]}


def _in_ranges(turns: DataFrame) -> DataFrame:
    """Turns dealt by ranges of (conv_id, turn, role, text).  Only the first
    characters of roles and texts are compared, so bounds stay small; where
    these are the whole, equal rows are told apart by a number of their own."""
    long_role = F.coalesce(F.length("role") > ROLE_KEY, F.lit(False))
    longer = long_role | F.coalesce(F.length("text") > TEXT_KEY, F.lit(False))
    return (turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("own"))
            .repartitionByRange("conv_id", F.col("turn").asc_nulls_last(), F.substring("role", 1, ROLE_KEY), long_role,
                                F.when(~long_role, F.substring("text", 1, TEXT_KEY)), longer, F.when(~longer, F.col("own"))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns, formatted, loss_starts, loss_ends (the
    assistant texts' code points within ``formatted``, escapes included), a
    row for every segment: a conversation is its segments in ascending order.

    ``turns`` has conv_id, turn, role, text; other columns are ignored.  Turns
    come in ascending order, null turns last, equal turns by role and text,
    so repeated rows stay.  Null roles and texts are empty; rows without a
    conv_id form one conversation; no rows give none.  A segment ends with
    the turn that fills a step, or with the conversation or its range."""
    target = arrow_schema(turns.sparkSession, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, segment = [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.append(row)
                size += len(row[1] or "") + len(row[2] or "")
                if size > SEGMENT_CHARS:
                    yield whole(held, segment)
                    held, size, segment = [], 0, segment + 1
        if held:
            yield whole(held, segment)

    def whole(rows, segment):
        out = assemble(*zip(*rows))
        return record_batch(out | {"segment": [segment] * len(out["conv_id"])}, target)

    return (_in_ranges(turns).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_last(), "role", "text")
        .select("conv_id", "role", "text").mapInArrow(run, SCHEMA))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


class _Digests:
    """What is read back of a conversation, a segment at a time."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = sha256(), sha256()

    def add(self, text: str, starts: list[int], ends: list[int]) -> None:
        for role, said in parse(text):
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for a, b in zip(starts, ends):
            said = unescape(text[a:b])
            self.loss.update(said.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, from the segments of formatted conversations alone.  The
    segments of a conversation are read one after the other, none is kept."""
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
    target = arrow_schema(formatted.sparkSession, schema)

    def rows_of(done: list[_Digests]) -> pa.RecordBatch:
        cols = zip(*(d.row() for d in done))
        return record_batch(dict(zip(target.names, map(list, cols))), target)

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                conv_id, text, starts, ends = (batch.column(k)[i].as_py() for k in range(4))
                if now is None or now.conv_id != conv_id:
                    done += [now] if now else []
                    now = _Digests(conv_id)
                now.add(text, starts, ends)
            if done:
                yield rows_of(done)
        if now:
            yield rows_of([now])

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
            .select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema))
