"""Byte-level BPE through a sentencepiece model that is written from the vocabulary.

A rank file lists byte strings; the lower the rank, the earlier a merge.  The
model is serialised here, field by field, without any training: every byte
becomes one character (``_SHIFT`` + byte), every vocabulary entry a piece of
such characters whose score is its negative rank, the normaliser is the
identity, and the unknown piece comes last, so that ids equal ranks.  Merging
the best-scored neighbours, leftmost first, is then byte-pair merging by rank.

Texts are cut into pre-tokens by the pattern of these vocabularies,
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
with array operations over a batch; which code points are letters, numbers or
white space is asked of the tiktoken library's own matcher.  A worker encodes
each distinct pre-token once, as long as a bounded cache holds it; entries are
found by hash and compared with the text itself.  Decoding maps ids back to
their bytes.

Null texts count as empty and give no tokens; rows stay rows (a repeated row is
encoded again, a null doc_id is carried); extra columns are ignored; an empty
table gives an empty result.  Long pre-tokens and texts are never cut.
"""

from __future__ import annotations

import base64
import functools
import itertools
import struct
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame

from cohortflow.llm import textbatch as tb
from cohortflow.llm.common import map_texts
from cohortflow.llm.pieces import HashNumbers, distinct_runs

_SHIFT = 0x100                    # byte b is the character _SHIFT + b
SPACE, LETTER, NUMBER, OTHER = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# ------------------------------------------------------------------ the model
def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1            # negative numbers take ten bytes
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _piece(piece: str, score: float, kind: int) -> bytes:
    body = _bytes(1, piece.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)
    return _bytes(1, body)


def mapped(data: bytes) -> str:
    """Bytes as the model's characters."""
    return "".join(map(chr, np.frombuffer(data, np.uint8).astype(np.uint32) + _SHIFT))


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of a vocabulary, serialised."""
    order = sorted(ranks, key=ranks.get)
    if [ranks[b] for b in order] != list(range(len(order))):
        raise ValueError("the ranks must be 0, 1, 2, ... without gaps")
    if len(order) > 1 << 24:
        raise ValueError("ranks beyond 2^24 are not exact as scores")
    normal, unknown, bpe = 1, 2, 2
    out = [_piece(mapped(b), -float(i), normal) for i, b in enumerate(order)]
    out.append(_piece("<unk>", 0.0, unknown))
    trainer = b"".join([_number(3, bpe), _number(4, len(order) + 1), _number(40, len(order)),
                        *(_number(f, -1) for f in (41, 42, 43))])
    normalizer = b"".join([_bytes(1, b"identity"), *(_number(f, 0) for f in (3, 4, 5))])
    return b"".join([*out, _bytes(2, trainer), _bytes(3, normalizer)])


# ------------------------------------------------------------------ pre-tokens
@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point, as the library's matcher sees it."""
    kind = np.full(0x110000, OTHER, dtype=np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    one = {bytes([i]): i for i in range(256)}
    for name, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=one, special_tokens={})
        found = bytes(probe.encode_ordinary(text)).decode()
        kind[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = name
    return kind


def pretokens(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every pre-token of the texts (``textbatch.code_points``)."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    fresh = first[:n].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    # the last white space before anything else leaves its run; a space joins what follows
    at = np.flatnonzero(fresh & (kind != SPACE) & ~first[:n])
    at = at[kind[at - 1] == SPACE]
    fresh[at - 1] = True
    fresh[at[cp[at - 1] == 0x20]] = False
    # contractions, where an apostrophe begins a pre-token
    at = np.flatnonzero((cp == 0x27) & fresh)
    at = at[~first[at + 1]]
    a = cp[at + 1]
    b = np.where(first[np.minimum(at + 2, n)], 0, cp[np.minimum(at + 2, n - 1)])
    size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 2, 0)
    for x, y in ("re", "ve", "ll"):
        size[(a == ord(x)) & (b == ord(y))] = 3
    at, size = at[size > 0], size[size > 0]
    fresh[at + 1] = False
    stop = at + size
    fresh[stop[stop < n]] = True
    return np.flatnonzero(fresh)


def gather(blob: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``blob[at:at + size]`` in a row, and their offsets."""
    ends = np.concatenate([[0], np.cumsum(size)])
    shift = np.repeat(at - ends[:-1], size)
    return blob[shift + np.arange(ends[-1])], ends


def utf8_sizes(cp: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of strings whose code points stand in a row."""
    width = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000))])
    ends = np.cumsum(sizes)
    return width[ends] - width[ends - sizes]


class Known:
    """Token ids of pre-tokens met before, found by hash and compared with
    their own code points; emptied before it would hold more than ``bound``."""

    def __init__(self, bound: int):
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.numbers = HashNumbers(self.bound)
        self.count = self.n_ids = self.n_chars = 0
        self.entry = np.zeros((4, 1024), dtype=np.int64)   # first id, ids, first code point, code points
        self.ids = np.zeros(4096, dtype=np.int32)
        self.chars = np.zeros(4096, dtype=np.uint32)

    def find(self, keys: np.ndarray, cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of every run; -1: none, -2: the hash is another string's."""
        found = self.numbers.find(keys)
        if self.count and self.count + int((found < 0).sum()) > self.bound:
            self.clear()
            found[:] = -1
        old = np.flatnonzero(found >= 0)
        at, own = self.entry[2:, found[old]]
        same = own == sizes[old]
        some = np.flatnonzero(same)
        a, ends = gather(cp, starts[old[some]], sizes[old[some]])
        differ = np.concatenate([[0], np.cumsum(a != gather(self.chars, at[some], own[some])[0])])
        same[some[differ[ends[1:]] > differ[ends[:-1]]]] = False
        found[old[~same]] = -2
        return found

    def add(self, keys, ids, size, chars, width) -> np.ndarray:
        """New entries in a row; ``keys``: hashes of the first of them, which
        are found from now on."""
        n = len(size)
        if self.count + n > self.entry.shape[1]:
            self.entry = np.concatenate([self.entry, np.zeros((4, max(n, self.entry.shape[1])), np.int64)], axis=1)
        at = slice(self.count, self.count + n)
        self.entry[0, at], self.entry[1, at] = self.n_ids + np.cumsum(size) - size, size
        self.entry[2, at], self.entry[3, at] = self.n_chars + np.cumsum(width) - width, width
        self.ids = _put(self.ids, self.n_ids, ids)
        self.chars = _put(self.chars, self.n_chars, chars)
        self.n_ids, self.n_chars, self.count = self.n_ids + len(ids), self.n_chars + len(chars), self.count + n
        made = np.arange(self.count - n, self.count)
        kept = np.sort(np.unique(keys, return_index=True)[1])[:self.bound]
        self.numbers.put(keys[kept], made[kept])
        return made


def _put(a: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    while len(a) < at + len(values):
        a = np.concatenate([a, np.zeros_like(a)])
    a[at:at + len(values)] = values
    return a


class ByteBpe:
    """Encoder and decoder of one vocabulary, for a worker's lifetime."""

    def __init__(self, ranks: dict[bytes, int], bound: int = 300_000):
        self.ranks, self.known = ranks, Known(bound)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        words = sorted(ranks, key=ranks.get)
        # a pre-token that is an entry is that entry, also where no merges lead to it
        made = self.model.encode([mapped(b) for b in words], num_threads=1)
        self.entries = {b: i for i, (b, ids) in enumerate(zip(words, made)) if ids != [i]}
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.array([len(b) for b in words], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        digits = [b"%d " % i for i in range(len(words))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_size = np.array([len(d) for d in digits], dtype=np.int64)
        self.digit_at = np.cumsum(self.digit_size) - self.digit_size

    def encode_runs(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids per pre-token) of pre-tokens whose code points
        stand in a row."""
        data = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
        text = (data.astype("<u4") + _SHIFT).tobytes().decode("utf-32-le")
        ends = np.cumsum(utf8_sizes(chars, sizes)).tolist()
        cuts = list(zip([0, *ends[:-1]], ends))
        made = self.model.encode([text[a:b] for a, b in cuts], num_threads=1)
        if self.entries:
            raw = data.tobytes()
            made = [[self.entries[raw[a:b]]] if raw[a:b] in self.entries else ids for (a, b), ids in zip(cuts, made)]
        size = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        flat = np.fromiter(itertools.chain.from_iterable(made), dtype=np.int32, count=int(size.sum()))
        return flat, size

    def ids(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and per-text offsets."""
        cp, offsets = tb.code_points(texts)
        starts = pretokens(cp, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(cp))
        h = tb.run_hashes(cp, starts, ends)
        which, rep = distinct_runs(cp, starts, ends, h)
        at, sizes, keys = starts[rep], (ends - starts)[rep], h[rep]
        found = self.known.find(keys, cp, at, sizes)
        new = np.concatenate([np.flatnonzero(found == -1), np.flatnonzero(found == -2)])
        if len(new):
            chars = gather(cp, at[new], sizes[new])[0]
            ids, n = self.encode_runs(chars, sizes[new])
            found[new] = self.known.add(keys[new[:int((found == -1).sum())]], ids, n, chars, sizes[new])
        first, size = self.known.entry[:2, found[which]]
        ids, place = gather(self.known.ids, first, size)
        return ids, place[tb.per_text(starts, offsets)]

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids in a row, and every id's offset."""
        return gather(self.blob, self.at[ids], self.size[ids])

    def decimal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every id in decimal with a space after it, and its offset."""
        return gather(self.digits, self.digit_at[ids], self.digit_size[ids])


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(read_ranks(path))


# ------------------------------------------------------------------ operators
def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    def step(batch, texts):
        ids, at = byte_bpe(path).ids(texts)
        return {"doc_id": batch.column(0),
                "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))}

    return map_texts(docs.select("doc_id", "text"), step, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data): the bytes of ids; null ids give empty data."""
    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                lists = part.column(1)
                data = []
                for k in range(len(lists)):
                    ids = lists[k].values
                    ids = np.zeros(0, np.int64) if ids is None else ids.to_numpy(zero_copy_only=False)
                    data.append(bpe.decoded(ids)[0].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text:
    digests of its decimal ids joined by a space, and of the bytes that its
    ids decode to."""
    def step(batch, texts):
        bpe = byte_bpe(path)
        ids, at = bpe.ids(texts)
        text, text_at = bpe.decimal(ids)
        data, data_at = bpe.decoded(ids)
        text, data = memoryview(text), memoryview(data)
        shown, plain = [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            shown.append(sha256(text[text_at[lo]:max(text_at[lo], text_at[hi] - 1)]).hexdigest())
            plain.append(sha256(data[data_at[lo]:data_at[hi]]).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": np.diff(at), "ids_sha256": shown, "decoded_sha256": plain}

    return map_texts(docs.select("doc_id", "text"), step,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
