"""Tokenizer pieces of whole texts, and their token ids through a cache.

A text's pieces (the strings that the tokenizer merges within) are found with
array operations over a batch; each distinct piece is encoded once per worker
and then found again by its hash.  The tables follow the tokenizer file:
NFC, lower case, then contractions, letter runs, single digits and runs of
anything else but white space.  Strings of special tokens are single pieces.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from tokenizers import Tokenizer, normalizers

from cohortflow.llm import textbatch as tb

SPACE, LETTER, NUMBER, OTHER, SPECIAL, UNKNOWN = range(6)
_PLAIN = 0x300           # below: composed, no combining marks, lower case by a table
_APOSTROPHE = 0x27


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point."""
    kind = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] in "LN":
            kind[c] = LETTER if k[0] == "L" else NUMBER
        elif k == "Cn":                 # the library may know a later Unicode version
            kind[c] = UNKNOWN
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
          0x202F, 0x205F, 0x3000]] = SPACE
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(_PLAIN):
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    return kind, lower


def classify(file: TokenizerFile, c: int) -> int:
    """The class of a code point as the tokenizer's own splitter sees it."""
    cut = file.library.pre_tokenizer.pre_tokenize_str
    around = len(cut(f"a{chr(c)}a"))
    if around < 3:
        return LETTER if around == 1 else SPACE
    return NUMBER if len(cut(chr(c) * 2)) == 2 else OTHER


class TokenizerFile:
    """What the operators need of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.specials: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        # texts are normalised before they are split, so pieces are not again
        self.library = Tokenizer.from_file(path)
        self.normalizer = self.library.normalizer
        self.library.normalizer = normalizers.Sequence([])
        self.size = 1 + max([*self.vocab.values(), *self.specials.values()])
        self.names = [""] * self.size
        for name, i in [*self.vocab.items(), *self.specials.items()]:
            self.names[i] = name
        self.last = np.array([n.endswith(self.suffix) for n in self.names])
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

    def merges(self) -> list[tuple[str, str]]:
        with open(self.path, encoding="utf-8") as f:
            return [tuple(m) if not isinstance(m, str) else tuple(m.split(" "))
                    for m in json.load(f)["model"]["merges"]]


@functools.lru_cache(maxsize=2)
def tokenizer_file(path: str) -> TokenizerFile:
    return TokenizerFile(path)


def _marks(texts: list, n: int) -> list[str]:
    """``n`` code points that no text has, to stand for special tokens."""
    found, c = [], 0x10FFFF
    while len(found) < n:
        if not any(chr(c) in t for t in texts):
            found.append(chr(c))
        c -= 1
    return found


def split(texts: list, file: TokenizerFile):
    """(code points, starts, ends, hashes, per-text offsets, special ids):
    the pieces of every text in order; the special id is -1 but for a special
    token's string."""
    texts = [t or "" for t in texts]
    marks: dict[str, str] = {}
    if file.special is not None:
        held = [t for t in texts if any(s in t for s in file.specials)]
        if held:
            marks = dict(zip(file.specials, _marks(texts, len(file.specials))))
    mark_ids = {ord(m): file.specials[s] for s, m in marks.items()}

    def normal(t):
        return file.normalizer.normalize_str(t) if t else ""

    kind, lower = _tables()
    cp, offsets = tb.code_points(texts)
    rich = np.flatnonzero((cp >= _PLAIN) | (cp == 0x130))
    redo = set(np.unique(tb.owner(rich, offsets)).tolist()) if len(rich) else set()
    if marks:
        redo |= {i for i, t in enumerate(texts) if any(s in t for s in marks)}
    if redo:
        texts = list(texts)
        for i in redo:
            if marks and file.special.search(texts[i]):
                out, at = [], 0
                for m in file.special.finditer(texts[i]):
                    out += [normal(texts[i][at:m.start()]), marks[m.group()]]
                    at = m.end()
                texts[i] = "".join([*out, normal(texts[i][at:])])
            else:
                texts[i] = normal(texts[i])
        cp, offsets = tb.code_points(texts)
    cp = lower[cp]
    cls = kind[cp]
    for c in np.unique(cp[cls == UNKNOWN]).tolist():
        if c not in mark_ids:
            kind[c] = classify(file, c)
            cls[cp == c] = kind[c]
    for m in mark_ids:
        cls[cp == m] = SPECIAL
    n = len(cp)
    if n == 0:
        none = np.zeros(0, np.int64)
        return cp, none, none, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = cls[1:] != cls[:-1]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    fresh |= first[:n] | (cls == NUMBER) | (cls == SPECIAL)
    _contractions(cp, cls, fresh, first)
    bounds = np.append(np.flatnonzero(fresh), n)
    inner = cls[bounds[:-1]] != SPACE
    starts, ends = bounds[:-1][inner], bounds[1:][inner]
    h = tb.run_hashes(cp, starts, ends)
    special = np.full(len(starts), -1, dtype=np.int64)
    for m, i in mark_ids.items():
        at = (cp[starts] == m) & (cls[starts] == SPECIAL)
        special[at] = i
        h[at] = tb.mix64(np.array([i + 1], dtype=np.uint64) << np.uint64(40))[0]
    return cp, starts, ends, h, tb.per_text(starts, offsets), special


def _contractions(cp, cls, fresh, first) -> None:
    """An apostrophe that begins a run of other characters takes s, t, m, d,
    re, ve or ll after it; what follows them begins a piece of its own."""
    n = len(cp)
    at = np.flatnonzero((cp == _APOSTROPHE) & fresh & (cls == OTHER))
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    if len(at) == 0:
        return
    a = cp[at + 1]
    two = at + 2 < n
    b = np.where(two, cp[np.minimum(at + 2, n - 1)], 0)
    b[two & first[np.minimum(at + 2, n)]] = 0
    size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 2, 0)
    for x, y in ("re", "ve", "ll"):
        size[(a == ord(x)) & (b == ord(y))] = 3
    at, size = at[size > 0], size[size > 0]
    fresh[at + 1] = False
    stop = at + size
    fresh[stop[stop < n]] = True


class HashNumbers:
    """Numbers by 64-bit hash: a table with open addressing, asked and filled
    by arrays.  It holds at most half as many entries as it has slots."""

    def __init__(self, bound: int):
        slots = 1 << max(4, (2 * bound - 1).bit_length())
        self.mask = slots - 1
        self.keys = np.zeros(slots, dtype=np.uint64)
        self.numbers = np.full(slots, -1, dtype=np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(17)).astype(np.int64) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of every hash, -1 where there is none."""
        out = np.full(len(h), -1, dtype=np.int64)
        left, slot = np.arange(len(h)), self._slots(h)
        while len(left):
            number, same = self.numbers[slot], self.keys[slot] == h[left]
            hit = (number >= 0) & same
            out[left[hit]] = number[hit]
            on = (number >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def put(self, h: np.ndarray, number: np.ndarray) -> None:
        """Add distinct hashes that are not held yet."""
        slot = self._slots(h)
        while len(h):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = number[free]
            mine = free & (self.numbers[slot] == number)      # of several, one has got the slot
            self.keys[slot[mine]] = h[mine]
            h, number, slot = h[~mine], number[~mine], (slot[~mine] + 1) & self.mask


class PieceCache:
    """Token ids of pieces, for a worker's lifetime; emptied before it would
    hold more than ``bound`` pieces.  Pieces are found by hash and compared with the entry's
    own code points, so a shared hash costs time and changes no ids.

    ``encode(file, chars, sizes)`` gives (ids in a row, ids per piece) of
    pieces whose code points stand in a row."""

    def __init__(self, file: TokenizerFile, encode, bound: int = 400_000):
        self.file, self.encode, self.bound = file, encode, bound
        self._clear()

    def _clear(self) -> None:
        self.numbers = HashNumbers(self.bound)
        self.count = 0
        self.entry = np.zeros((4, 1024), dtype=np.int64)   # first id, ids, first code point, code points
        self.ids = np.zeros(4096, dtype=np.uint32)
        self.chars = np.zeros(4096, dtype=np.uint32)
        self.used = self.used_chars = 0
        self.generation = getattr(self, "generation", 0) + 1

    def _store(self, ids: np.ndarray, size: np.ndarray, chars: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Add entries; returns their numbers."""
        n = len(size)
        while self.count + n > self.entry.shape[1]:
            self.entry = np.concatenate([self.entry, np.zeros_like(self.entry)], axis=1)
        self.ids = _room(self.ids, self.used + len(ids))
        self.chars = _room(self.chars, self.used_chars + len(chars))
        at = slice(self.count, self.count + n)
        self.entry[0, at] = self.used + np.cumsum(size) - size
        self.entry[1, at] = size
        self.entry[2, at] = self.used_chars + np.cumsum(width) - width
        self.entry[3, at] = width
        self.ids[self.used:self.used + len(ids)] = ids
        self.chars[self.used_chars:self.used_chars + len(chars)] = chars
        self.used += len(ids)
        self.used_chars += len(chars)
        self.count += n
        return np.arange(self.count - n, self.count)

    def codes(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The cache's number of every piece, and per-text offsets."""
        cp, starts, ends, h, bounds, special = split(texts, self.file)
        if len(starts) == 0:
            return np.zeros(0, np.int64), bounds
        # special strings are known by their id, whatever stood for them in the text
        cp = np.append(cp, np.arange(len(self.file.specials) + 1, dtype=np.uint32) + 0x110000)
        if (special >= 0).any():
            ids = np.array(sorted(self.file.specials.values()))
            at = special >= 0
            starts, ends = starts.copy(), ends.copy()
            starts[at] = len(cp) - len(ids) - 1 + np.searchsorted(ids, special[at])
            ends[at] = starts[at] + 1
        which, rep = distinct_runs(cp, starts, ends, h)
        keys = h[rep]
        found = self.numbers.find(keys)
        if self.count + int((found < 0).sum()) > self.bound and self.count:
            self._clear()
            found[:] = -1
        old = np.flatnonzero(found >= 0)
        first, width = self.entry[2:4, found[old]]
        alien = old[~_equal(cp, starts[rep[old]], ends[rep[old]] - starts[rep[old]], self.chars, first, width)]
        new = np.concatenate([np.flatnonzero(found < 0), alien])
        if len(new):
            s, e, own = starts[rep[new]], ends[rep[new]], special[rep[new]]
            chars = gather(cp, s, e - s)
            plain = own < 0
            ids, size = self.encode(self.file, gather(cp, s[plain], (e - s)[plain]), (e - s)[plain])
            if not plain.all():
                every = np.ones(len(new), dtype=np.int64)
                every[plain] = size
                mixed = np.zeros(int(every.sum()), dtype=np.uint32)
                mixed[np.repeat(plain, every)] = ids
                mixed[np.repeat(~plain, every)] = own[~plain]
                ids, size = mixed, every
            found[new] = self._store(ids, size, chars, e - s)
            named = new[:max(0, min(len(new) - len(alien), self.bound))]
            named = named[np.unique(keys[named], return_index=True)[1]]
            self.numbers.put(keys[named], found[named])
        return found[which], bounds

    def tokens(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts in a row, and per-text offsets."""
        codes, bounds = self.codes(texts)
        at, sizes = self.entry[:2, codes]
        return gather(self.ids, at, sizes), np.concatenate([[0], np.cumsum(sizes)])[bounds]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    while len(a) < n:
        a = np.concatenate([a, np.zeros_like(a)])
    return a


def gather(blob: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``blob[at:at + size]`` in a row."""
    ends = np.cumsum(size)
    return blob[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _equal(a, a_at, a_size, b, b_at, b_size) -> np.ndarray:
    """Whether each stretch of ``a`` equals its counterpart of ``b``."""
    same = a_size == b_size
    size = a_size[same]
    if size.sum():
        differ = gather(a, a_at[same], size) != gather(b, b_at[same], size)
        bad = np.repeat(np.arange(len(size)), size)[differ]
        ok = np.ones(len(size), dtype=bool)
        ok[bad] = False
        same[same] = ok
    return same


def distinct_runs(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(number of its distinct string for every run, a run for each of them):
    runs are grouped by hash, and compared with the group's first one."""
    which, values = pd.factorize(h)
    rep = np.zeros(len(values), dtype=np.int64)
    rep[which[::-1]] = np.arange(len(which))[::-1]
    same = _equal(cp, starts, ends - starts, cp, starts[rep][which], (ends - starts)[rep][which])
    if not same.all():                  # strings that share a hash: by the strings themselves
        raw = cp.tobytes()
        names = np.array([raw[4 * s:4 * e] for s, e in zip(starts.tolist(), ends.tolist())], dtype=object)
        which, values = pd.factorize(names)
        rep = np.zeros(len(values), dtype=np.int64)
        rep[which[::-1]] = np.arange(len(which))[::-1]
    return which, rep


def names_of(chars: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The pieces as strings."""
    text = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(sizes)
    return [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def library_encode(file: TokenizerFile, chars: np.ndarray, sizes: np.ndarray, part: int = 2000
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pieces by the library: joined by spaces, cut after every
    token that ends a word."""
    out, counts, at = [], [], 0
    for lo in range(0, len(sizes), part):
        own = sizes[lo:lo + part]
        n = int(own.sum())
        wide = np.full(n + len(own), 0x20, dtype="<u4")
        inner = np.ones(len(wide), dtype=bool)
        inner[np.cumsum(own + 1) - 1] = False
        wide[inner] = chars[at:at + n]
        text = wide.tobytes().decode("utf-32-le", "surrogatepass")
        ids = np.array(file.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        ends = np.flatnonzero(file.last[ids]) + 1
        if len(ends) != len(own):       # a piece that the joined text splits otherwise
            each = [file.library.encode(x, add_special_tokens=False).ids for x in names_of(chars[at:at + n], own)]
            ids = np.array([i for x in each for i in x], dtype=np.uint32)
            ends = np.cumsum([len(x) for x in each])
        out.append(ids)
        counts.append(np.diff(ends, prepend=0))
        at += n
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(counts)


@functools.lru_cache(maxsize=2)
def library_cache(path: str) -> PieceCache:
    return PieceCache(tokenizer_file(path), library_encode)
