"""Vectorised views of a batch of texts, shared by the operators of this package.

A batch is one array of code points plus the offset of every text in it; runs
of characters (words, lines, tokenizer pieces) are found by comparing class
arrays, and every run gets a 64-bit hash from one prefix sum, so the cost is a
few array passes per character and no Python loop per word.

Null texts count as empty; empty texts have no runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: characters handled per step; a longer single text forms a step of its own
STEP_CHARS = 1 << 19

_BASE = 0x9E3779B97F4A7C13          # odd, 3 modulo 8
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift-multiply rounds)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_CHARS + 1)
        made = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = made
    return _powers


def steps(texts: list, budget: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch into consecutive index ranges of at most ``budget``
    characters each (one text at least)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > lo and size + n > budget:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and each text's offset
    (one more than texts; null texts are empty)."""
    texts = [t or "" for t in texts]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cp, offsets


def is_word_char(cp: np.ndarray) -> np.ndarray:
    """Anything but a space and the control characters U+0009..U+000D."""
    return (cp != 32) & ((cp - np.uint32(9)) > np.uint32(4))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of true values that stays within
    one text."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def run_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of every run."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(cp) + 1)
    total = np.zeros(len(cp) + 1, dtype=np.uint64)
    values = (cp.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xD1342543DE82EF95)
    values ^= values >> np.uint64(29)
    values *= power[:len(cp)]
    np.cumsum(values, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix64(h)


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that each run lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    upper = (cp - np.uint32(65)) < np.uint32(26)
    return cp + upper.astype(np.uint32) * np.uint32(32)


def words(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word (maximal run of word characters)."""
    starts, ends = runs(is_word_char(cp), offsets)
    return starts, ends, run_hashes(cp, starts, ends)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets, per text, into an array of runs (one more than texts)."""
    return np.searchsorted(starts, offsets, side="left")


_GRAM_FACTORS = np.array([0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xC6A4A7935BD1E995,
                          0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], dtype=np.uint64)


def grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``n`` words that stays within a text, and the
    index of its first word.  ``bounds`` are the per-text word offsets."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        g += h[k:k + count] * _GRAM_FACTORS[k]
    inside = np.ones(count, dtype=bool)
    for k in range(1, n):
        cut = bounds[1:-1] - k
        inside[cut[(cut >= 0) & (cut < count)]] = False
    first = np.flatnonzero(inside)
    return mix64(g[first]), first
